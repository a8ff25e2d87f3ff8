"""Ranking from kept state: batches of mentions are merged, only changed books are counted again, and scores serve any date.

What is kept can be merged: each reader's latest opinion on a book is a maximum,
numbers of mentions are sums, different threads are bitmaps that are or-ed. From
the opinions of a book come its sums by month, undecayed and decayed forward
from a fixed landmark: 2 ** ((t - landmark) / half life), so a score at any date
is one factor away, and no opinion is read for it. Opinions later than the date
count undecayed, so months after it give their plain sums, and of the month that
the date lies in the opinions themselves are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.classify import is_positive
from quillmark.operators.ranking import ANONYMOUS_WEIGHT, DAY, HALF_LIFE_DAYS, NEGATIVE_WEIGHT, opinionated, rated

#: Where forward decay starts; any date does, one near the mentions keeps the sums small.
LANDMARK = 1_577_836_800  # 2020-01-01, in UTC
READER = ("book_id", "anonymous", "reader")
SAID = ("created_at", "recommendation_strength", "sentiment", "thread_id", "comment_id")


@dataclass
class State:
    """What is kept of mentions."""

    opinions: DataFrame  # READER, what SAID names of the latest opinion, and the largest most and least
    counts: DataFrame  # book_id, mention_count, recommendation_count
    threads: DataFrame  # book_id, bucket, bits: bitmaps of the threads that mention a book

    def of_books(self, books: DataFrame) -> State:
        """The state of some books (book_id)."""
        return State(*(df.join(books, "book_id", "left_semi") for df in (self.opinions, self.counts, self.threads)))


def bitmap(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """by, bucket, bits: exact bitmaps of the different values (whole numbers), a row and a number for each 64 of them, so few values take few bytes."""
    v = F.col(value).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(v, F.lit(64)).cast("int"))
    return rows.where(v.isNotNull()).groupBy(*by, F.shiftright(v, 6).alias("bucket")).agg(F.bit_or(bit).alias("bits"))


def ored(bitmaps: DataFrame, *by: str) -> DataFrame:
    return bitmaps.groupBy(*by, "bucket").agg(F.bit_or("bits").alias("bits"))


def counted(bitmaps: DataFrame, name: str, *by: str) -> DataFrame:
    return bitmaps.groupBy(*by).agg(F.sum(F.bit_count("bits").cast("long")).alias(name))


def latest(rows: DataFrame) -> DataFrame:
    """Of rows with READER, SAID, most and least each reader's latest opinion; plain columns, of which a reader takes those that it needs."""
    pick = F.struct(*SAID[:3], (-F.col("thread_id")).alias("t"), (-F.col("comment_id")).alias("c"))
    best = rows.groupBy(*READER).agg(F.max(pick).alias("p"), F.max("most").alias("most"), F.max("least").alias("least"))
    return best.select(*READER, *[f"p.{c}" for c in SAID[:3]], (-F.col("p.t")).alias("thread_id"), (-F.col("p.c")).alias("comment_id"), "most", "least")


def gathered(mentions: DataFrame) -> State:
    """The state of one batch. Thread ids are dense numbers where bitmaps are to be small."""
    good, twice = is_positive().cast("int"), F.col("created_at").cast("long") * 2
    # odd if an opinion at the latest time is for the book (most) or against it (least)
    opinions = latest(opinionated(mentions).withColumns({"most": twice + good, "least": twice + 1 - good}))
    booked = mentions.where("book_id is not null")
    counts = booked.groupBy("book_id").agg(F.count("*").alias("mention_count"), F.count_if(is_positive()).alias("recommendation_count"))
    return State(opinions, counts, bitmap(booked, "thread_id", "book_id"))


def merged(a: State, b: State) -> State:
    """The state of the mentions of both."""
    counts = a.counts.unionByName(b.counts).groupBy("book_id").agg(F.sum("mention_count").alias("mention_count"), F.sum("recommendation_count").alias("recommendation_count"))
    return State(latest(a.opinions.unionByName(b.opinions)), counts, ored(a.threads.unionByName(b.threads), "book_id"))


def weighed(state: State) -> DataFrame:
    """book_id, month (a number), created_at, thread_id, anonymous, conflict, up, weight, gain of each reader's opinion."""
    o = state.opinions.withColumn("conflict", (F.col("most").bitwiseAND(1) == 1) & (F.col("least").bitwiseAND(1) == 1))
    weight = F.when(F.col("anonymous"), ANONYMOUS_WEIGHT).otherwise(1.0)
    up = is_positive()
    gain = F.when(up, weight * F.col("recommendation_strength")).otherwise(weight * NEGATIVE_WEIGHT)
    return o.select("book_id", month_of("created_at").alias("month"), "created_at", "thread_id", "anonymous", "conflict", up.alias("up"), weight.alias("weight"), gain.alias("gain"))


def month_of(second: str | Column) -> Column:
    """Months since the epoch, in UTC."""
    day = F.date_from_unix_date(F.floor((F.col(second) if isinstance(second, str) else second) / DAY).cast("int"))
    return ((F.year(day) - 1970) * 12 + F.month(day) - 1).cast("int")


def decay(seconds: Column) -> Column:
    return F.pow(F.lit(0.5), seconds / DAY / HALF_LIFE_DAYS)


@dataclass
class Board:
    """What scores at any date are read from."""

    standing: DataFrame  # book_id, and what doesn't depend on the date
    months: DataFrame  # book_id, month, up, plain, forward
    opinions: DataFrame  # weighed(), of which the date's month is read


def board(state: State) -> Board:
    """Sums and counts of the books of a state; none of its aggregates expands rows."""
    w = weighed(state)
    ok = w.where(~F.col("conflict"))
    up, named = F.col("up"), ~F.col("anonymous")
    sums = w.groupBy("book_id").agg(
        F.coalesce(F.sum(F.when(~F.col("conflict") & up, F.col("gain"))), F.lit(0.0)).alias("positive_weight"),
        F.coalesce(F.sum(F.when(~F.col("conflict") & ~up, F.col("gain"))), F.lit(0.0)).alias("negative_weight"),
        F.coalesce(F.sum(F.when(~F.col("conflict") & up, F.col("weight"))), F.lit(0.0)).alias("voters"),
        F.count_if(~F.col("conflict") & up).alias("independent_contexts"),
        F.count_if(~F.col("conflict") & F.col("anonymous")).alias("anonymous_opinions"),
        F.count_if(~F.col("conflict") & up & named).alias("positive_users"),
        F.count_if(~F.col("conflict") & ~up & named).alias("negative_users"),
        F.count_if("conflict").alias("conflicting_readers"),
    )
    for name, value in (("positive_threads", F.col("thread_id")), ("positive_dates", F.floor(F.col("created_at") / DAY))):
        found = bitmap(ok.where("up").select("book_id", value.alias("v")), "v", "book_id")
        sums = sums.join(counted(found, name, "book_id"), "book_id", "left")
    standing = state.counts.join(counted(state.threads, "thread_count", "book_id"), "book_id", "left").join(sums, "book_id", "left").na.fill(0)
    forward = F.col("gain") / decay(F.col("created_at") - LANDMARK)
    months = ok.groupBy("book_id", "month", "up").agg(F.sum("gain").alias("plain"), F.sum(forward).alias("forward"))
    return Board(standing, months, w)


def scores_at(kept: Board, as_of: int) -> DataFrame:
    """ranking.scores() at an epoch second, from kept sums and the opinions of that month."""
    now = F.lit(as_of)
    month = month_of(now)
    sums = kept.months.where(F.col("month") != month)
    value = F.when(F.col("month") < month, F.col("forward") * decay(now - LANDMARK)).otherwise(F.col("plain"))
    exact = kept.opinions.where((F.col("month") == month) & ~F.col("conflict"))
    near = exact.select("book_id", "up", (F.col("gain") * decay(F.greatest(F.lit(0), now - F.col("created_at")))).alias("value"))
    recent = sums.select("book_id", "up", value.alias("value")).unionByName(near).groupBy("book_id").agg(
        F.coalesce(F.sum(F.when(F.col("up"), F.col("value"))), F.lit(0.0)).alias("recent_positive"), F.coalesce(F.sum(F.when(~F.col("up"), F.col("value"))), F.lit(0.0)).alias("recent_negative")
    )
    return rated(kept.standing.join(recent, "book_id", "left").na.fill(0))


def updated(old: Board, state: State, changed: DataFrame) -> Board:
    """The board after a batch: books of `changed` (book_id) are counted from the state, the others stay as they are."""
    new = board(state.of_books(changed))
    keep = lambda a, b: a.join(changed, "book_id", "left_anti").select(*b.columns).unionByName(b)
    return Board(keep(old.standing, new.standing), keep(old.months, new.months), keep(old.opinions, new.opinions))
