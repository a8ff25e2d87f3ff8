"""From mentions to ranked works: one latest opinion of each reader, scores, tags.

A mention has book_id, author, thread_id, comment_id, created_at (epoch s),
recommendation_strength and sentiment. Groups are only ever summed up by
aggregates that combine before the shuffle, so a book or reader with a large
share of all mentions does not meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.classify import is_positive

FORMULA_VERSION = 2
HALF_LIFE_DAYS, NEGATIVE_WEIGHT, ANONYMOUS_WEIGHT = 365, 0.5, 0.25
DAY = 86400


def named(author: str = "author") -> Column:
    return F.col(author).isNotNull() & (F.col(author) != "")


def opinionated(mentions: DataFrame) -> DataFrame:
    """Mentions for or against, with their reader: a name, or all nameless ones of a book together."""
    out = mentions.where(is_positive() | (F.col("sentiment") < 0))
    return out.withColumns({"anonymous": ~named(), "reader": F.when(named(), F.col("author")).otherwise("")})


def latest_opinions(mentions: DataFrame) -> DataFrame:
    """book_id, reader, anonymous, conflict and the fields of each reader's latest opinion on a book.

    Of several at the latest time the strongest counts, then the most positive,
    the smaller thread and the smaller comment; if they are both for and
    against, the reader is in conflict. All of it comes from one aggregate.
    """
    rows = opinionated(mentions)
    pick = F.struct("created_at", "recommendation_strength", "sentiment", (-F.col("thread_id")).alias("t"), (-F.col("comment_id")).alias("c"))
    good = is_positive().cast("int")
    best = rows.groupBy("book_id", "anonymous", "reader").agg(
        F.max(pick).alias("p"),
        F.max(F.struct("created_at", good.alias("g"))).alias("most"),
        F.max(F.struct("created_at", (-good).alias("g"))).alias("least"),
    )
    return best.select(
        "book_id", "anonymous", "reader", (F.col("most.g") != -F.col("least.g")).alias("conflict"),
        F.col("p.created_at").alias("created_at"), F.col("p.recommendation_strength").alias("recommendation_strength"), F.col("p.sentiment").alias("sentiment"),
        (-F.col("p.t")).alias("thread_id"), (-F.col("p.c")).alias("comment_id"),
    )


def scores(mentions: DataFrame, as_of: int) -> DataFrame:
    """A row for each book that is mentioned: counts, both scores and what they are made of, as of an epoch second."""
    win = latest_opinions(mentions)
    up, ok = is_positive(), ~F.col("conflict")
    weight = F.when(F.col("anonymous"), ANONYMOUS_WEIGHT).otherwise(1.0)
    decay = F.pow(F.lit(0.5), F.greatest(F.lit(0), F.lit(as_of) - F.col("created_at")) / DAY / HALF_LIFE_DAYS)
    gain, loss = weight * F.col("recommendation_strength"), weight * NEGATIVE_WEIGHT
    total = lambda cond, value: F.coalesce(F.sum(F.when(ok & cond, value)), F.lit(0.0))
    unique = lambda cond, value: F.countDistinct(F.when(ok & cond, value))
    won = win.groupBy("book_id").agg(
        total(up, gain).alias("positive_weight"),
        total(~up, loss).alias("negative_weight"),
        total(up, gain * decay).alias("recent_positive"),
        total(~up, loss * decay).alias("recent_negative"),
        total(up, weight).alias("voters"),
        F.count(F.when(ok & up, 1)).alias("independent_contexts"),
        F.count(F.when(ok & F.col("anonymous"), 1)).alias("anonymous_opinions"),
        F.count(F.when(ok & up & ~F.col("anonymous"), 1)).alias("positive_users"),
        F.count(F.when(ok & ~up & ~F.col("anonymous"), 1)).alias("negative_users"),
        F.count(F.when(F.col("conflict"), 1)).alias("conflicting_readers"),
        unique(up, F.col("thread_id")).alias("positive_threads"),
        unique(up, F.floor(F.col("created_at") / DAY)).alias("positive_dates"),
    )
    every = mentions.where("book_id is not null").groupBy("book_id").agg(
        F.count("*").alias("mention_count"), F.count(F.when(is_positive(), 1)).alias("recommendation_count"), F.countDistinct("thread_id").alias("thread_count")
    )
    return rated(every.join(won, "book_id", "left").na.fill(0))


def rated(sums: DataFrame) -> DataFrame:
    """The scores of books from their sums and counts."""
    breadth = lambda c, rate, most: F.least(rate * F.log1p(F.greatest(F.lit(0), F.col(c) - 1)), F.lit(most))
    out = sums.withColumn("net_support", F.greatest(F.lit(0.0), F.col("positive_weight") - F.col("negative_weight")))
    out = out.withColumn("support_multiplier", F.col("voters") / (F.col("voters") + 2))
    out = out.withColumn("diversity_multiplier", 1 + breadth("positive_threads", 0.1, 0.15) + breadth("positive_dates", 0.05, 0.1))
    times = F.col("support_multiplier") * F.col("diversity_multiplier")
    four = lambda x: F.round(F.round(x, 9), 4)  # noqa: E731  the order of additions doesn't show
    six = lambda c: F.round(F.round(c, 9), 6)
    recent = F.greatest(F.lit(0.0), F.col("recent_positive") - F.col("recent_negative"))
    return out.select(
        "book_id", "mention_count", "recommendation_count", F.col("positive_users").alias("independent_recommenders"), "thread_count",
        four(F.col("net_support") * times).alias("all_time_score"), four(recent * times).alias("recent_score"),
        "independent_contexts", "positive_users", "negative_users", "positive_threads", "positive_dates", "conflicting_readers", "anonymous_opinions",
        six("positive_weight").alias("positive_weight"), six("negative_weight").alias("negative_weight"), six("net_support").alias("net_support"),
        six("support_multiplier").alias("support_multiplier"), six("diversity_multiplier").alias("diversity_multiplier"),
        F.lit(FORMULA_VERSION).alias("formula_version"),
    )


SCORE_COLUMNS = ["mention_count", "recommendation_count", "independent_recommenders", "thread_count", "all_time_score", "recent_score"]


def score_books(books: DataFrame, mentions: DataFrame, as_of: int) -> DataFrame:
    """All books with their scores, 0 for those without mentions."""
    s = scores(mentions, as_of).select(F.col("book_id").alias("id"), *SCORE_COLUMNS)
    return books.drop(*SCORE_COLUMNS).join(s, "id", "left").na.fill(0, SCORE_COLUMNS)


def stale(books: DataFrame, details: str = "score_details") -> DataFrame:
    """Books whose score is of another version of the formula (details: JSON text)."""
    version = F.coalesce(F.get_json_object(details, "$.formula_version").cast("int"), F.lit(0))
    return books.where(version != FORMULA_VERSION)


def book_tags(mentions: DataFrame, mention_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """book_id, name, mention_count, confidence of each tag of each book."""
    per = mention_tags.join(mentions.select(F.col("id").alias("mention_id"), "book_id"), "mention_id").where("book_id is not null")
    per = per.groupBy("book_id", "tag_id").agg(F.count("*").alias("mention_count"), F.avg("confidence").alias("confidence"))
    return per.join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id").select("book_id", "name", "mention_count", "confidence")


#: Sort of the shelf: two columns, both descending; ties by title (A-Z without case), then id.
ORDERS = {
    "all-time": ("all_time_score", "independent_recommenders"),
    "recent": ("recent_score", "independent_recommenders"),
    "mentions": ("mention_count", "all_time_score"),
    "recommendations": ("independent_recommenders", "all_time_score"),
}


def no_case(title: str) -> Column:
    return F.translate(title, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(page_rows: DataFrame, sort: str = "all-time", page: int = 1, page_size: int = 12) -> DataFrame:
    """A shelf() page with each book's rank on the whole shelf: numbered within the page, which has page_size rows at most."""
    a, b = ORDERS[sort]
    place = Window.orderBy(F.desc(a), F.desc(b), no_case("canonical_title"), "id")
    return page_rows.withColumn("rank", F.row_number().over(place) + F.lit((page - 1) * page_size))


def shelf(books: DataFrame, sort: str = "all-time", page: int = 1, page_size: int = 12) -> DataFrame:
    """One page of the books that are mentioned. Top-k per task, then of those: no full sort."""
    if not (1 <= page_size <= 100 and page >= 1):
        raise ValueError("page from 1, page_size from 1 to 100")
    a, b = ORDERS[sort]
    rows = books.where("mention_count > 0").orderBy(F.desc(a), F.desc(b), no_case("canonical_title"), "id")
    return rows.offset((page - 1) * page_size).limit(page_size)
