"""Importance resampling towards a target's word distribution: hashed features, a table of gains, random keys, one exact cutoff.

Features fall into a fixed number of buckets, so what both corpora say of them
is one array of that length, which is broadcast. The cutoff is found without
sorting all rows: a quantile sketch gives a bracket of scores around it, exact
counts of the rows above and inside say whether the cutoff lies in it (if not,
the bracket is widened), and only the rows inside are sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import Workspace, numbered, table
from quillmark.llm.text import LONG, LOWER, chunks, row_of

BUCKETS, MOST_WORDS, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, "2024"
#: Values a level of the sketch keeps, groups whose sketches are merged, and the bracket's first half width as a share of the rows.
SKETCH, SKETCHES, MARGIN = 2048, 64, 0.005

IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[65:91] = IN_WORD[97:123] = IN_WORD[128:] = True


def crc_table() -> np.ndarray:
    """The remainders of all bytes by the reflected polynomial of crc32."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


CRC = crc_table()


def crc_on(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The inner states of crc32 after the bytes from starts to ends, all words at once, byte by byte."""
    out, size = state.copy(), ends - starts
    for i in np.flatnonzero(size > LONG):
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    left, k = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(left):
        now = out[left]
        out[left] = CRC[(now ^ data[starts[left] + k]) & np.uint32(255)] ^ (now >> np.uint32(8))
        k += 1
        left = left[size[left] > k]
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (ASCII letters and digits, and all beyond ASCII) of a chunk, and each row's offsets into them."""
    inside = IN_WORD[data]
    new, last = inside.copy(), inside.copy()
    new[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = np.flatnonzero(np.diff(offsets))
    new[offsets[:-1][full]] = inside[offsets[:-1][full]]
    last[offsets[1:][full] - 1] = inside[offsets[1:][full] - 1]
    starts = np.flatnonzero(new)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def features(data: np.ndarray, offsets: np.ndarray, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of every run of 1 to `most` words, and how many words each row has."""
    starts, ends, by_row = words(data, offsets)
    data = LOWER[data]
    rows = row_of(by_row)
    state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    out_rows, out_buckets = [], []
    for n in range(1, most + 1):
        if n > 1:  # runs that end in the same text go on by a space and the next word
            alive = rows[: len(rows) - n + 1] == rows[n - 1 :] if len(rows) >= n else np.zeros(0, bool)
            state = state[: len(alive)]
            state = CRC[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8))
        else:
            alive = np.ones(len(rows), bool)
        state = crc_on(state, data, starts[n - 1 :], ends[n - 1 :])
        out_rows.append(rows[: len(alive)][alive])
        out_buckets.append((~state[alive]).astype(np.int64) % buckets)
    return np.concatenate(out_rows), np.concatenate(out_buckets), np.diff(by_row)


def counted(docs: DataFrame, most: int, buckets: int) -> np.ndarray:
    """How many features of the texts lie in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, offsets in chunks(batch.column(0)):
                total += np.bincount(features(data, offsets, most, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of how much likelier each bucket is in the target, both smoothed by one."""
    s, t, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log(float((b + 1) * (s + n)) / float((a + 1) * (t + n)))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, most: int, carry: tuple[str, ...]) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row, and the columns to carry."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for first, data, offsets in chunks(batch.column(0)):
                rows, buckets, n_words = features(data, offsets, most, len(own))
                n = np.bincount(rows, minlength=len(n_words))
                order = np.argsort(rows, kind="stable") if most > 1 else slice(None)
                sums = np.r_[0, np.cumsum(own[buckets[order]])][np.r_[0, np.cumsum(n)]]
                weight = np.diff(sums) // np.maximum(n, 1)
                kept = [c.slice(first, len(n)) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, (n_words, n, weight))], [*batch.schema.names[1:], "n_words", "n_features", "weight"])

    rows = docs.select("text", "doc_id", *carry)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{kinds}, n_words long, n_features long, weight long")


def noise(seed: str) -> Column:
    """A Gumbel variable in thousandths, from a hash of the seed and the doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def sketched(rows: DataFrame, k: int = SKETCH) -> DataFrame:
    """One row: a quantile sketch of the scores, merged from those of SKETCHES groups of partitions."""
    some = rows.groupBy((F.spark_partition_id() % SKETCHES).alias("g")).agg(F.kll_sketch_agg_bigint("score", F.lit(k)).alias("s"))
    return some.agg(F.kll_merge_agg_bigint("s", F.lit(k)).alias("sketch"))


def bracketed(rows: DataFrame, rank: int, total: int, margin: float = MARGIN, sketch: int = SKETCH) -> tuple[Column, Column, int]:
    """Which rows lie above a bracket of scores and which inside, and how many above; the rank-th highest lies inside.

    A side that has no rows beyond it is open. Exact counts decide; if the
    sketch was wrong, the bracket is widened.
    """
    own = rows.sparkSession.createDataFrame([(bytes(sketched(rows, sketch).first().sketch),)], "sketch binary")
    share = 1 - rank / total
    while True:
        low, high = share - margin, share + margin
        at = own.select(*[F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(min(max(q, 0.0), 1.0)))).alias(n) for n, q in (("low", low), ("high", high))]).first()
        above = F.col("score") > at.high if high < 1 else F.lit(False)
        inside = ~above & (F.col("score") >= at.low if low > 0 else F.lit(True))
        n_above, n_inside = rows.agg(F.count_if(above), F.count_if(inside)).first()
        if n_above < rank <= n_above + n_inside:
            return above, inside, n_above
        margin *= 4


def ranked(scored: DataFrame, ws: Workspace, *, percent: int = PERCENT, least_words: int = LEAST_WORDS, margin: float = MARGIN, sketch: int = SKETCH) -> DataFrame:
    """scored (doc_id, n_words, score, ...) with rank: 1, 2, 3, ... for the rows drawn, null for the others."""
    usable = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    rows = scored.where(usable)
    total = rows.count()
    rank = percent * total // 100
    nobody = F.lit(None).cast("long").alias("rank")
    if not rank:
        return scored.select("*", nobody)
    above, inside, n_above = bracketed(rows, rank, total, margin, sketch)
    within = numbered(ws, rows.where(inside).select((-F.col("score")).alias("down"), "doc_id"), ["down", "doc_id"], "place")
    last = within.where(F.col("place") == rank - n_above - 1).first()
    # structs compare null as least, as the order does; rows alike in score and doc_id may lie beyond the rank
    key = F.struct((-F.col("score")).alias("down"), F.col("doc_id"))
    end = F.struct(F.lit(last.down).cast("long").alias("down"), F.lit(last.doc_id).cast(scored.schema["doc_id"].dataType).alias("doc_id"))
    drawn = usable & (above | (inside & (key <= end)))
    tie = [c for c in scored.columns if c not in ("doc_id", "score")]
    order = numbered(ws, scored.where(drawn).withColumn("down", -F.col("score")), ["down", "doc_id", *tie], "place")
    taken = order.select(*scored.columns, F.when(F.col("place") < rank, F.col("place") + 1).alias("rank"))
    return taken.unionByName(scored.where(~drawn).select("*", nobody))


def resample(docs: DataFrame, target: DataFrame, ws: Workspace, *, buckets: int = BUCKETS, most: int = MOST_WORDS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of docs, and the columns to carry.

    A row's weight is the floored mean of its features' gains, its score adds a
    Gumbel variable, so that the highest scores are a draw without replacement
    by weight: `percent` of the rows with at least `least_words` words. Ties go
    to the smaller doc_id; a null doc_id is the least, with the hash of an empty
    one. Rows alike in doc_id are rows of their own; of rows alike in every
    column any may get the last rank. Null text has no words: weight 0. Very
    long texts are read whole. Only doc_id, text and `carry` are read of docs,
    so other columns may have any name. Empty tables give empty ones; an empty
    target leaves the buckets' smoothing only.
    """
    own, other = counted(docs, most, buckets), counted(target, most, buckets)
    rows = weighed(docs, gains(own, other), most, carry)
    scored = ws.save(rows.withColumn("score", F.col("weight") + noise(seed)), "scored")
    return ranked(scored, ws, percent=percent, least_words=least_words)


def resampled(docs: DataFrame, target: DataFrame, ws: Workspace, **options) -> DataFrame:
    """The rows of docs that are drawn, with their columns, whatever their names."""
    rows = ws.save(docs.select(F.monotonically_increasing_id().alias("q_row"), F.struct(*[docs[c] for c in docs.columns]).alias("q_doc")), "rows")
    found = resample(rows.select("q_row", "q_doc.doc_id", "q_doc.text"), target, ws, carry=("q_row",), **options)
    return rows.join(found.where("rank is not null").select("q_row"), "q_row", "left_semi").select("q_doc.*")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Workspace(spark, "op13"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
