"""Substring dedup: winnowed anchors seed, matches are extended both ways, repeats over the threshold go."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm.common import Workspace, table
from quillmark.llm.text import chunks, mix, row_of, windows, word_hashes, words

WINDOW, GRAM = 50, 20


def variant(text: bytes) -> int:
    """Tells rows of one doc_id with different texts apart."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def run_hashes(hashes: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of hashes[start : start + n] for each of the runs, which lie one after another."""
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    each = mix(hashes[np.repeat(start, n) + at] ^ mix(at.astype(np.uint64) + np.uint64(1)))
    return mix(np.add.reduceat(each, np.cumsum(n) - n) + n.astype(np.uint64))


def owners(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` grams the place of its smallest, the last of equal ones."""
    value, place, size = grams, np.arange(len(grams)), 1

    def join(shift: int) -> tuple[np.ndarray, np.ndarray]:
        right = value[shift:] <= value[:-shift]
        return np.where(right, value[shift:], value[:-shift]), np.where(right, place[shift:], place[:-shift])

    while size * 2 <= width:
        value, place = join(size)
        size *= 2
    if size < width:
        value, place = join(width - size)
    return place


def anchors(window: int, gram: int):
    """For mapInArrow: runs of windows that share the anchor which winnowing picks.

    Every window of `window` words picks the smallest of its grams, so windows
    with the same words pick the same gram. Neighbouring windows with the same
    pick form a run; its hash covers all words of its windows. A row is
    (anchor, span, doc_id, variant, first window, windows).
    """
    schema = pa.schema([("anchor", pa.int64()), ("span", pa.int64()), ("doc_id", pa.int64()), ("variant", pa.int64()), ("first", pa.int32()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, data, offsets in chunks(batch.column(1)):
                starts, ends, by_row = words(data, offsets)
                n = len(starts)
                if n < window:
                    continue
                hashes = word_hashes(data, starts, ends, lower=False)
                grams = windows(hashes, gram)
                owner = owners(grams, window - gram + 1)
                rows = row_of(by_row)
                valid = np.flatnonzero(rows[: n - window + 1] == rows[window - 1 :])
                if not len(valid):
                    continue
                new = np.r_[True, (owner[valid][1:] != owner[valid][:-1]) | (np.diff(valid) != 1)]
                begin = np.flatnonzero(new)
                s1, s2 = valid[begin], valid[np.r_[begin[1:], len(valid)] - 1]
                row = rows[s1]
                raw = data.tobytes()
                kinds = {r: variant(raw[offsets[r] : offsets[r + 1]]) for r in np.unique(row)}
                a, whole = owner[s1], windows(hashes, window)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(grams[a].view(np.int64)),
                        pa.array(run_hashes(whole, s1, s2 - s1 + 1).view(np.int64)),
                        pa.array(ids[first + row].astype(np.int64)),
                        pa.array([kinds[r] for r in row], pa.int64()),
                        pa.array((s1 - by_row[row]).astype(np.int32)),
                        pa.array((s2 - s1 + 1).astype(np.int32)),
                    ],
                    schema=schema,
                )

    return run


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: doc_id, variant and the text, compressed for the way through a shuffle."""
    zip_ = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = [t.as_py() or b"" for t in batch.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([variant(t) for t in texts], pa.int64()), pa.array([zip_.compress(t) for t in texts], pa.binary())], ["doc_id", "variant", "packed"])


PACKED = "doc_id long, variant long, packed binary"


def window_hashes(window: int):
    """For mapInArrow: a row for each window of the given runs: two hashes, doc_id, variant, place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            for doc_id, kind, zipped, runs in zip(*(c.to_pylist() for c in batch.columns)):
                data = np.frombuffer(unzip.decompress(zipped), np.uint8)
                starts, ends, _ = words(data, np.array([0, len(data)]))
                at = np.unique(np.concatenate([np.arange(r["first"], r["first"] + r["n"]) for r in runs]))
                one, two = (windows(word_hashes(data, starts, ends, lower=False, seed=k), window)[at].view(np.int64) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(np.full(len(at), doc_id)), pa.array(np.full(len(at), kind)), pa.array(at.astype(np.int32))], ["w1", "w2", "doc_id", "variant", "place"])

    return run


def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: doc_id, words, removed words, and the kept words."""
    unzip = zstandard.ZstdDecompressor()
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for doc_id, zipped, cuts in zip(*(c.to_pylist() for c in batch.columns)):
            tokens = unzip.decompress(zipped).split()
            n = len(tokens)
            if cuts:
                edges = np.zeros(n + 1, np.int64)
                np.add.at(edges, [c["start"] for c in cuts], 1)
                np.add.at(edges, [c["stop"] for c in cuts], -1)
                tokens = list(compress(tokens, np.cumsum(edges)[:n] == 0))
            for column, value in zip(out, (doc_id, n, n - len(tokens), b" ".join(tokens))):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])


def with_first(rows: DataFrame, keys: list[str], salts: int, more: str = "false") -> DataFrame:
    """rows whose keys two or more documents hold (or `more` is true of), with the smallest such doc_id as first_doc.

    Every key is first reduced where its rows lie. On the way back the reduced
    side is copied to `salts` salts, over which a hot key's rows are dealt.
    """
    shared = rows.groupBy(*keys).agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.max(F.expr(more)).alias("more"))
    shared = shared.where("first_doc < last_doc or more").drop("last_doc", "more")
    shared = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).join(shared, [*keys, "salt"]).drop("salt")


def repeats(docs: DataFrame, ws: Workspace, *, window: int = WINDOW, gram: int = GRAM, salts: int = 4) -> DataFrame:
    """doc_id, variant, start, stop: words of windows that also start in a smaller doc_id (spans may overlap).

    Seeds are anchors that two or more documents hold. A seed's match is
    extended over the words of its run of windows: where the whole run is the
    same as in a smaller document, all of it repeats. What is left are runs
    that differ in part, at the ends of common passages. Of each different run
    one document compares its windows one by one, by two 64-bit hashes. Only
    counts and smallest ids are taken of a group, so no pairs arise in it.
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    runs = ws.save(docs.mapInArrow(anchors(window, gram), "anchor long, span long, doc_id long, variant long, first int, n int"), "runs")
    seeds = runs.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), (F.min("span") != F.max("span")).alias("mixed"))
    seeds = seeds.where("a < b").select("anchor", "mixed", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    seeded = runs.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).join(seeds, ["anchor", "salt"]).drop("salt")
    seeded = ws.save(seeded, "seeded")
    ws.drop("runs")
    placed = ws.save(with_first(seeded, ["anchor", "span"], salts, "mixed"), "placed")
    ws.drop("seeded")
    same = placed.where("doc_id > first_doc").select("doc_id", "variant", F.col("first").alias("start"), (F.col("first") + F.col("n") + (window - 1)).alias("stop"))
    asked = placed.where("mixed and doc_id = first_doc").groupBy("doc_id", "variant").agg(F.collect_list(F.struct("first", "n")).alias("runs"))
    texts = docs.mapInArrow(packed, PACKED).join(asked, ["doc_id", "variant"]).select("doc_id", "variant", "packed", "runs")
    hashes = ws.save(texts.mapInArrow(window_hashes(window), "w1 long, w2 long, doc_id long, variant long, place int"), "windows")
    parts = with_first(hashes, ["w1", "w2"], salts).where("doc_id > first_doc")
    parts = parts.select("doc_id", "variant", F.col("place").alias("start"), (F.col("place") + window).alias("stop"))
    return same.union(parts)


def maximal(spans: DataFrame) -> DataFrame:
    """doc_id, variant, start, stop: overlapping and touching spans of a document joined to maximal repeats.

    Windows that repeat lie one word apart where a match goes on to either side,
    so joining them extends each match both ways until it ends.
    """
    by = Window.partitionBy("doc_id", "variant").orderBy("start", "stop")
    rows = spans.withColumn("reach", F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("run", F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(by))
    return rows.groupBy("doc_id", "variant", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("run")


def dedup_substrings(docs: DataFrame, ws: Workspace, *, window: int = WINDOW, gram: int = GRAM, salts: int = 4) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of every row of docs.

    Words covered by a window of `window` words whose sequence also starts in a
    document with a smaller doc_id go. Kept words are joined by one space.

    Null text has no words; texts shorter than a window lose nothing. Rows with
    the same doc_id are one document: they take nothing from each other. Rows
    with a null doc_id lose nothing and take nothing. Very long texts are read
    whole. Only doc_id and text are read of docs. An empty table gives an empty
    one. Windows are compared by hashes of 128 bits, which no structure of words
    makes equal.
    """
    cuts = maximal(repeats(docs, ws, window=window, gram=gram, salts=salts))
    cuts = cuts.groupBy("doc_id", "variant").agg(F.collect_list(F.struct("start", "stop")).alias("cuts"))
    texts = docs.select("doc_id", "text").mapInArrow(packed, PACKED)
    both = texts.join(cuts, ["doc_id", "variant"], "left").select("doc_id", "packed", "cuts")
    return both.mapInArrow(finished, "doc_id long, n_words long, n_removed long, kept_text string")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"), Workspace(spark, "op6"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
