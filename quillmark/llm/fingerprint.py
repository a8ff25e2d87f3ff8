"""Document fingerprints: improbable byte windows, chosen by how rare their entropy is, in chained Bloom filters.

Each window of 64 bytes has an entropy, and entropies that few windows of all
texts have are rare. A window is a feature if, among neighbouring windows, it is
the rarest often enough. Features go into filters of 2,048 bits, a new one after
160 features. Two fingerprints are as alike as their filters' common bits,
between what chance gives and the most there can be.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm.common import Workspace, table
from quillmark.llm.text import chunks, word_hashes

#: Bytes of a window, neighbours it is compared with at a time, how often it has to be the rarest, kinds of entropy.
WIDTH, RUN, POPULAR, KINDS = 64, 64, 8, 1000
#: Kinds of entropy below this say little of a text (runs of few different bytes) and come last.
DULL = 250
#: Bits and features of a filter, bits that a feature sets, the share of the range above chance that counts as nothing.
BITS, FEATURES, SETS, CHANCE = 2048, 160, 5, 0.1

#: Places of a text looked at at a time, so that a very long text takes memory for little more than its bytes.
SEGMENT = 1 << 20

COUNTS = np.arange(WIDTH + 1, dtype=float)
#: By how much one more copy of a byte, beside c of them, raises the sum of c * log2(c); in whole numbers, so that sums don't depend on their order.
STEP = np.rint(np.diff(COUNTS * np.log2(np.maximum(COUNTS, 1))) * (1 << 20)).astype(np.int64)
TOP = int(STEP.sum())
BELOW, PLACE = np.array([1 << 62], np.int64), np.int64((1 << 40) - 1)


def entropy_kinds(data: np.ndarray) -> np.ndarray:
    """The kind of entropy, 0 to KINDS, of the window at each place of a chunk.

    A window follows from the one before: one byte goes, one comes. How often
    they occur in between are sums of comparisons with the data shifted.
    """
    if len(data) < WIDTH:
        return np.zeros(0, np.int64)
    before, after = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for lag in range(1, WIDTH):
        same = (data[lag:] == data[:-lag]).view(np.uint8)
        before[lag:] += same
        after[:-lag] += same
    change = STEP[before[WIDTH - 1 :]]
    change[1:] -= STEP[after[: len(data) - WIDTH]]
    change[0] = STEP[before[:WIDTH]].sum()
    return (TOP - np.cumsum(change)) * KINDS // TOP


def ends_of(offsets: np.ndarray, a: int, b: int) -> np.ndarray:
    """Where the text of each place from a to b of a chunk ends."""
    return np.repeat(offsets[1:], np.diff(np.clip(offsets, a, b)))


def segments(data: np.ndarray, offsets: np.ndarray, beyond: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first place, kinds, places, ends of their texts) of the windows of a chunk, SEGMENT places and `beyond` more at a time."""
    for a in range(0, max(len(data) - WIDTH + 1, 0), SEGMENT):
        kinds = entropy_kinds(data[a : a + SEGMENT + beyond + WIDTH - 1])
        yield a, kinds, np.arange(a, a + len(kinds)), ends_of(offsets, a, a + len(kinds))


def rarity(docs: DataFrame) -> np.ndarray:
    """The place of each kind of entropy in the order from rare to common, over all windows of all texts; dull kinds last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(KINDS + 1, np.int64)
        for batch in batches:
            for _, data, offsets in chunks(batch.column(0)):
                for _, kinds, place, end in segments(data, offsets):
                    total += np.bincount(kinds[place + WIDTH <= end], minlength=KINDS + 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["kind", "n"])

    n = np.zeros(KINDS + 1, np.int64)
    for r in docs.select("text").mapInArrow(run, "kind long, n long").groupBy("kind").agg(F.sum("n").alias("n")).collect():  # a row for each kind
        n[r.kind] = r.n
    out = np.empty(KINDS + 1, np.int64)
    out[np.lexsort((np.arange(KINDS + 1), n, np.arange(KINDS + 1) < DULL))] = np.arange(KINDS + 1)
    return out


def rare_keys(kinds: np.ndarray, place: np.ndarray, end: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Numbers in the order from rare to common, of equal ones the first place first; windows that reach into another text come last."""
    return np.where(place + WIDTH <= end, ranks[kinds] << 40 | place, BELOW)


def features(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the features of each text, each once, in order.

    A text without a popular window has its rarest one; one shorter than a
    window is a feature itself; an empty one has none.
    """
    wins = np.zeros(len(data), np.uint8)
    for a, kinds, place, end in segments(data, offsets, RUN - 1):
        least, n = rare_keys(kinds, place, end, ranks), 1
        while n < RUN:  # RUN is a power of two
            least, n = np.minimum(least[:-n], least[n:]), 2 * n
        runs = min(SEGMENT, max(0, len(kinds) - RUN + 1))
        inside = place[:runs] + RUN + WIDTH - 1 <= end[:runs]
        wins[a : a + len(kinds)] += np.bincount((least[:runs][inside] & PLACE) - a, minlength=len(kinds)).astype(np.uint8)
    at, size = np.flatnonzero(wins >= POPULAR), np.diff(offsets)
    found = np.bincount(np.searchsorted(offsets, at, "right") - 1, minlength=len(size))
    bare = []
    for r in np.flatnonzero((found == 0) & (size >= WIDTH)):
        own = data[offsets[r] : offsets[r + 1]]
        bare.append(min(int(rare_keys(k, p, e, ranks).min()) for _, k, p, e in segments(own, np.array([0, len(own)]))) & int(PLACE))
        bare[-1] += int(offsets[r])
    at, short = np.sort(np.r_[at, np.array(bare, np.int64)]), np.flatnonzero((size > 0) & (size < WIDTH))
    starts, ends = np.r_[at, offsets[short]], np.r_[at + WIDTH, offsets[short + 1]]
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    of, hashes = np.searchsorted(offsets, starts, "right") - 1, word_hashes(data, starts, ends, lower=False)
    _, first = np.unique(np.stack([of.astype(np.uint64), hashes]), axis=1, return_index=True) if len(of) else (None, np.zeros(0, np.int64))
    first = np.sort(first)
    return of[first], hashes[first]


@dataclass
class Digest:
    """Chained filters: how many features each holds, and its bits in words of 64."""

    n: np.ndarray
    bits: np.ndarray

    def packed(self) -> bytes:
        return b"".join(bytes([n]) + b.tobytes() for n, b in zip(self.n.tolist(), self.bits))

    @staticmethod
    def opened(blob: bytes) -> Digest:
        rows = np.frombuffer(blob, np.uint8).reshape(-1, 1 + BITS // 8)
        return Digest(rows[:, 0].astype(np.int64), np.ascontiguousarray(rows[:, 1:]).view(np.uint64))


def digests(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> list[Digest]:
    """The digest of each text of a chunk."""
    rows, hashes = features(data, offsets, ranks)
    size = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.r_[0, np.cumsum(size)]
    filters = -(-size // FEATURES)
    base = np.r_[0, np.cumsum(filters)]
    number = np.arange(len(rows)) - first[rows]
    at = base[rows] + number // FEATURES
    bits = np.zeros((base[-1], BITS), bool)
    for k in range(SETS):
        bits[at, (hashes >> np.uint64(11 * k) & np.uint64(BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    n = np.bincount(at, minlength=base[-1])
    return [Digest(n[a:b], packed[a:b]) for a, b in zip(base[:-1], base[1:])]


def toward(a: Digest, b: Digest) -> float:
    """How much of a's filters is found in b's, each held against the one most like it."""
    size, total = np.bitwise_count(b.bits).sum(axis=1, dtype=np.int64), 0.0
    miss = 1 - 1 / BITS
    free = miss ** (SETS * b.n)
    for n, own in zip(a.n.tolist(), a.bits):
        common = np.bitwise_count(own & b.bits).sum(axis=1, dtype=np.int64)
        most = np.minimum(size, int(np.bitwise_count(own).sum()))
        chance = BITS * (1 - miss ** (SETS * n)) * (1 - free)
        least = chance + CHANCE * (most - chance)
        room = most - least
        likeness = np.divide(common - least, room, out=(common == most).astype(float), where=room > 1e-9)
        total += n * min(1.0, max(0.0, float(likeness.max())))
    return total / int(a.n.sum())


def likeness(a: Digest, b: Digest) -> float:
    """0 to 1, the same both ways: the shorter chain's share in the longer one; 1 for equal ones, and for two without features."""
    if not len(a.n) or not len(b.n):
        return float(len(a.n) == len(b.n))
    if len(a.n) != len(b.n):
        return toward(a, b) if len(a.n) < len(b.n) else toward(b, a)
    return (toward(a, b) + toward(b, a)) / 2


def shown(name: str) -> Column:
    """A fingerprint as text: its filters in base64, joined by dots."""
    step, size = F.lit(1 + BITS // 8), F.octet_length(name)
    filters = F.when(size > 0, F.sequence(F.lit(1), size, step)).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(filters, lambda i: F.translate(F.base64(F.substr(name, i, step)), "\r\n", "")), ".")


def fingerprints(docs: DataFrame, ranks: np.ndarray) -> DataFrame:
    """doc_id and fingerprint (binary) of every row of docs by the ranks that rarity() gives.

    Null text is empty and has an empty fingerprint. Equal texts have equal
    ones; rows alike in doc_id are rows of their own. Very long texts are read
    whole. Only doc_id and text are read of docs. An empty table gives an empty
    one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # KINDS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in chunks(batch.column(1)):
                found = [d.packed() for d in digests(data, offsets, shared.value)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(found)), pa.array(found, pa.binary())], ["doc_id", "fingerprint"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint binary")


def compared(pairs: DataFrame, left: str, right: str, name: str = "likeness") -> DataFrame:
    """pairs with the likeness of two columns of fingerprints; null if one is null."""

    @F.pandas_udf("double")
    def of(a, b):
        import pandas as pd

        return pd.Series([None if x is None or y is None else likeness(Digest.opened(x), Digest.opened(y)) for x, y in zip(a, b)], dtype="float64")

    return pairs.withColumn(name, of(left, right))


FOUND = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
NAMES = [f.split()[0] for f in FOUND.split(", ")]


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the next document."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def digests_of(texts: list[str], ranks: np.ndarray) -> list[Digest]:
    return [d for _, data, offsets in chunks(pa.array(texts, pa.large_string())) for d in digests(data, offsets, ranks)]


def held_against_next(texts: list[str], own: list[Digest], ranks: np.ndarray) -> list[tuple]:
    """FOUND of each text but the last, which follows."""
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    other = digests_of(changed, ranks)
    return [
        (len(t), hashlib.sha256(c.encode()).hexdigest(), a.packed(), e.packed(), likeness(a, e), likeness(a, b))
        for t, c, a, e, b in zip(texts, changed, own, other, own[1:])
    ]


def edits(docs: DataFrame, ranks: np.ndarray, ws: Workspace) -> DataFrame:
    """doc_id and FOUND of every row of docs: fingerprints of its text and of its edited text, and their likeness.

    The next document is the one with the next larger doc_id (null is least),
    and the first after the last. Texts are dealt once, in ranges of doc_id, and
    each range is read in order; only its first and last rows meet those of
    other ranges. Rows with the same doc_id follow each other by a hash of their
    text. Null text is empty. The only row of a table follows itself.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # KINDS numbers
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumns({"q_hash": F.xxhash64("text"), "q_row": F.monotonically_increasing_id()})
    order = ["doc_id", "q_hash", "q_row"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    nothing = [None] * len(NAMES)

    def batch(found: list[tuple], ids: pa.DataType) -> pa.RecordBatch:
        kinds = [ids, pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], ["doc_id", *NAMES, "part", "edge", "edge_text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        for b in batches:
            kind_of = b.schema.field(0).type
            for first, _, offsets in chunks(b.column(1)):
                ids, texts = (b.column(i).slice(first, len(offsets) - 1).to_pylist() for i in (0, 1))
                own = digests_of(texts, shared.value)
                if held is None:
                    yield batch([(ids[0], *nothing, part, "first", texts[0])], kind_of)
                else:
                    ids, texts, own = [held[0], *ids], [held[1], *texts], [held[2], *own]
                found = held_against_next(texts, own, shared.value)
                if found:
                    yield batch([(i, *f, None, None, None) for i, f in zip(ids, found)], kind_of)
                held = ids[-1], texts[-1], own[-1]
        if held:
            yield batch([(held[0], *nothing, part, "last", held[1])], kind_of)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                texts = [b.column(1)[i].as_py(), b.column(2)[i].as_py()]
                (found,) = held_against_next(texts, digests_of(texts, shared.value), shared.value)
                yield batch([(b.column(0)[i].as_py(), *found, None, None, None)], b.schema.field(0).type).select(["doc_id", *NAMES])

    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    got = ws.save(dealt.mapInArrow(run, f"doc_id {kind}, {FOUND}, part int, edge string, edge_text string"), "ranges")
    first, last = (got.where(F.col("edge") == e) for e in ("first", "last"))
    parts = first.select("part")  # one row for each range
    follows = parts.withColumn("after", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())))
    starts = first.select(F.col("part").alias("after"), F.col("edge_text").alias("following"))
    ends = last.select("part", "doc_id", "edge_text").join(follows, "part").join(starts, "after")
    inner = got.where("edge is null").select("doc_id", *NAMES)
    return inner.unionByName(ends.select("doc_id", "edge_text", "following").mapInArrow(meet, f"doc_id {kind}, {FOUND}"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = edits(docs, rarity(docs), Workspace(spark, "op11"))
    return found.select("doc_id", "n_chars", "edited_sha256", *[shown(c).alias(c) for c in ("fingerprint", "edited_fingerprint")], "near_edited", "near_next")
