"""Near-duplicates: circulant MinHash signatures, banding, exact Jaccard verification, components.

Work is done on the different shingle sets (copies collapse first, by a 128-bit
hash of the set), which are numbered in the order of their smallest doc_id.
Banding puts sets into buckets. A bucket's members are compared with its smallest
member (a star, not all pairs). What the stars leave apart in a bucket is compared
in blocks: members outside the bucket's largest component against all others,
first by signature, then by their full sets. Pairs that link by the hashes of
their shingles are held against each other once more by the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import Workspace, numbered, table
from quillmark.llm.text import chunks, mix, windows, word_hashes, words

SHINGLE, PERCENT = 4, 80
BANDS, BAND = 32, 4
#: Blocks of the residual comparison; least share of equal coordinates there (seven deviations below 80 %).
BLOCK, LEAST_EQUAL = 1024, 0.55
SIGNATURE = "row long, doc_id long, key long, key_too long, n_shingles long, set_hash long, set_hash2 long, bands array<long>, signature binary"

U32 = np.uint32
#: The circulant step: coordinate k sees the second permutation shifted by k steps.
SHIFTS = (np.arange(1, BANDS * BAND + 1, dtype=np.uint64) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)).astype(U32)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text: its different shingles as sorted 64-bit hashes; a shorter text is one shingle."""
    for _, data, offsets in chunks(column):
        starts, ends, by_row = words(data, offsets)
        hashes = word_hashes(data, starts, ends, lower=True)
        all_ = windows(hashes, size)
        for a, b in zip(by_row[:-1], by_row[1:]):
            if b - a >= size:
                yield np.unique(all_[a : b - size + 1])
            else:
                yield windows(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def first_permutation(x: np.ndarray) -> np.ndarray:
    """Shingles to places of a universe of 2**32, in random order."""
    return (mix(x ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(U32)


def circulant_minhash(shingles: np.ndarray) -> np.ndarray:
    """All coordinates from two permutations: the second one, shifted circularly by a step for each."""
    places = first_permutation(shingles)
    out = np.full(len(SHIFTS), 0xFFFFFFFF, U32)
    for i in range(0, len(places), 1024):
        x = places[None, i : i + 1024] + SHIFTS[:, None]  # circular: wraps at 2**32
        x ^= x >> U32(16)  # the second permutation, a bijection of 32 bits
        x *= U32(0x7FEB352D)
        x ^= x >> U32(15)
        x *= U32(0x846CA68B)
        np.minimum(out, x.min(axis=1), out=out)
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    c = coordinates.astype(np.uint64).reshape(BANDS, BAND)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + c[:, k])
    return key


def signatures(size: int):
    """For mapInArrow: (row, doc_id, key, key_too, text) to SIGNATURE; an empty set has no bands."""
    schema = pa.schema([*[(c, pa.int64()) for c in ("row", "doc_id", "key", "key_too", "n_shingles", "set_hash", "set_hash2")], ("bands", pa.list_(pa.int64())), ("signature", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, bands, sign = [], [], [], [], []
            for s in shingle_sets(batch.column(4), size):
                n.append(len(s))
                one.append(int(np.bitwise_xor.reduce(mix(s)).view(np.int64)) if len(s) else 0)
                two.append(int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                c = circulant_minhash(s) if len(s) else None
                bands.append(None if c is None else band_keys(c).view(np.int64))
                sign.append(None if c is None else (c >> U32(8)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(v, f.type) for v, f in zip((n, one, two, bands, sign), list(schema)[4:]))], schema=schema)

    return run


def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over doc_id, key, key_too and text: the text compressed."""
    zip_ = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([zip_.compress(t.as_py() or b"") for t in batch.column(3).cast(pa.binary())], pa.binary())], ["doc_id", "key", "key_too", "packed"])


class Text:
    """A compressed text's shingles: hashes, and the words themselves once they are asked for."""

    def __init__(self, packed: bytes, size: int) -> None:
        self.raw, self.size, self.known = zstandard.ZstdDecompressor().decompress(packed), size, None
        self.hashes = next(shingle_sets(pa.array([self.raw]), size))

    def shingles(self) -> set[tuple[bytes, ...]]:
        if self.known is None:
            w = self.raw.lower().split()
            self.known = set(zip(*(w[k:] for k in range(self.size)))) if len(w) >= self.size else {tuple(w)} if w else set()
        return self.known

    def links(self, other: Text, percent: int) -> bool:
        """100 x intersection >= percent x union: by hashes first, then on the full sets."""
        s, t = self.hashes, other.hashes
        if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
            return False
        both = len(np.intersect1d(s, t, assume_unique=True))
        if not both or 100 * both < percent * (len(s) + len(t) - both):
            return False
        s, t = self.shingles(), other.shingles()
        both = len(s & t)
        return 100 * both >= percent * (len(s) + len(t) - both)


def linked(size: int, percent: int):
    """For mapInArrow over (a, b, packed_a, packed_b): those that link, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, text = None, None
        for batch in batches:
            a, b, za, zb = (c.to_pylist() for c in batch.columns)
            keep = []
            for i in range(len(a)):
                if b[i] != last:
                    last, text = b[i], Text(zb[i], size)
                if Text(za[i], size).links(text, percent):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["a", "b"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link. Rows of one b lie together; a b with very many is split by Spark's skew join."""
    one = pairs.join(texts.select(F.col("node").alias("a"), F.col("packed").alias("packed_a")), "a")
    both = one.join(texts.select(F.col("node").alias("b"), F.col("packed").alias("packed_b")), "b")
    return both.select("a", "b", "packed_a", "packed_b").mapInArrow(linked(size, percent), "a long, b long").distinct()


def components(ws: Workspace, links: DataFrame, name: str) -> DataFrame:
    """node, component for all nodes of the links: the smallest node that can be reached.

    Each round a node takes the smallest label of its neighbours, and then its
    label's label, so that paths halve. Labels of rounds are written tables.
    """
    both = ws.save(links.union(links.select("b", "a")).toDF("node", "other").distinct(), f"{name}-edges")
    labels = ws.save(both.groupBy("node").agg(F.least("node", F.min("other")).alias("component")), f"{name}-0")
    for i in range(1, 100):
        near = both.join(labels.toDF("other", "near"), "other").groupBy("node").agg(F.min("near").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("component", "near").alias("mid"), F.col("component").alias("was"))
        jump = lower.join(labels.toDF("mid", "next"), "mid").select("node", F.least("mid", "next").alias("component"), "was")
        new = ws.save(jump, f"{name}-{i}")
        done = new.where("component <> was").limit(1).count() == 0
        labels = new.drop("was")
        if done:
            return labels
    raise RuntimeError("components: no end after 100 rounds")


def links_between(size: int, percent: int):
    """For mapInArrow over rows sorted by (bucket, i, j): links (a, b) that join different components.

    A row is (bucket, i, j, outside, node, component, main, hub, signature,
    bands, packed); a cell (i, j) has about a block of rows on either side. A
    pair is looked at in the first bucket that it shares, and only while its
    components are apart. If the signatures are alike enough, the full sets
    decide. So a cell returns fewer links than it has rows.
    """

    def links(rows: pa.Table) -> pa.RecordBatch:
        node, comp, main, hub = (rows[c].to_numpy() for c in ("node", "component", "main", "hub"))
        bucket = rows["bucket"][0].as_py()
        sign = np.frombuffer(b"".join(rows["signature"].to_pylist()), np.uint8).reshape(len(node), -1)
        bands = rows["bands"].combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        out = rows["outside"].to_numpy(zero_copy_only=False)
        texts: dict[int, Text] = {}
        up: dict[int, int] = {}

        def top(c: int) -> int:
            while up.get(c, c) != c:
                c = up[c]
            return c

        def text(i: int) -> Text:
            if i not in texts:
                texts[i] = Text(rows["packed"][i].as_py(), size)
            return texts[i]

        b, found = np.flatnonzero(~out), []
        for x in np.flatnonzero(out):
            y = b[(comp[b] != comp[x]) & ((node[x] < node[b]) | (comp[b] == main[b])) & (node[b] != hub[b]) & (node[x] != hub[x])]
            y = y[(sign[y] == sign[x]).mean(axis=1) >= LEAST_EQUAL]
            shared = bands[y] == bands[x]
            y = y[bands[x][shared.argmax(axis=1)] == bucket]
            for k in y:
                if top(comp[x]) != top(comp[k]) and text(x).links(text(k), percent):
                    up[top(comp[x])] = top(comp[k])
                    found.append((max(node[x], node[k]), min(node[x], node[k])))
        both = np.array(found, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        key = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            marks = list(zip(*(rows[c].to_pylist() for c in ("bucket", "i", "j"))))
            start = 0
            for n in range(len(marks)):
                if marks[n] != key:
                    if n > start:
                        held.append(rows.slice(start, n - start))
                    if held:
                        yield links(pa.concat_tables(held).combine_chunks())
                    held, start, key = [], n, marks[n]
            held.append(rows.slice(start))
        if held:
            yield links(pa.concat_tables(held).combine_chunks())

    return run


def residual_links(members: DataFrame, labels: DataFrame, profiles: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between components that share a bucket, of pairs that the stars didn't compare."""
    own = members.join(labels.toDF("node", "label"), "node", "left")
    own = own.select("bucket", "node", "hub", F.coalesce("label", "node").alias("component"))
    sizes = own.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    per = sizes.groupBy("bucket").agg(F.sum("n").alias("all"), F.max("n").alias("top"), F.max_by("component", F.struct("n", -F.col("component"))).alias("main"), F.count("*").alias("kinds"))
    per = per.where("kinds > 1 and all > 2").select("bucket", "main", F.ceil(F.col("all") / BLOCK).alias("n_j"), F.ceil((F.col("all") - F.col("top")) / BLOCK).alias("n_i"))
    rows = own.join(per, "bucket").join(profiles, "node")
    one = lambda n: F.array(F.pmod(F.xxhash64("node"), F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n).cast("int") - 1)
    columns = ["bucket", "i", "j", "outside", "node", "component", "main", "hub", "signature", "bands", "packed"]
    outside = rows.where("component <> main").withColumn("outside", F.lit(True)).withColumn("i", F.explode(one("n_i"))).withColumn("j", F.explode(every("n_j")))
    inside = rows.withColumn("outside", F.lit(False)).withColumn("i", F.explode(every("n_i"))).withColumn("j", F.explode(one("n_j")))
    cells = outside.select(*columns).union(inside.select(*columns))
    cells = cells.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return cells.mapInArrow(links_between(size, percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, ws: Workspace, *, size: int = SHINGLE, percent: int = PERCENT, row: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, row, first for every row of docs.

    Two texts link if 100 x |both sets| >= percent x |either set|, on the full
    sets of their different shingles of `size` words (A-Z in lower case). The
    component is the smallest doc_id that links reach. Of pairs at 0.8 the
    bands miss 5 in 10^8, and the residual comparison's least share of equal
    coordinates, where it decides, fewer than 1 in 10^9 more.

    `row` names a column of docs that tells its rows apart (else they are
    numbered). first is true of one row of each component: of those with the
    smallest doc_id the one whose text has the smallest hash, then the smallest
    row. kept is true of all rows with that doc_id.

    Texts without a word (or null) have an empty set, link with nothing and are
    their own component, and so are rows with a null doc_id, whose component is
    null. Each row goes by its own text, also where rows share a doc_id.
    Repeated rows are linked. Very long texts are read whole. Other columns of
    docs aren't read. An empty table gives an empty one.
    """
    key = {"key": F.xxhash64(F.coalesce("text", F.lit(""))), "key_too": F.xxhash64(F.lit(1), F.coalesce("text", F.lit("")))}
    docs = docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row"), "doc_id", *[c.alias(k) for k, c in key.items()], "text")
    sets = ws.save(docs.mapInArrow(signatures(size), SIGNATURE), "sets")
    same = ["set_hash", "set_hash2", "n_shingles"]
    kinds = sets.where("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(F.min(F.struct("doc_id", "key", "key_too", "row")).alias("of"), F.count("*").alias("copies"))
    nodes = ws.save(numbered(ws, kinds.select(*same, "copies", "of.*"), ["doc_id", *same], "node"), "nodes")
    firsts = sets.select("row", "bands", "signature").join(nodes.select("row", "node"), "row")
    banded = firsts.select("node", F.explode("bands").alias("bucket"))
    hubs = banded.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").drop("last")
    members = ws.save(banded.join(hubs, "bucket"), "members")
    by_text = ["doc_id", "key", "key_too"]
    asked = nodes.select("node", *by_text).join(members.select("node").distinct(), "node")
    texts = docs.select(*by_text, "text").mapInArrow(zipped, "doc_id long, key long, key_too long, packed binary")
    texts = texts.join(asked, by_text).groupBy(*by_text, "node").agg(F.any_value("packed").alias("packed"))
    texts = ws.save(texts.select("node", "packed"), "texts")
    stars = members.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    links = ws.save(verified(stars, texts, size, percent), "links")
    labels = components(ws, links, "stars")
    profiles = firsts.select("node", "signature", "bands").join(texts, "node")
    more = ws.save(residual_links(members, labels, profiles, size, percent), "more")
    if more.limit(1).count():
        labels = components(ws, links.union(more), "all")
    named = nodes.join(labels.toDF("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = named.where("copies > 1 or component <> node").select(*same, "component")
    tops = nodes.select(F.col("node").alias("component"), F.col("doc_id").alias("component_id"), F.col("row").alias("first_row"))
    named = named.join(tops, "component").drop("component")
    named = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(7))))  # a set that a third of all rows share is dealt over the salts
    rows = sets.select("row", "doc_id", *same).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(8)).cast("int"))
    rows = rows.join(named, [*same, "salt"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    first = F.col("doc_id").isNull() | F.coalesce(F.col("row") == F.col("first_row"), F.lit(True))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "row", first.alias("first"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Workspace(spark, "op1")).drop("row", "first")
