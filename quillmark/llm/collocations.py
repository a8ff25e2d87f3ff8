"""Collocations by marginalising the longest windows: padded windows are counted once, Spark's ROLLUP sums their prefixes.

Every word opens one window: its own column and lead columns of the words after
it in the piece, padded where the piece ends. Only these windows are counted; a
shorter phrase's count is the sum over the windows that it begins, which ROLLUP
gives. Before that, windows lose the words that no result can need: a phrase
under the least count is in no candidate, and neither is what it begins. So
windows are merged by their first four words, then those left by their first
three, two and one, and each round cuts the last word of what is rare and
passes on the rest. Rows that reach ROLLUP have a frequent prefix each, so they
are a fraction of the words, and no round meets a hot key: what a prefix passes
on is one row for each task that held it.

Windows move in blocks: the block's words, each once, and columns of their
numbers, compressed. Words are compared as bytes, never by hashes alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm.common import Workspace, lean, table
from quillmark.llm.text import LOWER, chunks, mix, row_of, word_hashes

MOST, LEAST, TOP, INSIDE = 4, 30, 2000, 80
#: Bytes of text read at once, words whose windows are combined at once, bytes of text whose windows make a bucket.
CHUNK, STEP, RANGE = 4 << 20, 1 << 19, 8 << 20
#: Rows of a batch that a Python worker gets: blocks are large, and so may texts be.
ROWS, BATCH = 256, "spark.sql.execution.arrow.maxRecordsPerBatch"
U64 = np.uint64

BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
IN_WORD = ~BREAK
IN_WORD[[0x09, 0x20]] = False


def shape(most: int) -> pa.Schema:
    """Blocks have words and body; counted windows have w1, w2, ... and n."""
    return pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("words", pa.binary()), ("body", pa.binary()), *[(f"w{k + 1}", pa.string()) for k in range(most)], ("n", pa.int64())])


def ddl(schema: pa.Schema) -> str:
    names = {pa.string(): "string", pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


class Windows:
    """Windows of words by number (0: none), how often each was seen, whether it is known to begin a frequent one, and the words."""

    def __init__(self, columns: list[np.ndarray], n: np.ndarray, known: np.ndarray, words: pa.Array) -> None:
        self.columns, self.n, self.known, self.words = columns, n, known, words

    def where(self, mask: np.ndarray) -> Windows:
        return Windows([c[mask] for c in self.columns], self.n[mask], self.known[mask], self.words)

    def combined(self) -> Windows:
        """Equal windows once, sorted."""
        order = ascending(self.columns, len(self.words) + 1)
        return Windows([c[order] for c in self.columns], self.n[order], self.known[order], self.words).grouped()

    def grouped(self) -> Windows:
        """Equal windows once, where they stand side by side."""
        at = np.flatnonzero(changes(self.columns))
        if not len(at):
            return self
        return Windows([c[at] for c in self.columns], np.add.reduceat(self.n, at), np.maximum.reduceat(self.known, at), self.words)

    def blocks(self, lang: str, length: int, buckets: int) -> Iterator[tuple]:
        """Rows of shape(): the windows, which are sorted, dealt by their first words."""
        starts = np.frombuffer(self.words.buffers()[1], np.int32)[: len(self.words) + 1] if len(self.words) else np.zeros(1, np.int32)
        data = np.frombuffer(self.words.buffers()[2] or b"", np.uint8)
        hashes = np.r_[U64(0), word_hashes(data, starts[:-1].astype(np.int64), starts[1:].astype(np.int64), lower=False)]
        deal = hashes[self.columns[0]]
        for c in self.columns[1:length]:
            deal = mix(deal * U64(0xD1342543DE82EF95) + hashes[c])
        bucket = (deal % U64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        at = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True]) if len(order) else [0]
        for a, b in zip(at[:-1], at[1:]):
            part = order[a:b]
            ids = np.stack([c[part] for c in self.columns])
            used, ids = renumbered(ids, len(self.words) + 1)
            ids[0] = np.diff(ids[0], prepend=0)
            yield lang, int(bucket[part[0]]), zstandard.compress(lines(self.words.take(pa.array(used[1:] - 1))), 1), squeezed(ids, self.n[part], self.known[part])


def changes(columns: list[np.ndarray]) -> np.ndarray:
    """True where the columns' values are others than in the row before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def ascending(columns: list[np.ndarray], below: int) -> np.ndarray:
    """The order of rows of numbers under `below`: by as many columns as fit in 63 bits, and then by the others where these are equal."""
    bits = max(1, int(below).bit_length())
    keys = []
    for k in range(0, len(columns), 63 // bits):
        key = np.zeros(len(columns[0]), np.int64)
        for c in columns[k : k + 63 // bits]:
            key = key << bits | c
        keys.append(key)
    order = np.argsort(keys[0])
    if len(keys) > 1:
        first = keys[0][order]
        same = np.r_[False, first[1:] == first[:-1]]
        tied = np.flatnonzero(same | np.r_[same[1:], False])
        order[tied] = order[tied][np.lexsort([k[order[tied]] for k in keys[::-1]])]
    return order


def renumbered(ids: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that occur, with 0, ascending, and each number's place among them."""
    if 8 * ids.size < below:
        used, at = np.unique(np.append(ids.ravel(), 0), return_inverse=True)
        return used, at[:-1].reshape(ids.shape)
    seen = np.zeros(below, bool)
    seen[0] = True
    seen[ids.ravel()] = True
    return np.flatnonzero(seen), (np.cumsum(seen, dtype=np.int32) - 1)[ids]


def lines(words: pa.Array) -> bytes:
    """Words, which hold no line ends, line by line."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), b"\n")[0].as_py()


def squeezed(ids: np.ndarray, n: np.ndarray, known: np.ndarray) -> bytes:
    """Columns of numbers byte plane by byte plane, which compresses well."""
    planes = lambda x, kind: np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(n), -1).T).tobytes()
    return zstandard.compress(b"".join([*(planes(c, "<u4") for c in ids), planes(n, "<u8"), known.astype(np.uint8).tobytes()]), 1)


def opened(words: bytes, body: bytes, most: int) -> Windows:
    raw = np.frombuffer(zstandard.decompress(body), np.uint8)
    n = len(raw) // (4 * most + 9)
    planes = raw[: (4 * most + 8) * n].reshape(-1, n)
    ids = [np.ascontiguousarray(planes[4 * k : 4 * k + 4].T).view("<i4").ravel() for k in range(most)]
    ids[0] = np.cumsum(ids[0], dtype=np.int32)
    count = np.ascontiguousarray(planes[4 * most :].T).view("<i8").ravel()
    return Windows(ids, count, raw[-n:].view(np.int8), pc.split_pattern(pa.array([zstandard.decompress(words)], pa.binary()), "\n")[0].values)


def joined(parts: list[Windows]) -> Windows:
    """The windows of all parts over one list of words, combined."""
    if len(parts) == 1:
        return parts[0].combined()
    own = pa.concat_arrays([p.words for p in parts]).dictionary_encode()
    ids, first, columns = own.indices.to_numpy().astype(np.int32) + 1, 0, []
    for p in parts:
        number = np.r_[np.int32(0), ids[first : first + len(p.words)]]
        first += len(p.words)
        columns.append([number[c] for c in p.columns])
    return Windows([np.concatenate(c) for c in zip(*columns)], np.concatenate([p.n for p in parts]), np.concatenate([p.known for p in parts]), own.dictionary).combined()


def windows_of(data: np.ndarray, offsets: np.ndarray, most: int, step: int) -> Iterator[Windows]:
    """The padded longest windows of a chunk of texts, `step` words at a time."""
    data = LOWER[data]
    inside = IN_WORD[data]
    new, last = inside.copy(), inside.copy()
    new[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = np.flatnonzero(np.diff(offsets))
    new[offsets[:-1][full]] = inside[offsets[:-1][full]]
    last[offsets[1:][full] - 1] = inside[offsets[1:][full] - 1]
    starts, ends = np.flatnonzero(new), np.flatnonzero(last) + 1
    piece = np.searchsorted(np.flatnonzero(BREAK[data]), starts) + row_of(np.searchsorted(starts, offsets))
    for a in range(0, len(starts), step):
        b, beyond = min(a + step, len(starts)), min(a + step + most - 1, len(starts))
        size = ends[a:beyond] - starts[a:beyond]
        at = np.r_[0, np.cumsum(size)].astype(np.int32)
        span = slice(starts[a], ends[beyond - 1])
        words = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(data[span][inside[span]])]).dictionary_encode()
        first = words.indices.to_numpy() + np.int32(1)
        columns = [first[: b - a]]
        for k in range(1, most):
            lead = np.zeros(b - a, np.int32)
            same = piece[a + k : b + k] == piece[a : min(b, len(piece) - k)]
            lead[: len(same)] = np.where(same, first[k : k + len(same)], 0)
            columns.append(lead)
        yield Windows(columns, np.ones(b - a, np.int64), np.zeros(b - a, np.int8), words.dictionary)


def batch_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    """Blocks as a batch; their count columns are null."""
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(columns[i] if i < 4 else [None] * len(rows), f.type) for i, f in enumerate(schema)], schema=schema)


def count_windows(most: int, buckets: int, step: int):
    """For mapInArrow over lang and text: blocks of counted windows, dealt by all their words."""
    schema = shape(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[Windows]] = {}
        size = 0
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                texts = batch.column(1).filter(pc.equal(langs.indices, code))
                for _, data, offsets in chunks(texts, CHUNK):
                    for found in windows_of(data, offsets, most, step):
                        held.setdefault(lang, []).append(found)
                        size += len(found.n)
                        if size >= step:
                            yield from flushed(schema, held, most, buckets)
                            size = 0
        yield from flushed(schema, held, most, buckets)

    return run


def flushed(schema: pa.Schema, held: dict[str, list[Windows]], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for lang, parts in held.items():
        for row in joined(parts).blocks(lang, length, buckets):
            yield batch_of(schema, [row])
    held.clear()


def fold(most: int, length: int, least: int, buckets: int, step: int):
    """For mapInArrow over blocks sorted by lang and bucket, dealt by `length` words.

    Windows whose first `length` words are frequent are counted for good, and
    their prefix is known as frequent in the next round. The others lose the
    last of these words and go on.
    """
    schema = shape(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ({n: b.column(n)[i].as_py() for n in ("lang", "bucket", "words", "body")} for b in batches for i in range(b.num_rows))
        for lang, groups in groupby(groupby(rows, lambda r: (r["lang"], r["bucket"])), lambda g: g[0][0]):
            held, size = {lang: []}, 0
            for _, blocks in groups:
                met = joined([opened(r["words"], r["body"], most) for r in blocks])
                new = changes(met.columns[:length])
                at, group = np.flatnonzero(new), np.cumsum(new) - 1
                often = (np.add.reduceat(met.n, at) >= least) | (np.maximum.reduceat(met.known, at) > 0)
                good = often[group] & (met.columns[length - 1] > 0)
                yield counted(schema, lang, met.where(good & (met.n > 0)))
                # frequent windows leave a mark, rare ones go on without the word; the order stays
                columns = [c if k < length - 1 else np.zeros_like(c) for k, c in enumerate(met.columns)]
                rest = Windows(columns, np.where(good, 0, met.n), np.where(good, np.int8(1), met.known), met.words).grouped()
                if length == 1:
                    yield counted(schema, lang, rest.where(rest.n > 0))
                    continue
                held.setdefault(lang, []).append(rest)
                size += len(rest.n)
                if size >= step:
                    yield from flushed(schema, held, length - 1, buckets)
                    size = 0
            if held.get(lang):
                yield from flushed(schema, held, length - 1, buckets)

    return run


def counted(schema: pa.Schema, lang: str, found: Windows) -> pa.RecordBatch:
    """Windows as words; a column without a word is empty."""
    words = pa.concat_arrays([pa.array([b""], pa.binary()), found.words]).cast(pa.string())
    n = len(found.n)
    return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), *[pa.nulls(n, schema.field(i).type) for i in (1, 2, 3)], *[words.take(pa.array(c)) for c in found.columns], pa.array(found.n)], schema=schema)


def phrase_counts(docs: DataFrame, ws: Workspace, *, most: int = MOST, least: int = LEAST, step: int = STEP, span: int = RANGE) -> DataFrame:
    """lang, size, phrase, f: how often each phrase of up to `most` words occurs, for all with f >= `least`; size 0 is all words.

    docs has lang and text. Rare single words may be among the rows or not.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, kind = 1 + size // span, ddl(shape(most))
    columns = [f"w{k + 1}" for k in range(most)]
    blocks, rows = docs.select("lang", "text").mapInArrow(lean(count_windows(most, buckets, step)), kind), None
    for length in range(most, 0, -1):
        met = blocks.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket")
        before = ws.spark.conf.get(BATCH)
        ws.spark.conf.set(BATCH, ROWS)
        try:
            got = ws.save(met.mapInArrow(lean(fold(most, length, least, buckets, step)), kind), f"round-{length}")
        finally:
            ws.spark.conf.set(BATCH, before)
        kept = ws.save(got.where("body is null").select("lang", *columns, "n"), f"windows-{length}")
        rows = rows.unionByName(kept) if rows else kept
        blocks = got.where("body is not null")
        ws.drop(f"round-{length + 1}")
    sums = rows.rollup("lang", *columns).agg(F.sum("n").alias("f"), F.grouping_id().alias("rolled"))
    words = F.filter(F.array(*columns), lambda w: w.isNotNull())  # null where rolled up, empty where the window ended
    sums = sums.where("lang is not null").select("lang", F.size(words).alias("size"), words.alias("words"), "f")
    whole = ~F.array_contains("words", F.lit("")) & ((F.col("size") == 0) | (F.col("f") >= least))
    return ws.save(sums.where(whole).select("lang", "size", F.array_join("words", " ").alias("phrase"), "f"), "counts")


def collocations(docs: DataFrame, ws: Workspace, *, most: int = MOST, least: int = LEAST, top: int = TOP, inside: int = INSIDE, **sizes: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best `top` phrases of 2 to `most` words in each language.

    Texts lose the case of A to Z and fall into pieces at punctuation and line
    ends, pieces into words at spaces and tabs. A phrase seen a >= `least` times
    is a candidate; cut in two parts seen l and r times it scores
    floor(2000000 * a / (l + r)), and its worst cut counts (the first of equal
    ones). Candidates inside a longer one that is seen `inside` percent as often
    are dropped; a phrase is inside a longer one if it is inside one of one more
    word that is seen no less often, so only these are compared. Ties go to the
    larger a, then to the smaller phrase. Sums are whole numbers of any size.

    Null text is empty, a null language is `und`; repeated rows count as often
    as they stand; very long texts are read whole. Only lang and text are read
    of docs, so other columns may have any name. An empty table gives an empty
    one.
    """
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = phrase_counts(rows, ws, most=most, least=least, **sizes)
    known = counts.where("size > 0").select("lang", "phrase", "f")
    found = counts.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"))
    words = F.split("phrase", " ")
    part = lambda start, n: F.array_join(F.slice(words, start, n), " ")
    longer = found.where("size > 2").select("lang", F.explode(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1))).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    free = found.join(longer, ["lang", "phrase"], "left").where(F.coalesce(exact("around") * 100 < exact("a") * inside, F.lit(True)))
    cut = free.select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    cut = cut.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("cast((cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + r) as bigint)")
    worst = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    placed = worst.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    n = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return placed.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), Workspace(spark, "op12"))


SQL = r"""
with pieces as (
  select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as ws
  from (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents
  )
),
runs as (
  select lang, m as size, array_to_string(ws[i:i + m - 1], ' ') as phrase
  from (select lang, ws, m, unnest(range(1, len(ws) - m + 2)) as i from pieces, (select unnest([1, 2, 3, 4]) as m))
),
f as (select lang, size, phrase, count(*) as f from runs group by all),
n as (select lang, cast(sum(f) as bigint) as n from f where size = 1 group by lang),
c as (select lang, size, phrase, f as a, string_split(phrase, ' ') as ws from f where size > 1 and f >= 30),
inner_ as (
  select lang, phrase, max(a) as around
  from (select c.lang, array_to_string(ws[i:i + m - 1], ' ') as phrase, a from (select *, unnest(range(1, size - m + 2)) as i from c, (select unnest([2, 3]) as m) where m < size) as c)
  group by all
),
cuts as (select c.*, unnest(range(1, size)) as k from c),
scored as (
  select q.lang, q.phrase, q.a, q.k, x.f as l, y.f as r, cast((2000000::hugeint * q.a) // (x.f + y.f) as bigint) as score
  from cuts q
  join f x on x.lang = q.lang and x.phrase = array_to_string(q.ws[1:q.k], ' ')
  join f y on y.lang = q.lang and y.phrase = array_to_string(q.ws[q.k + 1:], ' ')
),
worst as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
ranked as (
  select w.*, row_number() over (partition by w.lang order by w.score desc, w.a desc, w.phrase) as rank
  from worst w left join inner_ i on i.lang = w.lang and i.phrase = w.phrase
  where i.around is null or 100::hugeint * i.around < 80::hugeint * w.a
)
select lang, rank, phrase, a, l, r, n, score from ranked join n using (lang) where rank <= 2000
"""
