"""Quality rules: counts from the text, and perplexity by a modified Kneser-Ney model within bands of its language.

The model is one of pairs of words. Words fall into 2 ** CLASS_BITS classes by a
hash of the word and its language, so what belongs to single words (continuation
counts, back-off weights) is an array of fixed length that may be broadcast. The
pairs grow with the corpus: they are counted in Spark and kept as sorted arrays
of their hashes, in ranges that no one holds all of. Texts fall into two halves
by a hash and each is scored by the counts of the other half, so that no text
vouches for itself or its copies.

A pair's hash has 2 * CLASS_BITS bits and is a bijection of its two classes, so a
range of hashes is an even share of all pairs, however common a word is, and
sorted hashes are stored as small differences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import Workspace, lean, table
from quillmark.llm.text import NOT_SPACE, chunks, counts, mix, row_of, windows, word_hashes, words

CLASS_BITS = 20
CLASSES = 1 << CLASS_BITS
#: Texts are read in chunks of so many bytes; a range of pairs is for so many bytes of text; texts are scored in so many rounds.
CHUNK, RANGE, ROUNDS = 2 << 20, 8 << 20, 4
#: Bands in quartile distances beyond the quartile, at least so wide in nats a word, and what chance allows short texts.
SPREADS, LEAST_BAND, SHORT_BAND = 2.0, 0.6, 9.0
#: Statistics of classes travel in so many pieces.
PIECES = 64

IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
STARTS_CHAR = (np.arange(256) & 0xC0) != 0x80
#: First bytes of characters that are words of their own: scripts without spaces (kana, Han), and beyond the basic plane.
WIDE = np.zeros(256, np.int64)
WIDE[0xE3:0xEA], WIDE[0xF0:0xF5] = 3, 4
U64 = np.uint64
PAIR_MASK = U64((1 << 2 * CLASS_BITS) - 1)
STEPS = (0x9E3779B97F, 0xC2B2AE3D27)


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Classes of two words to a hash that no other two have."""
    x = left << U64(CLASS_BITS) | right
    for m in STEPS:
        x = (x ^ x >> U64(CLASS_BITS)) * U64(m) & PAIR_MASK
    return x ^ x >> U64(CLASS_BITS)


def pair_classes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of pair_hash."""
    x = x ^ x >> U64(CLASS_BITS)
    for m in reversed(STEPS):
        x = x * U64(pow(m, -1, 1 << 2 * CLASS_BITS)) & PAIR_MASK
        x = x ^ x >> U64(CLASS_BITS)
    return (x >> U64(CLASS_BITS)).astype(np.int64), (x & U64(CLASSES - 1)).astype(np.int64)


def squeezed(numbers: np.ndarray) -> bytes:
    """Numbers that aren't negative, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueezed(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def steps(ascending: np.ndarray) -> bytes:
    return squeezed(np.diff(ascending.astype(U64), prepend=U64(0)))


def unstepped(blob: bytes) -> np.ndarray:
    return np.cumsum(unsqueezed(blob), dtype=U64)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """words(), where each WIDE character is a word."""
    starts, ends, by_row = words(data, offsets)
    wide = np.flatnonzero(WIDE[data])
    if not len(wide):
        return starts, ends, by_row
    after = wide + WIDE[data[wide]]
    after = after[after < len(data)]
    new = np.unique(np.concatenate([starts, wide, after[NOT_SPACE[data[after]]]]))
    word_ends = ends[np.searchsorted(ends, new, "right")]
    return new, np.minimum(np.r_[new[1:], len(data)], word_ends), np.searchsorted(new, offsets)


def pairs(data: np.ndarray, offsets: np.ndarray, langs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and the classes of the two words of every pair; the first word's pair is with the start of the text."""
    starts, ends, by_row = tokens(data, offsets)
    rows = row_of(by_row)
    salt = mix(langs.view(U64))
    right = mix(word_hashes(data, starts, ends, lower=True) ^ salt[rows]) >> U64(64 - CLASS_BITS)
    left = np.empty_like(right)
    left[1:] = right[:-1]
    full = np.flatnonzero(np.diff(by_row))
    left[by_row[:-1][full]] = mix(salt[full] + U64(1)) >> U64(64 - CLASS_BITS)
    return rows, left, right


def ranges_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Where each of n even ranges of hashes begins in the sorted hashes, and the end."""
    edges = [-(-(k << 2 * CLASS_BITS) // n) for k in range(n)]
    return np.r_[np.searchsorted(hashes, np.array(edges, U64)), len(hashes)]


COUNTS = "half int, place int, hashes binary, counts binary"


def count_pairs(n_ranges: int):
    """For mapInArrow over half, q_lang and text: sorted pairs and their counts, chunk by chunk, for each half and range."""
    schema = pa.schema([("half", pa.int32()), ("place", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half, langs = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for first, data, offsets in chunks(batch.column(2), CHUNK):
                rows, left, right = pairs(data, offsets, langs[first : first + len(offsets) - 1])
                own, out = half[first + rows], []
                for h in (0, 1):
                    seen, n = np.unique(pair_hash(left[own == h], right[own == h]), return_counts=True)
                    at = ranges_of(seen, n_ranges)
                    out += [(h, i, steps(seen[a:b]), squeezed(n[a:b])) for i, (a, b) in enumerate(zip(at[:-1], at[1:])) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 4, schema)], schema=schema)

    return run


def grouped(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows of sorted batches, by runs of equal keys."""
    return groupby((r for b in batches for r in b.to_pylist()), lambda r: tuple(r[k] for k in keys))


class Statistics:
    """Of the classes in one half: counts as a left word, its kinds of pairs seen once, twice and more often, and kinds of pairs as a right word; and how many pairs were seen once to four times."""

    def __init__(self, half: int) -> None:
        self.half, self.of, self.seen = half, np.zeros((5, CLASSES), np.int64), np.zeros(4, np.int64)

    def add(self, hashes: np.ndarray, n: np.ndarray) -> None:
        left, right = pair_classes(hashes)
        np.add.at(self.of[0], left, n.astype(np.int64))
        for k in (1, 2, 3):
            np.add.at(self.of[k], left[(n == k) if k < 3 else (n >= 3)], 1)
        np.add.at(self.of[4], right, 1)
        self.seen += [(n == k).sum() for k in (1, 2, 3, 4)]

    def rows(self) -> list[tuple]:
        """(half, -1 - piece, classes, their counts); the counts of counts end the first piece's."""
        some = np.flatnonzero(self.of.any(axis=0))
        at = np.searchsorted(some, np.arange(PIECES + 1) * (CLASSES // PIECES))
        cut = enumerate(zip(at[:-1], at[1:]))
        return [(self.half, -1 - i, steps(some[a:b]), squeezed(np.r_[self.of[:, some[a:b]].ravel(), self.seen * (i == 0)])) for i, (a, b) in cut if b > a or i == 0]

    def take(self, classes: bytes, numbers: bytes) -> None:
        """Adds a row of rows()."""
        at, n = unstepped(classes).astype(np.int64), unsqueezed(numbers).astype(np.int64)
        self.of[:, at] += n[:-4].reshape(5, -1)
        self.seen += n[-4:]


def merge_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over COUNTS sorted by half and place: each range's sorted pairs, and at negative places this task's Statistics."""
    for half, ranges in groupby(grouped(batches, "half", "place"), lambda g: g[0][0]):
        stats = Statistics(half)
        for (_, place), rows in ranges:
            got = [(unstepped(r["hashes"]), unsqueezed(r["counts"])) for r in rows]
            hashes, at = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
            n = np.bincount(at, np.concatenate([g[1] for g in got])).astype(U64)
            stats.add(hashes, n)
            yield arrow(COUNTS, [(half, place, steps(hashes), squeezed(n))])
        yield arrow(COUNTS, stats.rows())


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over Statistics.rows() sorted by half and place: their sums."""
    for (half, place), rows in grouped(batches, "half", "place"):
        stats = Statistics(half)
        for r in rows:
            stats.take(r["hashes"], r["counts"])
        yield arrow(COUNTS, [r for r in stats.rows() if r[:2] == (half, place)])


KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}


def arrow(ddl: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [(n, KINDS[t]) for n, t in (f.split() for f in ddl.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows) if rows else [[]] * len(fields), fields)], schema=pa.schema(fields))


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and 3 or more, from how many were seen once to four times."""
    if min(n) == 0:
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return np.r_[0.0, np.clip(d, 0.01, [0.99, 1.99, 2.99])]


@dataclass
class Words:
    """What belongs to single classes in the model of one half; all of fixed length."""

    log_p: np.ndarray  # as right word: log of the lowest order's probability
    log_back_off: np.ndarray  # as left word: log of the share that its unseen pairs get
    left_over: np.ndarray  # as left word: that share times its count
    discount: np.ndarray


def words_of(of: np.ndarray, seen: np.ndarray) -> Words | None:
    """From summed Statistics of a half; none if it has no text."""
    total, once, twice, more, kinds = of.astype(float)
    if not kinds.any():
        return None
    d = discounts(seen)
    left_over = d[1] * once + d[2] * twice + d[3] * more
    low = discounts(np.array([(kinds == k).sum() for k in (1, 2, 3, 4)]))
    cut = low[np.minimum(kinds, 3).astype(int)]
    p = (kinds - cut + cut.sum() / CLASSES) / kinds.sum()
    back_off = np.divide(left_over, total, out=np.ones(CLASSES), where=total > 0)
    return Words(np.log(p).astype(np.float32), np.log(back_off).astype(np.float32), left_over.astype(np.float32), d)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with q_key and q_key_too (128 bits of the text), q_lang (a hash), and q_round; half is its last bit."""
    text = F.coalesce("text", F.lit(""))
    out = docs.withColumns({"q_key": F.xxhash64(text), "q_key_too": F.xxhash64(F.lit(1), text), "q_lang": F.xxhash64("lang")})
    return out.withColumn("q_round", F.pmod("q_key_too", F.lit(ROUNDS)).cast("int"))


@dataclass
class Model:
    pairs: DataFrame  # COUNTS: each half's ranges of sorted pairs
    words: list[Words | None]  # for each half
    n_ranges: int


def fit(docs: DataFrame, ws: Workspace) -> Model:
    """The models of both halves of docs (lang, text)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_ranges = 1 + size // 2 // RANGE
    rows = keyed(docs.select("lang", "text")).select((F.col("q_round") % 2).alias("half"), "q_lang", "text")
    found = rows.mapInArrow(lean(count_pairs(n_ranges)), COUNTS).repartition("half", "place").sortWithinPartitions("half", "place")
    got = ws.save(found.mapInArrow(lean(merge_pairs), COUNTS), "pairs")
    stats = got.where("place < 0").repartition(2 * PIECES, "half", "place").sortWithinPartitions("half", "place").mapInArrow(lean(add_up), COUNTS)
    totals = [Statistics(h) for h in (0, 1)]
    for r in stats.collect():  # 2 * PIECES rows, of at most CLASSES classes in all
        totals[r.half].take(r.hashes, r.counts)
    return Model(got.where("place >= 0"), [words_of(t.of, t.seen) for t in totals], n_ranges)


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words of each row in 3-word windows that the row holds twice or more."""
    n, rows = len(hashes), row_of(offsets)
    covered = np.zeros(n, bool)
    if n >= 3:
        at = np.flatnonzero(rows[:-2] == rows[2:])
        key = windows(hashes, 3)[at] ^ mix(rows[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        again = at[order[np.flatnonzero(np.r_[False, same] | np.r_[same, False])]]
        for k in range(3):
            covered[again + k] = True
    return counts(covered, offsets)


def repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def measured(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """STATS of each row."""
    starts, ends, by_row = words(data, offsets)
    raw = data.tobytes()
    return [
        np.diff(by_row),
        counts(NOT_SPACE[data] & STARTS_CHAR[data], offsets),
        counts(IS_SYMBOL[data], offsets),
        np.array([repeated_lines(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], np.int64),
        repeated_words(word_hashes(data, starts, ends, lower=False), by_row),
    ]


SCORES = ", ".join(["q_key long, q_key_too long, doc_id long, lang string", *[f"q_{s} long" for s in STATS], "q_n_tokens long, q_nll double, q_nll_one double"])
ASKED = "place int, part long, hashes binary, counts binary, docs binary"


def ask(model, n_ranges: int):
    """For mapInArrow over q_key, q_key_too, doc_id, lang, q_lang and text: what is known of each text without pairs, and its pairs by range.

    A chunk of texts is a part. Its row at a negative place holds SCORES, where
    q_nll lacks the gains of seen pairs; the others hold a range of its pairs,
    sorted, with counts and each one's text (its number in the part).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = model.value, TaskContext.get().partitionId() << 32
        for batch in batches:
            langs = batch.column(4).to_numpy(zero_copy_only=False)
            for first, data, offsets in chunks(batch.column(5), CHUNK):
                n, part = len(offsets) - 1, part + 1
                rows, left, right = pairs(data, offsets, langs[first : first + n])
                size = np.bincount(rows, minlength=n)
                one, all_ = np.full(n, np.nan), np.full(n, np.nan)
                if own:
                    some = np.maximum(size, 1)
                    one = -np.bincount(rows, own.log_p[right], n) / some
                    all_ = one - np.bincount(rows, own.log_back_off[left], n) / some
                    one[size == 0] = all_[size == 0] = np.nan
                head = [*[c.slice(first, n) for c in batch.columns[:4]], *map(pa.array, [*measured(data, offsets), size]), *(pa.array(x, from_pandas=True) for x in (all_, one))]
                sink = pa.BufferOutputStream()
                head = pa.RecordBatch.from_arrays(head, [f.split()[0] for f in SCORES.split(", ")])
                with pa.ipc.new_stream(sink, head.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(head)
                found = [(-1 - part % 997, part, sink.getvalue().to_pybytes(), None, None)]
                if own and len(rows):
                    h = pair_hash(left, right)
                    order = np.lexsort((rows, h))
                    h, rows = h[order], rows[order]
                    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])])
                    times, h, rows = np.diff(np.r_[new, len(h)]), h[new], rows[new]
                    at = ranges_of(h, n_ranges)
                    found += [(i, part, steps(h[a:b]), squeezed(times[a:b]), squeezed(rows[a:b])) for i, (a, b) in enumerate(zip(at[:-1], at[1:])) if b > a]
                yield arrow(ASKED, found)

    return run


def answer(model):
    """For mapInArrow over ASKED sorted by place and part, where part -1 is the model's range: heads as they are, and each part's sums of gains by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for (place,), rows in grouped(batches, "place"):
            known, gain = np.zeros(0, U64), np.zeros(0)
            for r in rows:
                if place < 0:
                    yield arrow(ASKED, [tuple(r.values())])
                elif r["part"] < 0:
                    known, n = unstepped(r["hashes"]), unsqueezed(r["counts"])
                    left, right = pair_classes(known)
                    more = (n - own.discount[np.minimum(n, 3).astype(int)]) / own.left_over[left]
                    gain = np.log1p(more / np.exp(own.log_p[right].astype(float)))
                elif len(known):
                    h = unstepped(r["hashes"])
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    hit = known[at] == h
                    docs = unsqueezed(r["docs"])[hit].astype(np.int64)
                    sums = np.bincount(docs, gain[at[hit]] * unsqueezed(r["counts"])[hit])
                    docs = np.unique(docs)
                    if len(docs):
                        yield arrow(ASKED, [(place, r["part"], None, squeezed(np.rint(sums[docs] * 1e4).astype(np.int64)), steps(docs))])

    return run


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over answer()'s rows sorted by part: SCORES. Gains are added as whole numbers, in any order."""
    for _, rows in grouped(batches, "part"):
        head, gains = None, []
        for r in rows:
            if r["hashes"] is not None:
                head = pa.ipc.open_stream(r["hashes"]).read_next_batch()
            else:
                gains.append((unstepped(r["docs"]).astype(np.int64), unsqueezed(r["counts"]).astype(np.int64)))
        total = np.zeros(head.num_rows, np.int64)
        for docs, sums in gains:
            total[docs] += sums
        size = np.maximum(head["q_n_tokens"].to_numpy(), 1)
        nll = head["q_nll"].to_numpy(zero_copy_only=False) - total / 1e4 / size
        yield head.set_column(head.schema.get_field_index("q_nll"), "q_nll", pa.array(nll, from_pandas=True))


def scores(docs: DataFrame, model: Model, ws: Workspace) -> DataFrame:
    """SCORES of every row of docs (doc_id, lang, text).

    Texts ask for the gains of their pairs, range by range: only hashes move,
    and neither texts nor the model meet in one place. A round takes texts of
    one half, so that the shuffles of one round only are on disk.
    """
    spark, out = docs.sparkSession, None
    rows = keyed(docs.select("doc_id", "lang", "text"))
    for k in range(ROUNDS):
        other = 1 - k % 2
        words_ = spark.sparkContext.broadcast(model.words[other])  # of fixed size
        asked = rows.where(F.col("q_round") == k).select("q_key", "q_key_too", "doc_id", "lang", "q_lang", "text").mapInArrow(lean(ask(words_, model.n_ranges)), ASKED)
        held = model.pairs.where(F.col("half") == other).select("place", F.lit(-1).cast("long").alias("part"), "hashes", "counts", F.lit(None).cast("binary").alias("docs"))
        met = asked.union(held).repartition("place").sortWithinPartitions("place", "part")
        answers = met.mapInArrow(lean(answer(words_)), ASKED).repartition("part").sortWithinPartitions("part")
        got = ws.save(answers.mapInArrow(lean(settle), SCORES), f"scores-{k}")
        out = out.union(got) if out else got
    return out


def base_failed() -> Column:
    return (F.col("q_n_words") < 50) | (100 * F.col("q_n_repeat_words") > 50 * F.col("q_n_words"))


def bands(rows: DataFrame) -> DataFrame:
    """q_band_lang, q_all and q_one: the quartiles of both scores of each language, to a thousandth.

    Quartiles come from counts of different values, which are few.
    """
    usable = rows.where(~base_failed() & F.col("q_nll").isNotNull())
    quartiles = lambda c: F.percentile(F.round(c, 3), F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    return usable.groupBy(F.col("lang").alias("q_band_lang")).agg(quartiles("q_nll").alias("q_all"), quartiles("q_nll_one").alias("q_one"))


def judged(rows: DataFrame, band: DataFrame) -> DataFrame:
    """rows with q_low, q_high, q_base_failed and q_kept.

    Both limits are of the language: the quartile, and SPREADS times its
    distance from the median beyond (LEAST_BAND at least), and what chance
    allows a text of its length: a mean over n words strays by about
    1 / sqrt(n), of which SHORT_BAND times are allowed. q_high is for the whole
    model; q_low for its lowest order, where a text with copies scores as
    others do, and dull repetition of common words scores low. A language has
    its own band, however few its texts; one whose texts have no score, as the
    other half is empty, has nothing to hold them against.
    """
    out = rows.join(band, rows.lang.eqNullSafe(band.q_band_lang), "left")
    short = SHORT_BAND / F.sqrt(F.greatest(F.col("q_n_tokens"), F.lit(1)))

    def limit(c: str, quartile: int) -> Column:
        q, middle = F.get(c, F.lit(quartile)), F.get(c, F.lit(1))
        wide = F.greatest(F.abs(q - middle) * SPREADS, F.lit(LEAST_BAND)) + short
        return q + wide if quartile == 2 else q - wide

    out = out.withColumns({"q_low": limit("q_one", 0), "q_high": limit("q_all", 2), "q_base_failed": base_failed()})
    verdict = F.coalesce((F.col("q_nll") <= F.col("q_high")) & (F.col("q_nll_one") >= F.col("q_low")), F.lit(True))
    return out.withColumn("q_kept", ~F.col("q_base_failed") & verdict).select(*rows.columns, "q_low", "q_high", "q_base_failed", "q_kept")


def judge(docs: DataFrame, ws: Workspace) -> tuple[DataFrame, Model, DataFrame]:
    """Every row's counts, scores and verdict without its text; the model; the bands.

    Null text is empty. Repeated rows count as documents of their own, and the
    verdict of all rows with one text and language is the same. Ties on a limit
    pass. A null language is a language. Very long texts are read whole, in a
    chunk of their own. Of docs only doc_id, lang and text are read, so other
    columns may have any name. An empty table gives an empty one.
    """
    model = fit(docs, ws)
    rows = scores(docs, model, ws)
    band = ws.save(bands(rows), "bands")
    return judged(rows, band), model, band


def keep_good(docs: DataFrame, ws: Workspace) -> DataFrame:
    """The rows of docs that pass, with their columns, whatever their names."""
    verdicts, _, _ = judge(docs, ws)
    key = ["q_key", "q_key_too", "q_lang"]
    gone = ws.save(verdicts.where("not q_kept").select("q_key", "q_key_too", F.xxhash64("lang").alias("q_lang")).distinct(), "gone")
    rows = keyed(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("q_row"), "lang", "text")).drop("lang", "text")
    return rows.join(gone, key, "left_anti").select("q_row.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, _ = judge(table(spark, sf_dir, "documents"), Workspace(spark, "op9"))
    return rows.select("doc_id", *[F.col(f"q_{s}").alias(s) for s in STATS], F.col("q_base_failed").alias("base_failed"), F.col("q_kept").alias("kept"), F.col("q_nll").alias("nll"), F.col("q_nll_one").alias("nll_one"))
