"""Packing documents into sequences of one length: patterns by non-negative least squares, the rest greedily."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import Workspace, lean, prefix_sums, table

WINDOW, UNIT, DEPTH, END_ID = 2048, 128, 4, 1
SCHEMA = (
    "doc_id long, doc_tokens long, window_crcs array<long>, units int, body_crc long, head_crcs array<long>, end_crcs array<long>, tail binary"
)


# How a tokenizer must be defined so that a text's ids are its words' ids in a row.
LOWER_WORDS = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
NO_SPACE = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: What may follow letters as a token of its own there (no apostrophe: 's and the like are tokens).
PUNCTUATION = ".,;:!?*$%&#|<>()[]{}=+/\\\"-_@^~"
#: Byte-level BPE writes a byte that is no visible character as one from 256 on, in order.
BYTE_LEVEL = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}


@cache
def tokenizer_of(path: str):
    """One for each Python worker, and whether it drops white space and lets no token span it."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    made = json.loads(t.to_str())
    return t, made["normalizer"] == LOWER_WORDS and made["pre_tokenizer"] == NO_SPACE and made["model"]["type"] == "BPE"


class Ids:
    """Ids of texts as little-endian unsigned 32-bit bytes; those of words are kept from their first use.

    Words that are tokenized and words that are put together from others (with
    capitals or punctuation) have a memory each; a full one loses its older
    half. A tokenizer of another kind than LOWER_WORDS and NO_SPACE gets whole
    texts.
    """

    def __init__(self, path: str, most: int = 400_000, most_forms: int = 100_000) -> None:
        self.tokenizer, self.by_word = tokenizer_of(path)
        self.known, self.forms, self.most, self.most_forms = {}, {}, most, most_forms

    def encoded(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def word(self, word: bytes) -> bytes:
        return self.known.get(word) or self.forms.get(word) or self.learn(word)

    def learn(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        stem = text.rstrip(PUNCTUATION)
        low = stem.lower()
        if not low.isalpha() or max(low) >= "\u0250":
            out = self.encoded(text)
        elif stem != text:  # letters and what follows them are tokens of their own
            return self.keep(self.forms, self.most_forms, word, self.word(low.encode()) + self.word(text[len(stem) :].encode()))
        elif low != stem:  # Latin letters fold alone
            return self.keep(self.forms, self.most_forms, word, self.word(low.encode()))
        else:  # nothing to normalise or to split: straight to the vocabulary
            ids = [t.id for t in self.tokenizer.model.tokenize(word.decode("latin-1").translate(BYTE_LEVEL))]
            out = struct.pack(f"<{len(ids)}I", *ids)
        return self.keep(self.known, self.most, word, out)

    @staticmethod
    def keep(memory: dict, most: int, word: bytes, out: bytes) -> bytes:
        if len(memory) >= most:
            for old in list(islice(memory, most // 2)):
                del memory[old]
        memory[word] = out
        return out

    def text(self, text: bytes) -> bytes:
        if not self.by_word:
            return self.encoded(text.decode("utf-8", "replace"))
        if b"<|" not in text:  # special tokens' names stay as they are; else A-Z fold alone
            text = text.lower()
        known, forms, learn = self.known.get, self.forms.get, self.learn
        return b"".join([known(w) or forms(w) or learn(w) for w in text.split()])


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut_documents(path: str, window: int, unit: int, end_id: int):
    """For mapInArrow: each document's whole windows, the body of whole units that follows, and the tail of ids."""
    last = np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(path)  # its memory goes with the task
        schema = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("window_crcs", pa.list_(pa.int64())), ("units", pa.int32()), ("body_crc", pa.int64()), ("head_crcs", pa.list_(pa.int64())), ("end_crcs", pa.list_(pa.int64())), ("tail", pa.binary())])
        w, u = 4 * window, 4 * unit
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                x = ids.text(text.as_py() or b"") + last
                whole = len(x) // w * w
                units = (len(x) - whole) // u
                body, tail = x[whole : whole + units * u], x[whole + units * u :]
                row = (
                    doc_id,
                    len(x) // 4,
                    [zlib.crc32(x[i : i + w]) for i in range(0, whole, w)],
                    units,
                    zlib.crc32(body),
                    [zlib.crc32(body[: i * u]) for i in range(1, units)],
                    [zlib.crc32(body[i * u :]) for i in range(1, units)],
                    tail,
                )
                for column, value in zip(out, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return run


def combinations(parts: int, depth: int, most: int | None = None) -> Iterator[tuple[int, ...]]:
    """Falling sequences of at most depth numbers below `parts` that add up to it."""
    total, most = parts, parts - 1 if most is None else most
    stack: list[tuple[tuple[int, ...], int, int]] = [((), total, most)]
    while stack:
        taken, left, top = stack.pop()
        if not left:
            yield taken
        elif len(taken) < depth:
            stack += [((*taken, x), left - x, x) for x in range(1, min(top, left) + 1)]


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 with a small ||ax - b||: accelerated projected gradient steps of a fixed number."""
    ata, atb = a.T @ a, a.T @ b
    step = 1.0 / np.linalg.eigvalsh(ata)[-1]
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * (ata @ y - atb))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan_patterns(histogram: np.ndarray, parts: int, depth: int) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """(pattern, repeats), and how many bodies of each class (units) they use; histogram[c]: bodies of c units."""
    patterns = sorted(combinations(parts, depth))
    a = np.array([[p.count(c) for p in patterns] for c in range(1, parts)], float)
    x = np.floor(non_negative_least_squares(a, histogram[1:].astype(float)) + 1e-9).astype(np.int64)
    used, plan = np.zeros(parts, np.int64), []
    for p, n in sorted(zip(patterns, x), key=lambda v: (-v[1], v[0])):
        need = np.bincount(p, minlength=parts)
        n = min([int(n), *[int((histogram[c] - used[c]) // need[c]) for c in np.flatnonzero(need)]])
        if n > 0:
            used += need * n
            plan.append((p, n))
    return plan, used


def pack(docs: DataFrame, ws: Workspace, *, path: str | None = None, window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and end_id. It is cut into whole windows, which are
    sequences of their own; then a body of whole units (less than a window);
    then a tail of less than a unit. Bodies are classed by their units. The
    combinations of at most `depth` classes that fill a window exactly, and
    how often to repeat each, come from non-negative least squares against the
    histogram of classes (one number for each class goes to the driver),
    rounded down. Bodies beyond that, class by class, and then all tails are
    packed greedily in one row, cut where a sequence is full; so only the very
    last sequence is padded.

    Places come from closed forms and distributed prefix sums. The texts are
    read once and not shuffled: crc32 of every piece that a cut can make is
    known where the text is read, or the ids of the tail are kept.

    Null text is empty: one id. Repeated rows are documents of their own, and
    equal bodies keep the order in which they were read. Very long texts are cut
    into whole windows and a rest. Only doc_id and text are read of docs. An
    empty table gives no pieces.
    """
    parts = window // unit
    cut = docs.select("doc_id", "text").mapInArrow(lean(cut_documents(path or tokenizer_path(), window, unit, end_id)), SCHEMA)
    cut = cut.withColumn("row_no", F.monotonically_increasing_id()).withColumn("q_part", F.spark_partition_id())
    cut = ws.save(cut, "cut")
    cut = cut.withColumn("n_windows", F.size("window_crcs").cast("long")).withColumn("n_tail", (F.octet_length("tail") / 4).cast("long"))
    cut = cut.withColumn("one", F.lit(1).cast("long"))

    sums = cut.groupBy("units").agg(F.count("*").alias("n"), F.sum("n_windows").alias("n_windows")).collect()  # a row for each class
    histogram = np.zeros(parts, np.int64)
    for r in sums:
        histogram[r.units] = r.n
    all_windows = sum(r.n_windows for r in sums)
    plan, used = plan_patterns(histogram, parts, depth)

    spark, slots, base = docs.sparkSession, [], all_windows
    taken = np.zeros(parts, np.int64)
    for p, n in plan:
        at = 0
        for c in p:
            slots.append((int(c), int(taken[c]), int(taken[c] + n), base, at * unit))
            taken[c] += n
            at += c
        base += n
    loose, left = [], 0
    for c in range(1, parts):
        loose.append((c, int(used[c]), left))
        left += c * int(histogram[c] - used[c])
    # both have a bounded number of rows: slots at most depth for each pattern, loose one for each class
    slots = F.broadcast(spark.createDataFrame(slots, "slot_units int, lo long, hi long, slot_base long, slot_offset long"))
    loose = F.broadcast(spark.createDataFrame(loose, "loose_units int, n_used long, loose_base long"))

    placed = prefix_sums(cut, [], ["row_no"], {"windows_before": "n_windows", "tails_before": "n_tail"})
    placed = prefix_sums(placed, ["units"], ["row_no"], {"rank": "one"})
    placed = placed.join(slots, (F.col("units") == F.col("slot_units")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left")
    placed = placed.join(loose, F.col("units") == F.col("loose_units"), "left")

    def piece(start: Column, length: Column, crc: Column, sequence: Column, offset: Column) -> Column:
        return F.struct(*[c.cast("long").alias(k) for c, k in ((start, "start"), (length, "length"), (crc, "ids_crc32"), (sequence, "sequence_id"), (offset, "offset"))])

    zero = F.lit(0)
    windows = F.transform("window_crcs", lambda crc, i: piece(i * window, F.lit(window), crc, F.col("windows_before") + i, zero))
    body_start = F.col("n_windows") * window
    fits = piece(body_start, F.col("units") * unit, F.col("body_crc"), F.col("slot_base") + F.col("rank") - F.col("lo"), F.col("slot_offset"))

    def in_row(first: Column, n: Column, start: Column, crc_all: Column, crc_head, crc_end) -> Column:
        """Pieces of n ids at place `first` of the greedy row; cut in two where a sequence ends inside."""
        at = F.pmod(first, F.lit(window))
        seq = F.lit(base) + F.floor(first / window)
        head = F.lit(window) - at
        whole = F.array(piece(start, n, crc_all, seq, at))
        two = F.array(piece(start, head, crc_head(head), seq, at), piece(start + head, n - head, crc_end(head), seq + 1, zero))
        return F.when(n <= head, whole).otherwise(two)

    loose_at = (F.col("loose_base") + (F.col("rank") - F.col("n_used")) * F.col("units")) * unit
    crc_at = lambda name: lambda head: F.get(F.col(name), (head / unit).cast("int") - 1)
    body = F.when(F.col("units") == 0, F.array().cast("array<struct<start:long,length:long,ids_crc32:long,sequence_id:long,offset:long>>"))
    body = body.when(F.col("slot_base").isNotNull(), F.array(fits))
    body = body.otherwise(in_row(loose_at, F.col("units") * unit, body_start, F.col("body_crc"), crc_at("head_crcs"), crc_at("end_crcs")))
    tail_at = F.lit(left * unit) + F.col("tails_before")
    part = lambda a, n: F.crc32(F.substr("tail", (a * 4 + 1).cast("int"), (n * 4).cast("int")))
    tail = in_row(tail_at, F.col("n_tail"), body_start + F.col("units") * unit, F.crc32("tail"), lambda head: part(zero, head), lambda head: part(head, F.col("n_tail") - head))
    tail = F.when(F.col("n_tail") > 0, tail).otherwise(F.array().cast("array<struct<start:long,length:long,ids_crc32:long,sequence_id:long,offset:long>>"))
    pieces = placed.select("doc_id", "doc_tokens", F.explode(F.concat(windows, body, tail)).alias("p"))
    return pieces.select("doc_id", "p.start", "p.length", "p.ids_crc32", "doc_tokens", "p.sequence_id", "p.offset")


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), Workspace(spark, "op7"))
