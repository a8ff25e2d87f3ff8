"""Quality classifier: heuristic labellers, their accuracies by expectation-maximisation, a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import table
from quillmark.llm.quality import IS_SYMBOL, repeated_lines, repeated_words
from quillmark.llm.text import LOWER, NOT_SPACE, chunks, counts, mix, row_of, word_hashes, words

BUCKETS = 1 << 16
#: The scorer is fit on about FIT_ROWS documents, taken by a hash of doc_id and text, and on no more than twice as many.
FIT_ROWS, STEPS, PENALTY, THRESHOLD = 4096, 80, 1e-3, 0.5
#: P(abstain), P(bad), P(good) in good and in bad texts, before any text is seen.
PRIOR, PRIOR_SHARE, LEAST_LIFT = np.array([[0.38, 0.02, 0.6], [0.2, 0.3, 0.5]]), 0.02, 4.0
IS_UPPER = np.zeros(256, bool)
IS_UPPER[65:91] = True
IS_LETTER = np.zeros(256, bool)
IS_LETTER[65:91] = IS_LETTER[97:123] = IS_LETTER[128:] = True
IS_DIGIT = np.zeros(256, bool)
IS_DIGIT[48:58] = True
IS_END = np.zeros(256, bool)
IS_END[[ord(c) for c in ".!?,;:"]] = True

#: A labeller votes bad above `bad`, good below `good` (most never do), else it abstains: (name, good, bad).
NEVER = -np.inf
LABELLERS = [
    ("few words", 1 / 80, 1 / 50),
    ("symbols per character", NEVER, 0.03),
    ("words with symbols", NEVER, 0.2),
    ("characters that are no letters", 0.12, 0.25),
    ("repeated words", 0.1, 0.4),
    ("repeated lines", NEVER, 0.3),
    ("upper case per letter", NEVER, 0.4),
    ("no sentence marks", NEVER, -1 / 200),
    ("digits per character", NEVER, 0.2),
]

def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row for each labeller: what it looks at, larger is worse."""
    starts, ends, by_row = words(data, offsets)
    n = np.maximum(np.diff(by_row), 0)
    chars = np.maximum(counts(NOT_SPACE[data], offsets), 1)  # bytes: both shares below count bytes
    letters = np.maximum(counts(IS_LETTER[data], offsets), 1)
    raw = data.tobytes()
    lines = [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    marks = np.r_[0, np.cumsum(IS_SYMBOL[data])]
    marked = counts(marks[ends] > marks[starts], by_row)
    return np.array(
        [
            1 / np.maximum(n, 0.5),
            counts(IS_SYMBOL[data], offsets) / chars,
            marked / np.maximum(n, 1),
            1 - counts(IS_LETTER[data], offsets) / chars,
            repeated_words(word_hashes(data, starts, ends, lower=False), by_row) / np.maximum(n, 1),
            [repeated_lines(x) / (x.count(b"\n") + 1) for x in lines],
            counts(IS_UPPER[data], offsets) / letters,
            -counts(IS_END[data], offsets) / chars,
            counts(IS_DIGIT[data], offsets) / chars,
        ]
    )


def votes(m: np.ndarray) -> np.ndarray:
    """0 abstains, 1 bad, 2 good."""
    good, bad = (np.array([x[k] for x in LABELLERS])[:, None] for k in (1, 2))
    return np.where(m > bad, 1, np.where(m < good, 2, 0))


def pattern(v: np.ndarray) -> np.ndarray:
    return (v * 3 ** np.arange(len(v))[:, None]).sum(axis=0)


def unpack(p: np.ndarray) -> np.ndarray:
    return p[None, :] // 3 ** np.arange(len(LABELLERS))[:, None] % 3


def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: this task's count of each pattern of votes."""
    total = np.zeros(3 ** len(LABELLERS), np.int64)
    for batch in batches:
        for _, data, offsets in chunks(batch.column(0)):
            total += np.bincount(pattern(votes(measures(data, offsets))), minlength=len(total))
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["pattern", "n"])


def accuracies(v: np.ndarray, n: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Of patterns of votes and their counts: P(vote | good) and P(vote | bad) of each labeller, and the share of good.

    Labellers are taken to err independently. So that the two classes keep
    their meaning, PRIOR (as strong as PRIOR_SHARE of the documents) says that
    a vote for bad is rare in good texts, and a labeller's bad votes are at
    least LEAST_LIFT times as likely in bad texts as in good ones.
    """
    good, bad = np.tile(PRIOR[0], (len(v), 1)), np.tile(PRIOR[1], (len(v), 1))
    share, weight = 0.8, PRIOR_SHARE * max(1.0, n.sum())
    for _ in range(rounds):
        p = posterior(v, good, bad, share)
        for out, w, prior in ((good, n * p, PRIOR[0]), (bad, n * (1 - p), PRIOR[1])):
            for vote in range(3):
                out[:, vote] = ((v == vote) * w).sum(axis=1) + weight * prior[vote]
            out /= out.sum(axis=1, keepdims=True)
        low = np.minimum(good[:, 1], bad[:, 1] / LEAST_LIFT)
        good[:, 2] += good[:, 1] - low
        good[:, 1] = low
        share = float(np.clip((n * p).sum() / max(1, n.sum()), 0.01, 0.99))
    return good, bad, share


def posterior(v: np.ndarray, good: np.ndarray, bad: np.ndarray, share: float) -> np.ndarray:
    rows = np.arange(len(v))[:, None]
    odds = np.log(share / (1 - share)) + (np.log(good[rows, v]) - np.log(bad[rows, v])).sum(axis=0)
    return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of each row's byte trigrams (A-Z in lower case), with length 1."""
    low = np.r_[np.zeros(2, np.uint8), LOWER[data]].astype(np.uint64)
    rows = row_of(offsets)
    at = np.arange(len(data)) - offsets[rows]  # nothing of the text before
    gram = low[2:] | np.where(at > 0, low[1:-1], 0) << np.uint64(8) | np.where(at > 1, low[:-2], 0) << np.uint64(16)
    bucket = mix(gram + np.uint64(1)) & np.uint64(BUCKETS - 1)
    key, n = np.unique(rows.astype(np.uint64) << np.uint64(16) | bucket, return_counts=True)
    row, value = (key >> np.uint64(16)).astype(np.int64), np.sqrt(n)
    return row, (key & np.uint64(BUCKETS - 1)).astype(np.int64), value / np.sqrt(np.bincount(row, value**2))[row]


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: pattern of votes, buckets and values of each text."""
    for batch in batches:
        for _, data, offsets in chunks(batch.column(0)):
            row, bucket, value = hashed(data, offsets)
            at = np.searchsorted(row, np.arange(len(offsets))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(pattern(votes(measures(data, offsets))).astype(np.int32)), pa.ListArray.from_arrays(pa.array(at), pa.array(bucket.astype(np.int32))), pa.ListArray.from_arrays(pa.array(at), pa.array(value.astype(np.float32)))], ["pattern", "buckets", "values"])


def train(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer of soft labels; both classes weigh the same."""
    w, m, s, b = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0
    weight = label / max(label.sum(), 1e-9) + (1 - label) / max((1 - label).sum(), 1e-9)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-(np.bincount(row, w[bucket] * value, len(label)) + b)))
        off = (p - label) * weight
        g = np.bincount(bucket, off[row] * value, BUCKETS) + PENALTY * w / BUCKETS
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9) * (s > 0)
        b -= 2.0 * off.sum()
    return w, b


def scorer(model):
    """For mapInArrow: (doc_id, text) to doc_id, score and the weak label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b, good, bad, share = model.value
        for batch in batches:
            score, weak = np.zeros(len(batch)), np.zeros(len(batch))
            for first, data, offsets in chunks(batch.column(1)):
                rows = slice(first, first + len(offsets) - 1)
                row, bucket, value = hashed(data, offsets)
                score[rows] = 1 / (1 + np.exp(-(np.bincount(row, w[bucket] * value, len(offsets) - 1) + b)))
                weak[rows] = posterior(votes(measures(data, offsets)), good, bad, share)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(weak)], ["doc_id", "score", "weak_label"])

    return run


def fit(docs: DataFrame, n_docs: int):
    """(weights, bias, P(vote | good), P(vote | bad), share of good)."""
    found = docs.select("text").mapInArrow(patterns, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    v = unpack(np.array([r.pattern for r in found], np.int64))  # a row for each pattern, 3 ** labellers at most
    good, bad, of_good = accuracies(v, np.array([r.n for r in found], float))
    share = min(1.0, FIT_ROWS / max(1, n_docs))
    part = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000_000)) < F.lit(int(1_000_000_000 * share))).limit(2 * FIT_ROWS)
    got = part.select("text").mapInArrow(features, "pattern int, buckets array<int>, values array<float>").toArrow()  # at most 2 * FIT_ROWS rows
    label = posterior(unpack(got["pattern"].to_numpy().astype(np.int64)), good, bad, of_good)
    sizes = got["buckets"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    flat = lambda c: got[c].combine_chunks().flatten().to_numpy()
    w, b = train(np.repeat(np.arange(len(label)), sizes), flat("buckets").astype(np.int64), flat("values").astype(float), label)
    return w, b, good, bad, of_good


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, score, weak_label, kept for every row of docs; kept if the score is at least THRESHOLD.

    All texts' votes are counted (a bounded number of patterns) to learn how far
    each labeller can be trusted; the posterior label of a bounded sample trains
    the scorer, which then scores all texts. Null text is empty and scores as
    such. Repeated rows give a row each, and rows with one text the same score;
    a score of THRESHOLD itself is kept. Very long texts are read whole. Only
    doc_id and text are read. An empty table gives an empty one.
    """
    docs = docs.select("doc_id", "text")
    model = fit(docs, docs.count())
    out = docs.mapInArrow(scorer(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double, weak_label double")
    return out.withColumn("kept", F.col("score") >= THRESHOLD)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))
