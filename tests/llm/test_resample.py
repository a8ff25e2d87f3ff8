import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from quillmark.llm import resample as r
from quillmark.llm.common import Workspace

SCHEMA = "doc_id long, text string, weight string, q_row int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def buckets(text, most=1, n=10_000):
    words = WORD.findall(lowered(text))
    runs = [" ".join(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1)]
    return [zlib.crc32(x.encode()) % n for x in runs], len(words)


def brute(docs, target, most=1, percent=10, least=20):
    """(doc_id, n_features, weight, score, rank) by plain Python."""
    own = [(d, *buckets(t, most)) for d, t in docs]
    s, t = Counter(b for _, x, _ in own for b in x), Counter(b for x in target for b in buckets(x, most)[0])
    all_s, all_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    rows = []
    for d, x, n in own:
        weight = sum(map(gain, x)) // len(x) if x else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    drawn = sorted((x for x in rows if x[4] >= least), key=lambda x: (-x[3], x[0] is not None, x[0]))
    drawn = drawn[: percent * len(drawn) // 100]
    rank = {id(x): i + 1 for i, x in enumerate(drawn)}
    return sorted(((*x[:4], rank.get(id(x))) for x in rows), key=repr)


def got(df):
    return sorted(((x.doc_id, x.n_features, x.weight, x.score, x.rank) for x in df.collect()), key=repr)


def made(n, seed=3):
    rng = random.Random(seed)
    parts = ["Alpha", "beta", "ÉTÉ", "été", "42", "x_y", "日本", "\x00", "\xa0", ".", "...", "a" * 2000, "B" * 1500, "\n"]
    return [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("most", [1, 3])
def test_against_brute_force(spark, most):
    texts = [None, "", "w " * 200_000, "Z" * 300_000, *made(300)]
    docs, target = list(enumerate(texts)), ["beta alpha 42 42", "x y été", None, ""]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA)
    out = r.resample(df, spark.createDataFrame([(1, t, "", 1) for t in target], SCHEMA), Workspace(spark, "t"), most=most)
    assert got(out) == brute(docs, target, most)


def test_query_against_brute_force(spark, sf_dir):
    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    target = [x.text for x in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert got(r.op13_resample(spark, sf_dir)) == brute(docs, target)


@pytest.mark.parametrize("margin", [1e-9, 0.01, 2.0])
def test_wrong_brackets_are_widened(spark, margin):
    """A sketch of eight values and a bracket too narrow or of all rows give the same ranks; so do ties."""
    rng = random.Random(1)
    rows = [(rng.choice([None, i, 7]), rng.randint(0, 40), rng.choice([5, rng.randint(-1000, 1000)])) for i in range(3000)]
    scored = spark.createDataFrame(rows, "doc_id long, n_words long, score long").repartition(5)
    out = r.ranked(scored, Workspace(spark, "t"), percent=30, margin=margin, sketch=8).collect()
    want = sorted((x for x in rows if x[1] >= 20), key=lambda x: (-x[2], x[0] is not None, x[0] or 0, x[1]))
    want = want[: 30 * len(want) // 100]
    assert [(x.doc_id, x.score) for x in sorted((x for x in out if x.rank), key=lambda x: x.rank)] == [(x[0], x[2]) for x in want]
    assert sorted(x.rank for x in out if x.rank) == list(range(1, len(want) + 1)) and len(out) == len(rows)


def test_repeated_rows_nulls_and_empty_tables(spark):
    rows = [(1, "one two " * 20, "x", 1)] * 30 + [(None, "one two " * 20, "x", 1)] * 30
    df = spark.createDataFrame(rows, SCHEMA)
    out = r.resample(df, df.limit(0), Workspace(spark, "t"))
    assert got(out) == brute([x[:2] for x in rows], [])
    assert r.resample(df.limit(0), df, Workspace(spark, "t")).count() == 0
    few = r.resample(df.limit(3), df, Workspace(spark, "t"))
    assert [x.rank for x in few.collect()] == [None] * 3


def test_drawn_documents_keep_their_columns(spark):
    rows = [(i, f"{'target words' if i % 2 else 'other things'} " * 15, "w", i) for i in range(200)]
    df, target = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(0, "target words " * 50, "", 0)], SCHEMA)
    out = r.resampled(df, target, Workspace(spark, "t"), percent=20)
    assert out.columns == df.columns and out.count() == 40
    assert out.where("doc_id % 2 = 1").count() > 30
