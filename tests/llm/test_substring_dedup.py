import hashlib
import random

from quillmark.llm.common import Workspace
from quillmark.llm.substring_dedup import dedup_substrings, maximal, op6_substring_dedup

SCHEMA = "doc_id long, text string, cuts string, variant int"


def brute(docs, window):
    """docs: (doc_id, text). The rule by its words."""
    split = [(d, (t or "").encode().split()) for d, t in docs]
    first = {}
    for d, w in split:
        for i in range(len(w) - window + 1 if d is not None else 0):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1 if d is not None else 0):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=repr)


def run(spark, docs, **k):
    df = spark.createDataFrame([(d, t, "c", 1) for d, t in docs], SCHEMA)
    return sorted(map(tuple, dedup_substrings(df, Workspace(spark, "t"), **k).collect()), key=repr)


def test_random_passages(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(30)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 40))] for _ in range(12)] + [["a"] * 30, ["a", "b"] * 15]
    docs = []
    for i in range(150):
        w = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) - 1)
            w += p[a : rng.randint(a, len(p))] if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 15))]
        docs.append((rng.randint(0, 200), rng.choice([" ", "\n", "\t "]).join(w)))
    docs += [docs[3], docs[3], (7, None), (8, ""), (None, docs[5][1]), (500, "x" * 3000), (501, "\xa0 ".join(passages[0]))]
    for window, gram in ((8, 3), (6, 6), (12, 5)):
        assert run(spark, docs, window=window, gram=gram) == brute(docs, window)


def test_copies_and_empty(spark):
    text = " ".join(f"t{i}" for i in range(60))
    got = run(spark, [(i, text) for i in range(1, 40)])
    assert [g[2] for g in got].count(0) == 1 and all(g[2] == 60 for g in got if g[0] != 1)
    assert run(spark, [(1, "z " * 20000), (2, "z " * 60)])[1][2] == 60
    assert run(spark, [(1, None)]) == [(1, 0, 0, "")]


def test_no_match_by_colliding_hashes(spark):
    bits = [bin(i).count("1") % 2 for i in range(2048)]  # words that polynomial hashes mod 2**64 take for equal
    a, b = ("".join(x[k] for k in bits) for x in ("ab", "ba"))
    around = [f"t{i}" for i in range(60)]
    docs = [(1, " ".join([*around[:30], a, *around[30:]])), (2, " ".join([*around[:30], b, *around[30:]])), (3, " ".join([*around[:30], a, *around[30:]]))]
    assert [g[2] for g in run(spark, docs)] == [0, 0, 61]


def test_spans_join_to_maximal_repeats(spark):
    rows = [(1, 5, 0, 50), (1, 5, 1, 51), (1, 5, 51, 101), (1, 5, 103, 150), (1, 6, 0, 50), (2, 5, 10, 60), (2, 5, 12, 20)]
    got = {tuple(r) for r in maximal(spark.createDataFrame(rows, "doc_id long, variant long, start int, stop int")).collect()}
    assert got == {(1, 5, 0, 101), (1, 5, 103, 150), (1, 6, 0, 50), (2, 5, 10, 60)}


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {(d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in brute(docs, 50)}
    assert {tuple(r) for r in op6_substring_dedup(spark, sf_dir).collect()} == want
