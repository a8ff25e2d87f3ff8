import random
import re

import numpy as np
import pytest

from quillmark.llm import near_dedup as nd
from quillmark.llm.common import Workspace

SCHEMA = "doc_id long, text string, component string, bands int"


def shingles(text, size=4):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(docs, size=4):
    """docs: (doc_id, text) with different ids."""
    sets = {d: shingles(t, size) for d, t in docs}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    by = {}
    for d in ids:
        for s in sets[d]:
            by.setdefault(s, []).append(d)
    for a, b in {(a, b) for m in by.values() for a in m for b in m if a < b}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def run(spark, docs):
    df = spark.createDataFrame([(d, t, "c", 1) for d, t in docs], SCHEMA)
    return list(nd.near_duplicates(df, Workspace(spark, "t")).collect())


def test_groups_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 7)
    rng = random.Random(4)
    docs = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(60)]
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(60)] = f"x{rng.randint(0, 40)}"
            docs.append((len(docs), " ".join(w)))
    chain = [f"c{i}" for i in range(80)]  # each links with the next only
    for k in range(8):
        docs.append((1000 + k, " ".join(chain[4 * k : 4 * k + 48])))
    docs += [(2000, None), (2001, ""), (2002, "One two"), (2003, "one TWO"), (2004, "one two three"), (2005, " \n"), (2006, docs[0][1].upper()), (2007, docs[0][1])]
    rng.shuffle(docs)
    want = brute(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, docs)}
    assert got == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in run(spark, docs[:30]))


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = " ".join(f"t{i}" for i in range(30))
    got = sorted((tuple(r)[:4] for r in run(spark, [(5, text), (5, text), (3, text + " end"), (None, text), (5, "other words entirely here now")])), key=repr)
    assert got == sorted([(5, 27, 3, False), (5, 27, 3, False), (3, 28, 3, True), (None, 27, None, True), (5, 2, 5, True)], key=repr)
    df = spark.createDataFrame([], SCHEMA)
    assert nd.near_duplicates(df, Workspace(spark, "t")).count() == 0


def thue_morse(n):
    """Complementary words of n letters that all polynomial hashes mod 2**64 take for equal once n is large."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_no_link_by_colliding_hashes(spark):
    a, b = thue_morse(2048)
    got = {r.doc_id: r.component_id for r in run(spark, [(1, f"w1 w2 {a} w3 w4"), (2, f"w1 w2 {b} w3 w4"), (3, f"W1 w2 {a} w3  w4")])}
    assert got == {1: 1, 2: 2, 3: 1}


def test_one_row_of_each_component_is_first(spark):
    x, y = (" ".join(f"{c}{i}" for i in range(30)) for c in "xy")
    got = run(spark, [(3, x), (3, x), (5, x), (5, y), (None, x), (None, x), (6, ""), (6, "")])
    assert sorted(((r.doc_id, r.n_shingles) for r in got if r.first), key=repr) == sorted([(3, 27), (5, 27), (None, 27), (None, 27), (6, 0), (6, 0)], key=repr)


def test_coordinates_estimate_jaccard():
    rng = np.random.default_rng(0)
    for share in (0.2, 0.5, 0.8, 0.95):
        n = 4000
        both = rng.integers(0, 2**63, int(n * share), dtype=np.uint64)
        a, b = (np.r_[both, rng.integers(0, 2**63, (n - len(both)) // 2, dtype=np.uint64)] for _ in range(2))
        equal = np.mean(nd.circulant_minhash(a) == nd.circulant_minhash(b))
        assert equal == pytest.approx(share, abs=0.13)


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in nd.op1_near_dedup(spark, sf_dir).collect()} == brute(docs)
