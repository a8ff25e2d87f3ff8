import numpy as np

from quillmark.llm import ann
from quillmark.llm.common import Workspace

SCHEMA = "vec_id long, embedding array<float>, label int, score double"


def exact(rows, k=20, every=20):
    rows = [(i, np.array(e, np.float32).astype(float)) for i, e in rows if i is not None and e is not None and all(v is not None and np.isfinite(v) for v in e) and any(e)]
    out = {}
    for i, q in rows:
        if i % every == 0:
            hits = sorted((-float(np.sum(q * x)), j) for j, x in rows if j != i)
            out[i] = [(j, -s) for s, j in hits[:k]]
    return out


def run(spark, rows, **k):
    df = spark.createDataFrame([(i, e, 0, 0.0) for i, e in rows], SCHEMA)
    out = {}
    for r in sorted(ann.nearest(df, Workspace(spark, "t"), **k).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_few_vectors_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(18)]
    rows[5] = (5, rows[4][1])
    rows += [(100, None), (101, [0.0] * 8), (102, [1.0] * 7 + [None]), (103, [float("nan")] * 8), (104, [float("inf")] * 8), (None, [1.0] * 8), (105, [])]
    got, want = run(spark, rows), exact(rows)
    assert got.keys() == want.keys() == {0}
    assert [v for v, _ in got[0]] == [v for v, _ in want[0]]
    assert np.allclose([s for _, s in got[0]], [s for _, s in want[0]], rtol=1e-12)


def test_recall_ties_and_blocks(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((10, 32))
    x = centre[rng.integers(0, 10, 1500)] + rng.standard_normal((1500, 32))
    x[700:900] = x[700]  # one vector many times
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    got, want = run(spark, rows, row_block=300, query_block=40), exact(rows)
    assert got.keys() == want.keys()
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want]) >= 0.9
    assert [v for v, _ in got[700]] == [v for v in range(701, 721)]
    for hits in got.values():
        assert hits == sorted(hits, key=lambda h: (-h[1], h[0]))


def test_probing_finds_every_code_in_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 16, (400, 3)).astype(np.uint16)
    codes[200:] = codes[:200] ^ (1 << rng.integers(0, 16, (200, 3))).astype(np.uint16)
    block = ann.Block(np.arange(400), np.arange(400), np.zeros((400, 2)), codes)
    for radius in (0, 2, 3, 7, 20):
        for c in codes[::40]:
            assert set(block.within(c, radius)) == set(np.flatnonzero(ann.distances(c[None], codes)[0] <= radius))


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, want = {}, exact(rows)
    for r in ann.op3_nearest(spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & {v for v, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_outliers_have_k_rows(spark):
    rng = np.random.default_rng(8)
    centre = 5 * rng.standard_normal((4, 32))
    x = centre[rng.integers(0, 4, 1200)] + 0.05 * rng.standard_normal((1200, 32))
    x[:100:20] = -centre[0] + 3 * rng.standard_normal((5, 32))  # queries far from every cluster
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    got, want = run(spark, rows, row_block=300, query_block=40), exact(rows)
    assert got.keys() == want.keys()
    assert all(len(hits) == 20 for hits in got.values())


def test_every_candidate_where_there_are_few(spark):
    rng = np.random.default_rng(9)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(rng.standard_normal((21, 8)))]
    got, want = run(spark, rows), exact(rows)
    assert {q: [v for v, _ in h] for q, h in got.items()} == {q: [v for v, _ in h] for q, h in want.items()}


def test_rows_with_one_id_and_other_dimensions(spark):
    rng = np.random.default_rng(10)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(rng.standard_normal((400, 16)))]
    twice = [(400, rng.standard_normal(16).astype(np.float32).tolist()) for _ in range(2)]
    short = [(1000 + i, rng.standard_normal(3).astype(np.float32).tolist()) for i in range(30)]
    df = spark.createDataFrame([(i, e, 0, 0.0) for i, e in rows + twice + short], SCHEMA)
    got = ann.nearest(df, Workspace(spark, "t")).collect()
    own = [r for r in got if r.query_id == 400]
    assert sorted(r.rank for r in own) == sorted([*range(1, 21)] * 2)
    both = [np.array(e, float) for _, e in twice]
    lists = [sorted(((-float(q @ np.array(e, float)), i) for i, e in [*rows, (400, o)]))[:20] for q, o in (both, both[::-1])]
    found = {(r.rank, r.vec_id, round(r.score, 9)) for r in own}
    assert np.mean([(k + 1, i, round(-s, 9)) in found for hits in lists for k, (s, i) in enumerate(hits)]) > 0.8
    assert {r.vec_id for r in got if r.query_id in (1000, 1020)} <= {i for i, _ in short} and sum(r.query_id == 1000 for r in got) == 20


def test_nearest_of_groups_are_the_nearest_of_all(spark):
    import random

    from quillmark.llm.ann import best_of

    rng = random.Random(3)
    rows = [(q, rng.choice([0.5, rng.random()]), rng.randrange(500), i) for q in range(5) for i in range(400)]
    found = spark.createDataFrame(rows, "query_row long, score double, vec_id long, row long").repartition(4)
    got = best_of(best_of(found, 7, 9), 7)
    for q in range(5):
        want = sorted((-s, v, r) for k, s, v, r in rows if k == q)[:7]
        assert sorted((r.less, r.vec_id, r.row) for r in got.where(f"query_row = {q}").collect()) == want
