import random

import pytest

from quillmark.operators import tree


@pytest.fixture
def cuts(monkeypatch):
    """How many tables the trees were cut at."""
    seen = []
    plain = tree.cut
    monkeypatch.setattr(tree, "cut", lambda df: seen.append(1) or plain(df))
    return seen


def test_rounds_are_the_logarithm_of_the_depth(spark, cuts):
    rows = [("long", i, i - 1) for i in range(10_000)] + [("round", i, i % 50 + 1) for i in range(1, 51)] + [("on", i, i - 1 if i else None) for i in range(3)]
    got = tree.depths(spark.createDataFrame(rows, "thread_id string, id long, parent_id long"))
    assert {tuple(r) for r in got.collect()} == {("long", 10_000, 9_999), ("on", 3, 2)}
    assert len(cuts) <= 17  # the start, and 16 rounds


def brute(items, roots):
    """{id: (root, depth)} of a forest, level by level."""
    held = {k: set(kids or []) for k, kids in items}
    out, level = {}, {r: r for r in roots if r in held}
    depth = 0
    while level:
        out |= {k: (r, depth) for k, r in level.items()}
        level, depth = {k: r for i, r in level.items() for k in held[i] if k in held and k not in out}, depth + 1
    return out


def test_under_against_levels(spark):
    rng = random.Random(6)
    kids = {i: [] for i in range(400)}
    for i in range(8, 400):
        kids[rng.randrange(max(0, i - 30), i)].append(i)
    kids[11].append(9_999)  # not stored
    kids[500], kids[501] = [501], [500]  # a cycle
    items = [*kids.items(), (600, None)]
    roots = [0, 1, 2, 7, 600, 777]
    df = spark.createDataFrame(items + items[:3], "id long, kids array<long>")
    got = tree.under(df, spark.createDataFrame([(r,) for r in roots], "id long"))
    assert {r.id: (r.root, r.depth) for r in got.collect()} == brute(items, roots)


def test_items_with_several_parents(spark):
    """5 hangs on 2, the smaller parent; 3 is held by 1, which isn't reached, and by 4, which is; so are 6 and 7 below it."""
    items = spark.createDataFrame([(0, [2, 4]), (2, [5]), (4, [3, 5]), (1, [3]), (3, [6]), (5, []), (6, [7]), (7, [])], "id long, kids array<long>")
    got = tree.under(items, spark.createDataFrame([(0,)], "id long"))
    assert {r.id: (r.root, r.depth) for r in got.collect()} == {0: (0, 0), 2: (0, 1), 4: (0, 1), 5: (0, 2), 3: (0, 2), 6: (0, 3), 7: (0, 4)}


def test_no_items_and_no_roots(spark):
    items = spark.createDataFrame([(1, [2]), (2, [])], "id long, kids array<long>")
    roots = spark.createDataFrame([(1,)], "id long")
    assert tree.under(items.limit(0), roots).count() == 0
    assert tree.under(items, roots.limit(0)).count() == 0
