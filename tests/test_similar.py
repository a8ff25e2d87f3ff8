import random

import pytest

from quillmark.functions.text import similarity
from quillmark.operators.similar import similar


def brute(left, right, ratio):
    return {(a, b): similarity(a, b) for a in set(left) for b in set(right) if a is not None and b is not None and a != b and similarity(a, b) >= ratio}


def titles(n, seed):
    rng = random.Random(seed)
    words = ["the", "name", "of", "wind", "wise", "man", "fear", "dune", "messiah", "Étude", "日本", "a", "ring", "rings", "lord", "x"]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 7))) for _ in range(n)]

    def edited(t):
        i = rng.randrange(len(t) + 1)
        return rng.choice([t[:i] + rng.choice("abc -") + t[i:], t[:i] + t[i + 1 :], t + ": a subtitle", t.title(), " ".join(sorted(t.split(), reverse=True))])

    return out + [edited(edited(t)) for t in out] + [edited(t) for t in out]


@pytest.mark.parametrize("ratio", [0.94, 0.8, 1.0])
def test_against_comparing_all_pairs(spark, ratio):
    left, right = titles(60, 1), titles(60, 1)[30:] + titles(20, 2)
    left += [None, "", "!!", "aaaaaaaaaaaaaaaaaaaaaaaa", "b"] + left[:5]
    right += [None, "", "aaaaaaaaaaaaaaaaaaaaaaaab", "B.", "x" * 400]
    rows = lambda x: spark.createDataFrame([(t, 1) for t in x], "title string, form int").repartition(3)
    got = {(r.left_title, r.right_title): r.similarity for r in similar(rows(left), rows(right), ratio).collect()}
    assert got == pytest.approx(brute(left, right, ratio)) and len(got) > 30


def test_empty(spark):
    none = spark.createDataFrame([], "title string")
    assert similar(none, none).count() == 0


def test_hot_pieces_are_dealt_and_far_pairs_go_before_the_ratio(spark, monkeypatch):
    """Titles of a few words: pairs are far more than titles, meet in many shares, and only near ones reach the ratio."""
    from pyspark.sql import functions as F

    from quillmark.operators import similar as s

    data = [f"{a} {b} model {i}" for i, (a, b) in enumerate((a, b) for a in ("red", "blue", "green", "black") for b in ("ring", "bolt", "gear", "plate", "widget") for _ in range(8))]
    monkeypatch.setattr(s, "SHARE", 7)
    monkeypatch.setattr(s, "PAIRS", 500)
    compared = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def watched(left, right):
        compared.add(len(left))
        return left.combine(right, lambda a, b: similarity(a, b))

    monkeypatch.setattr(s, "title_similarity", watched)
    rows = spark.createDataFrame([(t,) for t in data], "title string")
    got = {(r.left_title, r.right_title): r.similarity for r in similar(rows, rows, 0.94).collect()}
    assert got == pytest.approx(brute(data, data, 0.94)) and len(got) > 100
    assert compared.value < len(data) ** 2 / 3
