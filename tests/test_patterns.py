import random

from pyspark.sql import functions as F

from quillmark.functions.patterns import names_in, standing_in


def brute(text, phrases):
    return {n for p, n in phrases if text and f" {p} " in f" {text} "}


def test_against_one_search_for_each_phrase(spark):
    rng = random.Random(5)
    words = ["a", "b", "c", "ab", "é", "日本", "b_c"]
    phrases = sorted({(" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))), f"n{rng.randrange(9)}") for _ in range(60)})
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 25))) for _ in range(300)] + [None, "", "a " * 50_000 + "b c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(3)
    got = {r.id: r.n for r in rows.select("id", standing_in(F.col("t"), phrases).alias("n")).collect()}
    for i, t in enumerate(texts):
        assert sorted(got[i]) == sorted(brute(t, phrases)), t[:80]


def test_overlapping_phrases_and_none():
    assert names_in("machine learning theory", (("machine learning", "x"), ("learning theory", "y"), ("learn", "z"))) == ["x", "y"]
    assert names_in("anything", ()) == [] and names_in(None, (("a", "x"),)) == []
