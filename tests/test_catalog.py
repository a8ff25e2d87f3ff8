import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillmark.functions.text import normal
from quillmark.operators import catalog, resolve

SCHEMA = "key string, title string, names array<string>"


def terms(title, names):
    w = normal(title).split()
    a = [x for n in names or [] for x in normal(n.replace(",", " ")).split()]
    return list(dict.fromkeys([f"t {x}" for x in w] + [f"p {x} {y}" for x, y in zip(w, w[1:])] + [f"a {x}" for x in a])), len(w)


def brute(records, asks, most=8):
    """{ask: [(key, score), ...]} by scoring every record."""
    held = {k: terms(t, n) for k, t, n in records if k is not None}
    df = Counter(x for t, _ in held.values() for x in t)
    weight = {x: math.floor(1000 * math.log(1 + len(held) / n)) for x, n in df.items()}
    impact = {k: {x: weight[x] if x[0] == "a" else max(1, weight[x] * 4 // (3 + n)) for x in t} for k, (t, n) in held.items()}
    out = {}
    for ask, title, names in asks:
        asked = terms(title, names)[0]
        found = [(-sum(i.get(x, 0) for x in asked), k) for k, i in impact.items() if any(x in i for x in asked if x[0] == "t")]
        out[ask] = [(k, -s) for s, k in sorted(found)[:most]]
    return {a: x for a, x in out.items() if x}


def asked(spark, asks):
    rows = spark.createDataFrame(asks, "ask string, title string, names array<string>")
    return catalog.with_terms(rows, "title", "names").select("ask", "terms")


def got(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: r.place):
        out[r.ask].append((r.key, r.score))
    return dict(out)


def library(n, seed=1):
    """Titles with words of very different frequency; one word is in all."""
    rng = random.Random(seed)
    word = lambda: f"w{int(2000 ** rng.random())}"
    return [(f"/works/OL{i}W", " ".join(["The", *[word() for _ in range(rng.randint(1, 6))]]), [f"Author {word()}", f"Last{i % 50}, First"][: rng.randint(0, 2)]) for i in range(n)]


def test_against_scoring_every_record(spark):
    records = library(1500)
    asks = [(f"q{i}", t, n[:1] if i % 2 else None) for i, (_, t, n) in enumerate(random.Random(2).sample(records, 150))]
    asks += [("common", "the", None), ("unknown", "zzz", ["nobody"]), ("empty", "", None), ("none", None, None), ("author only", "zzz", ["Author w3"]), ("twice", "the the w1 W1", None)]
    rows = [*records, records[0], ("/works/OL9999W", None, None), (None, "the w1", None)]
    index = catalog.build(spark.createDataFrame(rows, SCHEMA).repartition(3))
    want = brute([*records, ("/works/OL9999W", None, None)], asks)
    assert got(catalog.search(asked(spark, asks), index)) == want
    assert got(catalog.search(asked(spark, asks), index, most=3)) == {a: x[:3] for a, x in want.items()}


def test_common_words_are_not_read_through(spark):
    """Beside a rare word none of the runs of a word that all records hold is read; alone it gives its first run."""
    records = library(4000, seed=3)
    asks = [(f"q{i}", t, None) for i, (_, t, _) in enumerate(records[:300]) if len(t.split()) > 3] + [("common", "The", None)]
    index = catalog.build(spark.createDataFrame(records, SCHEMA))
    words = catalog.asked_terms(asked(spark, asks), index)
    seeds = catalog.scored(words.join(index.postings.where("run = 0").select("term", "key"), "term"), index)
    read = catalog.needed(words, seeds).groupBy("ask", "term").agg(F.sum("n").alias("n")).collect()
    assert [r for r in read if r.term == "t the"] == []
    df = {r.term: r.df for r in index.terms.collect()}
    assert df["t the"] == 4000
    everything = sum(df.get(x, 0) for _, t, n in asks for x in terms(t, n)[0])
    assert sum(r.n for r in read) + 16 * len(asks) * 8 < 0.1 * everything


def test_runs_double(spark):
    index = catalog.build(spark.createDataFrame(library(300), SCHEMA))
    sizes = {r.run: r.n for r in index.postings.where("term = 't the'").groupBy("run").agg(F.count("*").alias("n")).collect()}
    assert sizes == {0: 16, 1: 16, 2: 32, 3: 64, 4: 128, 5: 44}


def test_empty_catalogue(spark):
    index = catalog.build(spark.createDataFrame([], SCHEMA))
    assert catalog.search(asked(spark, [("a", "the", None)]), index).count() == 0


def test_answers_feed_the_lookup(spark):
    """Spans find their works through the index as through the service's answers: with the author, or by title alone."""
    records = spark.createDataFrame([("/works/OL1W", "Dune", ["Frank Herbert"]), ("/works/OL2W", "Dune Messiah", ["Frank Herbert"]), ("/works/OL3W", "Emma", ["Jane Austen"])], SCHEMA)
    none = F.lit(None)
    full = records.select("key", F.col("title").alias("candidate_title"), "names", none.cast("array<string>").alias("subjects"), none.cast("array<string>").alias("isbns"), none.cast("int").alias("year"), none.cast("long").alias("cover_i"))
    spans = spark.createDataFrame([("s1", "dune", "Herbert, Frank", None), ("s2", "Dune", None, None), ("s3", "emma", "Nobody", None), ("s4", "zzz", None, None)], "span_id string, title string, author string, work_id string")
    found = catalog.answers(spans, full, catalog.build(records))
    assert {(r.query, r.query_author) for r in found.collect()} == {("dune", "frank herbert"), ("dune", None), ("emma", "nobody"), ("emma", None)}
    works = records.select("key", "title", F.array().cast("array<string>").alias("author_keys"))
    rows = resolve.looked_up(spans, found, works, spark.createDataFrame([], "key string, name string"))
    assert {(r.span_id, r.key) for r in rows.collect()} >= {("s1", "/works/OL1W"), ("s2", "/works/OL1W"), ("s2", "/works/OL2W"), ("s3", "/works/OL3W")}


@pytest.mark.parametrize("most", [1, 8])
def test_ties_go_to_smaller_keys(spark, most):
    records = [(f"k{i:04d}", "same title", None) for i in range(200)]
    index = catalog.build(spark.createDataFrame(records, SCHEMA).repartition(4))
    assert [k for k, _ in got(catalog.search(asked(spark, [("q", "Same Title", None)]), index, most))["q"]] == [f"k{i:04d}" for i in range(most)]


def test_copies_are_one_entry(spark):
    """Records alike in all terms don't lengthen postings; answers and weights are those of all records."""
    records = [(f"k{i:04d}", ["red ring", "Ring, RED", "ring red", "blue ring"][i % 4], [["Ann Lee"], ["Lee, Ann"], None][i % 3]) for i in range(600)] + [("a", "red", None), ("z", "ring of blue", ["Lee"])]
    asks = [("q1", "red ring", ["Ann Lee"]), ("q2", "ring", None), ("q3", "blue", ["Lee"]), ("q4", "ring red", None)]
    index = catalog.build(spark.createDataFrame(records, SCHEMA).repartition(3))
    assert index.postings.groupBy("term").count().agg(F.max("count")).first()[0] < 12
    assert {r.term: r.df for r in index.terms.collect()}["t ring"] == 601
    for most in (1, 5, 8):
        assert got(catalog.search(asked(spark, asks), index, most)) == brute(records, asks, most)
    with pytest.raises(ValueError):
        catalog.search(asked(spark, asks), index, 9)
