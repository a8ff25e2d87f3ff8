"""Runs that touch what changed: partitions of comments and of what is derived from them."""

import os

import pytest
from pyspark.sql import functions as F

from quillmark.plans import ingest
from quillmark.plans.shards import Derived, Shards
from quillmark.sources import schemas

NOW = 1_700_000_000
BOOKS = "id long, openlibrary_id string, canonical_title string, normalized_title string, authors array<string>, publication_year int, description string, cover_url string, isbn_10 array<string>, isbn_13 array<string>, resolution_version int, review_digest string"
FOUND = "query string, key string, title string, author_name array<string>, first_publish_year int, cover_i long, isbn array<string>, subject array<string>"


def files(root, table):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{root}/{table}") for f in names if f.endswith(".parquet")}


def shards_of(paths):
    return {p.split("shard=")[1].split("/")[0] for p in paths}


@pytest.fixture
def inputs(spark):
    def item(**k):
        return tuple(k.get(n) for n in schemas.ITEMS.names)

    items, roots = [], []
    for t in range(100, 2100, 100):  # twenty threads with three comments each
        roots.append((t,))
        items.append(item(id=t, type="story", title=f"Thread {t}", by="op", time=NOW, kids=[t + 1, t + 3]))
        items.append(item(id=t + 1, type="comment", by="ann", parent=t, time=NOW + t, text="I highly recommend <i>Dune</i> by Frank Herbert.", kids=[t + 2]))
        items.append(item(id=t + 2, type="comment", by="bob", parent=t + 1, time=NOW + t, text="Nothing here."))
        items.append(item(id=t + 3, type="comment", by="cyd", parent=t, time=NOW + t, text='I loved "Some Unknown Book"' if t == 500 else "No."))
    return {
        "items": spark.createDataFrame(items, schemas.ITEMS),
        "roots": spark.createDataFrame(roots, "id long"),
        "books": spark.createDataFrame([], BOOKS),
        "candidates": spark.createDataFrame([("dune", "/works/OL2W", "Dune", ["Frank Herbert"], 1965, 7, None, None)], FOUND),
        "works": spark.createDataFrame([("/works/OL2W", "Dune", None, ["/authors/OL1A"], None), ("/works/OL9W", "Some Unknown Book", None, ["/authors/OL9A"], None)], schemas.WORKS),
        "authors": spark.createDataFrame([("/authors/OL1A", "Frank Herbert"), ("/authors/OL9A", "Some One")], schemas.AUTHORS),
    }


def test_only_what_changed_is_done_again(spark, inputs, tmp_path, monkeypatch):
    parsed = []
    plain = ingest.spans_of
    monkeypatch.setattr(ingest, "spans_of", lambda todo, known=None: parsed.append(sorted(r.id for r in todo.collect())) or plain(todo, known))
    root = str(tmp_path / "store")
    store = Shards(spark, root, shards=8)
    counts, books = ingest.update(spark, store, **inputs)
    assert counts == {"comments_total": 60, "comments_processed": 60, "comments_skipped": 0, "shards_written": len(shards_of(files(root, "rows"))), "mentions_extracted": 21, "books_resolved": 20, "unresolved_mentions": 1}
    assert len(parsed) == 1 and store.read("mentions").count() == 21

    # the library has grown by that run, so the comment with an unresolved mention is looked at once more
    again, books = ingest.update(spark, store, **(inputs | {"books": books}))
    assert (again["comments_processed"], parsed[1:]) == (1, [[503]])
    before = {t: files(root, t) for t in ("rows", "mentions", "mention_tags")}
    third, _ = ingest.update(spark, store, **(inputs | {"books": books}))
    assert third == {"comments_total": 60, "comments_processed": 0, "comments_skipped": 60, "shards_written": 0, "mentions_extracted": 0, "books_resolved": 0, "unresolved_mentions": 0}
    assert len(parsed) == 2 and {t: files(root, t) for t in before} == before

    # one changed comment rewrites its partition, and loses its mention
    edited = inputs["items"].withColumn("text", F.when(F.col("id") == 701, "Never mind.").otherwise(F.col("text")))
    counts, _ = ingest.update(spark, store, **(inputs | {"items": edited, "books": books}))
    assert (counts["comments_processed"], counts["shards_written"], parsed[2:]) == (1, 1, [[701]])
    for t in ("rows", "mentions"):
        now = files(root, t)
        assert len(shards_of({p for p in now if before[t].get(p) != now[p]})) == 1
    assert store.read("mentions").where("comment_id = 701").count() == 0 and store.read("mentions").count() == 20
    assert store.read("rows").where("id = 701").first().text == "Never mind." and store.read("rows").count() == 60

    # the catalogue learns of the unknown book
    more = inputs["candidates"].union(spark.createDataFrame([("some unknown book", "/works/OL9W", "Some Unknown Book", ["Some One"], 1999, None, None, None)], FOUND))
    counts, books = ingest.update(spark, store, **(inputs | {"items": edited, "books": books, "candidates": more}), catalogue="2")
    assert (counts["comments_processed"], counts["books_resolved"]) == (1, 1) and {r.canonical_title for r in books.collect()} == {"Dune", "Some Unknown Book"}
    assert store.read("mentions").where("status = 'unresolved'").count() == 0

    # a part of the threads
    some = ingest.update(spark, store, **(inputs | {"items": edited, "books": books, "roots": inputs["roots"].where("id < 300")}), catalogue="2")[0]
    assert (some["comments_total"], some["comments_processed"]) == (6, 0) and store.read("rows").count() == 60


def test_a_new_version_redoes_all_and_keeps_ids(spark, inputs, tmp_path):
    store = Shards(spark, str(tmp_path / "store"), shards=4)
    _, first = ingest.update(spark, store, **inputs, version=1, review_digest="a")
    ids = {r.openlibrary_id: r.id for r in first.collect()}
    assert {(r.resolution_version, r.review_digest) for r in first.collect()} == {(1, "a")}
    counts, books = ingest.update(spark, store, **(inputs | {"books": first}), version=2, review_digest="a")
    assert counts["comments_processed"] == 60 and counts["books_resolved"] == 20
    assert {r.openlibrary_id: (r.id, r.resolution_version) for r in books.collect()} == {k: (i, 2) for k, i in ids.items()}
    # without the catalogue's answer, books of the old version don't resolve anything
    counts, _ = ingest.update(spark, store, **(inputs | {"books": books, "candidates": inputs["candidates"].limit(0)}), version=3, review_digest="a")
    assert counts["books_resolved"] == 0 and counts["unresolved_mentions"] == 21


def test_update_equals_build(spark, inputs, tmp_path):
    store = Shards(spark, str(tmp_path / "store"), shards=3)
    ingest.update(spark, store, **(inputs | {"roots": inputs["roots"].where("id <= 900")}))
    known = ingest.update(spark, store, **(inputs | {"roots": inputs["roots"].where("id > 900")}))[1]
    whole = ingest.build(spark, **inputs, as_of=NOW)
    columns = ["id", "comment_id", "normalized_mention", "status", "sentiment"]
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    assert rows(store.read("mentions")) == rows(whole["mentions"]) and known.count() == 1
    assert store.read("mention_tags").count() == whole["mention_tags"].count()


def test_pruned_reads_and_emptied_partitions(spark, tmp_path):
    store = Shards(spark, str(tmp_path / "s"), shards=16)
    rows = spark.createDataFrame([(i, i % 40 if i % 7 else None, f"text {i}") for i in range(400)], "id long, thread_id long, text string")
    words = lambda todo: Derived({"words": todo.select(F.col("id").alias("row_id"), F.explode(F.split("text", " ")).alias("word")).where("word <> 'gone'")})
    store.update(rows, words, version="1")
    assert store.read("words").count() == 800
    plan = store.read("rows", [3])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "shard#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    shard = store.read("words").first().shard
    ids = [r.id for r in store.read("rows", [shard]).select("id").collect()]
    emptied = rows.withColumn("text", F.when(F.col("id").isin(ids), "gone").otherwise(F.col("text")))
    counts = store.update(emptied, words, version="1")
    assert counts["rows_processed"] == len(ids) and counts["shards_written"] == 1
    assert store.read("words").count() == 800 - 2 * len(ids) and store.read("words", [shard]).count() == 0
    assert store.update(emptied.limit(0), words, version="1")["rows_total"] == 0


def test_candidates_of_what_stays_unresolved(spark, inputs):
    books = spark.createDataFrame([(1, "/works/OL1W", "Dune", "dune", ["Frank Herbert"]), (2, "/works/OL2W", "Dune", "dune", ["Frank Herbert"])], "id long, openlibrary_id string, canonical_title string, normalized_title string, authors array<string>")
    books = books.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], BOOKS).schema.fields[5:]])
    spans = spark.createDataFrame([("a", "Dune", "Frank Herbert", None, 0.9), ("b", "Emma", None, None, 0.9), ("c", "Zzz", None, None, 0.9), ("d", "Emma", None, None, 0.1)], "span_id string, title string, work_author string, work_id string, confidence double")
    found = spark.createDataFrame([("emma", "/works/OL5W", "Emma Brown", ["X Y"], 1, None, None, None), ("emma", "/works/OL4W", "Emmas", ["X Y"], 1, None, None, None)], FOUND)
    got = {r.span_id: r for r in ingest.resolved(spans, books, found, inputs["works"], inputs["authors"])[0].collect()}
    assert got.keys() == {"a", "b"}
    assert got["a"].openlibrary_id is None and [(c.book_id, c.confidence) for c in got["a"].candidates] == [(1, 1.0), (2, 1.0)]
    assert got["b"].openlibrary_id is None and [c.key for c in got["b"].candidates] == ["/works/OL4W", "/works/OL5W"]


def test_tables_without_rows(spark, tmp_path):
    store = Shards(spark, str(tmp_path / "s"), shards=4)
    rows = spark.createDataFrame([(i, i % 3, "a") for i in range(9)], "id long, thread_id long, text string")
    derive = lambda todo: Derived({"words": todo.where("text = 'b'").select(F.col("id").alias("row_id"), "text")})
    assert store.update(rows, derive, version="1")["words_written"] == 0 and store.read("words").count() == 0
    store.update(rows.withColumn("text", F.when(F.col("id") == 4, "b").otherwise(F.col("text"))), derive, version="1")
    assert [r.row_id for r in store.read("words").collect()] == [4]


def test_a_tracked_run_has_measured_counters(spark, inputs, tmp_path):
    from quillmark.plans import api

    store = Shards(spark, str(tmp_path / "store"), shards=4)
    runs = spark.createDataFrame([], "id long, command string, started_at timestamp, finished_at timestamp, status string, metrics map<string,long>, error string")
    with api.tracked(spark, runs, "update") as run:
        counts, books = ingest.update(spark, store, **inputs)
        run.add(counts)
    row = run.rows.first()
    m = store.read("mentions")
    assert (row.id, row.command, row.status, row.error) == (1, "update", "completed", None) and row.finished_at >= row.started_at
    assert row.metrics["comments_processed"] == store.read("rows").count() and row.metrics["mentions_extracted"] == m.count()
    assert row.metrics["unresolved_mentions"] == m.where("book_id is null").count() and "shards_written" not in row.metrics
    with pytest.raises(ValueError, match="no luck"), api.tracked(spark, run.rows, "update") as broken:
        broken.add({"comments_total": 5})
        raise ValueError("no luck")
    last = broken.rows.where("id = 2").first()
    assert (last.status, last.error, last.metrics["failures"], last.metrics["comments_total"]) == ("failed", "no luck", 1, 5)


def test_health(spark):
    from quillmark.plans import api

    one = spark.range(1)
    assert api.Api(lambda name: one).health()

    def gone(name):
        raise LookupError("nothing is published")

    assert not api.Api(gone).health()
    assert not api.Api(lambda name: one.select(F.raise_error(F.lit("broken")).alias("x"))).health()
