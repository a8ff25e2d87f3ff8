"""Whole runs: ingestion of a small tree, publishing, streams."""

import pytest
from pyspark.sql import functions as F

from quillmark.operators import ranking
from quillmark.plans import ingest
from quillmark.plans.publish import Busy, CheckFailed, Library, standard_checks
from quillmark.sources import schemas
from quillmark.streaming import stream

NOW = 1_700_000_000


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    keys = schemas.ITEMS.names

    def item(**k):
        return tuple(k.get(n) for n in keys)

    items = [
        item(id=1, type="story", title="What are you reading?", by="op", time=NOW, kids=[2, 3, 99], score=5, descendants=4),
        item(id=2, type="comment", by="ann", parent=1, time=NOW + 10, text="I highly recommend <i>Dune</i> by Frank Herbert. Great science fiction.", kids=[4]),
        item(id=3, type="comment", parent=1, time=NOW + 20, deleted=True, kids=[5]),
        item(id=4, type="comment", by="bob", parent=2, time=NOW + 30, text="Dune by Frank Herbert is excellent"),
        item(id=5, type="comment", by="cyd", parent=3, time=NOW + 40, text='I loved "Some Unknown Book"'),
        item(id=50, type="story", title="Other", by="x", time=NOW, kids=[]),
    ]
    candidates = [("dune", "/works/OL2W", "Dune", ["Frank Herbert"], 1965, 7, ["0441013597"], ["Science fiction"]), ("dune", "/works/OL3W", "Children of Dune", ["Frank Herbert"], 1976, None, None, None)]
    return {
        "items": spark.createDataFrame(items, schemas.ITEMS),
        "roots": spark.createDataFrame([(1,)], "id long"),
        "books": spark.createDataFrame([], "id long, openlibrary_id string, canonical_title string, normalized_title string, authors array<string>, publication_year int, description string, cover_url string, isbn_10 array<string>, isbn_13 array<string>"),
        "candidates": spark.createDataFrame(candidates, "query string, key string, title string, author_name array<string>, first_publish_year int, cover_i long, isbn array<string>, subject array<string>"),
        "works": spark.createDataFrame([("/works/OL2W", "Dune", '{"value": "A desert"}', ["/authors/OL1A"], [-1, 8])], schemas.WORKS),
        "authors": spark.createDataFrame([("/authors/OL1A", "Frank Herbert")], schemas.AUTHORS),
    }


def test_a_run_from_items_to_index(spark, inputs):
    t = ingest.build(spark, **inputs, as_of=NOW)
    comments = {r.id: r for r in t["comments"].collect()}
    assert comments.keys() == {2, 3, 4, 5} and comments[3].text == "" and comments[5].thread_id == 1
    book = t["books"].first()
    assert (book.canonical_title, book.openlibrary_id, book.authors, book.description, book.isbn_10) == ("Dune", "/works/OL2W", ["Frank Herbert"], "A desert", ["0441013597"])
    assert (book.mention_count, book.independent_recommenders) == (2, 2) and book.all_time_score > 0
    m = {(r.comment_id, r.normalized_mention): r for r in t["mentions"].collect()}
    assert m[2, "dune"].status == m[4, "dune"].status == "resolved" and m[5, "some unknown book"].status == "unresolved"
    assert "science-fiction" in {r.name for r in t["book_tags"].collect()}
    assert {r.term for r in t["terms"].collect()} >= {"dune", "frank", "desert"}
    assert [(r.parent, r.id) for r in t["missing"].collect()] == [(1, 99)]


def test_a_second_run_keeps_ids_and_needs_no_catalogue(spark, inputs):
    first = ingest.build(spark, **inputs, as_of=NOW)
    books = spark.createDataFrame(first["books"].select(*inputs["books"].columns).collect(), inputs["books"].schema)
    again = ingest.build(spark, **(inputs | {"books": books, "candidates": inputs["candidates"].limit(0)}), as_of=NOW)
    assert sorted(map(tuple, again["mentions"].select("id", "book_id", "status").collect())) == sorted(map(tuple, first["mentions"].select("id", "book_id", "status").collect()))
    assert again["books"].count() == 1


def test_deleted_text_takes_its_mentions_along(spark, inputs):
    items = inputs["items"].withColumn("dead", F.when(F.col("id") == 4, F.lit(True)).otherwise(F.col("dead")))
    t = ingest.build(spark, **(inputs | {"items": items}), as_of=NOW)
    assert t["books"].first().mention_count == 1 and t["comments"].count() == 4


def test_publish(spark, inputs, tmp_path):
    lib = Library(spark, f"file://{tmp_path}/library")
    assert lib.current() is None and lib.versions() == []
    with pytest.raises(LookupError):
        lib.read("books")
    t = ingest.build(spark, **inputs, as_of=NOW)
    with lib.lock():
        with pytest.raises(Busy), lib.lock():
            pass
        lib.stage("v1", **{k: t[k] for k in ("threads", "comments", "books", "mentions", "checkpoints", "tags")})
        rows = {k: lib.read(k, "v1") for k in ("threads", "comments", "books", "mentions", "checkpoints")}
        assert lib.current() is None
        lib.publish("v1", standard_checks(*(rows[k] for k in ("threads", "comments", "books", "mentions", "checkpoints")), version=ingest.PROCESSOR))
    assert lib.current() == "v1" and lib.read("books").count() == 1
    old = lib.read("books")
    lib.seed("v2")
    assert set(lib.tables("v2")) == {"threads", "comments", "tags"}
    checks = standard_checks(rows["threads"], rows["comments"], rows["books"], rows["mentions"], rows["checkpoints"], "another version", thread_id=1)
    with pytest.raises(CheckFailed, match="foreign threads, threads not processed"):
        lib.publish("v2", checks)
    assert lib.current() == "v1"
    lib.publish("v2", {})
    assert lib.current() == "v2" and old.count() == 1
    with pytest.raises(Exception, match="(?i)exist"):
        lib.stage("v1", books=t["books"])
    with lib.lock():
        pass


def test_broken_rows_are_found(spark):
    threads = spark.createDataFrame([(1,), (1,)], "id long")
    comments = spark.createDataFrame([(1, 2)], "id long, thread_id long")
    books = spark.createDataFrame([(1, "w"), (2, "w")], "id long, openlibrary_id string")
    mentions = spark.createDataFrame([(1, 9, 5, "x", "resolved"), (2, None, 1, "y", "resolved"), (3, None, 1, "y", "odd")], "id long, book_id long, comment_id long, normalized_mention string, status string")
    assert {k for k, v in standard_checks(threads, comments, books, mentions).items() if v.count()} == {"thread ids repeat", "books repeat", "titles repeat in a comment", "comments without a thread", "mentions without a comment", "mentions of no book", "status unknown", "status and book disagree"}


def test_stream_follows_new_files(spark, tmp_path):
    schema = "book_id long, author string, thread_id long, comment_id long, created_at long, recommendation_strength double, sentiment double"
    rows = [(1, "a", 1, 1, 10, 0.95, 0.9), (1, "a", 1, 2, 20, 0.0, -0.8), (2, None, 1, 3, 5, 0.95, 0.9)]
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = stream.run_available(ranking.latest_opinions(live), "t")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ranking.latest_opinions(df).collect()))


def test_stream_upserts_changed_groups(spark, tmp_path):
    """Three batches give what all rows give; a batch rewrites the buckets of its groups only."""
    import os

    schema = "book_id long, author string, thread_id long, comment_id long, created_at long, recommendation_strength double, sentiment double"
    rows = [(i % 5 if i % 9 else None, f"r{i % 7}" if i % 4 else None, 1, i, i * 37 % 100, 0.95 if i % 3 else 0.0, 0.9 if i % 3 else -0.8) for i in range(300)] + [(1, "late", 1, 999, 5, 0.95, 0.9)]
    df = spark.createDataFrame(rows, schema)
    got = stream.upserted(ranking.latest_opinions(stream.in_files(df, "comment_id", 3)), ["book_id", "anonymous", "reader"], "t", buckets=16)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, ranking.latest_opinions(df).collect()))
    folder = got.inputFiles()[0].removeprefix("file://").rsplit("/", 2)[0]
    times = {d: max(os.stat(f"{folder}/{d}/{f}").st_mtime for f in os.listdir(f"{folder}/{d}")) for d in os.listdir(folder) if d.startswith("q_bucket=")}
    assert len(times) > 3


def test_windows_close_after_late_rows(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(id as int)) as ts, id % 2 as k from range(10)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = stream.windowed_counts(live, "ts", ["k"]).writeStream.format("memory").queryName("q_windows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("q_windows").collect()
    assert got and all(r.n == 1 for r in got) and len(got) < 10  # the last days may still get rows


def test_backup_is_checked_and_never_overwritten(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"))
    lib.stage("v1", books=spark.range(20).withColumnRenamed("id", "n"), threads=spark.range(3))
    lib.publish("v1", {})
    folder = str(tmp_path / "copy")
    lib.backup(folder)
    lib.verify(folder)
    with pytest.raises(FileExistsError):
        lib.backup(folder)
    spark.range(19).withColumnRenamed("id", "n").write.mode("overwrite").parquet(f"{folder}/books")
    with pytest.raises(CheckFailed, match="books"):
        lib.verify(folder)


def test_a_lock_that_a_dead_writer_left_is_taken_over(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"))
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "LOCK").touch()
    with pytest.raises(Busy), lib.lock():
        pass
    with pytest.raises(Busy), lib.lock(stale_after=3600):
        pass
    import os

    os.utime(tmp_path / "lib" / "LOCK", (1, 1))
    with lib.lock(stale_after=3600), pytest.raises(Busy), lib.lock(stale_after=3600):
        pass
    with lib.lock():
        pass
