import random

from pyspark.sql import functions as F

from quillmark.operators import kept, ranking

SCHEMA = "book_id long, author string, thread_id long, comment_id long, created_at long, recommendation_strength double, sentiment double"
DAY = 86_400


def mentions(n, seed=7):
    rng = random.Random(seed)
    says = [(0.95, 0.9), (0.65, 0.6), (0.2, 0.0), (0.0, -0.8)]
    return [(rng.choice([None, *range(12)]), rng.choice([None, "", *"abcdefgh"]), rng.choice([1, 2, 40_000, 70_000, 70_001]), i, rng.randrange(1_500_000_000, 1_600_000_000), *rng.choice(says)) for i in range(n)]


def rows(df):
    return sorted(map(tuple, df.collect()))


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def test_merged_batches_give_the_scores_of_all_mentions_at_any_date(spark):
    data = mentions(900)
    parts = [data[:300], data[300:650], data[650:]]
    state = kept.gathered(frame(spark, parts[0]))
    board = kept.board(state)
    for p in parts[1:]:
        batch = kept.gathered(frame(spark, p))
        state = kept.merged(state, batch)
        board = kept.updated(board, state, batch.counts.select("book_id"))
    whole = frame(spark, data)
    for as_of in (1_400_000_000, data[17][4], 1_550_000_000, 1_600_000_000, 1_900_000_000):
        assert rows(kept.scores_at(board, as_of)) == rows(ranking.scores(whole, as_of))


def test_only_books_of_the_batch_are_counted_again(spark):
    data = [m for m in mentions(300) if m[0] is not None]
    state = kept.gathered(frame(spark, data))
    marked = kept.board(state)
    marked = kept.Board(marked.standing.withColumn("mention_count", F.lit(-1).cast("long")), marked.months, marked.opinions)
    batch = kept.gathered(frame(spark, [(3, "z", 1, 999, 1_599_999_999, 0.95, 0.9)]))
    after = kept.updated(marked, kept.merged(state, batch), batch.counts.select("book_id"))
    counts = {r.book_id: r.mention_count for r in after.standing.collect()}
    assert counts.pop(3) == sum(m[0] == 3 for m in data) + 1 and set(counts.values()) == {-1}


def test_no_aggregate_expands_rows_and_dates_read_one_month(spark, tmp_path):
    board = kept.board(kept.gathered(frame(spark, mentions(50))))
    assert "Expand" not in kept.scores_at(board, 1_550_000_000)._jdf.queryExecution().toString()
    board.opinions.write.partitionBy("month").parquet(str(tmp_path / "o"))
    stored = kept.Board(board.standing, board.months, spark.read.parquet(str(tmp_path / "o")).select(*board.opinions.columns))
    plan = kept.scores_at(stored, 1_550_000_000)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    assert rows(kept.scores_at(stored, 1_550_000_000)) == rows(kept.scores_at(board, 1_550_000_000))


def test_bitmaps_are_exact(spark):
    values = [(b, v) for b in (1, 2) for v in [*range(0, 100_000, 7), 32_767, 32_768, 0, 0]]
    df = spark.createDataFrame(values, "b long, v long").repartition(4)
    a, b = kept.bitmap(df.where("v % 2 = 0"), "v", "b"), kept.bitmap(df.where("v % 3 <> 1"), "v", "b")
    both = kept.counted(kept.ored(a.union(b), "b"), "n", "b")
    assert {r.b: r.n for r in both.collect()} == {k: len({v for x, v in values if x == k and (v % 2 == 0 or v % 3 != 1)}) for k in (1, 2)}


def test_empty_state(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert kept.scores_at(kept.board(kept.gathered(none)), 1).count() == 0
    one = kept.merged(kept.gathered(none), kept.gathered(frame(spark, mentions(40))))
    assert rows(kept.scores_at(kept.board(one), 1_550_000_000)) == rows(ranking.scores(frame(spark, mentions(40)), 1_550_000_000))


def test_bitmaps_of_few_values_are_small(spark):
    """A number for each 64 values, negative ones and the ends of a number too."""
    values = [0, 1, 63, 64, -1, -64, -65, 70_000, 2**40]
    maps = kept.bitmap(spark.createDataFrame([(1, v) for v in values * 2], "b long, v long"), "v", "b")
    assert dict(maps.dtypes)["bits"] == "bigint" and maps.count() == 6
    assert [tuple(r) for r in kept.counted(maps, "n", "b").collect()] == [(1, len(values))]


def test_mentions_are_made_once_for_all_that_is_kept(spark, sf_dir, monkeypatch):
    """What is kept of both batches reads stored mentions, not the lines and orders again."""
    from quillmark.plans import queries

    read = []
    gathered = kept.gathered
    monkeypatch.setattr(kept, "gathered", lambda m: read.append(m) or gathered(m))
    queries._two_batches(spark, sf_dir)
    plans = [m._jdf.queryExecution().optimizedPlan().toString() for m in read]
    assert len(plans) == 2 and not any("lineitem" in p or "Join" in p for p in plans)


def test_kept_buckets_of_books_are_not_shuffled_again(spark, sf_dir, monkeypatch):
    """Readers' opinions of both batches are made, merged and summed up without a shuffle of more than a row for each book."""
    from quillmark.plans import queries

    made, merged = [], kept.merged
    monkeypatch.setattr(kept, "merged", lambda a, b: made.append(merged(a, b)) or made[-1])
    board = queries._two_batches(spark, sf_dir)[0]
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (made[0].opinions, board.months)]
    assert not any("Exchange hashpartitioning" in p for p in plans)


def test_books_too_large_for_a_bucket_are_kept_apart_with_the_same_scores(spark, sf_dir, monkeypatch):
    from quillmark.plans import queries

    whole = rows(ranking.scores(queries.views.order_mentions(spark, sf_dir), queries.AS_OF_ORDERS))
    lines = queries.read(spark, sf_dir, "lineitem").groupBy("l_partkey").count()
    monkeypatch.setattr(queries, "LARGE_BOOK", int(lines.agg(F.percentile_approx("count", 0.9)).first()[0]))
    monkeypatch.setattr(queries, "BUCKET", 500)
    apart = queries._merged_batches
    calls = []
    monkeypatch.setattr(queries, "_merged_batches", lambda m, *b: calls.append((m.select("book_id").distinct().count(), *b)) or apart(m, *b))
    assert rows(queries.score_details_kept(spark, sf_dir)) == whole
    assert [len(c) for c in calls] == [2, 1] and all(c[0] > 0 for c in calls) and calls[0][1] > 4
