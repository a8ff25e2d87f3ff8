"""Incremental runs: upserts, replacement of derived rows, what changed, what is pending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.session import cut


def upsert(old: DataFrame, new: DataFrame, key: str, keep: list[str] = ()) -> DataFrame:
    """old with new's rows by key; columns in `keep` stay as they were first. new: one row for each key."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    there, came = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()

    def value(c: str) -> Column:
        if c == key or c in keep:
            return F.when(there, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
        return F.when(came, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return both.select(*map(value, old.columns))


def added(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, is_new of new's rows: whether upsert() inserts them."""
    there = old.select(key).distinct().withColumn("there", F.lit(True))
    return new.join(there, key, "left").select(key, F.col("there").isNull().alias("is_new"))


def numbered(rows: DataFrame, order: str, number: str, after: int = 0) -> DataFrame:
    """rows with numbers from after + 1 on, in the order of a column.

    Ranges of the column are counted and numbered each for itself; only the
    ranges' sizes, a row for each, meet in one place.
    """
    ranges = cut(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("range", F.spark_partition_id()))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = ranges.groupBy("range").agg(F.count("*").alias("n")).select("range", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("range").orderBy(order))
    return ranges.withColumn("own", own).join(sizes, "range").select(*rows.columns, (F.lit(after) + F.col("before") + F.col("own")).cast("long").alias(number))


def newest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row of each key with the largest order columns."""
    rest = [c for c in rows.columns if c != key and c not in order]
    top = rows.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("r"))
    return top.select(*[key if c == key else F.col(f"r.{c}").alias(c) for c in rows.columns])


def replace_by(old: DataFrame, new: DataFrame, touched: DataFrame, key: str) -> DataFrame:
    """old without the rows of touched keys, and new: derived rows of a comment are replaced as a whole."""
    return old.join(touched.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def digest(*parts: str) -> Column:
    """SHA-256 of the parts; null and '' differ."""
    return F.sha2(F.to_json(F.array(*[F.col(p).cast("string") for p in parts])), 256)


def changed(rows: DataFrame, processed: DataFrame, key: str, unresolved: DataFrame | None = None, force: bool = False) -> DataFrame:
    """rows (key, digest) whose digest isn't the processed one, which have unresolved mentions, or all by force."""
    out = rows.join(processed.select(key, F.col("digest").alias("was")), key, "left")
    if unresolved is not None:
        out = out.join(unresolved.select(key).distinct().withColumn("open", F.lit(True)), key, "left")
    again = F.coalesce(F.col("open"), F.lit(False)) if unresolved is not None else F.lit(False)
    return out.where(F.lit(force) | ~F.col("digest").eqNullSafe(F.col("was")) | again).select(*rows.columns)


def pending(candidates: DataFrame, checkpoints: DataFrame, version: str, key: str = "thread_id", limit: int | None = None, order: list[Column] = ()) -> DataFrame:
    """Candidates not completed at this version; a limit counts pending ones only."""
    done = checkpoints.where(F.col("raw_complete") & (F.col("processed_version") == version)).select(key)
    out = candidates.join(done, key, "left_anti")
    out = out.orderBy(*order) if order else out
    return out.limit(limit) if limit is not None else out


def run_status(failures: Column, errors: Column) -> Column:
    return F.when(errors.isNotNull(), "failed").when(failures > 0, "partial").otherwise("completed")


def cached(asked: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """(rows that the cache answers, with its columns; different keys that it doesn't)."""
    return asked.join(cache, key), asked.join(cache.select(key), key, "left_anti").select(key).distinct()


def remember(cache: DataFrame, answers: DataFrame, key: str = "cache_key", ok: str = "ok") -> DataFrame:
    """cache with new answers; failures (not `ok`) are never kept, the first answer stays."""
    new = answers.where(ok).select(*cache.columns).dropDuplicates([key])
    return cache.unionByName(new.join(cache.select(key), key, "left_anti").select(*cache.columns))


def completed(checkpoints: DataFrame, version: str) -> DataFrame:
    """Threads that are done at this version."""
    return checkpoints.where(F.col("raw_complete") & (F.col("processed_version") == version)).select("thread_id")


def refetched(checkpoints: DataFrame, threads: DataFrame) -> DataFrame:
    """Checkpoints after threads' items were read again: neither complete nor processed."""
    again = threads.select("thread_id").withColumn("again", F.lit(True))
    rows = checkpoints.join(again, "thread_id", "left").withColumn("again", F.coalesce("again", F.lit(False)))
    return rows.select("thread_id", (F.col("raw_complete") & ~F.col("again")).alias("raw_complete"), F.when(~F.col("again"), F.col("processed_version")).alias("processed_version"))


def metadata_key(base: Column, path: Column, params: Column) -> Column:
    """The key of a cached answer: base, path and parameters (a map), whatever the parameters' order."""
    return F.sha2(F.to_json(F.struct(base.alias("base"), path.alias("path"), F.array_sort(F.map_entries(params)).alias("params"))), 256)


# What a run counts.
RUN_COUNTERS = (
    "threads_discovered", "threads_fetched", "threads_skipped", "threads_reused_raw", "threads_remaining", "comments_fetched", "new_comments",
    "comments_total", "comments_processed", "comments_skipped", "mentions_extracted", "books_resolved", "unresolved_mentions", "metadata_lookups",
    "classifications_performed", "failures", "runtime_seconds", "llm_requests", "llm_cache_hits", "llm_input_tokens", "llm_cached_input_tokens", "llm_output_tokens",
)


def run_metrics(counted: DataFrame, by: list[str] = ()) -> DataFrame:
    """A column for each of RUN_COUNTERS, 0 where nothing was counted. counted: counter, n, from any steps of a run."""
    sums = [F.coalesce(F.sum(F.when(F.col("counter") == c, F.col("n"))), F.lit(0)).alias(c) for c in RUN_COUNTERS]
    return counted.groupBy(*by).agg(*sums)


def dry_run(candidates: DataFrame, checkpoints: DataFrame, version: str, limit: int | None = None, refresh: bool = False, preview: int = 10) -> tuple[DataFrame, DataFrame]:
    """(one row of counts; the first threads that a run would take). candidates: thread_id, title, comments, created_at; oldest first."""
    done = completed(checkpoints, version).withColumn("done", F.lit(not refresh))
    rows = candidates.join(done, "thread_id", "left").withColumn("todo", ~F.coalesce("done", F.lit(False)))
    todo = rows.where("todo").orderBy("created_at", "thread_id")
    todo = todo.limit(limit) if limit else todo
    counts = rows.agg(F.count("*").alias("threads_discovered"), F.count_if("todo").alias("threads_pending"), F.count_if(~F.col("todo")).alias("threads_skipped"))
    taken = todo.agg(F.count("*").alias("threads_to_process"), F.coalesce(F.sum("comments"), F.lit(0)).alias("estimated_comments"))
    return counts.crossJoin(taken), todo.limit(preview).select("thread_id", "title", "comments", "created_at")  # one row each
