"""The ranking's aggregates as streams: the same operators, run whenever rows arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.session import cut, shared_folder


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a folder as a stream; files that come later are read too."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def in_files(rows: DataFrame, order: str, files: int) -> DataFrame:
    """A table as a stream that brings it in so many batches, in the order of a column."""
    spark, folder = rows.sparkSession, f"{shared_folder(rows.sparkSession)}/in-{uuid.uuid4().hex}"
    rows.repartitionByRange(files, order).write.parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run_available(aggregate: DataFrame, name: str) -> DataFrame:
    """The result of a streamed aggregate once all rows that are there have been read.

    Each batch replaces the result's table, so a batch that is run again after
    a failure leaves the same rows.
    """
    spark, base = aggregate.sparkSession, f"{shared_folder(aggregate.sparkSession)}/{name}-{uuid.uuid4().hex}"

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/result")

    run = aggregate.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(put).start()
    run.awaitTermination()
    return spark.read.schema(aggregate.schema).parquet(f"{base}/result")


def upserted(aggregate: DataFrame, keys: list[str], name: str, buckets: int = 64) -> DataFrame:
    """As run_available(), from the groups only that each batch changed.

    The state of a group is the aggregate's own, so it is bounded by the
    groups. The result lies in partitions by a hash of the keys; a batch
    rewrites those that hold a group that it changed, and run again after a
    failure it leaves the same rows.
    """
    spark, base = aggregate.sparkSession, f"{shared_folder(aggregate.sparkSession)}/{name}-{uuid.uuid4().hex}"
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    schema = aggregate.withColumn("q_bucket", bucket).schema

    def put(batch: DataFrame, number: int) -> None:
        new = cut(batch.withColumn("q_bucket", bucket))
        touched = [r.q_bucket for r in new.select("q_bucket").distinct().collect()]  # one for each bucket at most
        if not touched:
            return
        if number:
            old = spark.read.schema(schema).parquet(f"{base}/result").where(F.col("q_bucket").isin(touched)).alias("old")
            same = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in ("q_bucket", *keys)]
            new = cut(old.join(new.alias("new"), same, "left_anti").unionByName(new))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("q_bucket").parquet(f"{base}/result")

    spark.createDataFrame([], schema).write.parquet(f"{base}/result")
    run = aggregate.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(put).start()
    run.awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/result").select(*aggregate.columns)


def windowed_counts(rows: DataFrame, ts: str, by: list[str], width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Mentions of each window and key; a window is final, and leaves the state, once `late` has passed."""
    return rows.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n"))
