"""A session with the settings that the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, app: str = "quillmark", **conf: str) -> SparkSession:
    """UTC, adaptive execution and Arrow; other settings by keyword with _ for the dots' places, or as given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode a temporary one where that isn't set."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir isn't set: it has to be a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="quillmark-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed in the shared folder: executors that are lost later cost no steps before."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, by: str = "", buckets: int = 0) -> DataFrame:
    """df as Parquet in the shared folder, in buckets by a column if stated.

    Grouping and joining bucketed rows by that column, with others or without, takes no
    shuffle; df has to be dealt so already (repartition), else each task writes to all buckets.
    """
    spark, name = df.sparkSession, f"stored_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    if buckets:
        df.write.bucketBy(buckets, by).option("path", path).saveAsTable(name, format="parquet")
        return spark.table(name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
