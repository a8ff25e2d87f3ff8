"""Rows and what is derived from them, in partitions by a hash of their thread, so that a run touches what changed.

A run compares digests, derives anew only for the rows that changed, and
rewrites the partitions that hold them (dynamic partition overwrite); the others
are neither read nor written. The rows themselves, with their digests, are
written last: after a crash their derived rows are simply derived again.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.operators.incremental import digest
from quillmark.session import cut

SHARDS = 256
MARKS = ("digest", "seen", "open")


class Derived(NamedTuple):
    """What a run makes of changed rows: tables with a column row_id, and the row_ids that have something left open."""

    tables: dict[str, DataFrame]
    open: DataFrame | None = None


class Shards:
    def __init__(self, spark: SparkSession, root: str, shards: int = SHARDS, by: str = "thread_id", key: str = "id") -> None:
        self.spark, self.root, self.shards, self.by, self.key = spark, root.rstrip("/"), shards, by, key
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def has(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/schemas/{name}/_SUCCESS"))

    def read(self, name: str, shards: list[int] | None = None) -> DataFrame:
        """A table; of given shards, only their folders are read. Its schema is kept, as it may have no row."""
        schema = T.StructType.fromJson(json.loads(self.spark.read.text(f"{self.root}/schemas/{name}").first()[0]))
        df = self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        return df if shards is None else df.where(F.col("shard").isin(shards))

    def _old(self, name: str, like: DataFrame, shards: list[int]) -> DataFrame:
        return self.read(name, shards).select(*like.columns) if self.has(name) else like.limit(0)

    def _replace(self, name: str, df: DataFrame, shards: list[int]) -> int:
        """Writes the shards of a table and removes those that have no rows any more; how many rows were written."""
        seen = Observation()
        df = cut(df)
        if not self.has(name):
            self.spark.createDataFrame([(df.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/schemas/{name}")
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(f"{self.root}/{name}")
        full = {r.shard for r in df.select("shard").distinct().collect()}  # SHARDS rows at most
        for shard in set(shards) - full:
            self._fs.delete(self._path(f"{self.root}/{name}/shard={shard}"), True)
        return seen.get["rows"]

    def update(self, rows: DataFrame, derive: Callable[[DataFrame], Derived], *, version: str, seen: str = "", force: bool = False) -> dict[str, int]:
        """Takes in rows (by, key and others; one for each key) and returns counters.

        A row is derived anew if a column or the version changed, if `seen` (what
        the derivation looked things up in) changed and something was left open,
        or by force. Rows that are stored and not given stay; so do rows of other
        shards. Derived rows of a row are replaced as a whole. Rows without a
        thread are a thread.
        """
        columns = rows.columns
        new = rows.withColumn("shard", F.pmod(F.xxhash64(self.by), F.lit(self.shards)).cast("int"))
        new = cut(new.withColumn("q_version", F.lit(version)).withColumn("digest", digest("q_version", *columns)).drop("q_version"))
        given = [r.shard for r in new.select("shard").distinct().collect()]  # SHARDS rows at most
        marked = new.withColumns({"seen": F.lit(seen), "open": F.lit(False)})
        was = self._old("rows", marked, given).select(self.key, F.col("digest").alias("was"), F.col("seen").alias("was_seen"), F.col("open").alias("was_open"))
        again = F.coalesce(F.col("was_open") & (F.col("was_seen") != seen), F.lit(False))
        todo = new.join(was, self.key, "left").where(F.lit(force) | ~F.col("digest").eqNullSafe(F.col("was")) | again)
        todo = cut(todo.select(*new.columns))
        counts = {"rows_total": new.count(), "rows_processed": todo.count()}
        counts |= {"rows_skipped": counts["rows_total"] - counts["rows_processed"], "shards_written": 0}
        if not counts["rows_processed"]:
            return counts
        shards = [r.shard for r in todo.select("shard").distinct().collect()]  # SHARDS rows at most
        found = derive(todo.drop("shard", "digest"))
        place = todo.select(F.col(self.key).alias("row_id"), "shard")
        for name, table in found.tables.items():
            fresh = table.join(place, "row_id")
            old = self._old(name, fresh, shards).join(place.select("row_id"), "row_id", "left_anti").select(*fresh.columns)
            counts[f"{name}_written"] = self._replace(name, old.unionByName(fresh), shards)
        left = todo.withColumn("seen", F.lit(seen))
        if found.open is None:
            left = left.withColumn("open", F.lit(False))
        else:
            left = left.join(found.open.select(F.col("row_id").alias(self.key)).distinct().withColumn("open", F.lit(True)), self.key, "left").withColumn("open", F.coalesce("open", F.lit(False)))
        kept = self._old("rows", marked, shards).join(todo.select(self.key), self.key, "left_anti")
        counts["rows_written"] = self._replace("rows", kept.select(*marked.columns).unionByName(left.select(*marked.columns)), shards)
        return counts | {"shards_written": len(shards)}
