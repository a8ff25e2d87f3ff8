"""What the operators of this subpackage share: inputs, tables in the shared folder, prefix sums."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that splits words and is stripped from lines.
SPACE = r"[\x20\x09-\x0D]"
#: Shuffle files go once the query that made them has ended, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Batches for Python are held by the executor and by its worker; by 10,000 rows alone they'd grow with the texts.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
SETTINGS = {CLEANUP: "true", BATCH: "8m"}
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one in local mode where none is set (tests)."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir isn't set: tables between steps need a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="quillmark-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


class Workspace:
    """Tables of one run under the shared folder.

    A written table cuts the lineage: executors that are lost later cost the
    tasks they ran, not the steps before. drop() frees a table that no later
    step reads; the rest goes when the driver ends. Shuffle files go as soon as
    the table that they were for is written. Python gets batches of few bytes.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        before = {k: self.spark.conf.get(k) for k in SETTINGS}
        for k, v in SETTINGS.items():
            self.spark.conf.set(k, v)
        try:
            df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session may have ended before
            return


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow whose worker gives freed memory back after each task.

    Workers outlive tasks and stages. What a task has freed stays with the
    process otherwise, and adds up with what other stages take.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
            if trim:
                trim(0)

    return task


def word_count(text: Column) -> Column:
    """Words of the text, 0 for null: places where a word follows white space or the start."""
    return F.coalesce(F.size(F.filter(F.split(text, SPACE + "+"), lambda w: w != "")), F.lit(0)).cast("long")


def ranged(ws: Workspace, df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df, written in ranges of the order columns, with the number of the range as q_part."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return ws.save(dealt.withColumn("q_part", F.spark_partition_id()), name)


def prefix_sums(df: DataFrame, groups: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """Exclusive prefix sums of columns in each group of a ranged() table: {sum's name: column}.

    Each range adds up its own rows; the sums of all ranges before it come from
    a table of one row for each range and group. No group meets in one task.
    """
    own = Window.partitionBy("q_part", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*groups).orderBy("q_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy("q_part", *groups).agg(*[F.sum(c).alias(f"q_all_{k}") for k, c in sums.items()])
    offsets = offsets.select("q_part", *groups, *[F.coalesce(F.sum(f"q_all_{k}").over(before), F.lit(0)).alias(f"q_off_{k}") for k in sums])
    local = df.withColumns({k: F.coalesce(F.sum(c).over(own), F.lit(0)) for k, c in sums.items()})
    same = [local.q_part == offsets.q_part, *[local[g].eqNullSafe(offsets[g]) for g in groups]]
    return local.join(offsets, same).select(*[local[c] for c in df.columns], *[(local[k] + offsets[f"q_off_{k}"]).alias(k) for k in sums])


def numbered(ws: Workspace, df: DataFrame, order: list[str], number: str) -> DataFrame:
    """df with its rows numbered from 0 in the order of the columns."""
    placed = ranged(ws, df.withColumn("q_one", F.lit(1).cast("long")), order, f"ranged-{number}")
    return prefix_sums(placed, [], order, {number: "q_one"}).drop("q_one", "q_part")
