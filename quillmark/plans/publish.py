"""Versions of the library: staged tables, checks, and one pointer that readers follow.

A version is a folder of Parquet tables that is never changed once it is
published. Publishing moves a pointer file, so readers see the old tables or the
new ones, whole. All files are reached through Hadoop's file system, on the
driver's side only names and one small pointer pass.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a rebuild starts from: raw rows and caches, no derived rows.
RAW = ("threads", "comments", "items", "metadata_cache", "extraction_cache", "tags")


class Busy(RuntimeError):
    """Another writer holds the lock."""


class CheckFailed(ValueError):
    """A staged table broke a rule; the published version is untouched."""


class Library:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> str | None:
        pointer = f"{self.root}/CURRENT"
        return self.spark.read.text(pointer).first()[0] if self._fs.exists(self._path(pointer)) else None

    def versions(self) -> list[str]:
        top = self._path(f"{self.root}/versions")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(top)) if self._fs.exists(top) else []

    def tables(self, version: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.root}/versions/{version}")))

    def read(self, name: str, version: str | None = None) -> DataFrame:
        """A table of the version that is current now; it stays readable when a new one is published."""
        version = version or self.current()
        if version is None:
            raise LookupError("nothing is published")
        return self.spark.read.parquet(f"{self.root}/versions/{version}/{name}")

    def stage(self, version: str, **tables: DataFrame) -> None:
        """Writes tables of a version that isn't published; a table is never overwritten."""
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{self.root}/versions/{version}/{name}")

    def seed(self, version: str, source: str | None = None) -> None:
        """Raw tables and caches of another version, for a rebuild."""
        source = source or self.current()
        have = self.tables(source)
        self.stage(version, **{n: self.read(n, source) for n in RAW if n in have})

    def publish(self, version: str, checks: dict[str, DataFrame]) -> None:
        """Moves the pointer if no check finds a row."""
        broken = [name for name, rows in checks.items() if rows.limit(1).count()]
        if broken:
            raise CheckFailed(", ".join(broken))
        new, pointer = self._path(f"{self.root}/CURRENT.{version}"), self._path(f"{self.root}/CURRENT")
        out = self._fs.create(new, True)
        out.write(bytearray(f"{version}\n".encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(new, pointer, options)

    @staticmethod
    def _sums(name: str, df: DataFrame) -> DataFrame:
        """table, rows, digest: the digest doesn't depend on the order of rows."""
        each = F.xxhash64(F.to_json(F.struct(*df.columns))).cast("decimal(38,0)")
        return df.agg(F.lit(name).alias("table"), F.count("*").alias("rows"), F.coalesce(F.sum(each), F.lit(0)).cast("string").alias("digest"))

    def manifest(self, folder: str, names: list[str]) -> DataFrame:
        out = None
        for n in names:
            one = self._sums(n, self.spark.read.parquet(f"{folder}/{n}"))
            out = one if out is None else out.unionByName(one)
        return out

    def backup(self, folder: str, version: str | None = None) -> None:
        """Copies a version to a folder that doesn't exist, with a manifest, and reads it back."""
        version = version or self.current()
        names = self.tables(version)
        if self._fs.exists(self._path(folder)):
            raise FileExistsError(folder)
        for n in names:
            self.read(n, version).write.mode("errorifexists").parquet(f"{folder}/{n}")
        self.manifest(f"{self.root}/versions/{version}", names).write.mode("errorifexists").parquet(f"{folder}/manifest.parquet")
        self.verify(folder)

    def verify(self, folder: str) -> None:
        """CheckFailed if a table of a backup isn't what the manifest says."""
        want = {r.table: (r.rows, r.digest) for r in self.spark.read.parquet(f"{folder}/manifest.parquet").collect()}  # a row for each table
        have = {r.table: (r.rows, r.digest) for r in self.manifest(folder, sorted(want)).collect()}
        broken = sorted(n for n in want if want[n] != have.get(n))
        if broken:
            raise CheckFailed(", ".join(broken))

    @contextmanager
    def lock(self, stale_after: float | None = None) -> Iterator[None]:
        """One writer at a time; readers aren't kept out.

        A lock that is older than `stale_after` seconds is one that a writer left
        when it died, and is taken over: it is moved away, which only one of
        several can do. So this has to be longer than any run takes.
        """
        path = self._path(f"{self.root}/LOCK")
        self._fs.mkdirs(self._path(self.root))
        if not self._fs.createNewFile(path) and not (stale_after is not None and self._taken_over(path, stale_after)):
            raise Busy(self.root)
        try:
            yield
        finally:
            self._fs.delete(path, False)

    def _taken_over(self, path, stale_after: float) -> bool:
        try:
            age = time.time() - self._fs.getFileStatus(path).getModificationTime() / 1000
            if age <= stale_after or not self._fs.rename(path, self._path(f"{self.root}/LOCK.{uuid.uuid4().hex}")):
                return False
        except Py4JJavaError:  # another writer moved it or gave it back just now
            pass
        return bool(self._fs.createNewFile(path))


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).count().where("count > 1")


def orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    p = parents.select(F.col(parent_key).alias("q_parent"))
    return rows.where(F.col(key).isNotNull()).join(p, F.col(key) == p.q_parent, "left_anti")


def outside(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return rows.where(F.col(column).isNull() | ~F.col(column).isin(allowed))


def standard_checks(threads: DataFrame, comments: DataFrame, books: DataFrame, mentions: DataFrame, checkpoints: DataFrame | None = None, version: str | None = None, thread_id: int | None = None) -> dict[str, DataFrame]:
    """The rules of a version, each as a frame of the rows that break it."""
    out = {
        "thread ids repeat": repeated(threads, "id"),
        "comment ids repeat": repeated(comments, "id"),
        "books repeat": repeated(books, "openlibrary_id"),
        "titles repeat in a comment": repeated(mentions, "comment_id", "normalized_mention"),
        "comments without a thread": orphans(comments, "thread_id", threads, "id"),
        "mentions without a comment": orphans(mentions, "comment_id", comments, "id"),
        "mentions of no book": orphans(mentions, "book_id", books, "id"),
        "status unknown": outside(mentions, "status", ["resolved", "unresolved"]),
        "status and book disagree": mentions.where((F.col("status") == "resolved") != F.col("book_id").isNotNull()),
    }
    if thread_id is not None:
        out["foreign threads"] = threads.where(F.col("id") != thread_id)
    if checkpoints is not None:
        done = checkpoints.where(F.col("raw_complete") & (F.col("processed_version") == version))
        out["threads not processed"] = threads.join(done.select(F.col("thread_id").alias("id")), "id", "left_anti")
    return out
