"""Lexical search: a table of terms, prefix matches, topic filters."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions.text import normal, normal_title
from quillmark.session import cut
from quillmark.sources.config import MOST_SEARCH_WORDS, STOPWORDS


def search_words(query: str) -> list[str]:
    """Words of a query that count; at most MOST_SEARCH_WORDS."""
    return [w for w in re.findall(r"\w+", query.casefold()) if w not in STOPWORDS][:MOST_SEARCH_WORDS]


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows with long texts, dealt over so many tasks that a task's terms don't grow with the table."""
    return rows.repartition(1 + rows.count() // TEXT_ROWS, key)


def term_index(rows: DataFrame, key: str, *texts: str, ascii_only: bool = False) -> DataFrame:
    """key, term: each different word of the rows' texts. An array column counts as its items."""
    parts = [F.array_join(t, " ") if rows.schema[t].dataType.typeName() == "array" else F.coalesce(t, F.lit("")) for t in texts]
    joined = F.concat_ws(" ", *parts)
    # punctuation and the underscore end words; beyond ASCII also case and accents fold
    words = F.split(F.lower(joined), "[^a-z0-9]+") if ascii_only else F.split(F.translate(normal_title(joined), "_", " "), " +")
    return rows.select(key, F.explode(F.array_distinct(words)).alias("term")).where("term <> ''")


#: Rows of a range: a task sorts one range, so what it holds doesn't grow with the index.
RANGE_ROWS = 1 << 20
#: Rows of a task that takes terms from long texts, each of which may have hundreds.
TEXT_ROWS = 4096


class TermTable:
    """An index in sorted ranges, one file each, and a list of their first and last terms.

    A prefix is a range of terms: the list says which files hold it, and no
    other is opened. A term of very many rows spreads over ranges by its keys.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, terms: DataFrame, key: str, ranges: int | None = None) -> TermTable:
        order = ["term", key]
        terms = cut(terms)  # counted, sampled for the ranges and dealt: texts are read once
        dealt = terms.repartitionByRange(ranges or 1 + terms.count() // RANGE_ROWS, *order)
        dealt.sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/terms")
        stored = self.spark.read.schema(T.StructType([*terms.schema, T.StructField("part", T.IntegerType())])).parquet(f"{self.path}/terms")
        stored.groupBy("part").agg(F.min("term").alias("low"), F.max("term").alias("high")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ranges")
        return self

    def ranges(self, words: list[str]) -> list[int]:
        """The ranges that may hold a term that one of the words begins."""
        bounds, within = self.spark.read.parquet(f"{self.path}/ranges"), F.lit(False)
        for w in map(normal, words):
            within = within | ((F.col("high") >= w) & (F.col("low") <= w + "\U0010ffff"))
        return [r.part for r in bounds.where(within).select("part").collect()]  # one for each range at most

    def starting(self, words: list[str]) -> DataFrame:
        """Rows whose term one of the words begins."""
        begins = F.lit(False)
        for w in map(normal, words):
            begins = begins | F.col("term").startswith(w)
        rows = self.spark.read.parquet(f"{self.path}/terms")
        return rows.where(F.col("part").isin(self.ranges(words)) & begins).drop("part")


def matching(terms: DataFrame, key: str, words: list[str]) -> DataFrame:
    """Keys that have, for every word, a term that it begins; words may hit different columns, and lose their accents as terms have."""
    words = [normal(w) for w in words]
    if not words:
        return terms.select(key).distinct()
    hits = [F.col("term").startswith(w) for w in words]
    any_ = hits[0]
    for h in hits[1:]:
        any_ = any_ | h
    agg = terms.where(any_).groupBy(key).agg(*[F.max(h).alias(f"w{i}") for i, h in enumerate(hits)])
    return agg.where(" and ".join(f"w{i}" for i in range(len(hits)))).select(key)


def search(books: DataFrame, terms: DataFrame, query: str) -> DataFrame:
    """books that match the query; all for a blank one, none for one without words that count."""
    words = search_words(query)
    if not query.strip():
        return books
    if not words:
        return books.limit(0)
    return books.join(matching(terms, "book_id", words).withColumnRenamed("book_id", "id"), "id", "left_semi")


def by_topics(books: DataFrame, mentions: DataFrame, mention_tags: DataFrame, tags: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """books with a mention of any included topic and none of any excluded one."""

    def having(names: list[str]) -> DataFrame:
        ids = tags.where(F.col("name").isin(*names)).select(F.col("id").alias("tag_id"))
        marked = mention_tags.join(F.broadcast(ids), "tag_id", "left_semi")  # ids: as many as names were given
        return mentions.select(F.col("id").alias("mention_id"), F.col("book_id").alias("id")).join(marked, "mention_id", "left_semi").select("id")

    if include:
        books = books.join(having(list(include)), "id", "left_semi")
    if exclude:
        books = books.join(having(list(exclude)), "id", "left_anti")
    return books
