"""The library's tables, as views of the star-schema tables that queries run over.

Two streams of mentions: `event_mentions` (events; few books, many readers) and
`order_mentions` (line items with their orders; many books and years).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.classify import LABELS


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _opinion(label: Column) -> list[Column]:
    sentiment, strength = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, (t, s) in LABELS.items():
        sentiment, strength = F.when(label == name, F.lit(t)).otherwise(sentiment), F.when(label == name, F.lit(s)).otherwise(strength)
    return [strength.alias("recommendation_strength"), sentiment.alias("sentiment")]


def day_seconds(ts: str) -> Column:
    """Epoch second of the day's start."""
    return (F.unix_date(F.to_date(ts)).cast("long") * 86400).alias("created_at")


def event_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_mentions(read(spark, sf_dir, "events"))


def as_mentions(events: DataFrame) -> DataFrame:
    """id, book_id, author, thread_id, comment_id, created_at, label, strength, sentiment, status."""
    kind = F.col("event_type")
    label = F.when(kind == "purchase", "recommended").when(kind == "signup", "positive").when(kind == "error", "negative").otherwise("neutral")
    book = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        F.col("event_id").alias("id"),
        book.alias("book_id"),
        F.when(F.col("user_id") % 11 != 0, F.concat(F.lit("u"), F.col("user_id"))).alias("author"),
        (F.col("event_id") % 37).alias("thread_id"),
        F.col("event_id").alias("comment_id"),
        day_seconds("ts"),
        label.alias("label"),
        *_opinion(label),
        F.when(F.col("event_id") % 7 == 0, "unresolved").otherwise("resolved").alias("status"),
    )


def event_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, canonical_title: books of events, and a book that nobody mentions."""
    ids = event_mentions(spark, sf_dir).select("book_id").distinct().union(spark.createDataFrame([(-1,)], "book_id long"))
    return ids.select(F.col("book_id").alias("id"), F.concat(F.lit("Book "), F.col("book_id")).alias("canonical_title"))


def order_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of parts in orders, one for each order and part: the largest line speaks.

    Lines are dealt by order, which has a few of them, so that the aggregate and the join share a shuffle and a sort.
    """
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag").repartition("l_orderkey")
    most = F.max(F.struct("l_quantity", "l_extendedprice", "l_discount", "l_returnflag")).alias("m")
    lines = lines.groupBy("l_orderkey", "l_partkey").agg(most)
    flag, off = F.col("m.l_returnflag"), F.col("m.l_discount")
    label = F.when(flag == "R", "negative").when(flag == "N", "recommended").when(off < 0.03, "neutral").otherwise("positive")
    orders = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        (F.col("l_orderkey") * 1_000_000 + F.col("l_partkey")).alias("id"),
        F.col("l_partkey").alias("book_id"),
        F.when(F.col("o_custkey") % 11 != 0, F.concat(F.lit("c"), F.col("o_custkey"))).alias("author"),
        F.col("c_nationkey").cast("long").alias("thread_id"),
        F.col("l_orderkey").alias("comment_id"),
        day_seconds("o_orderdate"),
        label.alias("label"),
        *_opinion(label),
        F.when(F.col("m.l_quantity") > 45, F.array("c_mktsegment", "o_orderpriority")).otherwise(F.array().cast("array<string>")).alias("topics"),
    )


def told_apart(mentions: DataFrame) -> DataFrame:
    """order_mentions with an id that no two share: from a million parts on, those of different orders and parts may be equal numbers."""
    return mentions.withColumn("id", F.struct("comment_id", "book_id"))


def order_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("canonical_title"))


def order_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name: topics of orders; a topic without mentions too. The ids are hashes of the names."""
    a = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"))
    b = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name"))
    names = a.union(b).distinct().union(spark.createDataFrame([("UNUSED",)], "name string")).where("name is not null")
    return names.select(F.xxhash64("name").alias("id"), "name")


def order_mention_tags(mentions: DataFrame) -> DataFrame:
    """mention_id, tag_id, confidence of order_mentions."""
    rows = mentions.select(F.col("id").alias("mention_id"), F.posexplode("topics").alias("at", "name"))
    return rows.select("mention_id", F.xxhash64("name").alias("tag_id"), F.when(F.col("at") == 0, 0.8).otherwise(0.5).alias("confidence"))


def conversation_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, thread_id, parent_id, author, text, created_at: a turn answers the one before."""
    c = read(spark, sf_dir, "conversations")
    return c.select(
        F.col("turn").cast("long").alias("id"), F.col("conv_id").alias("thread_id"), (F.col("turn") - 1).cast("long").alias("parent_id"),
        F.col("role").alias("author"), F.coalesce("text", F.lit("")).alias("text"), (F.col("turn") * 60).cast("long").alias("created_at"),
    )
