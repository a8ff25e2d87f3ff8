"""Mentions that a model returned: checks against the comment, and duplicates of one title."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import grounded_excerpt, normal_title
from quillmark.sources.config import TOPICS

CONFLICT_CAP = 0.69
#: Where an author's name came from, weakest first.
SOURCES = ["unknown", "inferred", "context", "stated"]
WORK = r"^(?:(?:https?://openlibrary\.org)?/works/)?(OL\d+W)(?:[/?#].*)?$"


def validated(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sound rows, rejected rows) of mentions with text and links of their comment.

    raw becomes the excerpt of the text that it quotes; without one, or without
    a title, the row is rejected with its reason. A work link stays if the
    comment holds it; unknown tags and repeated ones go; an author without a
    name has no source. What was changed is kept in `changes`.
    """
    topics = F.array(*map(F.lit, TOPICS))
    number = F.regexp_extract(F.trim("work_id"), WORK, 1)
    linked = F.exists("links", lambda u: F.regexp_extract(u, r"^https?://openlibrary\.org/works/(OL\d+W)(?:[/?#].*)?$", 1) == number)
    author = F.when(F.trim("author") != "", F.trim("author"))
    new = {
        "raw": grounded_excerpt("raw", "text"),
        "work_id": F.when((number != "") & linked, F.concat(F.lit("/works/"), number)),
        "tags": F.array_distinct(F.filter("tags", lambda t: F.array_contains(topics, t))),
        "author": author,
        "author_source": F.when(author.isNull(), "unknown").when(F.col("author_source") == "unknown", "inferred").otherwise(F.col("author_source")),
    }
    rows = mentions.withColumns({f"new_{k}": v for k, v in new.items()})
    reason = F.when(F.col("new_raw").isNull(), "evidence").when(normal_title("title") == "", "title")
    rows = rows.withColumn("reason", reason)
    text = lambda c: F.col(c).cast("string")
    changed = [F.when(~text(k).eqNullSafe(text(f"new_{k}")), F.struct(F.lit(k).alias("key"), text(k).alias("value"))) for k in new]
    rows = rows.withColumn("changes", F.map_from_entries(F.array_compact(F.array(*changed))))
    keep = [c for c in mentions.columns if c not in new]
    sound = rows.where("reason is null").select(*keep, *[F.col(f"new_{k}").alias(k) for k in new], "changes")
    return sound, rows.where("reason is not null").select(*mentions.columns, "reason")


def collapsed(mentions: DataFrame, keys: list[str], title: str = "normal") -> DataFrame:
    """One row for each keys and title, as duplicates tell it.

    The row with the best author source, confidence and longest raw text leads.
    Different sentiments make neutral; tags are united; different authors or
    works leave neither, and a confidence of CONFLICT_CAP at most.
    """
    rank = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("author_source"))
    lead = F.struct(rank.alias("rank"), "confidence", F.char_length("raw").alias("length"), "raw", "author", "author_source", "sentiment")
    names = F.when(F.col("author").isNotNull(), F.coalesce("author_normal", F.lower("author"))) if "author_normal" in mentions.columns else F.lower("author")
    per = mentions.groupBy(*keys, title).agg(
        F.count("*").alias("n"),
        F.max(lead).alias("lead"),
        F.max("confidence").alias("top"),
        F.countDistinct(names).alias("n_authors"),
        F.countDistinct("work_id").alias("n_works"),
        F.max("work_id").alias("work"),
        F.countDistinct("sentiment").alias("n_sentiments"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"),
    )
    split = (F.col("n_authors") > 1) | (F.col("n_works") > 1)
    return per.select(
        *keys, title, F.col("lead.raw").alias("raw"),
        F.when(~split, F.col("lead.author")).alias("author"),
        F.when(split, "unknown").otherwise(F.col("lead.author_source")).alias("author_source"),
        F.when(~split, F.col("work")).alias("work_id"),
        F.when(split, F.least("top", F.lit(CONFLICT_CAP))).otherwise(F.col("top")).alias("confidence"),
        F.when(F.col("n_sentiments") > 1, "neutral").otherwise(F.col("lead.sentiment")).alias("sentiment"),
        "tags", F.col("n").alias("n_duplicates"), split.alias("conflicting"),
    )
