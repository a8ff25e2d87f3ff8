"""Decisions made by hand: on works' identities, and on whole comments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import authors_complete, normal_title
from quillmark.operators.incremental import digest
from quillmark.sources.config import excluded_works, reviewed_works


class ReviewOutdated(ValueError):
    """The comment, or what was shown of its ancestors, changed since it was reviewed."""


def with_reviews(scored: DataFrame) -> DataFrame:
    """scored_candidates() rows with `preferred` and `excluded`, and score 1 where a review says that titles mean the work.

    Reviews speak only of spans with an author; a link to a work overrides
    an exclusion. Both lists are fixed and short, so they are broadcast.
    """
    spark = scored.sparkSession
    rows = scored.join(F.broadcast(reviewed_works(spark)), F.col("key") == F.col("reviewed_key"), "left")
    rows = rows.join(F.broadcast(excluded_works(spark)), F.col("key") == F.col("excluded_key"), "left")
    own, theirs = normal_title("title"), normal_title("candidate_title")
    known = F.col("reviewed_key").isNotNull() & F.col("author").isNotNull() & authors_complete("author", "review_authors") & F.array_contains("review_titles", own)
    linked = F.coalesce(F.col("work_id") == F.col("key"), F.lit(False))
    out = F.col("excluded_key").isNotNull() & F.col("author").isNotNull() & ~linked & authors_complete("author", "excluded_authors")
    meant = known & F.array_contains("review_titles", theirs)
    return rows.withColumns({
        "score": F.when(meant, 1.0).otherwise(F.col("score")),
        "preferred": F.coalesce(known & F.col("work_id").isNull(), F.lit(False)),
        "excluded": F.coalesce(out, F.lit(False)),
    }).select(*scored.columns, "preferred", "excluded")


def apply_overrides(extracted: DataFrame, inputs: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mentions of all comments, audit) after replacing what was extracted from reviewed comments.

    extracted: comment_id and mention columns; inputs: thread_id, id, payload
    (model_input); reviews: thread_id, comment_id, source_digest, mentions
    (array of the mention columns). A review holds only for the very input it
    was made on; an outdated one stops the run before anything is replaced.
    The audit keeps what the reviews replaced.
    """
    twice = reviews.groupBy("thread_id", "comment_id").count().where("count > 1").limit(1).count()
    if twice:
        raise ValueError("a comment is reviewed twice")
    now = inputs.select("thread_id", F.col("id").alias("comment_id"), digest("thread_id", "id", "payload").alias("now"))
    bad = reviews.join(now, ["thread_id", "comment_id"], "left").where(~F.col("source_digest").eqNullSafe(F.col("now"))).select("comment_id").limit(5).collect()
    if bad:
        raise ReviewOutdated(", ".join(str(r.comment_id) for r in bad))
    ids = reviews.select("comment_id")
    columns = [c for c in extracted.columns if c != "comment_id"]
    new = reviews.select("comment_id", F.explode("mentions").alias("m")).select("comment_id", *[F.col(f"m.{c}").alias(c) for c in columns])
    return extracted.join(ids, "comment_id", "left_anti").select(*extracted.columns).unionByName(new.select(*extracted.columns)), extracted.join(ids, "comment_id", "left_semi")


def reclassified(mentions: DataFrame, comments: DataFrame) -> DataFrame:
    """mentions with sentiment and strength read anew from their comment's text."""
    from quillmark.functions import classify, extract
    from quillmark.functions.text import html_parts

    texts = comments.select(F.col("id").alias("comment_id"), html_parts("text")["plain"].alias("plain"))
    rows = mentions.join(texts, "comment_id").withColumn("context_text", extract.mention_context("plain", "raw_mention"))
    label = classify.label(F.col("context_text"))
    return rows.withColumns({"sentiment": classify.sentiment(label), "recommendation_strength": classify.strength(label)}).select(*mentions.columns)


def retagged(mentions: DataFrame, tags: DataFrame) -> DataFrame:
    """mention_id, tag_id, confidence: the topics of reclassified() mentions, read anew from their context and title."""
    from quillmark.functions import classify

    title = F.coalesce("canonical_title", "raw_mention") if "canonical_title" in mentions.columns else F.col("raw_mention")
    said = mentions.select(F.col("id").alias("mention_id"), normal_title(F.concat_ws(" ", "context_text", title)).alias("said"))
    found = classify.tag_topics(said, "said", "mention_id")
    return found.join(F.broadcast(tags.select(F.col("id").alias("tag_id"), F.col("name").alias("topic"))), "topic").select("mention_id", "tag_id", "confidence")  # a fixed list
