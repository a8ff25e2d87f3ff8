"""The golden run: extraction, classification and resolution held against labelled samples and cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions import classify, extract
from quillmark.functions.text import html_parts, normal_title
from quillmark.operators import resolve, reviews

SAMPLES = "sample_id long, html string, known_titles array<string>, books array<struct<title:string,tags:array<string>,strength:double>>"
CASES = (
    "case_id long, mention struct<title:string,author:string,work_id:string>,"
    " candidates array<struct<key:string,title:string,author_name:array<string>,subject:array<string>,isbn:array<string>,first_publish_year:int,cover_i:bigint>>, expected_work string"
)
NEAR = 0.1  # strengths that agree


def mentions_of(samples: DataFrame) -> DataFrame:
    """sample_id, normal, strength, tags: what is extracted from each sample, one for each normal title."""
    rows = samples.select("sample_id", html_parts("html")["plain"].alias("plain"), F.posexplode(extract.mentions_in_known("html", F.coalesce("known_titles", F.array().cast("array<string>")))).alias("place", "m"))
    rows = rows.select("sample_id", "place", normal_title("m.title").alias("normal"), extract.mention_context("plain", "m.raw").alias("context"))
    last = rows.groupBy("sample_id", "normal").agg(F.max_by("context", "place").alias("context"))
    strength = classify.strength(classify.label(F.col("context")))
    said = last.select(F.struct("sample_id", "normal").alias("key"), strength.alias("strength"), normal_title(F.concat_ws(" ", "context", "normal")).alias("said"))
    tags = classify.tag_topics(said, "said", "key").groupBy("key").agg(F.collect_set("topic").alias("tags"))  # a fixed list of topics
    return said.join(tags, "key", "left").select("key.sample_id", "key.normal", "strength", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def resolved_cases(cases: DataFrame) -> DataFrame:
    """case_id, expected_work, key: the candidate that each case's mention resolves to, or null."""
    spans = cases.select(F.col("case_id").alias("span_id"), "mention.title", "mention.author", "mention.work_id", F.explode("candidates").alias("c"))
    listed = spans.select("span_id", "title", "author", "work_id", "c.key", F.col("c.title").alias("candidate_title"), F.col("c.author_name").alias("names"), F.col("c.subject").alias("subjects"), F.col("c.isbn").alias("isbns"), F.col("c.first_publish_year").alias("year"))
    picked = resolve.cascade(reviews.with_reviews(resolve.scored_candidates(listed)))
    return cases.select("case_id", "expected_work").join(picked.select(F.col("span_id").alias("case_id"), "key"), "case_id", "left")


def golden(samples: DataFrame, cases: DataFrame) -> DataFrame:
    """One row: precision and recall of mentions and tags, agreement of strengths, accuracy of resolution, and how many of each there were.

    samples and cases have the columns of SAMPLES and CASES. A ratio of nothing is 0.
    """
    want = samples.select("sample_id", F.posexplode(F.coalesce("books", F.array().cast("array<struct<title:string,tags:array<string>,strength:double>>"))).alias("place", "b"))
    want = want.select("sample_id", normal_title("b.title").alias("normal"), "place", "b.tags", "b.strength").groupBy("sample_id", "normal").agg(F.max_by(F.struct("tags", "strength"), "place").alias("want"))
    both = mentions_of(samples).join(want, ["sample_id", "normal"], "full")
    hit = F.col("tags").isNotNull() & F.col("want").isNotNull()
    size = lambda c: F.sum(F.when(hit, F.size(c)).otherwise(0))
    expected = F.array_distinct(F.coalesce("want.tags", F.array().cast("array<string>")))
    n = both.agg(
        F.count_if(hit).alias("tp"), F.count_if(F.col("want").isNull()).alias("fp"), F.count_if(F.col("tags").isNull()).alias("fn"),
        size(F.array_intersect("tags", expected)).alias("tags_tp"), size(F.array_except("tags", expected)).alias("tags_fp"), size(F.array_except(expected, F.col("tags"))).alias("tags_fn"),
        F.count_if(hit & (F.abs(F.col("strength") - F.col("want.strength")) <= NEAR)).alias("strengths"),
    )
    right = resolved_cases(cases).agg(F.count("*").alias("canonicalization_cases"), F.count_if(F.col("key").eqNullSafe(F.col("expected_work"))).alias("right"))
    rows = n.crossJoin(right).crossJoin(samples.agg(F.count("*").alias("comments")))  # one row each
    share = lambda a, *rest: (F.coalesce(F.col(a), F.lit(0)) / F.greatest(F.lit(1), *[sum((F.coalesce(F.col(c), F.lit(0)) for c in rest), F.lit(0))])).cast("double")
    return rows.select(
        "comments", "canonicalization_cases",
        share("tp", "tp", "fp").alias("mention_precision"), share("tp", "tp", "fn").alias("mention_recall"), share("right", "canonicalization_cases").alias("canonicalization_accuracy"),
        share("tags_tp", "tags_tp", "tags_fp").alias("tag_precision"), share("tags_tp", "tags_tp", "tags_fn").alias("tag_recall"), share("strengths", "tp").alias("recommendation_strength_agreement"),
    )
