"""Precision and recall of predictions against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRENGTH_TOLERANCE = 0.1 + 1e-9


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b; null for b = 0."""
    return F.try_divide(F.col(a).cast("double") if isinstance(a, str) else a.cast("double"), F.col(b).cast("double") if isinstance(b, str) else b.cast("double"))


def matched(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Gold and predictions of each comment, one to one, in gold's order.

    gold: comment_id, gold_no, titles (normal forms, aliases too); predicted:
    comment_id, pred_no, title (normal form). A comment's titles are different
    in gold and, but for repeats, in predictions, so the first gold that a
    prediction fits, and the first prediction that fits a gold, are each other's.
    """
    pairs = gold.withColumn("title", F.explode("titles")).select("comment_id", "gold_no", "title").join(predicted.select("comment_id", "pred_no", "title"), ["comment_id", "title"])
    pairs = pairs.select("comment_id", "gold_no", "pred_no").distinct()
    first_gold = Window.partitionBy("comment_id", "pred_no").orderBy("gold_no")
    first_pred = Window.partitionBy("comment_id", "gold_no").orderBy("pred_no")
    pairs = pairs.withColumn("a", F.row_number().over(first_gold)).where("a = 1").withColumn("b", F.row_number().over(first_pred)).where("b = 1").select("comment_id", "gold_no", "pred_no")
    g = gold.withColumnRenamed("comment_id", "g_comment").withColumnRenamed("gold_no", "g_no")
    left = pairs.join(g, (F.col("comment_id") == F.col("g_comment")) & (F.col("gold_no") == F.col("g_no")), "right")
    p = predicted.withColumnRenamed("comment_id", "p_comment").withColumnRenamed("pred_no", "p_no")
    both = left.join(p, (F.col("g_comment") == F.col("p_comment")) & (F.col("pred_no") == F.col("p_no")), "full")
    return both.drop("comment_id", "gold_no", "pred_no").withColumn("outcome", F.when(F.col("g_no").isNull(), "fp").when(F.col("p_no").isNull(), "fn").otherwise("tp"))


def mention_metrics(pairs: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counts and ratios of matched() rows that also have tags, sentiment and strength of both sides (g_*, p_*)."""
    none = F.array().cast("array<string>")
    g, p = F.coalesce("g_tags", none), F.coalesce("p_tags", none)
    is_ = lambda o: F.col("outcome") == o
    n = lambda cond: F.count(F.when(cond, 1))
    out = pairs.groupBy(*by).agg(
        n(is_("tp")).alias("tp"), n(is_("fp")).alias("fp"), n(is_("fn")).alias("fn"),
        F.sum(F.size(F.array_intersect(g, p))).alias("tags_tp"), F.sum(F.size(F.array_except(p, g))).alias("tags_fp"), F.sum(F.size(F.array_except(g, p))).alias("tags_fn"),
        n(is_("tp") & (F.col("g_sentiment") == F.col("p_sentiment"))).alias("sentiment_correct"),
        n(is_("tp") & (F.abs(F.col("g_strength") - F.col("p_strength")) <= STRENGTH_TOLERANCE)).alias("strength_correct"),
    )
    c = F.col
    return out.select(
        "*", ratio(c("tp"), c("tp") + c("fp")).alias("mention_precision"), ratio(c("tp"), c("tp") + c("fn")).alias("mention_recall"),
        ratio(c("tags_tp"), c("tags_tp") + c("tags_fp")).alias("tag_precision"), ratio(c("tags_tp"), c("tags_tp") + c("tags_fn")).alias("tag_recall"),
        ratio("sentiment_correct", "tp").alias("sentiment_agreement"), ratio("strength_correct", "tp").alias("strength_agreement"),
    )


def _identities() -> dict[str, Column]:
    """Conditions on matched() rows that also have g_identity, g_work, g_accepted and p_work, p_status."""
    hit, pending = F.col("outcome") == "tp", F.coalesce(F.col("g_identity") == "pending", F.lit(False))
    accepted = F.concat(F.array("g_work"), F.coalesce("g_accepted", F.array().cast("array<string>")))
    right = F.coalesce(F.array_contains(accepted, F.col("p_work")), F.lit(False))
    known = hit & ~pending & F.col("g_work").isNotNull()
    unknown = hit & ~pending & F.col("g_work").isNull()
    status = F.coalesce("p_status", F.lit(""))
    return {"pending": F.col("g_comment").isNotNull() & pending, "known": known, "right": known & right, "wrong": known & ~right, "unknown": unknown, "abstained": unknown & (status == "unresolved"), "rash": unknown & (status == "resolved"), "unresolved": status == "unresolved"}


def identity_metrics(pairs: DataFrame, by: list[str] = ()) -> DataFrame:
    """How many works were known, and resolved to the right one with the right authors; how many weren't, and were left open.

    pairs: matched() rows with g_identity, g_work, g_accepted, g_authors and
    p_work, p_status, p_authors (authors as normal names). Labels whose identity
    is pending are counted, and no more is said of them.
    """
    i = _identities()
    none = F.array().cast("array<string>")
    names = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, none)))
    out = pairs.groupBy(*by).agg(
        F.count_if(i["pending"]).alias("identities_pending"), F.count_if(i["known"]).alias("known_works"), F.count_if(i["right"]).alias("identity_correct"),
        F.count_if(i["known"] & (names("g_authors") == names("p_authors"))).alias("authors_correct"),
        F.count_if(i["unknown"]).alias("ambiguous_works"), F.count_if(i["abstained"]).alias("abstentions_correct"), F.count_if(i["unresolved"]).alias("unresolved"),
    )
    return out.select("*", ratio("identity_correct", "known_works").alias("identity_accuracy"), ratio("abstentions_correct", "ambiguous_works").alias("abstention_accuracy"))


def errors(pairs: DataFrame) -> DataFrame:
    """comment_id, kind, title, expected_work, actual_work: a row for each thing that is wrong with a prediction, or left open.

    pairs: as for identity_metrics(), with g_title and p_title.
    """
    i, o = _identities(), F.col("outcome")
    none = F.lit(None).cast("string")
    row = lambda kind, title, want=none, got=none: F.struct(F.lit(kind).alias("kind"), F.col(title).alias("title"), want.alias("expected_work"), got.alias("actual_work"))
    kinds = [
        (o == "fn", row("omission", "g_title")), (i["wrong"], row("identity_mismatch", "g_title", F.col("g_work"), F.col("p_work"))),
        (i["rash"], row("unexpected_resolution", "g_title")), (o == "fp", row("false_positive", "p_title")), (i["unresolved"], row("unresolved", "p_title")),
    ]
    found = F.array_compact(F.array(*[F.when(cond, r) for cond, r in kinds]))
    return pairs.select(F.coalesce("g_comment", "p_comment").alias("comment_id"), F.explode(found).alias("e")).select("comment_id", "e.*")


def confusion(rows: DataFrame, truth: str, guess: str, cases: str) -> DataFrame:
    """case, tp, fp, fn, tn, precision, recall; a row counts in each of its cases, and in 'all'."""
    rows = rows.withColumn("case", F.explode(F.concat(F.array(F.lit("all")), F.col(cases))))
    t, g = F.col(truth), F.col(guess)
    n = lambda cond: F.count(F.when(cond, 1))
    out = rows.groupBy("case").agg(n(t & g).alias("tp"), n(~t & g).alias("fp"), n(t & ~g).alias("fn"), n(~t & ~g).alias("tn"))
    return out.select("*", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def set_metrics(expected: DataFrame, actual: DataFrame, by: list[str], item: str) -> DataFrame:
    """by, tp, fp, fn: how the sets of items of each group agree; groups that only one side has count too."""
    e = expected.select(*by, item).distinct().withColumn("in_expected", F.lit(True))
    a = actual.select(*by, item).distinct().withColumn("in_actual", F.lit(True))
    both = e.join(a, [*by, item], "full")
    there = lambda c: F.coalesce(F.col(c), F.lit(False))
    e, a = there("in_expected"), there("in_actual")
    return both.groupBy(*by).agg(F.count_if(e & a).alias("tp"), F.count_if(~e & a).alias("fp"), F.count_if(e & ~a).alias("fn"))


def compared(gold: DataFrame, predictors: dict[str, DataFrame], by: list[str] = ()) -> DataFrame:
    """mention_metrics() of several predictors on one gold, with the predictor's name; what was saved, a baseline, what reviews replaced."""
    out = None
    for name, predicted in predictors.items():
        rows = mention_metrics(matched(gold, predicted).withColumn("predictor", F.lit(name)), ["predictor", *by])
        out = rows if out is None else out.unionByName(rows)
    return out


def review_faults(snapshot: DataFrame, labels: DataFrame, topics: list[str], partial: bool = False) -> dict[str, DataFrame]:
    """The rules of a complete review, each as a frame of the rows that break it.

    snapshot: comment_id, text, source_digest, processed; labels: comment_id,
    source_digest, status, mentions (array of raw, titles, tags, identity_status,
    work_id), null while pending. A partial review may leave comments out.
    """
    twice = lambda df: df.groupBy("comment_id").count().where("count > 1")
    both = labels.join(snapshot.select("comment_id", "text", F.col("source_digest").alias("now")), "comment_id")
    said = both.where("status = 'reviewed'").select("comment_id", "text", F.explode("mentions").alias("m"))
    titles = said.select("comment_id", F.explode("m.titles").alias("title"))
    open_ = F.col("m.identity_status").isin("ambiguous", "pending")
    out = {
        "stored twice": twice(snapshot),
        "reviewed twice": twice(labels),
        "unknown comments": labels.join(snapshot, "comment_id", "left_anti"),
        "other source": both.where(~F.col("source_digest").eqNullSafe(F.col("now"))),
        "status unknown": labels.where(~F.coalesce(F.col("status").isin("pending", "reviewed"), F.lit(False))),
        "status and labels disagree": labels.where((F.col("status") == "pending") != F.col("mentions").isNull()),
        "titles empty or repeated": titles.groupBy("comment_id", "title").count().where("count > 1 or trim(title) = ''"),
        "not in the text": said.where(~F.contains("text", F.col("m.raw"))),
        "topics unknown": said.where(F.size(F.array_except("m.tags", F.array(*map(F.lit, topics)))) > 0),
        "identity and work disagree": said.where(((F.col("m.identity_status") == "verified") & F.col("m.work_id").isNull()) | (open_ & F.col("m.work_id").isNotNull())),
    }
    if "snapshot_digest" in snapshot.columns:  # as Api.snapshot() makes it
        now = F.sha2(F.to_json(F.struct("comment_id", "text", *[c for c in ("mentions",) if c in snapshot.columns])), 256)
        out["snapshot changed"] = snapshot.where(~F.col("snapshot_digest").eqNullSafe(now))
    if not partial:
        out |= {
            "not reviewed": snapshot.join(labels.where("status = 'reviewed'"), "comment_id", "left_anti"),
            "not processed": snapshot.where(~F.coalesce("processed", F.lit(False))),
            "identities pending": said.where("m.identity_status = 'pending'"),
        }
    return out
