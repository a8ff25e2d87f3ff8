"""Titles alike but not equal: a similarity join by rare pieces and length, then the exact ratio.

A ratio of t between texts of n and m characters allows d = (1 - t)(n + m)
insertions and deletions, and each of them spoils at most Q of a text's pieces
of Q characters. So two texts that are alike share one of their d * Q + 1 rarest
pieces, whatever the order of rarity, and only these are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import normal_title, title_similarity
from quillmark.operators.resolve import TITLE_SCORE
from quillmark.session import cut

Q = 2
#: Pairs of forms that a task compares, forms of one piece in a share of it, and the most tasks of the join.
PAIRS, SHARE, MOST_TASKS = 250_000, 250, 10_000


def pieces(text: Column) -> Column:
    """Pieces of Q characters with their number among equal ones, so that repeated pieces count; the text itself if it is shorter."""
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text) - (Q - 1), F.lit(1))), lambda i: F.substr(text, i, F.lit(Q)))
    return F.transform(every, lambda p, i: F.concat_ws("|", p, F.size(F.filter(F.slice(every, F.lit(1), i), lambda x: x == p))))


def most_edits(length: Column, ratio: float) -> Column:
    """Insertions and deletions between a text of this length and any text that is alike."""
    longest = F.floor(length * (2 - ratio) / ratio + 1e-9)
    return F.floor((1 - ratio) * (length + longest) + 1e-9).cast("int")


def forms(rows: DataFrame, right: bool) -> DataFrame:
    """normal, kind, form: what the ratio compares of each normal title; a right one also without its subtitle."""
    plain, ordered = F.col("normal"), F.array_join(F.array_sort(F.split("normal", " ")), " ")
    kinds = [F.struct(F.lit("plain").alias("kind"), plain.alias("form")), F.struct(F.lit("ordered").alias("kind"), ordered.alias("form"))]
    if right:
        kinds.append(F.struct(F.lit("plain").alias("kind"), F.col("main").alias("form")))
    return rows.select("title", F.explode(F.array(*kinds)).alias("f")).select("title", "f.kind", "f.form").where("form <> ''").distinct()


def similar(left: DataFrame, right: DataFrame, ratio: float = TITLE_SCORE) -> DataFrame:
    """left_title, right_title, similarity of all pairs of different titles (column title) whose similarity is at least `ratio`.

    The right title may have a subtitle after a colon, which needn't be in the
    left one. Equal titles are compared once, so copies don't multiply; titles
    of nulls or without a word are like nothing. Pieces that very many titles
    hold are among the rarest of few. Pairs are met at each piece that they
    share there, and those with more edits than the ratio allows go at once:
    most pairs of titles made of the same few words never leave the join, and
    only what is left is told apart and has its ratio computed.
    """
    normal = lambda df: cut(df.where("title is not null").select("title").distinct().withColumns({"normal": normal_title("title"), "main": normal_title(F.element_at(F.split("title", ":"), 1))}))
    sides = [cut(forms(normal(df), r).withColumn("side", F.lit(int(r)))) for df, r in ((left, False), (right, True))]
    held = cut(sides[0].unionByName(sides[1]).withColumn("length", F.char_length("form")))
    each = held.select("kind", "form", "length").distinct().withColumn("piece", F.explode(pieces(F.col("form"))))
    rare = each.groupBy("piece").agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("n", "piece")))  # a title's own pieces
    first = each.join(rare, "piece").groupBy("kind", "form", "length").agg(ordered.alias("all"))
    first = cut(first.select("kind", "form", "length", F.explode(F.slice("all", F.lit(1), most_edits(F.col("length"), ratio) * Q + 1)).alias("p")).select("kind", "form", "length", "p.piece"))
    held_by = cut(first.groupBy("kind", "piece").agg(F.count("*").alias("n")))
    tasks = int(held_by.agg(F.coalesce(F.sum(F.col("n").cast("double") * F.col("n")), F.lit(0.0)).alias("n")).first().n / PAIRS) + 1
    dealt = first.join(held_by.withColumn("shares", F.ceil(F.col("n") / SHARE).cast("int")), ["kind", "piece"])
    share = {"a": F.pmod(F.xxhash64("form"), F.col("shares")).cast("int"), "b": F.explode(F.sequence(F.lit(0), F.col("shares") - 1))}
    side = lambda s: dealt.select(F.col("kind").alias(f"{s}_kind"), F.col("form").alias(f"{s}_form"), F.col("length").alias(f"{s}_length"), F.col("piece").alias(f"{s}_piece"), share[s].alias(f"{s}_share"))
    a, b = (side(s).repartition(min(tasks, MOST_TASKS), f"{s}_piece", f"{s}_kind", f"{s}_share") for s in "ab")
    near = (F.least("a_length", "b_length") * (2 - ratio) + 1e-9 >= F.greatest("a_length", "b_length") * ratio)
    # replacing counts once here and twice in the ratio, so no pair that is alike is farther apart than that
    edits = F.floor((1 - ratio) * (F.col("a_length") + F.col("b_length")) + 1e-9)
    longest = held.agg(F.coalesce(F.max("length"), F.lit(0)).alias("n")).first().n
    near &= F.levenshtein("a_form", "b_form", int(2 * longest * (1 - ratio) + 1e-9)).between(F.lit(0), edits)  # -1: more edits than any two titles may have
    met = a.join(b, (F.col("a_piece") == F.col("b_piece")) & (F.col("a_kind") == F.col("b_kind")) & (F.col("a_share") == F.col("b_share"))).where(near).select(F.col("a_kind").alias("kind"), "a_form", "b_form").distinct()
    titled = lambda side, s: sides[side].select(F.col("kind").alias(f"{s}_kind"), F.col("form").alias(f"{s}_form"), F.col("title").alias(f"{'left' if s == 'a' else 'right'}_title"))
    l, r = titled(0, "a"), titled(1, "b")  # noqa: E741
    pairs = met.join(l, (met.kind == l.a_kind) & (met.a_form == l.a_form)).join(r, (met.kind == r.b_kind) & (met.b_form == r.b_form))
    pairs = pairs.select("left_title", "right_title").where("left_title <> right_title").distinct()
    return pairs.withColumn("similarity", title_similarity("left_title", "right_title")).where(F.col("similarity") >= ratio)
