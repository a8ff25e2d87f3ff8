"""Mixing sources to target weights: hash-random order, prefix sums of words, exact cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import SPACE, Workspace, prefix_sums, ranged, table, word_count

WEIGHTS = (1, 2, 3)
MOST = 3


def targets(sizes: DataFrame, ws: Workspace, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target of each source in sizes (source, size).

    Sources in order of code points, null last, weigh as `weights` repeats and
    share the sum of all sizes. No target is above `most` times its source's
    size; what is over goes to the others by weight, until none is above. That
    comes to a level: a target is level x weight or the source's own bound,
    whichever is less, and the sources at their bound are those with the
    smallest bound for their weight. So one order by (bound / weight) and the
    prefix sums along it give the level.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = by.withColumn("no_source", F.col("source").isNull()).withColumn("one", F.lit(1))
    placed = prefix_sums(ranged(ws, by, ["no_source", "source"], "sources"), [], ["no_source", "source"], {"place": "one"})
    kinds = F.array(*map(F.lit, weights))
    placed = placed.withColumn("weight", F.get(kinds, F.pmod("place", F.lit(len(weights))).cast("int")).cast("long"))
    placed = placed.withColumn("bound", most * F.col("source_size")).withColumn("ratio", F.col("bound") / F.col("weight"))
    placed = placed.drop("q_part")
    ordered = prefix_sums(ranged(ws, placed, ["ratio", "place"], "ratios"), [], ["ratio", "place"], {"bounds": "bound", "weights": "weight"})
    total = placed.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    # the level if all sources before this one are at their bound; the first that is at most the own ratio holds
    level = (F.col("all_size") - F.col("bounds")) / (F.col("all_weight") - F.col("weights"))
    levels = ordered.crossJoin(F.broadcast(total)).withColumn("level", level)  # total: one row
    first = levels.where("level <= ratio").agg(F.min_by("level", F.struct("ratio", "place")).alias("at"))
    out = placed.crossJoin(F.broadcast(first))  # first: one row
    target = F.least(F.col("bound").cast("double"), F.col("at") * F.col("weight"))
    return out.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, ws: Workspace, *, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs, and the columns to `carry`.

    size counts the words of the text, 0 for null. Within each source the rows
    lie in the order of a hash of seed and doc_id. The mix takes whole passes
    over a source as long as its budget (the target, rounded) holds them, and
    then the rows from the start up to the word at which the budget is used up:
    taken = passes x size + what the last pass takes of the row. One row of a
    source may be cut there. No row is taken more than `most` times.

    Rows with the same doc_id are rows of their own; those alike in doc_id and
    size are equal, and so is what they may get. A null source is a source, the
    last one; a source without words gets nothing. Very long texts are counted
    whole. Only doc_id, source, text and `carry` are read of docs. Empty tables
    give empty ones.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *carry)
    rows = rows.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    rows = ws.save(rows, "sizes")
    goal = ws.save(targets(rows, ws, weights, most), "targets")
    order = ["source", "mix_key", "doc_id", "size", *carry]
    laid = prefix_sums(ranged(ws, rows, order, "order"), ["source"], order[1:], {"before": "size"})
    at = laid.join(goal.withColumnRenamed("source", "goal_source"), F.col("source").eqNullSafe(F.col("goal_source")))
    budget = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - passes * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return at.select("doc_id", "size", "source_size", "target", (passes * F.col("size") + last).cast("long").alias("taken"), *carry)


def mixed(docs: DataFrame, ws: Workspace) -> DataFrame:
    """The mix as rows of docs: one for each time a row is taken; the row at a source's cut holds its first words only.

    Columns of docs may have any name. Rows without a word aren't taken.
    """
    rows = ws.save(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[docs[c] for c in docs.columns]).alias("doc")), "rows")
    taken = mix(rows.select("row", "doc.doc_id", "doc.source", "doc.text"), ws, carry=("row",)).where("taken > 0").select("row", "size", "taken")
    whole = F.array_repeat(F.col("size"), F.floor(F.col("taken") / F.col("size")).cast("int"))
    cut = F.col("taken") % F.col("size")
    takes = F.concat(whole, F.when(cut > 0, F.array(cut)).otherwise(F.array().cast("array<bigint>")))
    out = rows.join(taken.withColumn("take", F.explode(takes)), "row")
    start = F.slice(F.filter(F.split("doc.text", SPACE + "+"), lambda w: w != ""), 1, F.col("take").cast("int"))
    text = F.when(F.col("take") == F.col("size"), F.col("doc.text")).otherwise(F.array_join(start, " "))
    return out.select(*[(text if c == "text" else F.col("doc").getField(c)).alias(c) for c in docs.columns])


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), Workspace(spark, "op8"))


SQL = r"""
with d as (
  select doc_id, source, md5('mix:' || coalesce(cast(doc_id as varchar), '')) as k,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size
  from documents
),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight, row_number() over (order by source nulls last) as place from s),
r as (select *, 3 * source_size as bound, (3 * source_size) / cast(weight as double) as ratio from w),
l as (
  select *, (sum(source_size) over () - coalesce(sum(bound) over before, 0)) / cast(sum(weight) over () - coalesce(sum(weight) over before, 0) as double) as level
  from r window before as (order by ratio, place rows between unbounded preceding and 1 preceding)
),
g as (
  select source, source_size, least(cast(bound as double), weight * (select arg_min(level, (ratio, place)) from l where level <= ratio)) as target from l
),
p as (
  select d.*, g.source_size, g.target, cast(round(g.target) as bigint) as budget,
    coalesce(sum(size) over (partition by d.source order by k, doc_id rows between unbounded preceding and 1 preceding), 0) as before
  from d join g on d.source is not distinct from g.source
)
select doc_id, cast(size as bigint) as size, source_size, target,
  cast(case when source_size = 0 then 0 else (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) end as bigint) as taken
from p
"""
