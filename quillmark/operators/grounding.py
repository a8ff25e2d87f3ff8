"""Quotes and the texts that hold them, met at each quote's rarest run of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import grounded_excerpt, normal_title
from quillmark.session import cut

#: Words of a run, characters of a piece of quotes that have no run.
RUN, PIECE = 5, 3


def runs_of(words: Column, n: Column | int, edge: int = 0) -> Column:
    """Runs of n words, without the first and last `edge` words."""
    n = F.lit(n) if isinstance(n, int) else n
    starts = F.when(F.size(words) >= n + 2 * edge, F.sequence(F.lit(1 + edge), F.size(words) - n - edge + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def pieces_of(text: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    starts = F.when(F.char_length(text) >= n, F.sequence(F.lit(1), F.char_length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substr(text, i, n))


def keyed(rows: DataFrame, key: str, kind: str, n: int, parts: Column) -> DataFrame:
    return rows.select(key, F.explode(F.array_distinct(F.transform(parts, lambda p: F.xxhash64(F.lit(kind), F.lit(n), p)))).alias("part"))


def asked_parts(quotes: DataFrame) -> DataFrame:
    """item_id, kind, n, part: what a text that holds the quote must hold too.

    The first and the last word of a quote may be parts of words there, so its
    runs are of the words between them: RUN of them, or all if they are fewer. A
    quote of one or two words has pieces of PIECE characters, or of all that it has.
    """
    q = quotes.select("item_id", F.regexp_replace(normal_title("raw"), "^[_ ]+|[_ ]+$", "").alias("t"))
    q = q.withColumn("w", F.split("t", " ")).where("t <> ''")
    inner = F.size("w") - 2
    q = q.withColumns({"kind": F.when(inner > 0, "run").otherwise("piece"), "n": F.when(inner > 0, F.least(inner, F.lit(RUN))).otherwise(F.least(F.char_length("t"), F.lit(PIECE)))})
    parts = F.when(F.col("kind") == "run", runs_of(F.col("w"), F.col("n"), 1)).otherwise(pieces_of(F.col("t"), F.col("n")))
    return q.select("item_id", "kind", "n", F.explode(F.array_distinct(F.transform(parts, lambda p: F.xxhash64("kind", "n", p)))).alias("part"))


def grounded_in(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, item_id, excerpt of every quote (item_id, raw) that a text (doc_id, text) holds.

    Each quote is held against the texts with its rarest part only. Quotes
    without a letter or digit are looked up nowhere.
    """
    asked = asked_parts(quotes)
    plain = docs.select("doc_id", normal_title("text").alias("t")).withColumn("w", F.split("t", " "))
    held = None
    for kind, n in sorted(map(tuple, asked.select("kind", "n").distinct().collect())):  # at most RUN + PIECE of them
        parts = runs_of(F.col("w"), n) if kind == "run" else pieces_of(F.col("t"), n)
        one = keyed(plain, "doc_id", kind, n, parts)
        held = one if held is None else held.union(one)
    if held is None:
        return docs.select("doc_id").crossJoin(quotes.select("item_id", F.lit(None).cast("string").alias("excerpt"))).limit(0)  # no quote has a word
    held = cut(held.join(asked.select("part").distinct(), "part", "left_semi"))  # counted, then joined: texts are read once
    counted = asked.join(held.groupBy("part").count(), "part", "left")
    rarest = counted.groupBy("item_id").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "part")).alias("r"))
    pairs = held.join(rarest.select("item_id", "r.part"), "part").select("doc_id", "item_id").distinct()
    rows = pairs.join(docs, "doc_id").join(quotes, "item_id")
    return rows.select("doc_id", "item_id", grounded_excerpt("raw", "text").alias("excerpt")).where("excerpt is not null")
