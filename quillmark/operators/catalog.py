"""Search of a catalogue by title and author: an inverted index with postings by impact, top answers by score bounds.

Terms are the words of a title, its pairs of neighbouring words, and the words
of its authors. A record's score for a question is the sum of the impacts of the
terms that they share: whole numbers, so ties are exact and go to the smaller
key. A term's postings lie by falling impact in runs, each as long as all before
it, so a term has few runs and their bounds are a short list. A question reads
every term's first run, knows from these records what its last answer has to
beat, and then reads those runs only whose bound can beat it. So a common word
beside a rare one is scored, but its postings aren't read.

Records with the same terms and length score the same for every question, so of
more than `most` such records only the `most` smallest keys can be answers: they
are one entry of the index, under the smallest key, and count in full for the
weights of terms.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.text import normal_name, normal_title
from quillmark.operators.incremental import numbered
from quillmark.session import cut

#: Postings of a term's first run; answers of a search; the runs that are read before all others that may count.
FIRST, MOST, DEEPER = 16, 8, 2


@dataclass
class Index:
    """Tables of an inverted index."""

    records: DataFrame  # key, impacts: map of term to impact, copies: the keys that it stands for, in order
    terms: DataFrame  # term, df, top: the largest impact, runs: (run, top, first_key, n) without the first
    postings: DataFrame  # term, run, key, impact
    most: int = MOST  # answers that it can give


def terms_of(title: Column, names: Column) -> Column:
    """Different terms of a normal title and of normal names (an array)."""
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    of_title = words(title)
    pairs = F.zip_with(F.slice(of_title, 1, F.greatest(F.size(of_title) - 1, F.lit(0))), F.slice(of_title, 2, F.size(of_title)), lambda a, b: F.concat_ws(" ", F.lit("p"), a, b))
    of_names = words(F.array_join(names, " "))
    marked = lambda kind, a: F.transform(a, lambda w: F.concat_ws(" ", F.lit(kind), w))
    return F.array_distinct(F.concat(marked("t", of_title), pairs, marked("a", of_names)))


def with_terms(rows: DataFrame, title: str, names: str) -> DataFrame:
    """rows with terms and n_words (of the title). names: an array of names, each read as such."""
    each = rows.withColumn("q_title", F.coalesce(normal_title(title), F.lit("")))
    each = each.withColumn("q_names", F.coalesce(normal_name(F.array_join(F.transform(F.coalesce(names, F.array().cast("array<string>")), turned), " ")), F.lit("")))
    words = F.size(F.filter(F.split("q_title", " "), lambda w: w != ""))
    return each.withColumns({"terms": terms_of(F.col("q_title"), F.array("q_names")), "n_words": words}).drop("q_title", "q_names")


def turned(name: Column) -> Column:
    """A name without its comma: words of authors are compared in any order."""
    return F.replace(name, F.lit(","), F.lit(" "))


def entries(base: DataFrame, title: str, names: str, most: int) -> DataFrame:
    """terms, n_words, key, copies, n: records with the same terms and length, as one row where they are more than `most`, else each."""
    first = lambda rows, *by: rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("key"))).where(F.col("place") <= most).drop("place")
    kinds = lambda rows: with_terms(rows, title, names).withColumn("terms", F.array_sort("terms"))
    sizes = kinds(base.groupBy(title, names).agg(F.count("*").alias("n"))).groupBy("terms", "n_words").agg(F.sum("n").alias("n"))
    kept = first(kinds(first(base, title, names)), "terms", "n_words").groupBy("terms", "n_words").agg(F.array_sort(F.collect_list("key")).alias("copies"))  # `most` at most
    one = F.transform("copies", lambda k: F.struct(k.alias("key"), F.array(k).alias("copies"), F.lit(1).cast("long").alias("n")))
    all_ = F.array(F.struct(F.get("copies", F.lit(0)).alias("key"), F.col("copies"), F.col("n")))
    rows = kept.join(sizes, ["terms", "n_words"]).select("terms", "n_words", F.explode(F.when(F.col("n") <= most, one).otherwise(all_)).alias("e"))
    return rows.select("terms", "n_words", "e.*")


def build(records: DataFrame, title: str = "title", names: str = "names", most: int = MOST) -> Index:
    """The index of records (key, title, names), for searches of up to `most` answers.

    A term's weight falls with the share of records that hold it; terms of a
    title count for less, the longer the title is. Postings are numbered in
    ranges of (term, impact, key), so a term that very many records hold is
    numbered by many tasks. Records with the same key are one. Null titles and
    names have no terms; an empty catalogue gives empty tables.
    """
    base = cut(records.select("key", title, names).where("key is not null").dropDuplicates(["key"]))
    total = base.count()
    rows = cut(entries(base, title, names, most))
    each = rows.select("key", "n_words", "n", F.explode("terms").alias("term"))
    weight = F.floor(1000 * F.log(1 + F.lit(float(total)) / F.col("df"))).cast("long")
    df = cut(each.groupBy("term").agg(F.sum("n").alias("df")).withColumn("weight", weight))
    of_title = F.greatest(F.expr("(weight * 4) div (3 + n_words)"), F.lit(1))
    held = cut(each.join(df, "term").select("term", "key", F.when(F.substring("term", 1, 1) == "a", F.col("weight")).otherwise(of_title).alias("impact")))
    numbers = numbered(held.select(F.struct("term", (-F.col("impact")).alias("down"), "key").alias("at")), "at", "number")
    numbers = cut(numbers.select("at.term", "at.key", (-F.col("at.down")).alias("impact"), "number"))
    starts = numbers.groupBy("term").agg(F.min("number").alias("start"))
    behind = F.expr(f"(number - start) div {FIRST}")
    postings = cut(numbers.join(starts, "term").withColumn("run", F.when(behind == 0, 0).otherwise(F.length(F.bin(behind)))).select("term", "run", "key", "impact"))
    runs = postings.groupBy("term", "run").agg(F.min(F.struct((-F.col("impact")).alias("down"), "key")).alias("first"), F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct("run", (-F.col("first.down")).alias("top"), F.col("first.key").alias("first_key"), "n")))  # runs double, so they are few
    terms = runs.groupBy("term").agg(F.max(-F.col("first.down")).alias("top"), listed.alias("runs")).join(df.select("term", "df"), "term")
    terms = terms.select("term", "df", "top", F.filter("runs", lambda r: r["run"] > 0).alias("runs"))
    impacts = held.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "impact"))).alias("impacts"))  # a record's own terms
    return Index(cut(impacts.join(rows.select("key", "copies"), "key")), cut(terms), postings, most)


def scored(found: DataFrame, index: Index) -> DataFrame:
    """ask, key, score, copies of each pair of a question and an entry (ask, asked: its terms, key), once; those without a word of the title go."""
    pairs = found.groupBy("ask", "key").agg(F.first("asked").alias("asked"))
    rows = pairs.join(index.records, "key")
    shared = F.filter("asked", lambda t: F.map_contains_key("impacts", t))
    rows = rows.withColumn("shared", shared).where(F.exists("shared", lambda t: F.startswith(t, F.lit("t "))))
    return rows.select("ask", "key", F.aggregate(F.transform("shared", lambda t: F.element_at("impacts", t)), F.lit(0).cast("long"), lambda a, x: a + x).alias("score"), "copies")


def leading(seeds: DataFrame, most: int) -> DataFrame:
    """Of each question's entries (ask, key, score) the `most` best: the best records are among these and their copies."""
    best = Window.partitionBy("ask").orderBy(F.desc("score"), "key")
    return seeds.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most).drop("place")


def placed(seeds: DataFrame, most: int) -> DataFrame:
    """ask, place (from 0), key, score: the `most` best records of each question's entries."""
    each = leading(seeds, most).select("ask", F.explode("copies").alias("key"), "score")
    best = Window.partitionBy("ask").orderBy(F.desc("score"), "key")
    return each.withColumn("place", F.row_number().over(best) - 1).where(F.col("place") < most).select("ask", "place", "key", "score")


def asked_terms(asks: DataFrame, index: Index) -> DataFrame:
    """ask, asked, term, top, runs, rest of the terms of asks (ask, terms) that the index has.

    The terms of a question are in order, the one with the largest impact first;
    rest is the most that the terms after it can add. A record is found by the
    first of its terms, so top and rest bound its score.
    """
    each = asks.select("ask", F.col("terms").alias("asked"), F.explode("terms").alias("term")).join(index.terms, "term")
    after = Window.partitionBy("ask").orderBy(F.desc("top"), "term").rowsBetween(1, Window.unboundedFollowing)
    return each.withColumn("rest", F.coalesce(F.sum("top").over(after), F.lit(0)))


def needed(terms: DataFrame, seeds: DataFrame, most: int = MOST) -> DataFrame:
    """ask, asked, term, run, n: the runs beyond the first that may hold one of the best `most` records.

    seeds (ask, key, score, copies): entries scored already. The last of a question's
    best has to be beaten: by a larger bound, or by an equal one and a smaller key.
    """
    last = placed(seeds, most).where(F.col("place") == most - 1).select("ask", F.col("score").alias("beat"), F.col("key").alias("beat_key"))

    def may(r: Column) -> Column:
        bound = r["top"] + F.col("rest")
        # a record that comes to an equal bound has the run's largest impact, and those lie by key
        return F.coalesce((bound > F.col("beat")) | ((bound == F.col("beat")) & (r["first_key"] < F.col("beat_key"))), F.lit(True))

    rows = terms.join(last, "ask", "left").select("ask", "asked", "term", F.explode(F.filter("runs", may)).alias("r"))
    return rows.select("ask", "asked", "term", "r.run", "r.n")


def search(asks: DataFrame, index: Index, most: int = MOST) -> DataFrame:
    """ask, place (from 0), key, score: the best `most` records of each question (ask, terms; ask is unique).

    What it returns is the best of all records that share a word of the title,
    by score and then key, as if every posting had been read. Questions without
    a known term have no rows.
    """
    if most > index.most:
        raise ValueError(f"the index was built for {index.most} answers")
    terms = cut(asked_terms(asks, index))
    first = index.postings.where("run = 0").select("term", "key")
    seeds = cut(scored(terms.select("ask", "asked", "term").join(first, "term"), index))
    for low, high in ((1, DEEPER), (DEEPER + 1, 64)):  # what the next runs hold raises what later ones have to beat
        wanted = needed(terms, seeds, most).where(F.col("run").between(low, high))
        more = scored(wanted.join(index.postings.select("term", "run", "key"), ["term", "run"]), index)
        seeds = cut(leading(seeds.union(more).distinct(), most))
    return placed(seeds, most)


def answers(spans: DataFrame, records: DataFrame, index: Index, most: int = MOST) -> DataFrame:
    """What looked_up() asks a catalogue: query, query_author, place and the records' columns, for spans (title, author).

    Every different title is asked once with each of its authors, and once
    without. records: key and columns of the catalogue.
    """
    named = spans.select("title", "author").union(spans.select("title", F.lit(None).cast("string"))).distinct()
    named = named.withColumns({"query": normal_title("title"), "query_author": F.when(F.col("author").isNotNull(), normal_name("author"))})
    asks = named.groupBy("query", "query_author").agg(F.min("title").alias("title"), F.min("author").alias("author"))
    asks = with_terms(asks.withColumn("names", F.when(F.col("author").isNotNull(), F.array("author"))), "title", "names")
    asks = cut(asks.withColumn("ask", F.to_json(F.array("query", "query_author"))).select("ask", "query", "query_author", "terms"))
    found = search(asks.select("ask", "terms"), index, most)
    return asks.select("ask", "query", "query_author").join(found.select("ask", "place", "key"), "ask").join(records, "key").drop("ask")
