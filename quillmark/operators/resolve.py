"""Resolution of mentions to works: conservative, and the same whatever order candidates come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.text import author_agrees, author_identities, authors_complete, normal_name, normal_title, title_similarity
from quillmark.sources.config import excluded_works, reviewed_works

TITLE_SCORE, MARGIN, GATE = 0.94, 0.04, 0.7
GRAPHIC = r"(?i)\b(?:comics?|graphic novels?|manga)\b"


def work_key(value: Column) -> Column:
    """/works/OL1W, from that or OL1W; null for anything else."""
    number = F.regexp_extract(value, r"^(?:/works/)?(OL\d+W)$", 1)
    return F.when(number != "", F.concat(F.lit("/works/"), number))


def gated(spans: DataFrame, require_author: bool = False) -> DataFrame:
    """Spans sure enough to look for; with require_author those that have an author or a work's link."""
    out = spans.where(F.col("confidence") >= GATE)
    return out.where("author is not null or work_id is not null") if require_author else out


def against_books(spans: DataFrame, books: DataFrame, version: int | None = None, review_digest: str | None = None) -> DataFrame:
    """span_id, book_id, confidence, n_books, candidates: spans that books of the library match.

    Titles have to be equal in normal form, so this is an equi-join, not a
    comparison of every span with every book; work links join on the link. A
    span that several books match stays unresolved: book_id is null, and the
    books are its candidates (book_id, confidence), best first. With a
    version (or digest of reviews), books that another one resolved don't count,
    so that their spans are looked up again. A work that reviews exclude for the
    span's author matches by its link only.
    """
    s = spans.withColumn("normal", normal_title("title"))
    if version is not None:
        books = books.where(F.col("resolution_version") == version)
    if review_digest is not None:
        books = books.where(F.col("review_digest") == review_digest)
    b = books.select(F.col("id").alias("book_id"), "canonical_title", "openlibrary_id", "authors", F.col("normalized_title").alias("normal"))
    titled = s.where("work_id is null").join(b, "normal").where(F.col("author").isNull() | (author_agrees("author", "authors") & authors_complete("author", "authors")))
    barred = F.broadcast(excluded_works(spans.sparkSession))  # a fixed list
    titled = titled.join(barred, F.col("openlibrary_id") == F.col("excluded_key"), "left")
    titled = titled.where(F.col("excluded_key").isNull() | F.col("author").isNull() | ~authors_complete("author", "excluded_authors"))
    linked = s.where("work_id is not null").join(b.withColumnRenamed("openlibrary_id", "work_id"), "work_id")
    hits = titled.select("span_id", "book_id", "title", "canonical_title").union(linked.select("span_id", "book_id", "title", "canonical_title"))
    hits = hits.withColumn("score", title_similarity("title", "canonical_title"))
    books_of = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "book_id"))), lambda b: F.struct(b["book_id"].alias("book_id"), (-b["down"]).alias("confidence")))
    per = hits.groupBy("span_id").agg(F.count("*").alias("n_books"), F.min("book_id").alias("book_id"), F.max("score").alias("score"), books_of.alias("books"))
    one = F.col("n_books") == 1
    return per.select("span_id", F.when(one, F.col("book_id")).alias("book_id"), F.when(one, F.greatest("score", F.lit(TITLE_SCORE))).otherwise(0.0).alias("confidence"), "n_books", F.filter("books", lambda b: ~one).alias("candidates"))


LOOKUP = ("key", "candidate_title", "names", "subjects", "isbns", "year", "cover_i")
MOST_FOUND = 8


def looked_up(spans: DataFrame, found: DataFrame, works: DataFrame, authors: DataFrame) -> DataFrame:
    """spans with a row for each record to choose from, LOOKUP.

    found: answers of the catalogue's search: query (normal title), query_author
    (normal name, null where it was asked without), place (from 0), and LOOKUP.
    The first MOST_FOUND of an answer count. A span that links to a work has that
    work's own record. One with an author has what was found with it, or, if
    that is nothing, by the title alone. Where a review knows the span's title
    and author, what was found for the reviewed work's own title joins in, unless
    that work was found already.
    """
    named = works.select("key", F.explode_outer("author_keys").alias("author_key")).join(authors.select(F.col("key").alias("author_key"), "name"), "author_key", "left")
    records = works.where("title <> ''").join(named.groupBy("key").agg(F.array_sort(F.collect_list("name")).alias("names")), "key")
    none = F.lit(None)
    records = records.select("key", F.col("title").alias("candidate_title"), "names", none.cast("array<string>").alias("subjects"), none.cast("array<string>").alias("isbns"), none.cast("int").alias("year"), none.cast("long").alias("cover_i"))
    linked = spans.where("work_id is not null").join(records, F.col("work_id") == F.col("key"))

    top = found.where(F.col("place") < MOST_FOUND).select("query", "query_author", *LOOKUP)
    asks = spans.where("work_id is null").withColumns({"ask": normal_title("title"), "ask_author": F.when(F.col("author").isNotNull(), normal_name("author"))})
    both = asks.join(top, (F.col("ask") == F.col("query")) & F.col("ask_author").eqNullSafe(F.col("query_author")))
    alone = asks.where("author is not null").join(both.select("span_id").distinct(), "span_id", "left_anti").join(top.where("query_author is null"), F.col("ask") == F.col("query"))
    columns = [*spans.columns, *LOOKUP]
    own = both.select(*columns).union(alone.select(*columns))

    reviewed = F.broadcast(reviewed_works(spans.sparkSession))  # a fixed list
    meant = asks.where("author is not null").join(reviewed, F.array_contains("review_titles", F.col("ask"))).where(authors_complete("author", "review_authors"))
    meant = meant.join(own.select(F.col("span_id").alias("had"), F.col("key").alias("had_key")), (F.col("span_id") == F.col("had")) & (F.col("reviewed_key") == F.col("had_key")), "left_anti")
    meant = meant.withColumns({"own_title": normal_title("review_title"), "own_author": normal_name(F.get("review_authors", F.lit(0)))})
    more = meant.join(top, (F.col("own_title") == F.col("query")) & F.col("own_author").eqNullSafe(F.col("query_author")))
    return linked.select(*columns).union(own).union(more.select(*columns))


def scored_candidates(candidates: DataFrame) -> DataFrame:
    """Adds what cascade() asks of each (span, candidate) row, by Arrow functions.

    Columns in: span_id, title, author, work_id, key, candidate_title, names, subjects, isbns, year.
    """
    c = candidates.withColumn("key", work_key(F.col("key"))).where("key is not null")
    linked = F.coalesce(F.col("work_id") == F.col("key"), F.lit(False))
    return c.select(
        "*",
        F.when(linked, 1.0).otherwise(F.round(title_similarity("title", "candidate_title"), 4)).alias("score"),
        author_agrees("author", "names").alias("agrees"),
        authors_complete("author", "names").alias("complete"),
        (normal_title("title") == normal_title("candidate_title")).alias("exact"),
        author_identities("names").alias("identities"),
        F.exists(F.coalesce("subjects", F.array().cast("array<string>")), lambda s: s.rlike(GRAPHIC)).alias("graphic"),
        F.size(F.array_distinct(F.coalesce("isbns", F.array().cast("array<string>")))).alias("n_isbns"),
    )


def cascade(scored: DataFrame) -> DataFrame:
    """span_id, key, confidence, n_eligible: the candidate that each span resolves to, or null.

    Columns in: span_id, author, key, score, agrees, complete, exact,
    identities, graphic, n_isbns, year; `preferred` and `excluded` too, if
    reviews say so. Eligible candidates are narrowed to the preferred ones, then
    to exact titles, then (for a span with an author) to complete authors, each
    step only if any are left. Several works near the best leave the span
    unresolved, unless they are the catalogue's duplicates of one work: exact
    title, same authors, all or none graphic.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in scored.columns else F.lit(False)
    span = Window.partitionBy("span_id")
    rows = scored.withColumn("best", F.max("score").over(span))
    rows = rows.withColumn("in", (F.col("score") >= TITLE_SCORE) & F.col("agrees") & ~flag("excluded"))
    narrow = [flag("preferred"), F.col("exact"), F.col("author").isNotNull() & F.col("complete")]
    for i, step in enumerate(narrow):
        rows = rows.withColumn(f"s{i}", F.max(F.col("in") & step).over(span))
        rows = rows.withColumn("in", F.col("in") & (~F.col(f"s{i}") | step))
    rows = rows.withColumn("top", F.max(F.when(F.col("in"), F.col("score"))).over(span))
    near = F.when(F.col("in") & (F.col("top") - F.col("score") < MARGIN), F.col("key"))
    who = F.when(F.col("in"), F.struct("identities", "graphic"))
    per = rows.groupBy("span_id").agg(
        F.max("best").alias("confidence"),
        F.count(F.when(F.col("in"), 1)).alias("n_eligible"),
        F.countDistinct(near).alias("n_near"),
        (F.max("s1") & F.max(F.col("author").isNotNull()) & (F.countDistinct(who) == 1) & (F.max(F.when(F.col("in"), F.size("identities"))) > 0)).alias("duplicates"),
        F.min(F.when(F.col("in"), F.struct((-F.col("n_isbns")).alias("a"), F.coalesce("year", F.lit(9999)).alias("b"), F.regexp_extract("key", r"(\d+)", 1).cast("long").alias("c"), "key"))).alias("by_record"),
        F.min(F.when(F.col("in"), F.struct((-F.col("score")).alias("a"), F.regexp_extract("key", r"(\d+)", 1).cast("long").alias("c"), "key"))).alias("by_score"),
    )
    chosen = F.when(F.col("duplicates"), F.col("by_record.key")).when(F.col("n_near") == 1, F.col("by_score.key"))
    return per.select("span_id", chosen.alias("key"), "confidence", "n_eligible")


def verified_works(chosen: DataFrame, works: DataFrame, authors: DataFrame) -> DataFrame:
    """chosen (span_id, title, author, work_id, key, names) with the work's record, where that agrees.

    The work must have a title, its title must fit unless the span links to it,
    its authors must be known if it names any, and agree with the span's.
    """
    named = works.select("key", F.explode_outer("author_keys").alias("author_key")).join(authors.select(F.col("key").alias("author_key"), "name"), "author_key", "left")
    listed = named.groupBy("key").agg(F.count("author_key").alias("n_keys"), F.array_sort(F.collect_set("name")).alias("work_authors"))
    rows = chosen.join(works.select("key", F.col("title").alias("work_title"), "description", "covers"), "key").join(listed, "key").where("work_title <> ''")
    rows = rows.withColumn("canonical_authors", F.when(F.size("work_authors") > 0, F.col("work_authors")).otherwise(F.col("names")))
    rows = rows.where(F.col("work_id").isNotNull() | (title_similarity("title", "work_title") >= TITLE_SCORE))
    rows = rows.where("author is null or n_keys = 0 or size(work_authors) > 0")
    return rows.where((F.size("canonical_authors") == 0) | author_agrees("author", "canonical_authors"))


def canonical_books(rows: DataFrame) -> DataFrame:
    """Book columns from verified works with their search record (isbns, year, cover_i)."""
    text = F.coalesce(F.get_json_object("description", "$.value"), F.col("description"), F.lit(""))
    cover = F.coalesce("cover_i", F.element_at(F.filter("covers", lambda c: c > 0), 1))
    of_length = lambda n: F.filter("isbns", lambda v: F.length(v) == n)
    return rows.select(
        F.col("key").alias("openlibrary_id"), F.col("candidate_title").alias("canonical_title"), normal_title("candidate_title").alias("normalized_title"),
        F.col("canonical_authors").alias("authors"), F.col("year").alias("publication_year"), text.alias("description"),
        F.when(cover.isNotNull(), F.concat(F.lit("https://covers.openlibrary.org/b/id/"), cover, F.lit("-M.jpg"))).alias("cover_url"),
        of_length(10).alias("isbn_10"), of_length(13).alias("isbn_13"),
    ).dropDuplicates(["openlibrary_id"])
