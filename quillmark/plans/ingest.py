"""One run over a set of items: comments, mentions, works, scores, index, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions import classify, extract
from quillmark.functions.text import html_parts, normal_title
from quillmark.operators import incremental, ranking, resolve, reviews, search, tree
from quillmark.plans.shards import Derived, Shards
from quillmark.session import cut
from quillmark.sources.config import topics

PROCESSOR = "rules-1"
START_WORDS = 4


def threads_of(items: DataFrame) -> DataFrame:
    return items.where("type = 'story'").select("id", "title", "url", F.col("by").alias("author"), F.col("time").alias("created_at"), F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("descendants", F.lit(0)).alias("descendants"))


def comments_of(items: DataFrame, roots: DataFrame) -> DataFrame:
    """Comments that the roots (id) reach, with their root as thread_id; deleted and dead ones stay, without text."""
    rows = items.join(tree.under(items, roots).select("id", F.col("root").alias("thread_id")), "id")
    gone = F.coalesce("deleted", F.lit(False)) | F.coalesce("dead", F.lit(False))
    return rows.where("type = 'comment'").select("id", "thread_id", F.col("parent").alias("parent_id"), F.col("by").alias("author"), F.when(gone, "").otherwise(F.coalesce("text", F.lit(""))).alias("text"), F.coalesce("time", F.lit(0)).alias("created_at"))


def spans_of(comments: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """span_id, comment, raw, title, author, confidence, work_id, context, label of the mentions in comments.

    known (title): titles of the library. As the list grows with the library,
    it is joined, not broadcast: a comment gets the titles of two words or more
    whose first words, up to START_WORDS of them, it holds in a row. So common
    first words alone don't bring a title.
    """
    parsed = comments.withColumn("h", html_parts("text")).select("*", F.col("h.plain").alias("plain")).drop("h")
    titles = F.lit(None).cast("array<string>")
    if known is not None:
        start = lambda c: F.array_join(F.slice(F.split(normal_title(c), " "), 1, START_WORDS), " ")
        k = known.select("title", start("title").alias("start")).where("instr(start, ' ') > 0")
        words = F.split(normal_title("plain"), " ")
        runs = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice(F.col("w"), i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
        starts = parsed.select("id", words.alias("w")).select("id", F.explode(F.array_distinct(F.concat(*[runs(n) for n in range(2, START_WORDS + 1)]))).alias("start"))
        held = starts.join(k, "start").groupBy("id").agg(F.array_sort(F.collect_set("title")).alias("known"))
        parsed, titles = parsed.join(held, "id", "left"), F.col("known")
    spans = parsed.withColumn("known_titles", titles).select("*", F.posexplode(extract.mentions_in_known("text", "known_titles")).alias("place", "m"))
    spans = spans.select(F.col("id").alias("comment_id"), "thread_id", "author", "created_at", "plain", "place", "m.raw", "m.title", F.col("m.author").alias("work_author"), "m.confidence", "m.work_id")
    spans = spans.withColumn("context", extract.mention_context("plain", "raw")).withColumn("label", classify.label(F.col("context")))
    return spans.withColumn("span_id", F.concat_ws("-", "comment_id", "place"))


CANDIDATES = "array<struct<key:string,book_id:bigint,title:string,confidence:double>>"


def resolved(spans: DataFrame, books: DataFrame, candidates: DataFrame, works: DataFrame, authors: DataFrame, version: int | None = None, review_digest: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(span_id, openlibrary_id, confidence, candidates of every gated span; rows of the works found in the catalogue).

    Spans are held against the library's books first; one that several books
    match stays unresolved, with these as candidates. The others are held
    against the catalogue's candidates (with the title they were searched by),
    and keep those, best first, if none is taken. With a version or a digest of
    reviews, books that were resolved under another one don't count: their spans
    are looked up again. The result doesn't depend on the order of spans.
    """
    s = resolve.gated(spans.select("span_id", "title", F.col("work_author").alias("author"), "work_id", "confidence"))
    hits = cut(resolve.against_books(s, books, version, review_digest))
    known = books.select(F.col("id").alias("book_id"), "openlibrary_id")
    none = F.array().cast(CANDIDATES)
    own = hits.where("book_id is not null").join(known, "book_id").select("span_id", "openlibrary_id", "confidence", none.alias("candidates"))
    listed_books = F.transform("candidates", lambda b: F.struct(F.lit(None).cast("string").alias("key"), b["book_id"].cast("long").alias("book_id"), F.lit(None).cast("string").alias("title"), b["confidence"].alias("confidence")))
    several = hits.where("book_id is null").select("span_id", F.lit(None).cast("string").alias("openlibrary_id"), "confidence", listed_books.alias("candidates"))
    rest = s.join(hits.select("span_id"), "span_id", "left_anti").drop("confidence")
    asked_by = F.col("query_author") if "query_author" in candidates.columns else F.lit(None).cast("string")
    place = F.col("place") if "place" in candidates.columns else F.lit(0)
    c = candidates.select("query", asked_by.alias("query_author"), place.alias("place"), "key", F.col("title").alias("candidate_title"), F.col("author_name").alias("names"), F.col("subject").alias("subjects"), F.col("isbn").alias("isbns"), F.col("first_publish_year").alias("year"), "cover_i")
    listed = cut(reviews.with_reviews(resolve.scored_candidates(resolve.looked_up(rest, c, works, authors))))
    picked = resolve.cascade(listed)
    chosen = listed.join(picked.where("key is not null").select("span_id", "key", F.col("confidence").alias("sure")), ["span_id", "key"])
    sound = cut(resolve.verified_works(chosen, works, authors))
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "key", "candidate_title")))  # MOST_FOUND and what reviews add
    evidence = listed.groupBy("span_id").agg(F.transform(best, lambda r: F.struct(r["key"].alias("key"), F.lit(None).cast("long").alias("book_id"), r["candidate_title"].alias("title"), (-r["down"]).alias("confidence"))).alias("evidence"))
    taken = picked.select("span_id", "confidence").join(sound.select("span_id", F.col("key").alias("openlibrary_id")), "span_id", "left").join(evidence, "span_id")
    taken = taken.select("span_id", "openlibrary_id", "confidence", F.filter("evidence", lambda e: F.col("openlibrary_id").isNull()).alias("candidates"))
    found = resolve.canonical_books(sound).withColumns({"resolution_version": F.lit(version).cast("int"), "review_digest": F.lit(review_digest).cast("string")})
    return own.unionByName(several).unionByName(taken), found


def with_new_books(books: DataFrame, found: DataFrame) -> DataFrame:
    """books with what was found in the catalogue: known works keep their id and get the new record, new ones get numbers after the last."""
    columns = [c for c in books.columns if c != "id"]
    found = found.select(*[F.col(c) if c in found.columns else F.lit(None).cast(books.schema[c].dataType).alias(c) for c in columns])
    ids = books.select("id", "openlibrary_id")
    again = found.join(ids, "openlibrary_id").select(*books.columns)
    last = books.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")).first().last
    new = incremental.numbered(found.join(ids, "openlibrary_id", "left_anti"), "openlibrary_id", "id", after=last).select(*books.columns)
    return cut(books.join(again.select("id"), "id", "left_anti").select(*books.columns).unionByName(again).unionByName(new))


def mentions_of(spans: DataFrame, found: DataFrame, books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mentions, one for each title of a comment: the first; mention_tags) of resolved spans."""
    m = spans.withColumnRenamed("confidence", "extraction_confidence").join(found, "span_id", "left").join(books.select(F.col("id").alias("book_id"), "openlibrary_id"), "openlibrary_id", "left")
    m = m.withColumns({"normalized_mention": normal_title("title"), "status": F.when(F.col("book_id").isNull(), "unresolved").otherwise("resolved")})
    one = Window.partitionBy("comment_id", "normalized_mention").orderBy("place")
    m = cut(m.withColumn("n", F.row_number().over(one)).where("n = 1"))
    mentions = m.select(
        F.xxhash64("comment_id", "normalized_mention").alias("id"), "book_id", "comment_id", "thread_id", "author", "created_at", F.col("raw").alias("raw_mention"), "normalized_mention", F.col("context").alias("context_text"),
        "extraction_confidence", F.when(F.col("book_id").isNull(), 0.0).otherwise(F.coalesce("confidence", F.lit(0.0))).alias("resolution_confidence"), classify.strength(F.col("label")).alias("recommendation_strength"), classify.sentiment(F.col("label")).alias("sentiment"), "status",
        F.coalesce("candidates", F.array().cast(CANDIDATES)).alias("candidates"),
    )
    said = m.select("comment_id", F.xxhash64("comment_id", "normalized_mention").alias("mention_id"), normal_title(F.concat_ws(" ", "context", "title")).alias("said"))
    tagged = classify.tag_topics(said, "said", "mention_id").join(F.broadcast(topics(spans.sparkSession).select(F.col("id").alias("tag_id"), F.col("name").alias("topic"))), "topic")  # a fixed list
    return mentions, tagged.select("mention_id", "tag_id", "confidence")


def aggregates(spark: SparkSession, books: DataFrame, mentions: DataFrame, mention_tags: DataFrame, as_of: int) -> dict[str, DataFrame]:
    """Scores, topics and index of the library from its mentions."""
    dimension = topics(spark)
    shelf = ranking.score_books(books, mentions, as_of)
    tags = ranking.book_tags(mentions, mention_tags, dimension)
    names = tags.groupBy(F.col("book_id")).agg(F.array_join(F.array_sort(F.collect_list("name")), " ").alias("topics"))
    indexed = shelf.where("mention_count > 0").select(F.col("id").alias("book_id"), "canonical_title", "authors", "description").join(names, "book_id", "left")
    said = mentions.where("book_id is not null").select("book_id", "context_text")  # word by word: a book with very many mentions is no row
    terms = search.term_index(indexed, "book_id", "canonical_title", "authors", "description", "topics").union(search.term_index(said, "book_id", "context_text")).distinct()
    return {"books": shelf, "tags": dimension, "book_tags": tags, "terms": terms}


def build(spark: SparkSession, items: DataFrame, roots: DataFrame, books: DataFrame, candidates: DataFrame, works: DataFrame, authors: DataFrame, as_of: int, *, version: int | None = None, review_digest: str | None = None) -> dict[str, DataFrame]:
    """All tables of a version, from all items. books: those of the version before, whose ids stay."""
    threads, comments = threads_of(items), cut(comments_of(items, roots))
    spans = cut(spans_of(comments, books.select(F.col("canonical_title").alias("title"))))  # texts are parsed once
    found, new = resolved(spans, books, candidates, works, authors, version, review_digest)
    books = with_new_books(books, new)
    mentions, mention_tags = mentions_of(spans, found, books)
    processed = comments.select("id", "thread_id", incremental.digest("text", "parent_id").alias("digest"))
    checkpoints = threads.select(F.col("id").alias("thread_id"), F.lit(True).alias("raw_complete"), F.lit(PROCESSOR).alias("processed_version"))
    return {"threads": threads, "comments": comments, "mentions": mentions, "mention_tags": mention_tags, "processed": processed, "checkpoints": checkpoints, "missing": tree.missing(items)} | aggregates(spark, books, mentions, mention_tags, as_of)


def update(spark: SparkSession, store: Shards, items: DataFrame, roots: DataFrame, books: DataFrame, candidates: DataFrame, works: DataFrame, authors: DataFrame, *, version: int | None = None, review_digest: str | None = None, catalogue: str = "", force: bool = False) -> tuple[dict[str, int], DataFrame]:
    """(counters of the run, books after it): takes the items of some threads into a store of comments.

    Only comments whose text, parent, thread or versions changed are parsed and
    resolved, and those with an unresolved mention if the library or the
    catalogue (`catalogue` names its state) changed since. What they had before
    is replaced. The store's tables are `rows` (comments), `mentions` and
    `mention_tags`.
    """
    comments = comments_of(items, roots)
    size = books.agg(F.count("*").alias("n"), F.max("id").alias("last")).first()
    counts: dict[str, int] = {}
    after = [books]

    def derive(todo: DataFrame) -> Derived:
        spans = cut(spans_of(todo, books.select(F.col("canonical_title").alias("title"))))
        found, new = resolved(spans, books, candidates, works, authors, version, review_digest)
        after[0] = with_new_books(books, new)
        mentions, tags = mentions_of(spans, found, after[0])
        mentions = cut(mentions.withColumn("row_id", F.col("comment_id")))
        seen = mentions.agg(F.count("*").alias("mentions_extracted"), F.count_if(F.col("status") == "resolved").alias("books_resolved"), F.count_if(F.col("status") == "unresolved").alias("unresolved_mentions")).first()
        counts.update(seen.asDict())
        tags = tags.join(mentions.select(F.col("id").alias("mention_id"), "row_id"), "mention_id")
        return Derived({"mentions": mentions, "mention_tags": tags}, mentions.where("status = 'unresolved'").select("row_id"))

    state = f"{size.n}/{size.last}/{catalogue}"
    done = store.update(comments, derive, version=f"{PROCESSOR}/{version}/{review_digest}", seen=state, force=force)
    run = {"comments_total": done["rows_total"], "comments_processed": done["rows_processed"], "comments_skipped": done["rows_skipped"], "shards_written": done["shards_written"]}
    return run | {"mentions_extracted": 0, "books_resolved": 0, "unresolved_mentions": 0} | counts, after[0]
