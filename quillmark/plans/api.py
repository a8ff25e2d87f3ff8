"""The fixed queries of the library, with their parameters, over the tables of a version."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.classify import is_positive
from quillmark.functions.text import html_parts
from quillmark.operators import ranking, search
from quillmark.operators.incremental import RUN_COUNTERS

EVIDENCE_PAGE, COMMENTS_PAGE, UNRESOLVED_PAGE, THREADS_PAGE, RUNS_PAGE = 20, 50, 50, 20, 30


class Api:
    """tables: threads, comments, books, mentions, mention_tags, tags, book_tags, terms, runs; each read when it is asked for."""

    def __init__(self, read) -> None:
        self.read = read

    def health(self) -> bool:
        """Whether the tables that every page needs can be read."""
        try:
            for name in ("books", "mentions", "threads", "comments"):
                self.read(name).first()
        except Exception:  # noqa: BLE001  whatever the reason, the library can't be served
            return False
        return True

    def stats(self) -> DataFrame:
        """One row: books, threads, comments, recommenders, last_updated."""
        one = lambda df, *aggs: df.agg(*aggs)
        m = self.read("mentions").where(F.col("book_id").isNotNull() & is_positive())
        parts = [
            one(self.read("books").where("mention_count > 0"), F.count("*").alias("books")),
            one(self.read("threads"), F.count("*").alias("threads")),
            one(self.read("comments"), F.count("*").alias("comments")),
            one(m, F.countDistinct("author").alias("recommenders")),
            one(self.read("runs").where("status = 'completed'"), F.max("finished_at").alias("last_updated")),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.crossJoin(p)  # one row each
        return out

    def find(self, q: str = "", tags: list[str] = (), exclude: list[str] = ()) -> DataFrame:
        """Books that are mentioned and match the words and topics."""
        if len(q) > 300:
            raise ValueError("q is too long")
        books = search.search(self.read("books").where("mention_count > 0"), self.read("terms"), q)
        return search.by_topics(books, self.read("mentions"), self.read("mention_tags"), self.read("tags"), list(tags), list(exclude))

    def books(self, q: str = "", tags: list[str] = (), exclude: list[str] = (), sort: str = "all-time", page: int = 1, page_size: int = 12) -> tuple[DataFrame, int]:
        """A page of find(), with each book's topics, and how many there are."""
        found = self.find(q, tags, exclude)
        page_rows = ranking.ranked(ranking.shelf(found, sort, page, page_size), sort, page, page_size)
        topics = self.read("book_tags").groupBy(F.col("book_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct((-F.col("mention_count")).alias("less"), "name", "confidence"))).alias("topics"))
        a, b = ranking.ORDERS[sort]
        return page_rows.join(topics, "id", "left").orderBy(F.desc(a), F.desc(b), ranking.no_case("canonical_title"), "id"), found.count()

    def book(self, book_id: int) -> tuple[DataFrame, DataFrame]:
        """The book, and its months with mentions and recommenders."""
        m = self.read("mentions").where(F.col("book_id") == book_id)
        m = m.withColumn("month", F.date_format(F.timestamp_seconds("created_at"), "yyyy-MM"))
        months = m.groupBy("month").agg(F.count("*").alias("mentions"), F.countDistinct(F.when(is_positive(), F.col("author"))).alias("recommenders"))
        return self.read("books").where(F.col("id") == book_id), months.orderBy("month")

    def evidence(self, book_id: int, page: int = 1) -> DataFrame:
        """A page of the book's mentions, strongest and newest first, with thread titles and topics."""
        m = self.read("mentions").where(F.col("book_id") == book_id).orderBy(F.desc("recommendation_strength"), F.desc("created_at"), "id")
        m = m.offset((page - 1) * EVIDENCE_PAGE).limit(EVIDENCE_PAGE)
        tags = self.read("mention_tags").join(self.read("tags").select(F.col("id").alias("tag_id"), "name"), "tag_id").groupBy(F.col("mention_id").alias("id")).agg(F.array_sort(F.collect_list("name")).alias("topics"))
        titles = self.read("threads").select(F.col("id").alias("thread_id"), F.col("title").alias("thread_title"))
        return m.join(titles, "thread_id").join(tags, "id", "left").orderBy(F.desc("recommendation_strength"), F.desc("created_at"), "id")

    def topics(self) -> DataFrame:
        """All topics with the number of their books, most first."""
        m = self.read("mention_tags").join(self.read("mentions").select(F.col("id").alias("mention_id"), "book_id"), "mention_id").select(F.col("tag_id").alias("id"), "book_id")
        per = self.read("tags").join(m, "id", "left").groupBy("id", "name", "description").agg(F.countDistinct("book_id").alias("book_count"))
        return per.drop("id").orderBy(F.desc("book_count"), "name")

    def threads(self, page: int = 1) -> DataFrame:
        """A page of threads, newest first, with how many comments are stored."""
        c = self.read("comments").select(F.col("thread_id").alias("id"), F.col("id").alias("comment"))
        per = c.groupBy("id").agg(F.count("comment").alias("stored"))
        t = self.read("threads").orderBy(F.desc("created_at"), "id").offset((page - 1) * THREADS_PAGE).limit(THREADS_PAGE)
        return t.join(per, "id", "left").withColumn("stored_comments", F.coalesce("stored", F.lit(0))).drop("stored").orderBy(F.desc("created_at"), "id")

    def thread(self, thread_id: int, page: int = 1) -> DataFrame:
        """A page of a thread's comments as plain text, oldest first."""
        c = self.read("comments").where(F.col("thread_id") == thread_id).orderBy("created_at", "id").offset((page - 1) * COMMENTS_PAGE).limit(COMMENTS_PAGE)
        return c.select("id", "parent_id", "author", "created_at", html_parts("text")["plain"].alias("text"))

    def unresolved(self, page: int = 1) -> DataFrame:
        return self.read("mentions").where("status = 'unresolved'").orderBy("id").offset((page - 1) * UNRESOLVED_PAGE).limit(UNRESOLVED_PAGE)

    def status(self) -> DataFrame:
        """The latest runs."""
        return self.read("runs").orderBy(F.desc("id")).limit(RUNS_PAGE)

    def label_template(self, thread_id: int) -> DataFrame:
        """What a reviewer fills in: a row for each comment of a thread, all pending."""
        rows = self.snapshot(thread_id)
        return rows.select("comment_id", "source_digest", F.lit("pending").alias("status"), F.lit(None).cast("array<struct<raw:string,titles:array<string>,tags:array<string>,identity_status:string,work_id:string>>").alias("mentions"))

    def snapshot(self, thread_id: int) -> DataFrame:
        """Every comment of a thread with its mentions and a digest of both; the label template is its comment_id column."""
        books = self.read("books").select(F.col("id").alias("book_id"), "openlibrary_id", F.col("authors").alias("book_authors"))
        m = self.read("mentions").where(F.col("thread_id") == thread_id).join(books, "book_id", "left")
        per = m.groupBy("comment_id").agg(F.array_sort(F.collect_list(F.struct("id", "raw_mention", "normalized_mention", "openlibrary_id", "recommendation_strength", "sentiment", "status"))).alias("mentions"))
        c = self.read("comments").where(F.col("thread_id") == thread_id).select(F.col("id").alias("comment_id"), "parent_id", "author", "text")
        rows = c.join(per, "comment_id", "left")
        return rows.withColumns({"source_digest": F.sha2(F.to_json(F.struct("comment_id", "parent_id", "text")), 256), "snapshot_digest": F.sha2(F.to_json(F.struct("comment_id", "text", "mentions")), 256)}).orderBy("comment_id")


def over(spark: SparkSession, library, version: str | None = None) -> Api:
    """The queries over one version of a published library; a later publication doesn't change it."""
    version = version or library.current()
    return Api(lambda name: library.read(name, version))


def write_report(rows: DataFrame, path: str) -> None:
    """As JSON lines; an existing report is never overwritten."""
    rows.write.mode("errorifexists").json(path)


def record_run(spark: SparkSession, runs: DataFrame, command: str, started: str, finished: str, metrics: dict[str, int], error: str | None = None) -> DataFrame:
    """runs with one more row; its status says whether anything failed."""
    status = "failed" if error else "partial" if any(v for k, v in metrics.items() if k.endswith("failed")) else "completed"
    last = runs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("n")).first().n
    row = spark.createDataFrame([(last + 1, command, started, finished, status, metrics, error)], "id long, command string, started_at string, finished_at string, status string, metrics map<string,long>, error string")
    row = row.withColumns({c: F.col(c).cast("timestamp") for c in ("started_at", "finished_at")})
    return runs.unionByName(row)


@contextmanager
def tracked(spark: SparkSession, runs: DataFrame, command: str, now: Callable[[], datetime] = lambda: datetime.now(timezone.utc)) -> Iterator[Run]:
    """A run whose counters are added up as its steps measure them; the run's row is there even if a step fails.

    with tracked(spark, runs, "update") as run: run.add(counts)
    then run.rows is `runs` with one more row.
    """
    run, began, error = Run(), now(), None
    try:
        yield run
    except BaseException as e:
        run.add({"failures": 1})
        error = str(e)
        raise
    finally:
        ended = now()
        run.counters["runtime_seconds"] = round((ended - began).total_seconds())
        status = "failed" if error else "partial" if run.counters.get("failures") else "completed"
        last = runs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("n")).first().n
        metrics = dict.fromkeys(RUN_COUNTERS, 0) | run.counters
        row = spark.createDataFrame([(last + 1, command, began, ended, status, metrics, error)], "id long, command string, started_at timestamp, finished_at timestamp, status string, metrics map<string,long>, error string")
        run.rows = runs.unionByName(row)


class Run:
    def __init__(self) -> None:
        self.counters: dict[str, int] = {}
        self.rows: DataFrame | None = None

    def add(self, counts: dict[str, int]) -> None:
        """Adds what a step counted; other figures than RUN_COUNTERS are left out."""
        for name in set(counts) & set(RUN_COUNTERS):
            self.counters[name] = self.counters.get(name, 0) + int(counts[name])
