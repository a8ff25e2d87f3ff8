"""Which threads to read: listed ids, dated hits, and how to split a window that a source caps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TITLE_WORDS = r"(?i)\b(books?|read(ing)?|novels?|literature)\b"
SOURCE_CAP = 1000


def listed_threads(items: DataFrame, ids: list[int], start: int, end: int, least_comments: int = 101) -> DataFrame:
    """Listed stories that still stand, dated start <= time < end, with enough comments, oldest first."""
    if any(isinstance(i, bool) or not isinstance(i, int) or i <= 0 for i in ids):
        raise ValueError("ids are positive whole numbers")
    wanted = items.sparkSession.createDataFrame([(i,) for i in sorted(set(ids))], "id long")
    rows = items.join(F.broadcast(wanted), "id", "left_semi")  # as many as were listed
    rows = rows.where(~F.coalesce("deleted", F.lit(False)) & ~F.coalesce("dead", F.lit(False)))
    rows = rows.where((F.col("time") >= start) & (F.col("time") < end) & (F.coalesce("descendants", F.lit(0)) >= least_comments))
    return rows.orderBy("time", "id")


def dated_hits(hits: DataFrame, start: int, end: int, least_comments: int, title: str = "title") -> DataFrame:
    """Hits of a search in start <= created_at < end with a title about reading; each thread once."""
    rows = hits.where((F.col("created_at") >= start) & (F.col("created_at") < end) & (F.col("num_comments") >= least_comments))
    return rows.where(F.col(title).rlike(TITLE_WORDS)).dropDuplicates(["thread_id"])


def split_windows(start: int, end: int, total: Callable[[int, int], int], room: int, cap: int = SOURCE_CAP) -> Iterator[tuple[int, int]]:
    """Windows of [start, end) small enough that a source, which gives `room` hits at most, gives all of each.

    For a paged source only: it asks for totals of windows, which are halved
    while they are too large. A second that alone is too large can't be split.
    """
    todo = [(start, end)]
    while todo:
        a, b = todo.pop()
        n = total(a, b)
        if n <= room and n < cap:
            yield a, b
        elif b - a <= 1:
            raise ValueError(f"more hits in second {a} than the source gives")
        else:
            half = (a + b) // 2
            todo += [(half, b), (a, half)]


def period(today: str, years: int) -> str:
    """SQL for the day `years` before today; 29 February becomes the 28th."""
    return f"add_months(date'{today}', -12 * {int(years)})"


def thread_ids(*found: DataFrame) -> DataFrame:
    """thread_id: the ids of all sources (a column thread_id or id each), each once."""
    one = [f.select(F.col("thread_id" if "thread_id" in f.columns else "id").cast("long").alias("thread_id")) for f in found]
    out = one[0]
    for f in one[1:]:
        out = out.unionByName(f)
    return out.where("thread_id is not null").distinct()
