"""The registered queries over the library's views, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions import classify, extract
from quillmark.functions.text import author_agrees, author_list, authors_complete, html_parts, normal_title, title_similarity
from quillmark.operators import catalog, discovery, evaluate, grounding, incremental, kept, mentions, ranking, resolve, search, similar, tree
from quillmark.plans import api, oracle, shards
from quillmark.session import cut, shared_folder, stored
from quillmark.sources import views
from quillmark.sources.views import read
from quillmark.streaming import stream

AS_OF = 1_706_745_600  # 2024-02-01, in UTC
AS_OF_ORDERS = 998_870_400  # 2001-08-27

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


# Ranking -----------------------------------------------------------------------------------------


def _ranked(spark: SparkSession, sf_dir: str, sort: str) -> DataFrame:
    books = ranking.score_books(views.event_books(spark, sf_dir), views.event_mentions(spark, sf_dir), AS_OF)
    return ranking.shelf(books, sort, page=1, page_size=100).select("id", "canonical_title", *ranking.SCORE_COLUMNS)


for _sort, (_a, _b) in ranking.ORDERS.items():
    _sql = f"""with {oracle.EVENTS},{oracle.scores("em", AS_OF)}
select book_id as id, 'Book ' || book_id as canonical_title, mention_count, recommendation_count, independent_recommenders, thread_count, all_time_score, recent_score
from score order by {_a} desc, {_b} desc, lower(canonical_title), id limit 100"""
    query(_sql, f"ranked_shelf_{_sort.replace('-', '_')}")(lambda spark, sf_dir, sort=_sort: _ranked(spark, sf_dir, sort))


@query(f"with {oracle.EVENTS},{oracle.opinions('em')} select book_id, anonymous, reader, conflict, created_at, recommendation_strength, sentiment, thread_id, comment_id from win")
def reader_latest_opinion(spark, sf_dir):
    return ranking.latest_opinions(views.event_mentions(spark, sf_dir))


@query(f"with {oracle.EVENTS},{oracle.opinions('em')} select book_id, count(*) as n_readers, cast(sum(conflict::int) as bigint) as n_conflicts from win group by book_id")
def reader_conflicts(spark, sf_dir):
    win = ranking.latest_opinions(views.event_mentions(spark, sf_dir))
    return win.groupBy("book_id").agg(F.count("*").alias("n_readers"), F.sum(F.col("conflict").cast("long")).alias("n_conflicts"))


@query(f"with {oracle.ORDERS},{oracle.scores('om', AS_OF_ORDERS)} select * from score")
def score_details(spark, sf_dir):
    return ranking.scores(views.order_mentions(spark, sf_dir), AS_OF_ORDERS)


#: Mentions of a bucket of books, on average; a book with more than LARGE_BOOK of them is in no bucket.
BUCKET, LARGE_BOOK = 500_000, 500_000


def _two_batches(spark: SparkSession, sf_dir: str) -> tuple[kept.Board, kept.State]:
    """A board kept over two batches of mentions: that of the first one, with the books of the second counted again.

    Mentions and state are kept in buckets of books, so they are shuffled once. Books too large for a task are
    kept apart, without buckets, where aggregates combine before they shuffle.
    """
    columns = ["book_id", "author", "thread_id", "comment_id", "created_at", "recommendation_strength", "sentiment"]
    m = views.order_mentions(spark, sf_dir).where("book_id is not null").select(*columns)
    # a book has no more mentions than lines, so there are at most lines / LARGE_BOOK large ones
    lines = read(spark, sf_dir, "lineitem").groupBy("l_partkey").count()
    n, large = lines.agg(F.sum("count"), F.collect_list(F.when(F.col("count") > LARGE_BOOK, F.col("l_partkey")))).first()
    buckets = max(spark.sparkContext.defaultParallelism, -(-(n or 0) // BUCKET))
    if not large:
        return _merged_batches(stored(m.repartition(buckets, "book_id"), "book_id", buckets), buckets)
    m, in_large = stored(m), F.col("book_id").isin(large)
    few, many = _merged_batches(stored(m.where(~in_large).repartition(buckets, "book_id"), "book_id", buckets), buckets), _merged_batches(m.where(in_large))
    both = lambda a, b, names: [getattr(a, x).unionByName(stored(getattr(b, x))) for x in names]
    return kept.Board(*both(few[0], many[0], ("standing", "months", "opinions"))), kept.State(*both(few[1], many[1], ("opinions", "counts", "threads")))


def _merged_batches(m: DataFrame, buckets: int = 0) -> tuple[kept.Board, kept.State]:
    """The board and the state of mentions, which may be in buckets of books."""
    put = lambda s: kept.State(*(stored(df, "book_id", buckets) for df in (s.opinions, s.counts, s.threads)))
    old, batch = put(kept.gathered(m.where("created_at < 820454400"))), kept.gathered(m.where("created_at >= 820454400"))  # 1996
    # only the old state is read from files here: Spark 4.1 may not group a union of nothing but bucketed files by bucket
    state, changed = put(kept.merged(old, batch)), stored(batch.counts, "book_id", buckets).select("book_id")
    # in buckets nothing has to move, and a hash table of a bucket's books saves a sort
    return kept.updated(kept.board(old), state, changed.hint("shuffle_hash") if buckets else changed), state


@query(f"with {oracle.ORDERS},{oracle.scores('om', AS_OF_ORDERS)} select * from score")
def score_details_kept(spark, sf_dir):
    """score_details, from state that two batches were merged into."""
    return kept.scores_at(_two_batches(spark, sf_dir)[0], AS_OF_ORDERS)


#: In the middle of the orders, at their end, and ten years later.
DATES = (AS_OF_ORDERS - 4 * 31_557_600 + 40_000, AS_OF_ORDERS, AS_OF_ORDERS + 10 * 31_557_600)


@query(" union all ".join(f"select {d} as as_of, book_id, all_time_score, recent_score from (with {oracle.ORDERS},{oracle.scores('om', d)} select * from score)" for d in DATES))
def scores_at_dates(spark, sf_dir):
    """Scores at three dates from one board."""
    board = _two_batches(spark, sf_dir)[0]
    board = kept.Board(*map(stored, (board.standing, board.months, board.opinions)))
    out = [kept.scores_at(board, d).select(F.lit(d).alias("as_of"), "book_id", "all_time_score", "recent_score") for d in DATES]
    return out[0].union(out[1]).union(out[2])


@query(f"""with {oracle.EVENTS},{oracle.scores("em", AS_OF)}
select book_id as id, row_number() over (order by recent_score desc, independent_recommenders desc, lower('Book ' || book_id), book_id) as rank, recent_score from score
qualify rank between 31 and 60""")
def ranked_shelf_second_page(spark, sf_dir):
    books = ranking.score_books(views.event_books(spark, sf_dir), views.event_mentions(spark, sf_dir), AS_OF)
    return ranking.ranked(ranking.shelf(books, "recent", 2, 30), "recent", 2, 30).select("id", F.col("rank").cast("long").alias("rank"), "recent_score")


# The library's fixed queries ---------------------------------------------------------------------


@query(f"""with {oracle.EVENTS}
select (select count(distinct book_id) from em) as books, (select count(distinct conv_id) from conversations) as threads,
  (select count(*) from conversations) as comments,
  (select count(distinct author) from em where book_id is not null and recommendation_strength >= 0.6 and sentiment > 0) as recommenders,
  (select max(created_at) from em where status = 'resolved') as last_updated""")
def library_stats(spark, sf_dir):
    m = views.event_mentions(spark, sf_dir)
    a = m.agg(
        F.countDistinct("book_id").alias("books"),
        F.countDistinct(F.when(F.col("book_id").isNotNull() & classify.is_positive(), F.col("author"))).alias("recommenders"),
        F.max(F.when(F.col("status") == "resolved", F.col("created_at"))).alias("last_updated"),
    )
    c = read(spark, sf_dir, "conversations").agg(F.countDistinct("conv_id").alias("threads"), F.count("*").alias("comments"))
    return a.crossJoin(c)  # one row each


@query(f"""with {oracle.ORDERS}
select book_id, strftime(to_timestamp(created_at) at time zone 'UTC', '%Y-%m') as month, count(*) as mentions,
  count(distinct case when recommendation_strength >= 0.6 and sentiment > 0 then author end) as recommenders
from om group by all""")
def book_timeline_monthly(spark, sf_dir):
    m = views.order_mentions(spark, sf_dir).withColumn("month", F.date_format(F.timestamp_seconds("created_at"), "yyyy-MM"))
    return m.groupBy("book_id", "month").agg(F.count("*").alias("mentions"), F.countDistinct(F.when(classify.is_positive(), F.col("author"))).alias("recommenders"))


@query(f"""with {oracle.ORDERS}
select book_id, row_number() over p as place, id as mention_id, author, n_name as thread_title, created_at, recommendation_strength, len(topics) as n_topics,
  'https://example.org/item?id=' || comment_id as url
from om join nation on thread_id = n_nationkey
window p as (partition by book_id order by recommendation_strength desc, created_at desc, id) qualify place <= 20""")
def book_evidence_page(spark, sf_dir):
    """The first page of every book's evidence."""
    threads = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("thread_id"), F.col("n_name").alias("thread_title"))
    page = Window.partitionBy("book_id").orderBy(F.desc("recommendation_strength"), F.desc("created_at"), "id")
    m = views.order_mentions(spark, sf_dir).withColumn("place", F.row_number().over(page)).where("place <= 20")
    return m.join(threads, "thread_id").select(
        "book_id", "place", F.col("id").alias("mention_id"), "author", "thread_title", "created_at", "recommendation_strength",
        F.size("topics").alias("n_topics"), F.concat(F.lit("https://example.org/item?id="), "comment_id").alias("url"),
    )


@query(f"""with {oracle.ORDERS}, {oracle.TOPICS},
t as (select distinct c_mktsegment as name from customer union select distinct o_orderpriority from orders union select 'UNUSED')
select t.name, count(distinct ot.book_id) as book_count from t left join ot using (name) where t.name is not null group by t.name""")
def topic_counts(spark, sf_dir):
    m = views.told_apart(views.order_mentions(spark, sf_dir))
    marked = views.order_mention_tags(m).join(m.select(F.col("id").alias("mention_id"), "book_id"), "mention_id", "left").select(F.col("tag_id").alias("id"), "book_id")
    return views.order_tags(spark, sf_dir).join(marked, "id", "left").groupBy("name").agg(F.countDistinct("book_id").alias("book_count"))


@query(f"with {oracle.ORDERS}, {oracle.TOPICS} select book_id, name, count(*) as mention_count, round(avg(confidence), 6) as confidence from ot group by all")
def topics_per_book(spark, sf_dir):
    m = views.told_apart(views.order_mentions(spark, sf_dir))
    return ranking.book_tags(m, views.order_mention_tags(m), views.order_tags(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


def _topics(include: list[str], exclude: list[str], words: str = "") -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, sf_dir):
        m, books = views.told_apart(views.order_mentions(spark, sf_dir)), views.order_books(spark, sf_dir)
        if words:
            books = search.search(books, search.term_index(books.withColumnRenamed("id", "book_id"), "book_id", "canonical_title", ascii_only=True), words)
        mentioned = books.join(m.select(F.col("book_id").alias("id")), "id", "left_semi")
        return search.by_topics(mentioned, m, views.order_mention_tags(m), views.order_tags(spark, sf_dir), include, exclude).select("id", "canonical_title")

    return run


def _topics_sql(include: list[str], exclude: list[str], words: str = "") -> str:
    names = lambda x: ", ".join(f"'{n}'" for n in x)
    where = [f"p_partkey in (select book_id from ot where name in ({names(include)}))"] if include else []
    where += [f"p_partkey not in (select book_id from ot where name in ({names(exclude)}))"] if exclude else []
    where += [f"len(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: starts_with(x, '{w}'))) > 0" for w in search.search_words(words)]
    return f"with {oracle.ORDERS}, {oracle.TOPICS} select p_partkey as id, p_name as canonical_title from part where p_partkey in (select book_id from om) and {' and '.join(where)}"


for _name, _args in {
    "topic_include_any": (["BUILDING", "1-URGENT"], []),
    "topic_exclude_any": ([], ["MACHINERY", "5-LOW"]),
    "topic_include_and_exclude": (["AUTOMOBILE", "HOUSEHOLD"], ["2-HIGH"]),
    "search_with_topics": (["BUILDING", "FURNITURE"], ["5-LOW"], "the books about b"),
}.items():
    query(_topics_sql(*_args), _name)(_topics(*_args))


@query("""
select conv_id as thread_id, count(turn) as stored_comments, min(turn) as first_turn, count(distinct role) as authors from conversations group by conv_id""")
def thread_list_counts(spark, sf_dir):
    c = views.conversation_comments(spark, sf_dir)
    threads = c.select("thread_id").distinct()
    return threads.join(c, "thread_id", "left").groupBy("thread_id").agg(F.count("id").alias("stored_comments"), F.min("id").alias("first_turn"), F.countDistinct("author").alias("authors"))


@query("""
select conv_id as thread_id, row_number() over p as place, turn as id, role as author, length(coalesce(text, '')) as n_chars
from conversations window p as (partition by conv_id order by turn) qualify place <= 50""")
def thread_comments_page(spark, sf_dir):
    """The first page of every thread's comments."""
    page = Window.partitionBy("thread_id").orderBy("created_at", "id")
    c = views.conversation_comments(spark, sf_dir).withColumn("place", F.row_number().over(page)).where("place <= 50")
    return c.select("thread_id", "place", "id", "author", F.char_length("text").cast("long").alias("n_chars"))


@query(f"with {oracle.EVENTS} select id, book_id, author, created_at from em where status = 'unresolved' order by id limit 50")
def unresolved_page(spark, sf_dir):
    m = views.event_mentions(spark, sf_dir).where("status = 'unresolved'")
    return m.orderBy("id").limit(50).select("id", "book_id", "author", "created_at")


@query("""with t as (select doc_id, list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9]+')) as terms from documents)
select doc_id from t where len(list_filter(terms, lambda x: starts_with(x, 'thin'))) > 0 and len(list_filter(terms, lambda x: starts_with(x, 'ere'))) > 0""")
def search_prefix_and(spark, sf_dir):
    terms = search.term_index(read(spark, sf_dir, "documents").withColumnRenamed("doc_id", "book_id"), "book_id", "text", ascii_only=True)
    return search.matching(terms, "book_id", search.search_words("a book on thin ere")).withColumnRenamed("book_id", "doc_id")


@query(r"""with t as (select doc_id, list_distinct(regexp_split_to_array(lower(strip_accents(replace(text, 'ß', 'ss'))), '[^\p{L}\p{N}]+')) as terms from documents)
select doc_id from t where len(list_filter(terms, lambda x: starts_with(x, 'ele'))) > 0 and len(list_filter(terms, lambda x: starts_with(x, 'que'))) > 0""")
def search_term_ranges(spark, sf_dir):
    """Documents with words that begin with both of two words, accents or not, from an index in sorted ranges."""
    docs = search.dealt(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), "text"), "book_id")
    terms = search.term_index(docs, "book_id", "text")
    index = search.TermTable(spark, f"{shared_folder(spark)}/terms-{uuid.uuid4().hex}").write(terms, "book_id")
    words = search.search_words("Élé QUE")
    return search.matching(index.starting(words), "book_id", words).withColumnRenamed("book_id", "doc_id")


@query(f"with {oracle.EVENTS},{oracle.opinions('em')} select book_id, anonymous, reader, conflict, created_at, recommendation_strength, sentiment, thread_id, comment_id from win")
def stream_latest_opinion(spark, sf_dir):
    """reader_latest_opinion, kept up by a stream that brings the events in three batches."""
    live = stream.in_files(read(spark, sf_dir, "events"), "event_id", 3)
    return stream.upserted(ranking.latest_opinions(views.as_mentions(live)), ["book_id", "anonymous", "reader"], "latest")


# The published library's own queries, over these tables ------------------------------------------


def _api(spark: SparkSession, sf_dir: str, apart: bool = False) -> api.Api:
    """Parts as books, their order lines as mentions, nations as threads, turns as comments, users' events as runs.

    apart: no two mentions share an id, which then isn't the number that pages of mentions show.
    """

    def read_table(name: str) -> DataFrame:
        m = views.order_mentions(spark, sf_dir).withColumn("status", F.when(F.col("id") % 7 == 0, "unresolved").otherwise("resolved"))
        m = views.told_apart(m) if apart else m
        if name == "mentions":
            return m.drop("topics").withColumns({"raw_mention": F.concat(F.lit("part "), "book_id"), "normalized_mention": F.concat(F.lit("part "), "book_id")})
        if name == "books":
            books = views.order_books(spark, sf_dir).withColumns({"openlibrary_id": F.concat(F.lit("/works/OL"), "id", F.lit("W")), "authors": F.array().cast("array<string>")})
            return books.join(m.groupBy(F.col("book_id").alias("id")).agg(F.count("*").alias("mention_count")), "id")
        if name == "tags":
            return views.order_tags(spark, sf_dir).withColumn("description", F.lower("name"))
        if name == "mention_tags":
            return views.order_mention_tags(m)
        if name == "threads":
            return read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("title"), (F.col("n_nationkey") % 5).cast("long").alias("created_at"))
        if name == "comments":
            return views.conversation_comments(spark, sf_dir)
        e = read(spark, sf_dir, "events")
        return e.groupBy(F.col("user_id").alias("id")).agg(F.max("event_id").alias("finished_at")).withColumn("status", F.when(F.col("id") % 3 == 0, "failed").otherwise("completed"))

    return api.Api(read_table)


_API_MENTIONS = "am as (select *, case when id % 7 = 0 then 'unresolved' else 'resolved' end as status from om)"


@query(f"""with {oracle.ORDERS}
select (select count(distinct book_id) from om join part on book_id = p_partkey) as books, (select count(*) from nation) as threads, (select count(*) from conversations) as comments,
  (select count(distinct author) from om where recommendation_strength >= 0.6 and sentiment > 0) as recommenders, (select max(event_id) from events where user_id % 3 <> 0) as last_updated""")
def api_stats(spark, sf_dir):
    return _api(spark, sf_dir).stats()


@query(f"""with {oracle.ORDERS}
select strftime(to_timestamp(created_at) at time zone 'UTC', '%Y-%m') as month, count(*) as mentions, count(distinct case when recommendation_strength >= 0.6 and sentiment > 0 then author end) as recommenders
from om where book_id = 7 group by 1""")
def api_book_months(spark, sf_dir):
    return _api(spark, sf_dir).book(7)[1]


@query(f"""with {oracle.ORDERS}, {oracle.TOPICS}, page as (select * from om where book_id = 7 order by recommendation_strength desc, created_at desc, id limit 20 offset 20)
select id, author, n_name as thread_title, created_at, recommendation_strength, (select array_to_string(list_sort(list(name)), ',') from ot where mention_id = page.id) as topics
from page join nation on thread_id = n_nationkey""")
def api_evidence_second_page(spark, sf_dir):
    rows = _api(spark, sf_dir).evidence(7, page=2)
    return rows.select("id", "author", "thread_title", "created_at", "recommendation_strength", F.array_join("topics", ",").alias("topics"))


@query(f"""with {oracle.ORDERS}, {oracle.TOPICS},
t as (select distinct c_mktsegment as name from customer union select distinct o_orderpriority from orders union select 'UNUSED')
select t.name, lower(t.name) as description, count(distinct ot.book_id) as book_count from t left join ot using (name) where t.name is not null group by t.name""")
def api_topics(spark, sf_dir):
    return _api(spark, sf_dir, apart=True).topics()


@query("""
select n_nationkey::bigint as id, n_name as title, (n_nationkey % 5)::bigint as created_at, (select count(*) from conversations where conv_id = n_nationkey) as stored_comments
from nation order by n_nationkey % 5 desc, n_nationkey limit 20""")
def api_threads_page(spark, sf_dir):
    return _api(spark, sf_dir).threads()


@query("""
select turn::bigint as id, (turn - 1)::bigint as parent_id, role as author, (turn * 60)::bigint as created_at, trim(regexp_replace(coalesce(text, ''), '[ \t]+', ' ', 'g'), E' \n\t\r') as text
from conversations where conv_id = 3 order by turn limit 50""")
def api_thread_page(spark, sf_dir):
    return _api(spark, sf_dir).thread(3)


@query(f"with {oracle.ORDERS}, {_API_MENTIONS} select id, book_id, author from am where status = 'unresolved' order by id limit 50 offset 50")
def api_unresolved_second_page(spark, sf_dir):
    return _api(spark, sf_dir).unresolved(page=2).select("id", "book_id", "author")


@query("select user_id as id, max(event_id) as finished_at, case when user_id % 3 = 0 then 'failed' else 'completed' end as status from events group by user_id order by id desc limit 30")
def api_status(spark, sf_dir):
    return _api(spark, sf_dir).status()


@query(f"""with {oracle.ORDERS}, m as (select comment_id, count(*) as n from om where thread_id = 3 group by comment_id)
select turn::bigint as comment_id, sha256('{{"comment_id":' || turn || ',"parent_id":' || (turn - 1) || ',"text":' || to_json(coalesce(text, ''))::varchar || '}}') as source_digest, coalesce(n, 0) as n_mentions, 'pending' as status
from conversations left join m on comment_id = turn where conv_id = 3""")
def api_snapshot(spark, sf_dir):
    """A thread's comments as a reviewer gets them: digest of the source, mentions, and the template's status."""
    a = _api(spark, sf_dir)
    rows = a.snapshot(3).select("comment_id", F.when(F.col("mentions").isNull(), 0).otherwise(F.size("mentions")).cast("long").alias("n_mentions"))
    return rows.join(a.label_template(3).select("comment_id", "source_digest", "status"), "comment_id")


# Trees -------------------------------------------------------------------------------------------


@query("""
select c.conv_id as thread_id, c.turn as id, (a.turn is not null)::int + (b.turn is not null)::int as n_ancestors,
  coalesce(b.turn, a.turn) as oldest, length(coalesce(left(b.text, 6000), '')) + length(coalesce(left(a.text, 6000), '')) as n_chars
from conversations c left join conversations a on a.conv_id = c.conv_id and a.turn = c.turn - 1
left join conversations b on b.conv_id = c.conv_id and b.turn = a.turn - 1""")
def ancestors_two_hops(spark, sf_dir):
    a = tree.ancestors(views.conversation_comments(spark, sf_dir))
    chars = F.aggregate(F.transform("ancestors", lambda x: F.char_length(x["text"]).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return a.select("thread_id", "id", F.size("ancestors").alias("n_ancestors"), F.get("ancestors.id", F.lit(0)).alias("oldest"), chars.alias("n_chars"))


@query("""
with recursive t as (
  select conv_id, turn, 0 as depth from conversations where turn = (select min(turn) from conversations)
  union all select c.conv_id, c.turn, t.depth + 1 from t join conversations c on c.conv_id = t.conv_id and c.turn = t.turn + 1
)
select conv_id as thread_id, count(*) as reachable, max(depth) as depth from t group by conv_id""")
def reply_tree_depth(spark, sf_dir):
    """Reachable items and depth of each thread, from its turns without a stored parent."""
    return tree.depths(views.conversation_comments(spark, sf_dir))


_PLAIN = lambda x: f"trim(regexp_replace(coalesce({x}, ''), '[ \\t]+', ' ', 'g'), E' \\n\\t\\r')"  # noqa: E731  the turns hold no tags or entities


@query(f"""
with c as (select conv_id, turn, {_PLAIN("text")} as t from conversations),
th as (select conv_id, arg_min(t, turn) as about from c group by conv_id)
select c.conv_id as thread_id, c.turn as id, (a.turn is not null)::int + (b.turn is not null)::int as n_ancestors,
  sha256(concat_ws('|', 'Thread ' || c.conv_id, left(about, 6000), b.turn || ':' || left(b.t, 6000), a.turn || ':' || left(a.t, 6000), c.t)) as shown_sha256
from c join th using (conv_id) left join c a on a.conv_id = c.conv_id and a.turn = c.turn - 1 left join c b on b.conv_id = c.conv_id and b.turn = a.turn - 1""")
def model_inputs(spark, sf_dir):
    """What a model is shown of each turn: the thread's title and first text, two turns before, the turn."""
    c = views.conversation_comments(spark, sf_dir)
    threads = c.groupBy(F.col("thread_id").alias("id")).agg(F.min_by("text", F.col("id")).alias("text")).withColumn("title", F.concat(F.lit("Thread "), "id"))
    kind = "thread_title string, thread_text string, ancestors array<struct<id: long, text: string>>, current_comment struct<text: string>"
    p = tree.model_input(c, threads).select("thread_id", "id", F.from_json("payload", kind).alias("p"))
    before = F.transform("p.ancestors", lambda x: F.concat(x["id"].cast("string"), F.lit(":"), x["text"]))
    shown = F.concat_ws("|", "p.thread_title", "p.thread_text", before, "p.current_comment.text")
    return p.select("thread_id", "id", F.size("p.ancestors").alias("n_ancestors"), F.sha2(shown, 256).alias("shown_sha256"))


@query("""
with e as (select event_id, user_id, cast(json_extract_string(props, '$.k') as bigint) as k from events)
select conv_id as thread_id from conversations union select k from e where k is not null union select event_id % 37 from e""")
def discovered_threads(spark, sf_dir):
    """Ids of threads from three sources, each once."""
    m = views.event_mentions(spark, sf_dir)
    return discovery.thread_ids(views.conversation_comments(spark, sf_dir), m.select(F.col("book_id").alias("thread_id")), m.select("thread_id"))


# Text --------------------------------------------------------------------------------------------

_SAYS = lambda x, phrases: f"regexp_matches(lower(coalesce({x}, '')), '\\b(?:{'|'.join(phrases).replace(chr(39), chr(39) * 2)})\\b')"
_LABEL = lambda x: f"case when {_SAYS(x, classify.NEGATIVE)} then 'negative' when {_SAYS(x, classify.STRONG)} then 'recommended' when {_SAYS(x, classify.POSITIVE)} then 'positive' else 'neutral' end"


@query(f"""with t as (select doc_id, {_LABEL("text")} as label from documents)
select doc_id, label, case label when 'negative' then -0.8 when 'recommended' then 0.9 when 'positive' then 0.6 else 0.0 end::double as sentiment,
  case label when 'negative' then 0.0 when 'recommended' then 0.95 when 'positive' then 0.65 else 0.2 end::double as strength from t""")
def classify_sentiment(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", classify.label(F.col("text")).alias("label"))
    return d.select("*", classify.sentiment(F.col("label")).alias("sentiment"), classify.strength(F.col("label")).alias("strength"))


@query(f"""select conv_id as thread_id, {_LABEL("text")} as label, count(*) as n from conversations group by all""")
def classify_turns(spark, sf_dir):
    return views.conversation_comments(spark, sf_dir).groupBy("thread_id", classify.label(F.col("text")).alias("label")).agg(F.count("*").alias("n"))


def _topic_rows() -> str:
    from quillmark.functions.text import normal
    from quillmark.sources.config import TOPICS

    return ", ".join(f"('{t}', '{w}')" for t, words in TOPICS.items() for w in sorted({normal(x) for x in words}))


@query(f"""
with d as (select 'd' || doc_id as key, text from documents union all select 'c' || conv_id || '-' || turn, text from conversations),
n as (select key, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9_]+', ' ', 'g')) || ' ' as t from d)
select distinct key, topic, 0.8::double as confidence from n join (values {_topic_rows()}) w(topic, word) on contains(t, ' ' || word || ' ')""")
def tag_topics_keyword(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("key"), "text")
    c = read(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("key"), "text")
    rows = d.union(c).select("key", classify.ascii_normal(F.col("text")).alias("normal"))
    return classify.tag_topics(rows, "normal", "key")


@query("select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9_]+', ' ', 'g')) as normal, trim(regexp_replace(regexp_replace(p_name, ',?\\s+ed\\.$', '', 'i'), ',?\\s+vol(?:s|umes?)?\\.?\\s+[\\dIVX]+\\s*,?$', '', 'i')) as lookup from part")
def normalize_title_ascii(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    lookup = F.trim(F.regexp_replace(F.regexp_replace("p_name", r"(?i),?\s+ed\.$", ""), r"(?i),?\s+vol(?:s|umes?)?\.?\s+[\dIVX]+\s*,?$", ""))
    return p.select("p_partkey", classify.ascii_normal(F.col("p_name")).alias("normal"), lookup.alias("lookup"))


@query()
def normalize_title_unicode(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(normal_title("text"), 256).alias("normal_sha256"))


@query()
def title_similarity_pairs(spark, sf_dir):
    """Names that differ in one word, found over their other words, with their similarity."""
    names = read(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    words = F.array_sort(F.split("name", " "))
    keyed = names.withColumn("w", words).withColumn("gone", F.explode(F.sequence(F.lit(1), F.size("w"))))
    keyed = keyed.select("name", F.array_join(F.filter("w", lambda x, i: i + 1 != F.col("gone")), " ").alias("rest"))
    pairs = keyed.withColumnRenamed("name", "left_name").join(keyed.withColumnRenamed("name", "right_name"), "rest").where("left_name < right_name")
    pairs = pairs.select("left_name", "right_name").distinct()
    return pairs.withColumn("similarity", title_similarity("left_name", "right_name"))


@query()
def similar_titles(spark, sf_dir):
    """All pairs of different names, types and brands of parts whose similarity is at least 0.94."""
    t = read(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("title"))
    return similar.similar(t, t)


def _each(rows: DataFrame, key: str, items: Column, *columns: str) -> DataFrame:
    """key, place and each item. With an inner posexplode Spark looks for empty arrays first, and makes every array twice."""
    return rows.select(key, F.posexplode_outer(items).alias("place", "part")).where("place is not null").select(key, "place", *columns)


def _pages(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", html_parts("html").alias("h"))


@query()
def html_plain_text(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.col("h.plain").alias("plain"))


@query()
def html_links(spark, sf_dir):
    return _each(_pages(spark, sf_dir), "page_id", F.col("h.links"), "part.url", "part.label")


@query()
def html_emphasis(spark, sf_dir):
    """Emphasised parts of pages whose headings are set in italics."""
    pages = read(spark, sf_dir, "pages").select("page_id", html_parts(F.regexp_replace("html", "<(/?)h1>", "<$1i>"))["emphasis"].alias("e"))
    return _each(pages, "page_id", F.col("e"), "part")


@query(r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[a-zA-Z0-9]+') as w from documents where len(regexp_extract_all(coalesce(text, ''), '[a-zA-Z0-9]+')) >= 4)
select doc_id, unnest([0, 1]) as place, unnest([w[2] || ' ' || w[3], w[4]]) as part from w""")
def emphasised_parts(spark, sf_dir):
    """Emphasis in HTML that is made of each document's first words."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[a-zA-Z0-9]+"), F.lit(0)).alias("w")).where("size(w) >= 4")
    page = F.concat(F.lit("<p>"), F.get("w", F.lit(0)), F.lit(" <i>"), F.get("w", F.lit(1)), F.lit(" "), F.get("w", F.lit(2)), F.lit("</i>, <b>"), F.get("w", F.lit(3)), F.lit("</b></p>"))
    return _each(d.select("doc_id", html_parts(page)["emphasis"].alias("e")), "doc_id", F.col("e"), "part")


@query("""
with a as (select p_partkey, split(p_name, ' ') as w from part),
n as (select p_partkey, upper(w[1][1]) || w[1][2:] as one, upper(w[2][1]) || w[2][2:] as two from a)
select p_partkey, one || ' ' || two || ' and Ann ' || two as author, one || ' ' || two || '; Ann ' || two as parts, true as listed, p_partkey % 2 = 0 as all_there from n where one <> 'Ann'""")
def author_names(spark, sf_dir):
    """Two persons with one surname, made of each part's name: their single names, and whether a list of names has them."""
    w = F.split(F.initcap("p_name"), " ")
    name = F.concat_ws(" ", F.get(w, F.lit(0)), F.get(w, F.lit(1)))
    other = F.concat(F.lit("Ann "), F.get(w, F.lit(1)))
    parts = read(spark, sf_dir, "part").repartition(4 * spark.sparkContext.defaultParallelism)  # few bytes with much work, else read by one task
    rows = parts.select("p_partkey", F.concat(name, F.lit(" and "), other).alias("author"), F.array(other, name).alias("names"), F.array(other).alias("one"))
    there = author_agrees("author", F.when(F.col("p_partkey") % 2 == 0, F.col("names")).otherwise(F.col("one")))
    return rows.select("p_partkey", "author", F.array_join(author_list("author"), "; ").alias("parts"), authors_complete("author", "names").alias("listed"), there.alias("all_there"))


@query()
def extract_mentions(spark, sf_dir):
    """Spans of pages and of conversations' turns, with the sentiment of their context."""
    p = read(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("key"), F.col("html").alias("value"))
    c = read(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("key"), F.col("text").alias("value"))
    rows = p.union(c).select("key", F.posexplode(extract.mentions_in_context("value")).alias("place", "m")).select("key", "place", "m.*")
    return rows.withColumn("label", classify.label(F.col("context")))


@query()
def grounded_excerpts(spark, sf_dir):
    """Benchmark passages as quotes: the documents that hold them, and the excerpt there."""
    return grounding.grounded_in(read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("raw")), read(spark, sf_dir, "documents").select("doc_id", "text"))


# Mentions and resolution -------------------------------------------------------------------------

_SOURCE = "case when id % 5 = 0 then 'stated' when id % 5 = 1 then 'context' when id % 5 = 2 then 'inferred' else 'unknown' end"


@query(f"""with {oracle.EVENTS},
m as (
  select thread_id, book_id, id, 'raw ' || repeat('x', (id % 6)::int) || id as raw, case when id % 3 = 0 then author end as author, {_SOURCE} as author_source,
    case when id % 50 = 0 then '/works/OL' || (id % 4) || 'W' end as work_id, (id % 90) / 100.0::double as confidence, label as sentiment,
    [label, 't' || (id % 3)] as tags
  from em where book_id is not null
),
g as (
  select thread_id, book_id, count(*) as n,
    max({{'rank': list_position(['unknown', 'inferred', 'context', 'stated'], author_source), 'confidence': confidence, 'length': length(raw), 'raw': raw}}) as lead,
    max(confidence) as top, count(distinct lower(author)) as n_authors, count(distinct work_id) as n_works, max(work_id) as work, count(distinct sentiment) as n_s,
    array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') as tags
  from m group by all
)
select g.thread_id, g.book_id, lead.raw as raw, case when n_authors <= 1 and n_works <= 1 then m.author end as author,
  case when n_authors > 1 or n_works > 1 then 'unknown' else m.author_source end as author_source,
  case when n_authors <= 1 and n_works <= 1 then work end as work_id,
  case when n_authors > 1 or n_works > 1 then least(top, 0.69::double) else top end as confidence,
  case when n_s > 1 then 'neutral' else m.sentiment end as sentiment, g.tags, n as n_duplicates, n_authors > 1 or n_works > 1 as conflicting
from g join m on m.thread_id = g.thread_id and m.book_id = g.book_id and m.raw = lead.raw""")
def duplicate_mention_collapse(spark, sf_dir):
    m = views.event_mentions(spark, sf_dir).where("book_id is not null")
    rows = m.select(
        "thread_id", "book_id", F.expr("concat('raw ', repeat('x', cast(id % 6 as int)), id)").alias("raw"), F.when(F.col("id") % 3 == 0, F.col("author")).alias("author"),
        F.expr(_SOURCE).alias("author_source"), F.expr("case when id % 50 = 0 then concat('/works/OL', id % 4, 'W') end").alias("work_id"),
        ((F.col("id") % 90) / 100.0).alias("confidence"), F.col("label").alias("sentiment"), F.array("label", F.expr("concat('t', id % 3)")).alias("tags"),
    )
    return mentions.collapsed(rows, ["thread_id"], "book_id").withColumn("tags", F.array_join("tags", ","))


def _candidates(spark, sf_dir):
    """Each name as a span; the parts of that name as its candidates, by suppliers as authors."""
    p = read(spark, sf_dir, "part")
    spans = p.groupBy("p_name").agg(F.min("p_partkey").alias("span_id"))
    rows = spans.join(p, "p_name")
    return rows.select(
        "span_id", F.when(F.col("span_id") % 2 == 0, F.lit("x")).alias("author"), F.concat(F.lit("/works/OL"), "p_partkey", F.lit("W")).alias("key"),
        F.when(F.col("p_partkey") % 5 == 0, 0.95).when(F.col("p_partkey") % 7 == 0, 0.9).otherwise(1.0).alias("score"),
        (F.col("p_partkey") % 11 != 0).alias("agrees"), (F.col("p_partkey") % 4 != 0).alias("complete"), (F.col("p_partkey") % 6 != 0).alias("exact"),
        F.array(F.col("p_brand")).alias("identities"), (F.col("p_size") > 48).alias("graphic"), (F.col("p_size") % 4).alias("n_isbns"), (F.col("p_size") + 1950).alias("year"),
    )


_CASCADE = """
with p as (select p_name, min(p_partkey) as span_id from part group by p_name),
c as (
  select span_id, case when span_id % 2 = 0 then 'x' end as author, p_partkey as k, case when p_partkey % 5 = 0 then 0.95 when p_partkey % 7 = 0 then 0.9 else 1.0 end::double as score,
    p_partkey % 11 <> 0 as agrees, p_partkey % 4 <> 0 as complete, p_partkey % 6 <> 0 as exact, p_brand, p_size > 48 as graphic, p_size % 4 as n_isbns, p_size + 1950 as year
  from p join part using (p_name)
),
e0 as (select *, max(score) over (partition by span_id) as best, score >= 0.94 and agrees as e from c),
e1 as (select *, coalesce(max((e and exact)::int) over (partition by span_id), 0) = 1 as any_exact from e0),
e2 as (select *, e and (not any_exact or exact) as f from e1),
e3 as (select *, coalesce(max((f and author is not null and complete)::int) over (partition by span_id), 0) = 1 as any_complete from e2),
e4 as (select *, f and (not any_complete or (author is not null and complete)) as i from e3),
e5 as (select *, max(case when i then score end) over (partition by span_id) as top from e4)"""


@query(f"""{_CASCADE},
g as (
  select span_id, max(best) as confidence, count(*) filter (i) as n_eligible, count(distinct k) filter (i and top - score < 0.04) as n_near,
    bool_or(any_exact) and bool_or(author is not null) and count(distinct (p_brand, graphic)) filter (i) = 1 as dup,
    arg_min(k, (-n_isbns, year, k)) filter (i) as by_record, arg_min(k, (-score, k)) filter (i) as by_score
  from e5 group by span_id
)
select span_id, '/works/OL' || case when dup then by_record when n_near = 1 then by_score end || 'W' as key, confidence, n_eligible from g""")
def candidate_cascade(spark, sf_dir):
    return resolve.cascade(_candidates(spark, sf_dir))


@query("""
select p_brand, p_type, '/works/OL' || arg_min(p_partkey, (-(p_size % 4), p_size + 1950, p_partkey)) || 'W' as key, count(*) as n_records from part group by all""")
def catalog_duplicate_pick(spark, sf_dir):
    """Of records alike in brand and type the one with most editions, then the oldest, then the first."""
    p = read(spark, sf_dir, "part")
    pick = F.min(F.struct((-(F.col("p_size") % 4)).alias("a"), (F.col("p_size") + 1950).alias("b"), "p_partkey"))
    return p.groupBy("p_brand", "p_type").agg(pick.alias("m"), F.count("*").alias("n_records")).select("p_brand", "p_type", F.concat(F.lit("/works/OL"), "m.p_partkey", F.lit("W")).alias("key"), "n_records")


@query("""
with k as (select p_name, p_size > 49 as large, min(p_partkey) as id from part group by all),
b as (select trim(lower(p_name)) as n, count(*) as n_books, min(id) as id, string_agg(id, ',' order by id) as ids from k group by n)
select s.p_partkey as span_id, case when n_books = 1 then id end as book_id, case when n_books = 1 then 1.0 else 0.0 end::double as confidence, n_books,
  case when n_books > 1 then ids else '' end as candidates
from part s join b on trim(lower(s.p_name)) = b.n""")
def resolve_against_books(spark, sf_dir):
    """Parts as spans; each name as a book, and as a second one where a part is large."""
    p = read(spark, sf_dir, "part")
    books = p.groupBy("p_name", (F.col("p_size") > 49).alias("large")).agg(F.min("p_partkey").alias("id")).select(
        "id", F.initcap("p_name").alias("canonical_title"), normal_title("p_name").alias("normalized_title"), F.array().cast("array<string>").alias("authors"), F.lit(None).cast("string").alias("openlibrary_id")
    )
    spans = p.select(F.col("p_partkey").alias("span_id"), F.upper("p_name").alias("title"), F.lit(None).cast("string").alias("author"), F.lit(None).cast("string").alias("work_id"))
    return resolve.against_books(spans, books).withColumn("candidates", F.array_join(F.col("candidates.book_id").cast("array<string>"), ","))


@query("""
with f as (select p_name as q, case when p_size > 20 then lower(p_type) end as qa, p_partkey as k, row_number() over (partition by p_name, case when p_size > 20 then lower(p_type) end order by p_partkey) - 1 as place from part),
t as (select * from f where place < 8),
s as (select p_partkey as id, p_name as q, case when p_partkey % 3 = 0 then lower(p_type) end as a, p_partkey % 10 = 1 as linked from part),
b as (select s.id, t.k from s join t on s.q = t.q and s.a is not distinct from t.qa where not linked),
o as (select s.id, t.k from s join t on s.q = t.q and t.qa is null where not linked and s.a is not null and s.id not in (select id from b)),
r as (select * from b union all select * from o union all select id, id from s where linked)
select id as span_id, count(*) as n, cast(sum(k) as bigint) as keys from r group by id""")
def lookup_records(spark, sf_dir):
    """Parts as spans, and as the catalogue: by a link, by title and author, else by title alone; the first eight answers count."""
    p = read(spark, sf_dir, "part")
    key, by = F.concat(F.lit("/works/OL"), "p_partkey", F.lit("W")), F.when(F.col("p_size") > 20, F.lower("p_type"))
    spans = p.select(F.col("p_partkey").alias("span_id"), F.upper("p_name").alias("title"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).alias("author"), F.when(F.col("p_partkey") % 10 == 1, key).alias("work_id"))
    place = F.row_number().over(Window.partitionBy("p_name", by).orderBy("p_partkey")) - 1
    none = F.lit(None)
    found = p.select(F.col("p_name").alias("query"), by.alias("query_author"), place.alias("place"), key.alias("key"), F.col("p_name").alias("candidate_title"), F.array("p_type").alias("names"), none.cast("array<string>").alias("subjects"), none.cast("array<string>").alias("isbns"), none.cast("int").alias("year"), none.cast("long").alias("cover_i"))
    works = p.select(key.alias("key"), F.col("p_name").alias("title"), F.array(F.concat(F.lit("/authors/OL"), F.col("p_partkey") % 100, F.lit("A"))).alias("author_keys"))
    authors = read(spark, sf_dir, "supplier").select(F.concat(F.lit("/authors/OL"), "s_suppkey", F.lit("A")).alias("key"), F.col("s_name").alias("name"))
    rows = resolve.looked_up(spans, found, works, authors)
    return rows.groupBy("span_id").agg(F.count("*").alias("n"), F.sum(F.regexp_extract("key", r"(\d+)", 1).cast("long")).alias("keys"))


_CATALOG = """
with r as (
  select '/works/OL' || p_partkey || 'W' as key, string_split(lower(p_name || ' ' || p_type), ' ') as w, string_split(lower(replace(s_name, '#', ' ')), ' ') as a
  from part left join supplier on s_suppkey = p_partkey % 100
),
q as (
  select distinct upper(p_name) || ' ' || lower(p_type) as title, s_name as author, string_split(lower(p_name || ' ' || p_type), ' ') as w, string_split(lower(replace(s_name, '#', ' ')), ' ') as a
  from part left join supplier on s_suppkey = (p_partkey * 7 + 3) % 100 and p_size > 40
),
rt as (select key, len(w) as n_words, unnest(list_distinct(list_concat(['t ' || x for x in w], ['p ' || w[i] || ' ' || w[i + 1] for i in range(1, len(w))], ['a ' || x for x in coalesce(a, [])]))) as term from r),
qt as (select title, author, unnest(list_distinct(list_concat(['t ' || x for x in w], ['p ' || w[i] || ' ' || w[i + 1] for i in range(1, len(w))], ['a ' || x for x in coalesce(a, [])]))) as term from q),
df as (select term, cast(floor(1000 * ln(1 + (select count(*) from r)::double / count(*))) as bigint) as weight from rt group by term),
i as (select key, term, case when term[1] = 'a' then weight else greatest(1, weight * 4 // (3 + n_words)) end as impact from rt join df using (term)),
s as (select title, author, key, cast(sum(impact) as bigint) as score from qt join i using (term) group by all having bool_or(term like 't %'))
select title, author, row_number() over (partition by title, author order by score desc, key) - 1 as place, key, score from s qualify place < 8"""


@query(_CATALOG)
def catalog_search_top8(spark, sf_dir):
    """Every part's name and type, of large parts with a supplier as author, asked of an index of all parts: the best eight of each question."""
    p, s = read(spark, sf_dir, "part"), read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    by = lambda n, cond=F.lit(True): p.join(s, (F.col("s_suppkey") == n) & cond, "left")
    names = F.when(F.col("s_name").isNotNull(), F.array("s_name"))
    records = by(F.col("p_partkey") % 100).select(F.concat(F.lit("/works/OL"), "p_partkey", F.lit("W")).alias("key"), F.concat_ws(" ", "p_name", "p_type").alias("title"), names.alias("names"))
    asks = by((F.col("p_partkey") * 7 + 3) % 100, F.col("p_size") > 40).select(F.concat_ws(" ", F.upper("p_name"), F.lower("p_type")).alias("title"), F.col("s_name").alias("author"), names.alias("names")).distinct()
    asks = cut(catalog.with_terms(asks, "title", "names").select(F.to_json(F.array("title", "author")).alias("ask"), "title", "author", "terms"))
    found = catalog.search(asks.select("ask", "terms"), catalog.build(records))
    return asks.join(found, "ask").select("title", "author", F.col("place").cast("long").alias("place"), "key", "score")


@query("""
with b as (select p_name, min(p_partkey) as id, min(p_partkey) % 4 = 0 as barred from part where p_size % 3 <> 0 group by p_name)
select p_partkey as span_id, id as book_id, 1.0::double as confidence, 1::bigint as n_books from part s join b using (p_name) where not (barred and s.p_size % 2 = 0)""")
def resolve_by_version(spark, sf_dir):
    """As resolve_against_books(), where books of another version don't count and reviews bar a work for one author."""
    p = read(spark, sf_dir, "part")
    who = "James S. A. Corey"
    books = p.groupBy("p_name", (F.col("p_size") % 3 == 0).alias("old")).agg(F.min("p_partkey").alias("id")).select(
        "id", F.col("p_name").alias("canonical_title"), normal_title("p_name").alias("normalized_title"), F.array(F.lit(who)).alias("authors"),
        F.when(F.col("id") % 4 == 0, "/works/OL20185071W").otherwise(F.concat(F.lit("/works/OL"), "id", F.lit("W"))).alias("openlibrary_id"), F.when(F.col("old"), 1).otherwise(2).alias("resolution_version"),
    )
    spans = p.select(F.col("p_partkey").alias("span_id"), F.upper("p_name").alias("title"), F.when(F.col("p_size") % 2 == 0, who).alias("author"), F.lit(None).cast("string").alias("work_id"))
    return resolve.against_books(spans, books, version=2).drop("candidates")


# Incremental runs --------------------------------------------------------------------------------

@query(f"""
with c as (select conv_id, turn, text, case when turn = 2 then coalesce(text, '') || ' overrated' else text end as after from conversations),
l as (select conv_id, turn, {_LABEL("after")} as label from c)
select conv_id as thread_id, count(*) as comments, count(*) filter (turn = 2) as done_again, count(*) filter (label <> 'neutral') as opinions,
  count(*) filter (label = 'negative') as negative from l group by conv_id""")
def incremental_run(spark, sf_dir):
    """Opinions of each thread's turns after two runs: over all turns, and over all turns with the third one edited, of which only these are read anew."""
    store = shards.Shards(spark, f"{shared_folder(spark)}/incremental-{uuid.uuid4().hex}", shards=16, key="key")
    c = views.conversation_comments(spark, sf_dir)
    runs = []

    def derive(todo):
        label = classify.label(F.col("text"))
        runs.append(todo.select("thread_id"))
        return shards.Derived({"opinions": todo.select(F.col("key").alias("row_id"), "thread_id", label.alias("label")).where("label <> 'neutral'")})

    for text in (F.col("text"), F.when(F.col("id") == 2, F.concat("text", F.lit(" overrated"))).otherwise(F.col("text"))):
        rows = c.withColumns({"text": text, "key": F.concat_ws("-", "thread_id", "id")})
        store.update(rows.select("key", "thread_id", "id", "text"), derive, version="1")
    every = store.read("rows").groupBy("thread_id").agg(F.count("*").alias("comments"))
    again = runs[-1].groupBy("thread_id").agg(F.count("*").alias("done_again"))
    said = store.read("opinions").groupBy("thread_id").agg(F.count("*").alias("opinions"), F.count_if(F.col("label") == "negative").alias("negative"))
    return every.join(again, "thread_id", "left").join(said, "thread_id", "left").na.fill(0)


_BATCHES = """
o as (select user_id, min(epoch_us(ts)) as created, max({'t': epoch_us(ts), 'id': event_id, 'v': value}) as m from events where event_type in ('view', 'click', 'signup') group by user_id),
n as (select user_id, min(epoch_us(ts)) as created, max({'t': epoch_us(ts), 'id': event_id, 'v': value}) as m from events where event_type not in ('view', 'click', 'signup') group by user_id)"""


def _batches(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    one = lambda cond: e.where(cond).groupBy("user_id").agg(F.min("t").alias("created"), F.max(F.struct("t", F.col("event_id").alias("id"), F.col("value").alias("v"))).alias("m")).select("user_id", "created", "m.*")
    return one("event_type in ('view', 'click', 'signup')"), one("event_type not in ('view', 'click', 'signup')")


@query(f"""with {_BATCHES}
select user_id, coalesce(o.created, n.created) as created, coalesce(n.m, o.m).t as t, coalesce(n.m, o.m).id as id, coalesce(n.m, o.m).v as v from o full join n using (user_id)""")
def upsert_latest(spark, sf_dir):
    old, new = _batches(spark, sf_dir)
    return incremental.upsert(old, new, "user_id", keep=["created"])


@query(f"""with {_BATCHES}
select user_id, n.m.id as id from n left join o using (user_id) where o.user_id is null or o.m.v is distinct from n.m.v or n.m.v > 50""")
def changed_rows(spark, sf_dir):
    old, new = _batches(spark, sf_dir)
    new, old = (x.withColumn("digest", incremental.digest("user_id", "v")) for x in (new, old))
    unresolved = new.where("v > 50")
    return incremental.changed(new, old, "user_id", unresolved).select("user_id", "id")


@query(f"""with {oracle.EVENTS}
select id, book_id, comment_id // 20 as comment_key from em where comment_id // 20 not in (select comment_id // 20 from em where label = 'negative')
union all select id, -book_id, comment_id // 20 from em where label = 'negative'""")
def replace_by_comment(spark, sf_dir):
    m = views.event_mentions(spark, sf_dir).select("id", "book_id", "label", F.floor(F.col("comment_id") / 20).alias("comment_key"))
    new = m.where("label = 'negative'").withColumn("book_id", -F.col("book_id"))
    return incremental.replace_by(m, new, new, "comment_key").drop("label")


@query("""
select conv_id as thread_id, count(*) as n from conversations
where conv_id not in (select conv_id from conversations group by conv_id having count(*) % 3 = 0 and max(turn) >= 2) group by conv_id""")
def pending_threads(spark, sf_dir):
    per = views.conversation_comments(spark, sf_dir).groupBy("thread_id").agg(F.count("*").alias("n"), F.max("id").alias("last"))
    done = per.select("thread_id", (F.col("last") >= 2).alias("raw_complete"), F.when(F.col("n") % 3 == 0, "v2").otherwise("v1").alias("processed_version"))
    return incremental.pending(per.drop("last"), done, "v2")


@query("""
with r as (select user_id, count(*) as n, sum((event_type = 'error')::int) as failures, bool_or(value > 99) as broken from events group by user_id)
select case when broken then 'failed' when failures > 0 then 'partial' else 'completed' end as status, count(*) as runs, cast(sum(n) as bigint) as events, cast(sum(failures) as bigint) as failures from r group by 1""")
def run_status_rollup(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    r = e.groupBy("user_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("event_type") == "error", 1)).alias("failures"), F.max(F.when(F.col("value") > 99, "value above 99")).alias("error"))
    r = r.withColumn("status", incremental.run_status(F.col("failures"), F.col("error")))
    return r.groupBy("status").agg(F.count("*").alias("runs"), F.sum("n").alias("events"), F.sum("failures").alias("failures"))


@query(f"""with {_BATCHES} select user_id, o.user_id is null as is_new from n left join o using (user_id)""")
def upsert_added(spark, sf_dir):
    old, new = _batches(spark, sf_dir)
    return incremental.added(old, new, "user_id")


@query("select p_partkey, p_name, 100 + row_number() over (order by p_name, p_partkey) as number from part")
def numbered_in_ranges(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat("p_name", F.lit(" "), F.lpad(F.col("p_partkey").cast("string"), 12, "0")).alias("place"))
    return incremental.numbered(rows, "place", "number", after=100).drop("place")


_METRICS = {"view": "comments_fetched", "click": "comments_processed", "purchase": "mentions_extracted", "signup": "new_comments", "error": "failures"}


@query(f"""
select user_id, {", ".join(f"cast(count(*) filter (event_type = '{ {v: k for k, v in _METRICS.items()}.get(c, '-') }') as bigint) as {c}" for c in incremental.RUN_COUNTERS)}
from events group by user_id""")
def run_counters(spark, sf_dir):
    """Each user's events as the steps of a run."""
    names = F.create_map(*[F.lit(x) for kv in _METRICS.items() for x in kv])
    e = read(spark, sf_dir, "events").select("user_id", names[F.col("event_type")].alias("counter"), F.lit(1).cast("long").alias("n"))
    return incremental.run_metrics(e, ["user_id"])


@query("""
with t as (select conv_id, count(*) as comments, max(turn) as last from conversations group by conv_id),
p as (select *, not (comments % 3 = 0 and last >= 2) as todo from t),
k as (select * from p where todo order by comments, conv_id limit 25)
select count(*) as threads_discovered, count(*) filter (todo) as threads_pending, count(*) filter (not todo) as threads_skipped,
  (select count(*) from k) as threads_to_process, (select cast(sum(comments) as bigint) from k) as estimated_comments from p""")
def dry_run_report(spark, sf_dir):
    """What a run that takes 25 threads would do."""
    per = views.conversation_comments(spark, sf_dir).groupBy("thread_id").agg(F.count("*").alias("comments"), F.max("id").alias("last"))
    done = per.select("thread_id", (F.col("last") >= 2).alias("raw_complete"), F.when(F.col("comments") % 3 == 0, "v2").otherwise("v1").alias("processed_version"))
    threads = per.select("thread_id", F.concat(F.lit("Thread "), "thread_id").alias("title"), "comments", F.col("comments").alias("created_at"))
    return incremental.dry_run(threads, done, "v2", limit=25)[0]


# Discovery ---------------------------------------------------------------------------------------


@query("""
select cast(o_orderkey as bigint) as id, cast(epoch(o_orderdate) as bigint) as time, n as descendants
from (select o_orderkey, any_value(o_orderdate) as o_orderdate from orders group by 1) o join (select l_orderkey, count(*) as n from lineitem group by 1) l on o_orderkey = l_orderkey
where o_orderkey <= 400 and o_orderkey % 3 <> 0 and n >= 3 and epoch(o_orderdate) >= 788918400 and epoch(o_orderdate) < 946684800""")
def listed_threads(spark, sf_dir):
    """Orders as stories, their lines as comments; the first 400 ids as the curated list."""
    n = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("descendants"))
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("id")).agg(F.first("o_orderdate").alias("d"))
    items = o.join(n, "id").select("id", F.unix_seconds(F.col("d").cast("timestamp")).alias("time"), "descendants", (F.col("id") % 3 == 0).alias("deleted"), F.lit(False).alias("dead"))
    return discovery.listed_threads(items, list(range(1, 401)), 788918400, 946684800, 3).select("id", "time", "descendants")


@query("""
select o_orderpriority, count(*) as n, count(distinct o_custkey) as authors from orders
where o_orderdate >= date '1999-06-30' and o_orderdate < date '2000-06-30' group by o_orderpriority""")
def dated_window(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    start = F.expr(discovery.period("2000-06-30", 1))
    return o.where((F.to_date("o_orderdate") >= start) & (F.col("o_orderdate") < F.lit("2000-06-30").cast("timestamp_ntz"))).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("authors"))


# Evaluation --------------------------------------------------------------------------------------


@query("""
with r as (
  select quality = 1 as t, toxic = 0 as g, unnest(['all', lang, case when n_chars > 2000 then 'long' else 'short' end]) as "case"
  from labels join documents using (doc_id)
),
c as (select "case", count(*) filter (t and g) as tp, count(*) filter (not t and g) as fp, count(*) filter (t and not g) as fn, count(*) filter (not t and not g) as tn from r group by 1)
select *, case when tp + fp > 0 then tp / (tp + fp)::double end as precision, case when tp + fn > 0 then tp / (tp + fn)::double end as recall from c""")
def confusion_matrix_by_case(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    rows = rows.select((F.col("quality") == 1).alias("truth"), (F.col("toxic") == 0).alias("guess"), F.array("lang", F.when(F.col("n_chars") > 2000, "long").otherwise("short")).alias("cases"))
    return evaluate.confusion(rows, "truth", "guess", "cases")


@query(f"""with {oracle.EVENTS},
g as (select thread_id, book_id, max(label) as label, max(recommendation_strength) as s from em where label <> 'neutral' group by all),
p as (select thread_id, book_id, min(label) as label, min(recommendation_strength) as s from em where label <> 'recommended' group by all),
j as (
  select g.label as gl, p.label as pl, g.s as gs, p.s as ps, case when g.book_id is null then 'fp' when p.book_id is null then 'fn' else 'tp' end as o
  from g full join p on g.thread_id = p.thread_id and g.book_id = p.book_id
),
c as (
  select count(*) filter (o = 'tp') as tp, count(*) filter (o = 'fp') as fp, count(*) filter (o = 'fn') as fn,
    cast(sum((coalesce(gl = pl, false))::int) as bigint) as tags_tp, cast(sum((pl is not null and not coalesce(gl = pl, false))::int) as bigint) as tags_fp,
    cast(sum((gl is not null and not coalesce(gl = pl, false))::int) as bigint) as tags_fn,
    count(*) filter (o = 'tp' and gl = pl) as sentiment_correct, count(*) filter (o = 'tp' and abs(gs - ps) <= 0.1 + 1e-9) as strength_correct
  from j
)
select *, tp / (tp + fp)::double as mention_precision, tp / (tp + fn)::double as mention_recall, tags_tp / (tags_tp + tags_fp)::double as tag_precision,
  tags_tp / (tags_tp + tags_fn)::double as tag_recall, sentiment_correct / tp::double as sentiment_agreement, strength_correct / tp::double as strength_agreement from c""")
def precision_recall(spark, sf_dir):
    """Mentions with an opinion as gold, all but recommendations as predictions, one for each thread and book."""
    m = views.event_mentions(spark, sf_dir).withColumn("title", F.concat(F.lit("b"), "book_id"))
    by = [F.col("thread_id").alias("comment_id"), "title"]
    gold = m.where("label <> 'neutral'").groupBy(*by).agg(F.max("label").alias("g_sentiment"), F.max("recommendation_strength").alias("g_strength"))
    gold = gold.select("comment_id", F.xxhash64("title").alias("gold_no"), F.array("title", F.concat("title", F.lit("!"))).alias("titles"), F.array("g_sentiment").alias("g_tags"), "g_sentiment", "g_strength")
    pred = m.where("label <> 'recommended'").groupBy(*by).agg(F.min("label").alias("p_sentiment"), F.min("recommendation_strength").alias("p_strength"))
    pred = pred.select("comment_id", F.xxhash64("title").alias("pred_no"), "title", F.array("p_sentiment").alias("p_tags"), "p_sentiment", "p_strength")
    return evaluate.mention_metrics(evaluate.matched(gold, pred))


@query("""
with a as (select item_id, list_distinct(regexp_split_to_array(lower(text), '[^a-z]+')) as w from benchmark), b as (select item_id - 1 as item_id, w as v from a)
select item_id, len(list_intersect(w, v)) as tp, len(list_filter(w, lambda x: not list_contains(v, x))) as fn, len(list_filter(v, lambda x: not list_contains(w, x))) as fp,
  len(list_intersect(w, v)) = len(v) as subset from a join b using (item_id)""")
def title_set_ops(spark, sf_dir):
    w = read(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(F.split(F.lower("text"), "[^a-z]+")).alias("w"))
    both = w.join(w.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("v")), "item_id")
    size = lambda x: F.size(x).cast("long")
    return both.select("item_id", size(F.array_intersect("w", "v")).alias("tp"), size(F.array_except("w", "v")).alias("fn"), size(F.array_except("v", "w")).alias("fp"), (F.size(F.array_except("v", "w")) == 0).alias("subset"))


@query("""
with e as (select distinct l_suppkey as g, l_partkey as i from lineitem where l_quantity > 25), a as (select distinct l_suppkey as g, l_partkey as i from lineitem where l_discount > 0.05)
select coalesce(e.g, a.g) as supplier, count(*) filter (e.i is not null and a.i is not null) as tp, count(*) filter (e.i is null) as fp, count(*) filter (a.i is null) as fn
from e full join a on e.g = a.g and e.i = a.i group by 1""")
def set_agreement(spark, sf_dir):
    """Parts that each supplier sold in large lines against those sold at a discount."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supplier"), "l_partkey", "l_quantity", "l_discount")
    return evaluate.set_metrics(rows.where("l_quantity > 25"), rows.where("l_discount > 0.05"), ["supplier"], "l_partkey")


def _one_title(m: DataFrame, prefix: str, label, strength) -> DataFrame:
    return m.groupBy(F.col("thread_id").alias("comment_id"), "title").agg(label.alias(f"{prefix}_sentiment"), strength.alias(f"{prefix}_strength"))


@query(f"""with {oracle.EVENTS},
g as (select thread_id, book_id, max(label) as label, max(recommendation_strength) as s from em where label <> 'neutral' group by all),
p as (
  select 'saved' as predictor, thread_id, book_id, min(label) as label, min(recommendation_strength) as s from em where label <> 'recommended' group by all
  union all select 'baseline', thread_id, book_id, min(label), min(recommendation_strength) from em where status = 'resolved' group by all
),
n as (select predictor, count(*) as all_p from p group by predictor),
j as (select p.predictor, count(*) as tp, count(*) filter (g.label = p.label) as ok, count(*) filter (abs(g.s - p.s) <= 0.1 + 1e-9) as strong from g join p on g.thread_id = p.thread_id and g.book_id = p.book_id group by all)
select predictor, tp, all_p - tp as fp, (select count(*) from g) - tp as fn, ok as sentiment_correct, strong as strength_correct from j join n using (predictor)""")
def compared_predictions(spark, sf_dir):
    """Two predictors on one gold."""
    m = views.event_mentions(spark, sf_dir).withColumn("title", F.concat(F.lit("b"), "book_id"))
    gold = _one_title(m.where("label <> 'neutral'"), "g", F.max("label"), F.max("recommendation_strength"))
    gold = gold.select("comment_id", F.xxhash64("title").alias("gold_no"), F.array("title").alias("titles"), F.array("g_sentiment").alias("g_tags"), "g_sentiment", "g_strength")

    def predicted(rows: DataFrame) -> DataFrame:
        rows = _one_title(rows, "p", F.min("label"), F.min("recommendation_strength"))
        return rows.select("comment_id", F.xxhash64("title").alias("pred_no"), "title", F.array("p_sentiment").alias("p_tags"), "p_sentiment", "p_strength")

    out = evaluate.compared(gold, {"saved": predicted(m.where("label <> 'recommended'")), "baseline": predicted(m.where("status = 'resolved'"))})
    return out.select("predictor", "tp", "fp", "fn", "sentiment_correct", "strength_correct")


@query("""
with d as (select conv_id, sha256(string_agg(turn || ':' || sha256(coalesce(text, '')), ',' order by turn)) as digest, count(*) as n, list_sort(list_distinct(list(role))) as roles from conversations group by conv_id)
select conv_id as thread_id, digest, n, array_to_string(roles, ',') as versions from d""")
def thread_snapshot(spark, sf_dir):
    """Digest of each thread's content, which any change of a text changes."""
    c = views.conversation_comments(spark, sf_dir).withColumn("one", F.concat("id", F.lit(":"), F.sha2("text", 256)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("id", "one"))), lambda x: x["one"])
    return c.groupBy("thread_id").agg(F.sha2(F.array_join(parts, ","), 256).alias("digest"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("author")), ",").alias("versions"))
