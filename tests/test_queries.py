import pytest

from quillmark.functions.extract import context, extract
from quillmark.functions.text import grounded, normal, read_html, similarity
from quillmark.plans.queries import QUERIES, SQL

from .oracle import connect, same


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf_dir, con, name):
    same(con, QUERIES[name](spark, sf_dir), SQL[name])


def rows(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").collect()


def test_html_queries(spark, sf_dir):
    pages = {r.page_id: read_html(r.html) for r in rows(spark, sf_dir, "pages")}
    assert {r.page_id: r.plain for r in QUERIES["html_plain_text"](spark, sf_dir).collect()} == {k: v["plain"] for k, v in pages.items()}
    assert {(r.page_id, r.place): (r.url, r.label) for r in QUERIES["html_links"](spark, sf_dir).collect()} == {(k, i): (x["url"], x["label"]) for k, v in pages.items() for i, x in enumerate(v["links"])}
    headed = {r.page_id: read_html(r.html.replace("<h1>", "<i>").replace("</h1>", "</i>")) for r in rows(spark, sf_dir, "pages")}
    emphasis = {(r.page_id, r.place): r.part for r in QUERIES["html_emphasis"](spark, sf_dir).collect()}
    assert emphasis == {(k, i): x for k, v in headed.items() for i, x in enumerate(v["emphasis"])} and len(emphasis) >= len(pages)


def test_extract_query(spark, sf_dir):
    values = {f"p{r.page_id}": r.html for r in rows(spark, sf_dir, "pages")} | {f"c{r.conv_id}-{r.turn}": r.text for r in rows(spark, sf_dir, "conversations")}
    want = {(k, i): (s.raw, s.title, s.confidence, context(read_html(v)["plain"], s.raw)) for k, v in values.items() for i, s in enumerate(extract(v))}
    assert {(r.key, r.place): (r.raw, r.title, r.confidence, r.context) for r in QUERIES["extract_mentions"](spark, sf_dir).collect()} == want


def test_grounded_query(spark, sf_dir):
    """All passages against all documents, without the join over runs of words."""
    items = [(r.item_id, r.text) for r in rows(spark, sf_dir, "benchmark")]
    want = {(d.doc_id, i): grounded(t, d.text) for d in rows(spark, sf_dir, "documents") for i, t in items}
    got = {(r.doc_id, r.item_id): r.excerpt for r in QUERIES["grounded_excerpts"](spark, sf_dir).collect()}
    assert got == {k: v for k, v in want.items() if v is not None}


def test_similar_names(spark, sf_dir):
    names = sorted({r.p_name for r in rows(spark, sf_dir, "part")})

    def near(a, b):
        x, y = sorted(a.split()), sorted(b.split())
        cut = lambda w: {tuple(w[:i] + w[i + 1 :]) for i in range(len(w))}
        return bool(cut(x) & cut(y))

    got = {(r.left_name, r.right_name): r.similarity for r in QUERIES["title_similarity_pairs"](spark, sf_dir).collect()}
    assert got == {(a, b): similarity(a, b) for a in names for b in names if a < b and near(a, b)}


def test_similar_titles(spark, sf_dir):
    """All pairs, by the ratio alone."""
    t = sorted({f"{r.p_name} {r.p_type} {r.p_brand}" for r in rows(spark, sf_dir, "part")})
    want = {(a, b): similarity(a, b) for a in t for b in t if a != b}
    got = {(r.left_title, r.right_title): r.similarity for r in QUERIES["similar_titles"](spark, sf_dir).collect()}
    assert got == {k: v for k, v in want.items() if v >= 0.94} and got


def test_normal_titles(spark, sf_dir):
    from hashlib import sha256

    want = {r.doc_id: sha256(normal(r.text).encode()).hexdigest() for r in rows(spark, sf_dir, "documents")}
    assert {r.doc_id: r.normal_sha256 for r in QUERIES["normalize_title_unicode"](spark, sf_dir).collect()} == want


def test_topics_with_more_than_a_million_parts(spark, tmp_path):
    """The mention of part 1,000,003 in one order and of part 3 in the next have the same number."""
    import datetime

    day = datetime.datetime(1996, 5, 1)
    lines = [(o, p, 1, float(q), 10.0, 0.05, "N") for o in range(40) for p, q in ((3, 50 if o % 2 else 1), (1_000_003, 1 if o % 2 else 50), (2_000_000 + o, 50))]
    tables = {
        "lineitem": spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string"),
        "orders": spark.createDataFrame([(o, o % 5, day, ["1-URGENT", "5-LOW", "2-HIGH"][o % 3]) for o in range(40)], "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string"),
        "customer": spark.createDataFrame([(c, c, ["BUILDING", "MACHINERY"][c % 2]) for c in range(5)], "c_custkey long, c_nationkey int, c_mktsegment string"),
        "part": spark.createDataFrame([(p, "blue ring") for p in (3, 1_000_003, *range(2_000_000, 2_000_040))], "p_partkey long, p_name string"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    import duckdb

    con = duckdb.connect()
    for name in tables:
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("topic_counts", "topics_per_book", "api_topics", "topic_include_any", "topic_exclude_any", "topic_include_and_exclude"):
        same(con, QUERIES[name](spark, str(tmp_path)), SQL[name])


def test_author_names_are_dealt_over_tasks(spark, sf_dir):
    """Parts are few bytes, which one task would read and work on alone."""
    assert QUERIES["author_names"](spark, sf_dir).rdd.getNumPartitions() > 1
