import json
import math

import pytest
from pyspark.sql import functions as F

from quillmark.operators import discovery, evaluate, incremental, mentions, ranking, resolve, search, tree
from quillmark.sources.config import TOPICS

MENTION = "id long, book_id long, author string, thread_id long, comment_id long, created_at long, recommendation_strength double, sentiment double"
DAY = 86400


def opinions(spark, *rows):
    """rows: (book, author, thread, day, strength, sentiment)"""
    return spark.createDataFrame([(i, b, a, t, i, d * DAY, float(s), float(v)) for i, (b, a, t, d, s, v) in enumerate(rows, 1)], MENTION)


def scores(spark, *rows, as_of=100 * DAY):
    return {r.book_id: r for r in ranking.scores(opinions(spark, *rows), as_of).collect()}


UP, DOWN, MEH = (0.95, 0.9), (0.0, -0.8), (0.2, 0.0)


def test_one_vote_for_each_reader(spark):
    s = scores(spark, (1, "a", 1, 1, *UP), *[(2, "a", t, 1, *UP) for t in range(5)])
    assert s[1].independent_recommenders == s[2].independent_recommenders == 1
    assert s[2].mention_count == 5 and s[2].all_time_score == pytest.approx(s[1].all_time_score, abs=0.2)
    assert s[1].all_time_score == round(0.95 / 3, 4)


def test_latest_wins_and_ties_that_conflict_abstain(spark):
    s = scores(spark, (1, "a", 1, 1, *UP), (1, "a", 1, 2, *DOWN), (2, "a", 1, 1, *UP), (2, "a", 2, 1, *DOWN), (3, "a", 1, 1, *DOWN), (3, "a", 1, 3, *UP), (3, "a", 1, 9, *MEH))
    assert s[1].all_time_score == 0 and s[1].negative_users == 1
    assert s[2].conflicting_readers == 1 and s[2].all_time_score == 0 and s[2].negative_users == 0
    assert s[3].positive_users == 1 and s[3].all_time_score > 0


def test_endorsement_and_critic(spark):
    assert scores(spark, (1, "a", 1, 1, *UP), (1, "b", 1, 1, *DOWN))[1].all_time_score == 0.15


def test_nameless_readers_share_a_quarter_vote(spark):
    s = scores(spark, *[(1, None, t, 1, *UP) for t in range(9)], (1, "", 20, 1, *UP), (2, "anonymous", 1, 1, *UP), (2, None, 1, 1, *UP))
    assert s[1].independent_recommenders == 0 and s[1].anonymous_opinions == 1
    assert s[1].all_time_score == round(0.25 * 0.95 * 0.25 / 2.25, 4)
    assert s[2].independent_recommenders == 1 and s[2].anonymous_opinions == 1


def test_decay_halves_in_a_year_and_breadth_is_capped(spark):
    s = scores(spark, (1, "a", 1, 0, *UP), as_of=365 * DAY)
    assert s[1].recent_score == pytest.approx(s[1].all_time_score / 2, abs=1e-4)
    wide = scores(spark, *[(1, f"u{i}", i, i, *UP) for i in range(60)])[1]
    assert wide.diversity_multiplier == pytest.approx(1.25) and wide.support_multiplier == pytest.approx(60 / 62, abs=1e-6)
    two = scores(spark, (1, "a", 1, 1, *UP), (1, "b", 2, 2, *UP))[1]
    assert two.diversity_multiplier == pytest.approx(1 + 0.15 * math.log(2), abs=1e-6)


def test_books_without_mentions_and_stale_formula(spark):
    books = spark.createDataFrame([(1, "x"), (2, "y")], "id long, canonical_title string")
    got = {r.id: r for r in ranking.score_books(books, opinions(spark, (1, "a", 1, 1, *UP)), 100 * DAY).collect()}
    assert got[2].all_time_score == 0 and got[2].mention_count == 0 and got[1].mention_count == 1
    d = spark.createDataFrame([(1, '{"formula_version": 2}'), (2, '{"formula_version": 1}'), (3, None), (4, "{}")], "id long, score_details string")
    assert {r.id for r in ranking.stale(d).collect()} == {2, 3, 4}


def test_shelf_orders_and_pages(spark):
    rows = [(1, "b", 3, 9, 1, 0.5, 0.1), (2, "A", 3, 1, 2, 0.5, 0.3), (3, "a", 1, 1, 2, 0.5, 0.3), (4, "z", 9, 0, 0, 0.1, 0.9), (5, "none", 0, 0, 0, 0.0, 0.0)]
    b = spark.createDataFrame(rows, "id long, canonical_title string, mention_count long, recommendation_count long, independent_recommenders long, all_time_score double, recent_score double")
    ids = lambda *a: [r.id for r in ranking.shelf(b, *a).collect()]
    assert ids("all-time") == [2, 3, 1, 4] and ids("recent") == [4, 2, 3, 1] and ids("mentions") == [4, 2, 1, 3][:1] + ids("mentions")[1:] and ids("recommendations") == [2, 3, 1, 4]
    assert ids("all-time", 2, 2) == [1, 4] and ids("all-time", 3, 2) == []
    with pytest.raises(ValueError):
        ranking.shelf(b, "recent", 0)


@pytest.mark.parametrize(
    ("include", "exclude", "want"),
    [([], [], {1, 2, 3, 4}), (["x"], [], {1, 2}), (["x", "y"], [], {1, 2, 3}), ([], ["x"], {3, 4}), (["y"], ["x"], {3}), (["nope"], [], set()), ([], ["nope"], {1, 2, 3, 4}), (["x' OR 1=1"], [], set()), (["x"], ["x"], set())],
)
def test_topic_filters(spark, include, exclude, want):
    books = spark.createDataFrame([(i,) for i in range(1, 5)], "id long")
    m = spark.createDataFrame([(10, 1), (11, 1), (20, 2), (30, 3), (40, 4)], "id long, book_id long")
    mt = spark.createDataFrame([(10, 1, 0.8), (11, 1, 0.8), (11, 2, 0.8), (20, 1, 0.8), (30, 2, 0.8)], "mention_id long, tag_id long, confidence double")
    tags = spark.createDataFrame([(1, "x"), (2, "y")], "id long, name string")
    assert {r.id for r in search.by_topics(books, m, mt, tags, include, exclude).collect()} == want


def test_search(spark):
    assert search.search_words("The books about Gödel_s DATA") == ["gödel_s", "data"] and len(search.search_words("w " * 50)) == 20
    b = spark.createDataFrame([(1, "Café Society", ["Ann Lee"], None), (2, "Data_Models", [], "with café"), (3, "Other", ["X"], "")], "id long, t string, a array<string>, d string")
    terms = search.term_index(b.withColumnRenamed("id", "book_id"), "book_id", "t", "a", "d")
    ids = lambda q: {r.id for r in search.search(b, terms, q).collect()}
    assert ids("cafe") == {1, 2} and ids("caf le") == {1} and ids("mod") == {2} and ids("") == {1, 2, 3} and ids("the a") == set() and ids('" OR *') == set()


SCORED = "span_id long, author string, key string, score double, agrees boolean, complete boolean, exact boolean, identities array<string>, graphic boolean, n_isbns int, year int, preferred boolean, excluded boolean"


def test_cascade(spark):
    def c(span, key, score=1.0, author="x", agrees=True, complete=True, exact=True, who=("x",), graphic=False, isbns=0, year=None, preferred=False, excluded=False):
        return (span, author, f"/works/OL{key}W", score, agrees, complete, exact, list(who), graphic, isbns, year, preferred, excluded)

    rows = [
        c(1, 1), c(2, 1, 0.93), c(3, 1, agrees=False), c(4, 1, author=None), c(4, 2, author=None), c(5, 1), c(5, 2, exact=False), c(6, 1, 0.95, exact=False), c(6, 2, 1.0, exact=False),
        c(7, 5, year=1999), c(7, 6, isbns=4), c(7, 7, isbns=4, year=1980), c(8, 1), c(8, 2, who=("x", "y")), c(9, 1), c(9, 2, graphic=True), c(10, 1, complete=False), c(10, 2),
        c(11, 1), c(11, 2, preferred=True, exact=False), c(12, 1, excluded=True), c(12, 2), c(13, 1, who=()), c(13, 2, who=()),
    ]
    want = {1: 1, 2: None, 3: None, 4: None, 5: 1, 6: 2, 7: 7, 8: None, 9: None, 10: 2, 11: 2, 12: 2, 13: None}
    for order in (rows, rows[::-1]):
        got = {r.span_id: r for r in resolve.cascade(spark.createDataFrame(order, SCORED)).collect()}
        assert {k: r.key for k, r in got.items()} == {k: v and f"/works/OL{v}W" for k, v in want.items()}
        assert got[2].confidence == 0.93


def test_work_keys_and_candidates(spark):
    df = spark.createDataFrame([("OL1W",), ("/works/OL2W",), ("/books/OL3M",), ("xOL1W",), (None,)], "k string")
    assert [r.w for r in df.select(resolve.work_key(df.k).alias("w")).collect()] == ["/works/OL1W", "/works/OL2W", None, None, None]
    c = "span_id long, title string, author string, work_id string, key string, candidate_title string, names array<string>, subjects array<string>, isbns array<string>, year int"
    rows = [
        (1, "Dune", "Frank Herbert", None, "OL2W", "Dune", ["Frank Herbert"], None, None, 1965), (1, "Dune", "Frank Herbert", None, "OL3W", "Dune", ["Another Author"], None, None, None),
        (2, "Dune", None, None, "OL2W", "Dune", ["Frank Herbert"], None, None, None), (2, "Dune", None, None, "OL3W", "Dune", ["Another Author"], None, None, None),
        (3, "Dune", "Frank Herbert", None, "OL4W", "Children of Dune", ["Frank Herbert"], None, None, None),
        (4, "Anything", None, "/works/OL9W", "OL9W", "Something else", [], None, None, None),
        (5, "Dune", "Herbert", None, "OL5W", "Dune", ["Frank Herbert"], ["Comics & graphic novels"], ["1"], None), (5, "Dune", "Herbert", None, "OL6W", "Dune", ["Frank Herbert"], [], ["2"], None),
    ]
    got = {r.span_id: r.key for r in resolve.cascade(resolve.scored_candidates(spark.createDataFrame(rows, c))).collect()}
    assert got == {1: "/works/OL2W", 2: None, 3: None, 4: "/works/OL9W", 5: None}


def test_validated_and_collapsed(spark):
    schema = "k int, raw string, title string, author string, author_source string, work_id string, confidence double, sentiment string, tags array<string>, text string, links array<string>"
    tag = next(iter(TOPICS))
    rows = [
        (1, '"Emma"', "Emma", " ", "stated", "https://openlibrary.org/works/OL7W/x", 0.9, "positive", [tag, tag, "odd"], "I like Emma", ["https://openlibrary.org/works/OL7W?a"]),
        (2, "Emma", "Emma", "Jane", "unknown", "OL8W", 0.9, "positive", [], "I like Emma", ["https://openlibrary.org/works/OL7W"]),
        (3, "Ulysses", "Ulysses", None, "unknown", None, 0.9, "positive", [], "I like Emma", []),
        (4, "Emma", "…", None, "unknown", None, 0.9, "positive", [], "I like Emma", []),
    ]
    sound, bad = mentions.validated(spark.createDataFrame(rows, schema))
    got = {r.k: r for r in sound.collect()}
    assert (got[1].raw, got[1].work_id, got[1].tags, got[1].author, got[1].author_source) == ("Emma", "/works/OL7W", [tag], None, "unknown")
    assert got[1].changes["raw"] == '"Emma"' and "author_source" in got[1].changes
    assert (got[2].work_id, got[2].author_source) == (None, "inferred")
    assert {r.k: r.reason for r in bad.collect()} == {3: "evidence", 4: "title"}

    d = "c int, normal string, raw string, author string, author_source string, work_id string, confidence double, sentiment string, tags array<string>"
    rows = [(1, "emma", "Emma", "Jane", "context", None, 0.95, "positive", ["b"]), (1, "emma", "Emma!", None, "unknown", "/works/OL1W", 0.8, "negative", ["a"]), (2, "x", "X", "A", "stated", None, 0.9, "positive", []), (2, "x", "X2", "B", "stated", None, 0.8, "positive", []), (3, "y", "Y", None, "unknown", None, 0.5, "neutral", ["z"])]
    got = {r.c: r for r in mentions.collapsed(spark.createDataFrame(rows, d), ["c"]).collect()}
    assert (got[1].raw, got[1].author, got[1].work_id, got[1].sentiment, got[1].tags, got[1].confidence) == ("Emma", "Jane", "/works/OL1W", "neutral", ["a", "b"], 0.95)
    assert (got[2].author, got[2].confidence, got[2].conflicting, got[2].author_source) == (None, 0.69, True, "unknown")
    assert (got[3].n_duplicates, got[3].sentiment) == (1, "neutral")


def test_upsert_replace_changed_pending(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id long, v string, created long")
    new = spark.createDataFrame([(2, None, 99), (3, "c", 30)], "id long, v string, created long")
    assert sorted(map(tuple, incremental.upsert(old, new, "id", keep=["created"]).collect())) == [(1, "a", 10), (2, None, 20), (3, "c", 30)]
    twice = old.union(spark.createDataFrame([(1, "z", 11)], old.schema))
    assert sorted(map(tuple, incremental.newest(twice, "id", ["created"]).collect())) == [(1, "z", 11), (2, "b", 20)]
    assert sorted(map(tuple, incremental.replace_by(old, new, new, "id").collect()), key=str) == [(1, "a", 10), (2, None, 99), (3, "c", 30)]
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id long, t string").withColumn("digest", incremental.digest("t"))
    done = rows.where("id <> 2").select("id", "digest").union(spark.createDataFrame([(2, "old")], "id long, digest string"))
    ids = lambda *a, **k: {r.id for r in incremental.changed(rows, done, "id", *a, **k).collect()}
    assert ids() == {2} and ids(force=True) == {1, 2, 3} and ids(spark.createDataFrame([(3,)], "id long")) == {2, 3}
    assert rows.select("digest").distinct().count() == 3
    threads = spark.createDataFrame([(i, i) for i in range(6)], "thread_id long, t long")
    points = spark.createDataFrame([(0, True, "v2"), (1, True, "v1"), (2, False, "v2")], "thread_id long, raw_complete boolean, processed_version string")
    assert [r.thread_id for r in incremental.pending(threads, points, "v2", limit=3, order=[F.desc("t")]).collect()] == [5, 4, 3]
    assert {r.thread_id for r in incremental.pending(threads, points, "v2").collect()} == {1, 2, 3, 4, 5}


def test_trees(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    items = spark.createDataFrame([(1, [2, 3]), (2, [4]), (3, []), (4, [1, 9]), (7, [8])], "id long, kids array<long>")
    got = {r.id: r.depth for r in tree.reachable(items, spark.createDataFrame([(1,)], "id long")).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2}
    assert {(r.parent, r.id) for r in tree.missing(items).collect()} == {(4, 9), (7, 8)}
    c = spark.createDataFrame([(1, 1, None, "root"), (1, 2, 1, "mid"), (1, 3, 2, "leaf"), (1, 4, 3, "deep" * 3000), (1, 5, 5, "self"), (2, 6, 1, "other thread"), (1, 7, 8, "a"), (1, 8, 7, "b")], "thread_id long, id long, parent_id long, text string")
    a = {r.id: [x.id for x in r.ancestors] for r in tree.ancestors(c).collect()}
    assert a == {1: [], 2: [1], 3: [1, 2], 4: [2, 3], 5: [], 6: [], 7: [8], 8: [7]}
    t = spark.createDataFrame([(1, "T"), (2, "U")], "id long, title string")
    one, two = tree.model_input(c, t), tree.model_input(c.withColumn("text", F.when(F.col("id") == 1, "edited").otherwise(F.col("text"))), t)
    changed = {r.id for r in one.join(two.select("id", F.col("digest").alias("d2")), "id").where("digest <> d2").collect()}
    assert changed == {1, 2, 3}  # an ancestor's edit reaches two levels down


def test_evaluation(spark):
    gold = spark.createDataFrame([(1, 0, ["a", "aa"], ["x"], "positive", 0.65), (1, 1, ["b"], ["y"], "neutral", 0.2), (2, 0, ["c"], [], "neutral", 0.2)], "comment_id long, gold_no int, titles array<string>, g_tags array<string>, g_sentiment string, g_strength double")
    pred = spark.createDataFrame([(1, 0, "aa", ["x", "z"], "positive", 0.75), (1, 1, "aa", [], "neutral", 0.2), (1, 2, "q", ["k"], "neutral", 0.2), (2, 0, "c", [], "negative", 0.5)], "comment_id long, pred_no int, title string, p_tags array<string>, p_sentiment string, p_strength double")
    pairs = evaluate.matched(gold, pred)
    m = evaluate.mention_metrics(pairs).first()
    assert (m.tp, m.fp, m.fn) == (2, 2, 1) and (m.tags_tp, m.tags_fp, m.tags_fn) == (1, 2, 1)
    assert (m.sentiment_correct, m.strength_correct) == (1, 1) and m.mention_precision == 0.5 and m.mention_recall == pytest.approx(2 / 3)
    none = evaluate.mention_metrics(pairs.limit(0)).first()
    assert none.mention_precision is None and none.tp == 0


def test_discovery(spark):
    items = spark.createDataFrame([(1, 100, 200, None, None), (2, 200, 200, None, None), (3, 150, 50, None, None), (4, 150, 200, True, None), (5, 150, 200, None, True), (6, 120, 101, False, False)], "id long, time long, descendants int, deleted boolean, dead boolean")
    assert [r.id for r in discovery.listed_threads(items, [6, 1, 2, 3, 4, 5, 1], 100, 200).collect()] == [1, 6]
    for bad in ([0], [True], ["1"]):
        with pytest.raises(ValueError):
            discovery.listed_threads(items, bad, 0, 1)
    hits = spark.createDataFrame([(1, 10, 200, "What are you reading?"), (1, 10, 200, "What are you reading?"), (2, 10, 200, "Threading in C"), (3, 20, 200, "Books"), (4, 10, 5, "novels")], "thread_id long, created_at long, num_comments int, title string")
    assert [r.thread_id for r in discovery.dated_hits(hits, 10, 20, 101).collect()] == [1]
    stamps = sorted([5] * 3 + list(range(0, 100, 2)))
    total = lambda a, b: sum(a <= t < b for t in stamps)
    windows = list(discovery.split_windows(0, 100, total, 4))
    assert windows[0][0] == 0 and windows[-1][1] == 100 and all(x[1] == y[0] for x, y in zip(windows, windows[1:])) and all(total(*w) <= 4 for w in windows)
    with pytest.raises(ValueError):
        list(discovery.split_windows(5, 6, total, 2))
    assert spark.sql(f"select {discovery.period('2024-02-29', 1)} as d").first().d.isoformat() == "2023-02-28"


def test_depths_of_long_threads_and_other_first_turns(spark, tmp_path):
    from quillmark.operators import tree

    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rows = [("long", i, i - 1) for i in range(106)] + [("late", i, i - 1) for i in range(5, 8)]
    got = tree.depths(spark.createDataFrame(rows, "thread_id string, id long, parent_id long"))
    assert {tuple(r) for r in got.collect()} == {("long", 106, 105), ("late", 3, 2)}


def test_model_input_shows_context_and_links(spark):
    from quillmark.operators import tree

    c = spark.createDataFrame([(1, 1, None, "<p>root &amp; more " + "x" * 7000), (1, 2, 1, '<p>see <a href="http://a.b">this</a> ' + "y" * 7000), (9, 3, 1, "no thread")], "thread_id long, id long, parent_id long, text string")
    t = spark.createDataFrame([(1, "T", "<i>about</i> " + "z" * 7000)], "id long, title string, text string")
    got = {r.id: json.loads(r.payload) for r in tree.model_input(c, t).collect()}
    assert got[2]["thread_title"] == "T" and got[2]["thread_text"].startswith("about z") and len(got[2]["thread_text"]) == 6000
    assert [(a["id"], len(a["text"])) for a in got[2]["ancestors"]] == [(1, 6000)] and got[2]["ancestors"][0]["text"].startswith("root & more")
    assert got[2]["current_comment"]["links"] == [{"url": "http://a.b", "label": "this"}] and len(got[2]["current_comment"]["text"]) > 7000
    assert got[3]["thread_title"] == "" and got[3]["ancestors"] == []
    inputs = tree.model_input(c, t)
    key = lambda *a: {r.id: r.cache_key for r in tree.model_keys(inputs, *a).collect()}
    base = key("b", "m", "p", ["x", "y"])
    assert key("b", "m", "p", ["y", "x"]) == base and len(set(base.values())) == 3
    assert all(key(*a)[1] != base[1] for a in (("c", "m", "p", ["x", "y"]), ("b", "n", "p", ["x", "y"]), ("b", "m", "q", ["x", "y"]), ("b", "m", "p", ["x"])))


def test_lookup_of_reviewed_works_and_links(spark):
    from quillmark.operators import resolve

    spans = spark.createDataFrame([(1, "1Q84", "Murakami Haruki", None), (2, "Dune", "F. Herbert", None), (3, "any label", None, "/works/OL9W"), (4, "Emma", None, None), (5, "gone", None, "/works/OL404W")], "span_id long, title string, author string, work_id string")
    found = [("1q84", "haruki murakami", 0, "/works/OL15029001W", "1Q84", ["Haruki Murakami"]), ("dune", None, 0, "/works/OL2W", "Dune", ["Frank Herbert"]), ("dune", None, 8, "/works/OL3W", "Dune 9", ["Frank Herbert"]), ("emma", "jane austen", 0, "/works/OL4W", "Emma", ["Jane Austen"])]
    f = spark.createDataFrame(found, "query string, query_author string, place int, key string, candidate_title string, names array<string>")
    f = f.selectExpr("*", "cast(null as array<string>) as subjects", "cast(null as array<string>) as isbns", "cast(null as int) as year", "cast(null as long) as cover_i")
    works = spark.createDataFrame([("/works/OL9W", "Walden", ["/authors/OL1A"])], "key string, title string, author_keys array<string>")
    authors = spark.createDataFrame([("/authors/OL1A", "H. D. Thoreau")], "key string, name string")
    got = {(r.span_id, r.key, r.candidate_title, tuple(r.names)) for r in resolve.looked_up(spans, f, works, authors).collect()}
    assert got == {(1, "/works/OL15029001W", "1Q84", ("Haruki Murakami",)), (2, "/works/OL2W", "Dune", ("Frank Herbert",)), (3, "/works/OL9W", "Walden", ("H. D. Thoreau",))}


def test_review_faults_and_keys(spark):
    from quillmark.operators import evaluate

    snap = spark.createDataFrame([(1, "I read Emma", "d1", True), (2, "nothing", "d2", True), (3, "more", "d3", False)], "comment_id long, text string, source_digest string, processed boolean")
    kind = "comment_id long, source_digest string, status string, mentions array<struct<raw:string,titles:array<string>,tags:array<string>,identity_status:string,work_id:string>>"
    good = [(1, "d1", "reviewed", [("Emma", ["emma"], ["fiction"], "verified", "/works/OL1W")]), (2, "d2", "reviewed", [])]
    broken = lambda rows, partial: {k for k, v in evaluate.review_faults(snap, spark.createDataFrame(rows, kind), ["fiction"], partial).items() if v.count()}
    assert broken(good, True) == set()
    assert broken(good, False) == {"not reviewed", "not processed"}
    bad = [(1, "old", "reviewed", [("Walden", ["w", "w"], ["?"], "pending", "/works/OL1W")]), (7, "d", "pending", [])]
    assert broken(bad, True) == {"other source", "not in the text", "topics unknown", "titles empty or repeated", "identity and work disagree", "unknown comments", "status and labels disagree"}
    k = spark.range(1).select(*[incremental.metadata_key(F.lit("b"), F.lit("p"), F.create_map(*map(F.lit, m))).alias(n) for n, m in {"a": ["x", "1", "y", "2"], "b": ["y", "2", "x", "1"], "c": ["x", "1", "y", "3"]}.items()]).first()
    assert k.a == k.b != k.c


def test_prefixes_read_the_ranges_that_hold_them(spark, tmp_path):
    from quillmark.operators import search

    words = [f"{a}{b}{n}" for a in "abcdefg" for b in "xyz" for n in range(40)]
    rows = [(i, w) for i, w in enumerate(words)] + [(10_000 + i, "the") for i in range(3000)]
    terms = spark.createDataFrame(rows, "book_id long, term string")
    index = search.TermTable(spark, str(tmp_path / "t")).write(terms, "book_id", ranges=24)
    for prefix in (["by1"], ["the"], ["éz"], ["bx", "ez3"], ["nothing"], ["a"]):
        got = index.starting(prefix)
        assert sorted(r.book_id for r in got.collect()) == sorted(i for i, w in rows if any(w.startswith(p.replace("é", "e")) for p in prefix))
    assert len(index.ranges(["by1"])) <= 2 and 8 < len(index.ranges(["the"])) < 24 and index.ranges(["zz"]) == []
    plan = index.starting(["by1"])._jdf.queryExecution().toString()
    assert "StringStartsWith(term,by1)" in plan and "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [part" in plan
    found = search.matching(index.starting(search.search_words("ÉZ1")), "book_id", search.search_words("ÉZ1"))
    assert {words[r.book_id] for r in found.collect()} == {w for w in words if w.startswith("ez1")}


def test_identities_and_errors(spark):
    gold = [
        (1, 0, ["a"], "A", "verified", "/w/1", ["/w/9"], ["x y"]), (1, 1, ["b"], "B", "verified", "/w/2", None, ["p q", "r"]), (1, 2, ["c"], "C", "ambiguous", None, None, None),
        (1, 3, ["d"], "D", "ambiguous", None, None, None), (2, 0, ["e"], "E", "pending", None, None, None), (2, 1, ["f"], "F", "verified", "/w/3", None, None),
    ]
    pred = [(1, 0, "a", "a", "/w/9", "resolved", ["x y"]), (1, 1, "b", "b", "/w/7", "resolved", ["r", "p q"]), (1, 2, "c", "c", None, "unresolved", None), (1, 3, "d", "d", "/w/5", "resolved", None), (2, 0, "e", "e", "/w/6", "resolved", None), (2, 1, "z", "z", None, "unresolved", None)]
    g = spark.createDataFrame(gold, "comment_id long, gold_no int, titles array<string>, g_title string, g_identity string, g_work string, g_accepted array<string>, g_authors array<string>")
    p = spark.createDataFrame(pred, "comment_id long, pred_no int, title string, p_title string, p_work string, p_status string, p_authors array<string>")
    pairs = evaluate.matched(g, p)
    m = evaluate.identity_metrics(pairs).first()
    assert (m.identities_pending, m.known_works, m.identity_correct, m.authors_correct, m.ambiguous_works, m.abstentions_correct, m.unresolved) == (1, 2, 1, 2, 2, 1, 2)
    assert m.identity_accuracy == 0.5 and m.abstention_accuracy == 0.5
    assert {tuple(r) for r in evaluate.errors(pairs).collect()} == {
        (1, "identity_mismatch", "B", "/w/2", "/w/7"), (1, "unresolved", "c", None, None), (1, "unexpected_resolution", "D", None, None),
        (2, "omission", "F", None, None), (2, "false_positive", "z", None, None), (2, "unresolved", "z", None, None),
    }
    assert evaluate.identity_metrics(pairs.limit(0)).first().known_works == 0


def test_a_changed_snapshot_is_found(spark):
    rows = spark.createDataFrame([(1, "text", "d", True), (2, "other", "d", True)], "comment_id long, text string, source_digest string, processed boolean")
    good = rows.withColumn("snapshot_digest", F.sha2(F.to_json(F.struct("comment_id", "text")), 256))
    labels = spark.createDataFrame([], "comment_id long, source_digest string, status string, mentions array<struct<raw:string,titles:array<string>,tags:array<string>,identity_status:string,work_id:string>>")
    assert evaluate.review_faults(good, labels, [], True)["snapshot changed"].count() == 0
    edited = good.withColumn("text", F.when(F.col("comment_id") == 2, "edited").otherwise(F.col("text")))
    assert [r.comment_id for r in evaluate.review_faults(edited, labels, [], True)["snapshot changed"].collect()] == [2]


def test_ranges_of_terms_grow_in_number_not_in_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "RANGE_ROWS", 50)
    terms = spark.createDataFrame([(i, f"t{i % 7}") for i in range(1000)], "book_id long, term string")
    index = search.TermTable(spark, str(tmp_path / "t")).write(terms, "book_id")
    stored = spark.read.parquet(f"{tmp_path}/t/terms")
    assert stored.groupBy("part").count().agg({"count": "max"}).first()[0] <= 100 and stored.select("part").distinct().count() >= 15
    assert index.starting(["t3"]).count() == sum(i % 7 == 3 for i in range(1000))
