import pytest

from quillmark.llm.common import Workspace
from quillmark.llm.line_dedup import LineRuns, dedup_batch, dedup_lines
from quillmark.llm.mixing import mix, targets

from .test_pipeline import lines_brute

SCHEMA = "doc_id long, text string, q_x string, n_lines int, source string"


def test_lines(spark):
    long_a, long_b, short = "This line is long enough, Ä", "another line of twenty or more", "short line"
    texts = [f"{long_a}\nx\n{short}", f" \t{long_a.replace('This', 'tHIS')}\x0b\n{short}", f"{short}\n{long_a}\n{long_a}", f"{long_b}\n{long_b}\n{long_b}", long_b, None, "", "\n\n", f"{long_a}\n{long_b}", "é" * 19, "é" * 19, "é" * 19, ("z" * 50 + "\n") * 3000]
    docs = {i: (t, "s") for i, t in enumerate(texts)}
    df = spark.createDataFrame([(i, t, "q", 1, "s") for i, (t, _) in docs.items()], SCHEMA)
    for batches, fanout in ((1, 2), (5, 2), (4, 4)):
        got = {r.doc.doc_id: r for r in dedup_lines(df, Workspace(spark, "t"), batches=batches, fanout=fanout, salts=3).collect()}
        assert {d: r.kept_text for d, r in got.items()} == {d: t for d, (t, _) in lines_brute(docs).items()}
        assert all(r.n_lines == len((docs[d][0] or "").split("\n")) for d, r in got.items())
        assert all(r.n_lines - r.n_dropped == len(r.kept_text.split("\n")) for r in got.values() if r.kept_text)


def test_repeated_rows_null_ids_empty(spark):
    line = "a line that many rows repeat"
    rows = [(1, line), (1, line), (None, line), (2, line)]
    df = spark.createDataFrame([(d, t, "q", 1, None) for d, t in rows], SCHEMA)
    assert all(r.n_dropped == 0 for r in dedup_lines(df, Workspace(spark, "t")).collect())  # two documents only
    more = df.union(spark.createDataFrame([(3, line, "q", 1, None)], SCHEMA))
    assert sorted((str(r.doc.doc_id), r.n_dropped) for r in dedup_lines(more, Workspace(spark, "t")).collect()) == [("1", 1), ("1", 1), ("2", 1), ("3", 0), ("None", 0)]
    assert dedup_lines(df.limit(0), Workspace(spark, "t")).count() == 0


def test_rows_of_one_doc_id_go_by_their_own_text(spark):
    line, other = "a line that many rows repeat", "a second line of some length"
    rows = [(1, f"x\n{line}"), (1, f"{line}\nx\n{other}"), (2, line), (3, line)]
    df = spark.createDataFrame([(d, t, "q", 1, None) for d, t in rows], SCHEMA)
    got = sorted((r.doc.doc_id, r.kept_text) for r in dedup_lines(df, Workspace(spark, "t")).collect())
    assert got == [(1, "x"), (1, f"x\n{other}"), (2, ""), (3, line)]


def test_levels_stay_few(spark):
    runs = LineRuns(Workspace(spark, "t"), fanout=2)
    for b in range(5):
        runs.add(spark.range(b * 10, b * 10 + 10).selectExpr("id as doc_id", "id % 3 as h1", "0L as h2"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert {(r.h1, r.n_docs, r.last_doc) for r in runs.frequent(1).collect()} == {(0, 17, 48), (1, 17, 49), (2, 16, 47)}


def test_batches_drop_what_earlier_ones_held(spark):
    ws, seen = Workspace(spark, "t"), set()
    runs = LineRuns(ws, fanout=2)
    for b in range(4):
        texts = {10 * b + i: "\n".join(f"a line of many letters {(7 * i + 3 * b + k) % 23}" if k % 3 else f"short {k}" for k in range(8)) for i in range(3)}
        df = spark.createDataFrame([(d, t, "q", 1, None) for d, t in texts.items()], SCHEMA)
        got = {r.doc.doc_id: r.kept_text for r in dedup_batch(df, runs, ws).collect()}
        assert got == {d: "\n".join(x for x in t.split("\n") if x not in seen) for d, t in texts.items()}
        seen |= {x for t in texts.values() for x in t.split("\n") if len(x) >= 20}
    assert sum(map(len, runs.levels)) <= 3


def test_targets_and_taken(spark):
    rows = [(i, "w " * (i % 7 * 50), f"s{i % 5}") for i in range(60)] + [(100 + i, "v " * 3000, "S") for i in range(30)] + [(200, None, None), (201, "a b c", None), (202, "", "empty"), (203, "tie tie", "t"), (203, "tie tie", "t")]
    df = spark.createDataFrame([(d, t, "q", 1, s) for d, t, s in rows], SCHEMA)
    got = mix(df, Workspace(spark, "t")).collect()
    assert sum(r.size for r in got) == pytest.approx(sum({(r.source_size, r.target) for r in got} and [r.taken for r in got]), abs=10)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    per = targets(df.selectExpr("source", f"cast(size(split(coalesce(text, ''), ' ')) as long) as size"), Workspace(spark, "t")).collect()
    assert all(r.target <= 3 * r.source_size for r in per)
    assert mix(df.limit(0), Workspace(spark, "t")).count() == 0
    again = mix(df.repartition(7), Workspace(spark, "t")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
