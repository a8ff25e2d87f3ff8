import random
import re
from collections import Counter

import pytest

from quillmark.llm import collocations as c
from quillmark.llm.common import Workspace

from ..oracle import connect, same

SCHEMA = "doc_id long, lang string, text string, n long, w1 string"


def brute(docs, most=4, least=30, top=2000, inside=80):
    """(lang, rank, phrase, a, l, r, n, score) by plain Python."""
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + m])) for m in range(1, most + 1) for i in range(len(words) - m + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    around = Counter()
    for (lang, ws), a in found.items():
        for m in range(2, len(ws)):
            for i in range(len(ws) - m + 1):
                around[lang, ws[i : i + m]] = max(around[lang, ws[i : i + m]], a)
    out = []
    for (lang, ws), a in found.items():
        if 100 * around[lang, ws] >= inside * a:
            continue
        score, _, l, r = min((2000000 * a // (f[lang, ws[:k]] + f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws)))
        out.append((lang, -score, -a, " ".join(ws).encode(), l, r))
    ranked, place = [], Counter()
    for lang, score, a, phrase, l, r in sorted(out):
        place[lang] += 1
        if place[lang] <= top:
            ranked.append((lang, place[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(ranked)


def got(df):
    return sorted((x.lang, x.rank, x.phrase, x.a, x.l, x.r, x.n, x.score) for x in df.collect())


def made(n, seed=2):
    rng = random.Random(seed)
    parts = ["a", "B", "b", "the", "The cat sat", "x y", "é", "É", "日本", "\x00", "\x0b", "\t", ".", ",", "\n", "\xa0", "w1"]
    return [(rng.choice(["en", "de", None]), " ".join(rng.choice(parts) for _ in range(rng.randint(0, 80)))) for _ in range(n)]


@pytest.mark.parametrize("options", [{}, {"least": 3}, {"most": 3, "least": 2, "top": 7}, {"least": 1, "inside": 50}])
@pytest.mark.parametrize("sizes", [{}, {"step": 50, "span": 1000}])
def test_against_brute_force(spark, options, sizes):
    """Small sizes take a text apart in many steps and the windows in many buckets."""
    docs = [(None, None), ("en", ""), ("en", "w " * 3000), ("fr", "long" * 5000 + " b"), *made(300)]
    df = spark.createDataFrame([(i, lang, t, 1, "") for i, (lang, t) in enumerate(docs)], SCHEMA).repartition(6)
    assert got(c.collocations(df, Workspace(spark, "t"), **options, **sizes)) == brute(docs, **options)


def test_frequent_windows_keep_their_prefix(spark):
    """Rare windows with a prefix that is frequent only together with a frequent longer one still count for it."""
    docs = [("en", "a b c d")] * 30 + [("en", f"a b c e{i}") for i in range(5)] + [("en", f"a b f{i}") for i in range(7)] + [("en", f"a g{i}") for i in range(3)]
    df = spark.createDataFrame([(i, lang, t, 1, "") for i, (lang, t) in enumerate(docs)], SCHEMA).repartition(5)
    counts = {(x.size, x.phrase): x.f for x in c.phrase_counts(df, Workspace(spark, "t")).collect()}
    assert counts[4, "a b c d"] == 30 and counts[3, "a b c"] == 35 and counts[2, "a b"] == 42 and counts[1, "a"] == 45
    assert counts[0, ""] == 120 + 20 + 21 + 6


def test_large_counts_are_exact(spark):
    score = spark.range(1).selectExpr("cast(9000000000000000 as bigint) a", "cast(9000000000000001 as bigint) l", "cast(9000000000000000 as bigint) r").selectExpr("cast((cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + r) as bigint) s")
    assert score.first().s == 2000000 * 9000000000000000 // 18000000000000001


def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, None, "Big cat. big cat", 1, "")] * 20, SCHEMA)
    assert got(c.collocations(df.limit(0), Workspace(spark, "t"))) == []
    assert got(c.collocations(df, Workspace(spark, "t"))) == [("und", 1, "big cat", 40, 40, 40, 80, 1000000)]


def test_query_against_sql(spark, sf_dir):
    same(connect(sf_dir), c.op12_collocations(spark, sf_dir), c.SQL)
