import random
import re
from collections import Counter

import numpy as np
import pytest

from quillmark.llm import quality as q
from quillmark.llm.common import Workspace

SCHEMA = "doc_id long, text string, lang string, n_words int, q_kept string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


def rows(spark, texts, langs=("en", "de", None)):
    return spark.createDataFrame([(i, t, langs[i % len(langs)], 1, "x") for i, t in enumerate(texts)], SCHEMA)


def test_counts_match_brute_force(spark):
    rng = random.Random(2)
    parts = ["a", "b", "a b c", "é", "#x", " ", "\n", "\t", "\x0b", "日本 語", "\xa0", "\x1c", "\n\n", "x y x y"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    texts += [None, "", "w " * 200_000, "z" * 300_000]
    got, _, _ = q.judge(rows(spark, texts), Workspace(spark, "t"))
    for r in got.collect():
        assert tuple(r[f"q_{s}"] for s in q.STATS) == brute(texts[r.doc_id]), repr(texts[r.doc_id])[:80]
        n = brute(texts[r.doc_id])
        assert r.q_base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r.q_base_failed and r.q_kept)


def test_gibberish_goes_and_prose_stays(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    junk = spark.createDataFrame([(-1, " ".join(f"q{i % 7}xz#$&zzq{i * 7919 % 1000}" for i in range(400)), "en"), (-2, "eeee aeae " + " ".join("e" * (i % 17 + 1) for i in range(400)), "fr")], docs.schema)
    got, _, _ = q.judge(docs.union(junk), Workspace(spark, "t"))
    kept = {r.doc_id: r.q_kept for r in got.collect()}
    assert not kept[-1] and not kept[-2]
    good = [r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()]
    failed = {r.doc_id for r in got.where("q_base_failed").collect()}
    assert all(kept[d] for d in good if d not in failed)


def test_filter_keeps_columns_and_empty_table(spark):
    docs = rows(spark, ["one two three"] * 3 + ["many words " + " ".join(f"w{i}" for i in range(80))])
    assert q.keep_good(docs, Workspace(spark, "t")).columns == docs.columns
    got, _, _ = q.judge(docs.limit(0), Workspace(spark, "t"))
    assert got.count() == 0


def test_word_level_nonsense_goes(spark):
    rng = random.Random(4)
    vocabulary = [f"{w}{v}" for w in ("reader", "writes", "town", "often", "about") for v in "abcdefghijklmnopqrstuvwxyz"]
    after = {w: rng.sample(vocabulary, 8) for w in vocabulary}

    def prose():
        out = [rng.choice(vocabulary)]
        while len(out) < 300:
            out.append(rng.choice(after[out[-1]]))
        return " ".join(out)

    texts = [prose() for _ in range(200)]
    salad = texts[0].split()
    rng.shuffle(salad)
    han = lambda: "".join("我们今天去学校看书" if rng.random() < 0.5 else "他们昨天在家里做饭" for _ in range(40))
    chars = list("".join(han() for _ in range(3)))
    rng.shuffle(chars)
    made = " ".join("".join(rng.sample(["rea", "wri", "tow", "der", "tes", "ten", "out"], 4)) for _ in range(300))
    rows_ = [(i, t, "en") for i, t in enumerate(texts)] + [(1000 + i, " ".join(han() for _ in range(60)), "zh") for i in range(60)]
    rows_ += [(-1, " ".join(salad), "en"), (-2, made, "en"), (-3, " ".join("".join(rng.sample(chars, 300)) for _ in range(60)), "zh")]
    docs = spark.createDataFrame([(i, t, lang, 1, "x") for i, t, lang in rows_], SCHEMA)
    got = q.judge(docs, Workspace(spark, "t"))[0].collect()
    kept = {r.doc_id: r.q_kept for r in got}
    assert not kept[-1] and not kept[-2] and not kept[-3]
    by_word = {r.doc_id: r.q_nll for r in got}
    assert min(by_word[-1], by_word[-2]) > max(n for d, n in by_word.items() if 0 <= d < 1000) + 1
    assert by_word[-3] > max(n for d, n in by_word.items() if d >= 1000) + 1
    gone = [(r.doc_id, r.q_nll, r.q_low, r.q_high, r.q_base_failed) for r in got if r.doc_id >= 0 and not r.q_kept]
    assert len(gone) <= 5, gone[:8]
    assert {r.doc_id for r in q.keep_good(docs, Workspace(spark, "t")).collect()} == {d for d, k in kept.items() if k}


def defined(texts, halves):
    """Mean negative log probability of each text by the other half: interpolated modified Kneser-Ney of pairs, and its lowest order."""
    out = []
    for text, half in zip(texts, halves):
        grams = Counter()
        for t, h in zip(texts, halves):
            if h != half:
                w = [None, *t.split()]
                grams.update(zip(w, w[1:]))
        kinds = Counter(v for _, v in grams)
        d, low = (q.discounts(np.array([sum(c == k for c in o.values()) for k in (1, 2, 3, 4)])) for o in (grams, kinds))

        def one(v, kinds=kinds, low=low):
            return (kinds[v] - low[min(kinds[v], 3)] + sum(low[min(c, 3)] for c in kinds.values()) / q.CLASSES) / sum(kinds.values())

        def both(u, v, grams=grams, d=d, one=one):
            seen = {g: c for g, c in grams.items() if g[0] == u}
            if not seen:
                return one(v)
            c = grams[u, v]
            return (c - d[min(c, 3)] + sum(d[min(x, 3)] for x in seen.values()) * one(v)) / sum(seen.values())

        w = [None, *text.split()]
        out.append((np.mean([-np.log(both(*g)) for g in zip(w, w[1:])]), np.mean([-np.log(one(v)) for v in w[1:]])))
    return out


def test_scores_match_definition(spark, monkeypatch):
    monkeypatch.setattr(q, "RANGE", 50)
    monkeypatch.setattr(q, "CHUNK", 300)
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(20, 60))) for _ in range(14)]
    docs = rows(spark, texts, langs=("en",))
    halves = {r.doc_id: r.q_round % 2 for r in q.keyed(docs).collect()}
    want = defined(texts, [halves[i] for i in range(len(texts))])
    ws = Workspace(spark, "t")
    got = {r.doc_id: (r.q_nll, r.q_nll_one) for r in q.scores(docs, q.fit(docs, ws), ws).collect()}
    for i, w in enumerate(want):
        assert got[i] == pytest.approx(w, abs=2e-4)


def test_pair_hash_is_a_bijection_and_numbers_round_trip():
    rng = np.random.default_rng(1)
    left, right = (rng.integers(0, q.CLASSES, 5000, dtype=np.uint64) for _ in range(2))
    h = q.pair_hash(left, right)
    back = q.pair_classes(h)
    assert (back[0] == left).all() and (back[1] == right).all() and h.max() < 1 << 2 * q.CLASS_BITS
    s = np.unique(h)
    assert (q.unstepped(q.steps(s)) == s).all() and len(q.unstepped(q.steps(s[:0]))) == 0
    at = q.ranges_of(s, 7)
    assert at[0] == 0 and at[-1] == len(s) and all(int(x) * 7 >> 2 * q.CLASS_BITS == k for k in range(7) for x in s[at[k] : at[k + 1]])


def test_verdict_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = q.judge(docs, Workspace(spark, "t"))[0].collect()
    by = {}
    for r in got:
        if not r.q_base_failed and r.q_nll is not None:
            by.setdefault(r.lang, []).append((round(r.q_nll, 3), round(r.q_nll_one, 3)))
    band = {k: np.percentile(np.array(v), (25, 50, 75), axis=0) for k, v in by.items()}
    for r in got:
        want = not r.q_base_failed
        if want and r.q_nll is not None:
            b, short = band[r.lang], 9 / np.sqrt(max(1, r.q_n_tokens))
            high = b[2, 0] + max(2 * (b[2, 0] - b[1, 0]), q.LEAST_BAND) + short
            low = b[0, 1] - max(2 * (b[1, 1] - b[0, 1]), q.LEAST_BAND) - short
            want = r.q_nll <= high + 1e-9 and r.q_nll_one >= low - 1e-9
        assert r.q_kept == want, r


def test_extra_columns_may_have_any_name(spark):
    texts = [" ".join(f"w{(i * 7 + k * k) % 60}" for k in range(90)) for i in range(8)]
    names = ["q_key", "q_key_too", "q_lang", "q_round", "q_row", "middle", "q_kept", "half"]
    docs = rows(spark, texts).select("doc_id", "text", "lang", *[q.F.lit(7).alias(n) for n in names])
    kept = q.keep_good(docs, Workspace(spark, "t"))
    assert kept.columns == docs.columns and all(r[n] == 7 for r in kept.collect() for n in names)


def test_query_against_counts_and_its_own_verdicts(spark, sf_dir):
    """The registered query over the whole table: counts by plain Python, the verdict from scores and bands."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = q.op9_quality_rules(spark, sf_dir)
    assert out.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rows, model, band = q.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark, "t"))
    verdicts = {r.doc_id: r for r in rows.collect()}
    got = out.collect()
    assert len(got) == len(docs)
    for r in got:
        n = brute(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        v = verdicts[r.doc_id]
        within = v.q_nll is None or (v.q_nll <= v.q_high and v.q_nll_one >= v.q_low)
        assert r.kept == (not r.base_failed and within) and r.nll == v.q_nll
    assert any(not r.kept and not r.base_failed for r in got)
