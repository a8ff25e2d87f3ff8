import re
from collections import Counter

import numpy as np

from quillmark.llm import classifier as c

SCHEMA = "doc_id long, text string, score string, kept int"


def test_accuracies_of_simulated_labellers():
    rng = np.random.default_rng(2)
    n, k = 40_000, len(c.LABELLERS)
    good = rng.random(n) < 0.85
    p_bad_if_good, p_bad_if_bad = rng.uniform(0.005, 0.05, k), rng.uniform(0.3, 0.8, k)
    bad_vote = rng.random((k, n)) < np.where(good, p_bad_if_good[:, None], p_bad_if_bad[:, None])
    v = np.where(bad_vote, 1, np.where(rng.random((k, n)) < 0.3, 0, 2))
    seen, count = np.unique(c.pattern(v), return_counts=True)
    g, b, share = c.accuracies(c.unpack(seen), count.astype(float))
    assert abs(share - 0.85) < 0.03
    assert np.abs(b[:, 1] - p_bad_if_bad).max() < 0.08
    p = c.posterior(v, g, b, share)
    assert ((p >= 0.5) == good).mean() > 0.97


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in c.classify(docs).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = np.array([got[d].score for d, q in labels.items() if q == 1])
    bad = np.array([got[d].score for d, q in labels.items() if q == 0])
    assert (good[:, None] > bad[None, :]).mean() > 0.85  # area under the curve; the labels weren't seen
    assert (good >= c.THRESHOLD).mean() > 0.97


def test_edge_rows(spark):
    texts = [None, "", " ", "one", "x" * 200_000, "a b c\n" * 5000, "fine words here. " * 30, "Ω≈ç√ 日本語"]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], SCHEMA)
    out = c.classify(df.union(df)).collect()
    assert len(out) == 16 and all(0 <= r.score <= 1 and 0 <= r.weak_label <= 1 for r in out)
    assert c.classify(df.limit(0)).count() == 0


def brute_votes(text):
    """Each labeller's vote on a text, by its definition; bytes count where shares of characters are meant."""
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    n, chars = max(1, len(words)), max(1, sum(map(len, words)))
    share = lambda keep: sum(map(keep, raw)) / chars
    symbol = lambda b: b in b"#*$%&|<>"
    letter = lambda b: b >= 128 or chr(b).isalpha()
    windows = Counter(zip(words, words[1:], words[2:]))
    again = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = max(1, sum(map(letter, raw)))
    m = [
        1 / max(len(words), 0.5), share(symbol), sum(any(map(symbol, w)) for w in words) / n, 1 - share(letter), len(again) / n,
        (len(lines) - len(set(lines))) / (raw.count(b"\n") + 1), sum(b < 128 and chr(b).isupper() for b in raw) / letters, -share(lambda b: b in b".!?,;:"), share(lambda b: b < 128 and chr(b).isdigit()),
    ]
    return [1 if x > bad else 2 if x < good else 0 for x, (_, good, bad) in zip(m, c.LABELLERS)]


def test_query_against_brute_force(spark, sf_dir):
    """Votes, accuracies and the scorer's training set are all made anew; every weak label and score has to agree."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    votes = np.array([brute_votes(d.text) for d in docs]).T
    seen, n = np.unique(c.pattern(votes), return_counts=True)
    good, bad, share = c.accuracies(c.unpack(seen), n.astype(float))
    weak = 1 / (1 + np.exp(-(np.log(share / (1 - share)) + sum(np.log(good[k, v]) - np.log(bad[k, v]) for k, v in enumerate(votes)))))
    got = {r.doc_id: r for r in c.op5_quality_classifier(spark, sf_dir).collect()}
    assert np.allclose([got[d.doc_id].weak_label for d in docs], weak, atol=1e-9)
    x = np.zeros((len(docs), c.BUCKETS), np.float32)
    for i, d in enumerate(docs):  # 200 documents: all of them train the scorer
        low = b"\0\0" + (d.text or "").encode().lower()
        grams = np.array([low[j] << 16 | low[j + 1] << 8 | low[j + 2] for j in range(len(low) - 2)], np.uint64)
        np.add.at(x[i], (c.mix(grams + np.uint64(1)) & np.uint64(c.BUCKETS - 1)).astype(int), 1)
    x = np.sqrt(x)
    x /= np.maximum(np.sqrt((x**2).sum(axis=1, keepdims=True)), 1e-9)
    row, bucket = np.nonzero(x)
    w, b = c.train(row, bucket, x[row, bucket].astype(float), weak)
    score = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.allclose([got[d.doc_id].score for d in docs], score, atol=1e-3)
    assert all(r.kept == (r.score >= c.THRESHOLD) for r in got.values())


def test_sample_has_a_bound_whatever_the_ids(spark, monkeypatch):
    monkeypatch.setattr(c, "FIT_ROWS", 50)
    sizes = []
    train = c.train
    monkeypatch.setattr(c, "train", lambda row, bucket, value, label: (sizes.append(len(label)), train(row, bucket, value, label))[1])
    null, same = ([(None if k else 7, f"text {0 if k else i} " * 60, "s", 1) for i in range(3000)] for k in (1, 0))
    for rows in (null, same):
        out = c.classify(spark.createDataFrame(rows, SCHEMA))
        assert out.count() == 3000
    assert all(n <= 100 for n in sizes)
