import base64
import hashlib
import math
import random

import numpy as np
import pytest

from quillmark.llm import fingerprint as f
from quillmark.llm.common import Workspace
from quillmark.llm.text import word_hashes

SCHEMA = "doc_id long, text string, part int, edge string, fingerprint string"


def kinds(data):
    """Entropy kinds of all windows of one text, byte by byte."""
    step = [round(((c + 1) * math.log2(c + 1) - (c * math.log2(c) if c else 0)) * 2**20) for c in range(f.WIDTH)]
    seen, total, out = [0] * 256, 0, []
    for i, b in enumerate(data):
        if i >= f.WIDTH:
            seen[data[i - f.WIDTH]] -= 1
            total -= step[seen[data[i - f.WIDTH]]]
        total += step[seen[b]]
        seen[b] += 1
        if i >= f.WIDTH - 1:
            out.append((sum(step) - total) * f.KINDS // sum(step))
    return out


def ranks_of(texts):
    n = [0] * (f.KINDS + 1)
    for t in texts:
        for k in kinds(t.encode()):
            n[k] += 1
    order = sorted(range(f.KINDS + 1), key=lambda k: (k < f.DULL, n[k], k))
    return {k: i for i, k in enumerate(order)}


def digest(text, ranks):
    """[(features, bits as a number)] of one text by plain Python."""
    data = text.encode()
    if not data:
        return []
    rank = [ranks[k] for k in kinds(data)]
    popular = [0] * len(rank)
    for i in range(len(rank) - f.RUN + 1):
        popular[min(range(i, i + f.RUN), key=lambda j: (rank[j], j))] += 1
    at = [i for i, p in enumerate(popular) if p >= f.POPULAR] or ([min(range(len(rank)), key=lambda j: (rank[j], j))] if rank else [])
    spans = list(dict.fromkeys(data[i : i + f.WIDTH] for i in at)) or [data]
    out = []
    for i in range(0, len(spans), f.FEATURES):
        bits = 0
        for s in spans[i : i + f.FEATURES]:
            h = int(word_hashes(np.frombuffer(s, np.uint8), np.array([0]), np.array([len(s)]), lower=False)[0])
            for k in range(f.SETS):
                bits |= 1 << (h >> 11 * k & 2047)
        out.append((len(spans[i : i + f.FEATURES]), bits))
    return out


def shown(d):
    return ".".join(base64.b64encode(bytes([n]) + bits.to_bytes(256, "little")).decode() for n, bits in d)


def alike(a, b):
    if not a or not b:
        return float(len(a) == len(b))

    def toward(a, b):
        total = 0
        for n, x in a:
            best = 0
            for m, y in b:
                most, common = min(x.bit_count(), y.bit_count()), (x & y).bit_count()
                chance = 2048 * (1 - (1 - 1 / 2048) ** (5 * n)) * (1 - (1 - 1 / 2048) ** (5 * m))
                least = chance + f.CHANCE * (most - chance)
                best = max(best, min(1, (common - least) / (most - least)) if most > least else common == most)
            total += n * best
        return total / sum(n for n, _ in a)

    if len(a) != len(b):
        return toward(*sorted((a, b), key=len))
    return (toward(a, b) + toward(b, a)) / 2


def brute(docs):
    docs = sorted(((d, t or "") for d, t in docs), key=lambda x: (x[0] is not None, x[0] or 0))
    ranks, out = ranks_of([t for _, t in docs]), {}
    for (d, t), (_, following) in zip(docs, docs[1:] + docs[:1]):
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        a, e, b = digest(t, ranks), digest(changed, ranks), digest(following, ranks)
        out[d] = (len(t), hashlib.sha256(changed.encode()).hexdigest(), shown(a), shown(e), pytest.approx(alike(a, e), abs=1e-9), pytest.approx(alike(a, b), abs=1e-9))
    return out


def got(df):
    return {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in df.collect()}


def query(spark, tmp_path, rows, parts=3):
    spark.createDataFrame(rows, SCHEMA).repartition(parts).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return f.op11_fingerprints(spark, str(tmp_path))


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    out = got(f.op11_fingerprints(spark, sf_dir))
    assert out == brute(docs)
    long = [r for r in out.values() if r[0] > 300]
    assert sum(r[4] > max(0.2, r[5]) for r in long) > 0.9 * len(long)


def test_lengths_nulls_and_wide_characters(spark, tmp_path):
    rng = random.Random(4)
    texts = [None, "", "a", "é" * 31, "x" * 63, "x" * 64, "x" * 126, "x" * 127, "日本語" * 700, "😀b", "ab" * 20_000]
    texts += ["".join(rng.choice("abcdefgh ijkl\nmnopé") for _ in range(rng.randint(0, 400))) for _ in range(60)]
    rows = [(7 * i - 50, t, 1, "x", "y") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    assert got(query(spark, tmp_path, rows)) == brute([r[:2] for r in rows])


def test_one_row_empty_table_and_null_id(spark, tmp_path):
    assert got(query(spark, tmp_path / "a", [(None, "some text " * 30, 1, "", "")])) == brute([(None, "some text " * 30)])
    assert query(spark, tmp_path / "b", []).count() == 0


def test_repeated_rows_follow_each_other(spark, tmp_path):
    rows = [(1, "one text " * 40, 1, "", "")] * 9 + [(2, "another one, longer " * 40, 1, "", "")]
    out = query(spark, tmp_path, rows).collect()
    assert len(out) == 10 and len({r.fingerprint for r in out if r.doc_id == 1}) == 1
    assert sorted(r.near_next for r in out if r.doc_id == 1)[1:] == [1.0] * 8


def test_rows_meet_across_any_ranges(spark):
    docs = spark.createDataFrame([(i, f"text {i * 7919} " * (5 + i % 30), 1, "", "") for i in range(120)], SCHEMA)
    ranks = f.rarity(docs)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        found = []
        for n in (1, 50, 300):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", n == 1)
            found.append(sorted(map(repr, f.edits(docs, ranks, Workspace(spark, "t")).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found[0] == found[1] == found[2] and len(found[0]) == 120


def test_alike_texts_and_others(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    base = " ".join(word() for _ in range(1500))
    changed = base[:4000] + "something else" + base[4100:]
    docs = spark.createDataFrame([(i, t, 1, "", "") for i, t in enumerate([base, changed, " ".join(word() for _ in range(1500)), base])], SCHEMA)
    prints = {r.doc_id: bytes(r.fingerprint) for r in f.fingerprints(docs, f.rarity(docs)).collect()}
    pairs = spark.createDataFrame([(prints[0], prints[i]) for i in (1, 2, 3)] + [(prints[0], None)], "a binary, b binary")
    near = [r.likeness for r in f.compared(pairs, "a", "b").collect()]
    assert 0.8 < near[0] < 1 and near[1] < 0.05 and near[2] == 1 and near[3] is None


def test_segments_change_nothing_and_long_texts_take_little_memory(monkeypatch):
    rng = np.random.default_rng(5)
    texts = ["", "short", "x" * 5000, "".join(map(chr, rng.integers(97, 123, 9000))), "ab" * 300, "".join(map(chr, rng.integers(97, 100, 700)))]
    ranks = np.array([ranks_of(texts)[k] for k in range(f.KINDS + 1)])
    whole = [d.packed() for d in f.digests_of(texts, ranks)]
    for segment in (64, 100, 1000):
        monkeypatch.setattr(f, "SEGMENT", segment)
        assert [d.packed() for d in f.digests_of(texts, ranks)] == whole
    monkeypatch.undo()
    import tracemalloc

    long = rng.integers(97, 123, 12_000_000).astype(np.uint8)
    tracemalloc.start()
    f.features(long, np.array([0, len(long)]), ranks)
    f.features(np.full(12_000_000, 97, np.uint8), np.array([0, len(long)]), ranks)
    assert tracemalloc.get_traced_memory()[1] < 250e6
    tracemalloc.stop()
