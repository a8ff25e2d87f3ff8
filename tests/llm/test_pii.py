import hashlib
import random
import re
import time

from quillmark.llm.pii import find_pii, op4_pii

SCHEMA = "doc_id long, text string, value string, m_email string"
BASE = ("email", "ip", "card", "phone")
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        n = [int(c) for c in reversed(d)]
        return 16 <= len(d) <= 19 and (sum(n[::2]) + sum(sum(divmod(2 * x, 10)) for x in n[1::2])) % 10 == 0
    if kind == "phone":
        return 8 <= len(d) <= 15
    return True


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k in BASE for m in re.finditer(PLAIN[k], text or "") if passes(k, m[0])]


def spans(df):
    return {r.doc_id: [f"{s.kind}:{s.start}:{s.end}" for s in r.pii] for r in df.collect()}


def rows(texts):
    return [(i, t, "x", "y") for i, t in enumerate(texts)]


def test_base_spans_match_plain_patterns(spark):
    rng = random.Random(5)
    parts = ["a@b.co", "x.y+z@q-r.de.fr", "1.2.3.4", "256.1.1.1", "0010.0.0.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111111", "+49 (30) 123-456", "+1", "@", ".", " ", "-", "+", "é", "日本", "5500-0000-0000-0004", "0" * 17, "a@b.c+x@d.e", "\n", "😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    texts += [None, "", "a" * 50000, "1" * 50000, "a@b" + ".c" * 20000, "+1" + " " * 20000, "é" * 10 + " a@b.co"]
    got = spans(find_pii(spark.createDataFrame(rows(texts), SCHEMA)))
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s.split(":")[0] in BASE] == brute(t), t[:80]


def test_checksum_and_context(spark):
    texts = ["iban DE89 3704 0044 0532 0130 00.", "iban DE88 3704 0044 0532 0130 00.", "ssn 123-45-6789", "code 123-45-6789", "ssn 000-45-6789"]
    got = spans(find_pii(spark.createDataFrame(rows(texts), SCHEMA)))
    assert got[0] == ["iban:5:32"]
    assert [s for s in got[1] if s.startswith("iban")] == []
    assert got[2] == ["national_id:4:15"]
    assert got[3] == got[4] == []
    score = {r.doc_id: r.pii[0].score for r in find_pii(spark.createDataFrame(rows(["mail a@b.co", "zzz a@b.co"]), SCHEMA)).collect()}
    assert score[0] > score[1]


def test_secrets_and_context_in_other_languages(spark):
    texts = ['x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" y', "password: short1", "api_key=abcdefghijklmnopqrstuvwx", "my tokens = 5", "seguridad social 123-45-6789", "Passwort Secret:AB12CD34EF56GH78IJ"]
    got = spans(find_pii(spark.createDataFrame(rows(texts), SCHEMA)))
    assert got == {0: ["secret:2:51"], 1: [], 2: [], 3: [], 4: ["national_id:17:28"], 5: ["secret:9:34"]}


def test_repeated_rows_and_empty_table(spark):
    twice = spark.createDataFrame([(1, "a@b.co", "", ""), (1, "a@b.co", "", ""), (None, "c@d.ef", "", "")], SCHEMA)
    assert find_pii(twice).count() == 3
    assert find_pii(twice.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op4_pii(spark, sf_dir).collect():
        want = brute(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len(want)


def test_many_matches_in_one_text(spark):
    """A megabyte of each kind in a text, and of numbers that no check confirms, in seconds."""

    texts = [
        " ".join(f"{i % 250}.{i % 199}.{i % 100}.{i % 260} x" for i in range(62_000)),
        " x ".join(f"{i % 90 + 10}" for i in range(200_000)),
        " ".join(f"user{i}@host{i % 100}.com" for i in range(50_000)),
        " x ".join(f"4111 1111 1111 {i % 9000 + 1000}" for i in range(45_000)),
        "é".join(f"+49 30 {i % 900_000 + 100_000} " for i in range(60_000)),
    ]
    docs = spark.createDataFrame(rows(texts), SCHEMA).repartition(5)
    find_pii(docs.limit(0)).collect()
    began = time.time()
    got = spans(find_pii(docs))
    assert time.time() - began < 90
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s.split(":")[0] in BASE] == brute(t)


def test_context_reaches_over_earlier_matches_and_blocks(spark):
    n = 700
    text = " ".join(["ssn 123-45-6789, 123-45-6788"] + ["word"] * 9 + ["123-45-6787"]) + "\n" + "\n".join(f"ssn {i % 600 + 100:03d}-45-{i + 1000} and {i % 600 + 100:03d}-44-{i + 1000}" for i in range(n))
    got = [s for s in spans(find_pii(spark.createDataFrame(rows([text]), SCHEMA)))[0] if s.startswith("national")]
    want = [m for m in re.finditer(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", text)]
    near = [m for m in want if "ssn" in text[max(0, m.start() - 40) : m.start()] and not re.search(r"^(000|666|9)|-00-|-0000$", m[0])]
    assert got == [f"national_id:{m.start()}:{m.end()}" for m in near] and len(got) > 2 * n - 20
