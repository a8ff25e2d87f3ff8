import zlib

import numpy as np
from tokenizers import Tokenizer

from quillmark.llm.common import Workspace
from quillmark.llm.packing import Ids, op7_pack, pack, plan_patterns, tokenizer_path

SCHEMA = "doc_id long, text string, start string, units int"


def check(pieces, texts, window=2048):
    """Every id once, crc32 right, sequences gapless; returns the padding."""
    t = Tokenizer.from_file(tokenizer_path())
    ids = {k: np.array([*t.encode(v or "", add_special_tokens=False).ids, 1], "<u4") for k, v in texts.items()}
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert by_doc.keys() == ids.keys()
    for k, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[k])
            assert p.ids_crc32 == zlib.crc32(ids[k][at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids[k])
    padding = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        padding += window - at
    return padding


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert check(op7_pack(spark, sf_dir).collect(), texts) < 2048


def test_edge_cases(spark):
    texts = {1: None, 2: "", 3: "word " * 5000, 4: "a" * 3000, 5: "x <|endoftext|> Ünï ß 日本 語 z", 6: "tie " * 127, 7: "tie " * 127, 8: "tie " * 2047, 9: " \t\n"}
    df = spark.createDataFrame([(k, v, "s", 1) for k, v in texts.items()], SCHEMA)
    assert check(pack(df, Workspace(spark, "t")).collect(), texts) < 2048
    assert pack(df.limit(0), Workspace(spark, "t")).count() == 0
    assert pack(df.union(df), Workspace(spark, "t")).count() >= 2 * len(texts)


def test_words_give_the_texts_ids():
    t, ids, rng = Tokenizer.from_file(tokenizer_path()), Ids(tokenizer_path(), most=50, most_forms=20), np.random.default_rng(3)
    parts = ["Don't", "it's", "ΑΣ", "é", "é", "́", "１２", "12", "!?", "<|startoftext|>", "日本", "😀", "ß", " ", " ", "x'll", "'s", "İ", "\x00", "\x1c", "a_b", "...", "ǅ", "ﬁ", "Été", "ÖL", ".", ",", "Thing", "K", "Å", "ſ"]
    for _ in range(500):
        text = "".join(rng.choice([" ", "", "\n", "\t"]) + rng.choice(parts) for _ in range(rng.integers(0, 12)))
        assert np.frombuffer(ids.text(text.encode()), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_other_tokenizers_get_whole_texts():
    path = tokenizer_path("byte_bpe_50k.json")
    t, ids = Tokenizer.from_file(path), Ids(path)
    assert not ids.by_word and Ids(tokenizer_path()).by_word
    for text in ("Two  words, and a\nline's end ", "", "é 日本"):
        assert np.frombuffer(ids.text(text.encode()), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_patterns_use_no_more_than_there_is():
    rng = np.random.default_rng(1)
    for _ in range(20):
        h = np.r_[0, rng.integers(0, 1000, 15)]
        plan, used = plan_patterns(h, 16, 4)
        assert (used <= h).all() and all(sum(p) == 16 for p, _ in plan)
        assert (used == sum(np.bincount(p, minlength=16) * n for p, n in plan)).all()


def test_python_gets_small_batches(spark, tmp_path):
    """A batch of 10,000 rows of long texts would be held by the executor and by the worker."""
    import pyarrow as pa

    from quillmark.llm.common import BATCH, Workspace

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    rows = spark.range(0, 3000, 1, 1).selectExpr("repeat('x', 10000) as t")
    before = spark.conf.get(BATCH)
    got = [r.n for r in Workspace(spark, "t").save(rows.mapInArrow(sizes, "n long"), "sizes").collect()]
    assert len(got) > 2 and max(got) < 10 << 20 and spark.conf.get(BATCH) == before
