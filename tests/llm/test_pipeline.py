import re
from collections import Counter, defaultdict
from hashlib import md5

import corpus_pipeline
from quillmark.llm.common import Workspace
from quillmark.llm.quality import judge

from .test_near_dedup import brute as near_brute
from .test_packing import check

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lines_brute(docs):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for d, (text, _) in docs.items():
        for x in (text or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(d)
    gone = {k: max(h) for k, h in holders.items() if len(h) >= 3}
    return {d: ("\n".join(x for x in (t or "").split("\n") if gone.get(key(x), d) == d), s) for d, (t, s) in docs.items()}


def mix_brute(docs):
    sources = sorted({s for _, s in docs.values()}, key=lambda s: (s is None, (s or "").encode()))
    words = {d: WORD.findall(t or "") for d, (t, _) in docs.items()}
    size = Counter()
    for d, (_, s) in docs.items():
        size[s] += len(words[d])
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    capped = set()
    while True:
        level = (sum(size.values()) - sum(3 * size[s] for s in capped)) / max(1, sum(weight[s] for s in sources if s not in capped))
        over = {s for s in sources if s not in capped and level * weight[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    out = []
    for s in sources:
        budget = round(3 * size[s] if s in capped else level * weight[s])
        passes, rest = divmod(budget, size[s]) if size[s] else (0, 0)
        for d in sorted((d for d, v in docs.items() if v[1] == s), key=lambda d: md5(f"mix:{d}".encode()).hexdigest()):
            out += [docs[d][0]] * passes if words[d] else []
            take = min(len(words[d]), rest)
            rest -= take
            if take:
                out.append(docs[d][0] if take == len(words[d]) else " ".join(words[d][:take]))
    return out


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = docs
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        at = Workspace(spark, "t").save(stage(spark, at, sf_dir), "out")
        outs.append(at)
    good = {r.doc_id for r in judge(docs, Workspace(spark, "t"))[0].where("q_kept").collect()}
    want = {r.doc_id: (r.text, r.source) for r in docs.collect() if r.doc_id in good}
    assert {r.doc_id: (r.text, r.source) for r in outs[0].collect()} == want
    want = lines_brute(want)
    assert {r.doc_id: (r.text, r.source) for r in outs[1].collect()} == want
    assert all(r.n_chars == len(r.text) for r in outs[1].collect())
    groups = near_brute([(d, t) for d, (t, _) in want.items()], size=5)
    want = {d: v for d, v in want.items() if groups[d][1] == d}
    assert {r.doc_id: (r.text, r.source) for r in outs[2].collect()} == want
    mixed = outs[3].collect()
    assert Counter(r.text for r in mixed) == Counter(mix_brute(want))
    assert all(o.columns == docs.columns for o in outs[:4])
    # each row of the mix, packed: ids of equal doc_ids can't be told apart by piece, so number the rows
    rows = [(i, r.text) for i, r in enumerate(mixed)]
    packed = corpus_pipeline.pack_sequences(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir)
    assert check(packed.collect(), dict(rows)) < 2048
    assert sum(r.length for r in outs[4].collect()) == sum(r.length for r in packed.collect())
    assert sorted(corpus_pipeline.run(spark, sf_dir).select("doc_id", "start", "ids_crc32").collect()) == sorted(outs[4].select("doc_id", "start", "ids_crc32").collect())


def test_stages_with_repeated_rows_nulls_and_any_column_names(spark, sf_dir):
    names = ["middle", "q_lines", "q_take", "row", "doc", "key", "size", "q_key", "half", "salt", "first"]
    words = lambda c, n=60: " ".join(f"{c}{i}" for i in range(n))
    rows = [(3, words("x"), "a"), (3, words("x"), "a"), (5, words("x"), "a"), (5, words("y"), "b"), (6, None, None), (None, words("z"), "b"), (None, words("z"), "b"), (7, "", "c")]
    df = spark.createDataFrame([(d, t, "en", s, len(t or ""), *[9] * len(names)) for d, t, s in rows], ", ".join(["doc_id long, text string, lang string, source string, n_chars int", *[f"`{n}` int" for n in names]]))
    for _, stage in corpus_pipeline.STAGES[:4]:
        for docs in (df, df.limit(0)):
            out = stage(spark, docs, sf_dir)
            assert out.columns == df.columns
            assert all(r[n] == 9 for r in out.collect() for n in names)
    once = corpus_pipeline.one_of_each_group(spark, df, sf_dir).collect()
    assert sorted(((r.doc_id, r.text) for r in once), key=repr) == sorted([(3, words("x")), (5, words("y")), (6, None), (7, ""), (None, words("z")), (None, words("z"))], key=repr)
    assert corpus_pipeline.pack_sequences(spark, df, sf_dir).where("start = 0").count() == len(rows)
