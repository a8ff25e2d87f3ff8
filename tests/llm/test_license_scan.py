import random
import re

from quillmark.llm.license_scan import TEMPLATES, Matcher, Windows, bigrams, full_texts, scan_licenses

SCHEMA = "doc_id long, text string, license string, score int"


def brute(text, least=0.75):
    segments = (text or "").split("\n")
    segments += [text] if len(segments) > 1 else []
    hits = []
    for s in segments:
        own = bigrams(re.findall(rb"[a-z0-9]+", s.encode().lower()))
        per = [(2 * len(own & t) / (len(own) + len(t)), n) for n, x in TEMPLATES for t in [bigrams(re.findall(rb"[a-z0-9]+", x.encode().lower()))] if own]
        per = [p for p in per if p[0] >= least]
        hits += [min(per, key=lambda p: (-p[0], p[1]))] if per else []
    best = min(hits, key=lambda p: (-p[0], p[1])) if hits else (0.0, None)
    return best[1], best[0], len(hits)


def test_scan(spark):
    mit = next(t for n, t in TEMPLATES if n == "MIT" and len(t) > 100)
    texts = [mit, mit.upper().replace(",", " ,"), "prose\nReleased under the MIT License\nmore prose", "Licensed under CC BY-NC 4.0", None, "", "licence", " ".join(mit.split()[:30]), "Überlizenz " * 5, mit + "\n" + mit, "x " * 100_000, "Licensed under the Apache License, Version 2.0."]
    df = spark.createDataFrame([(i, t, "l", 1) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: (r.license, r.score, r.n_matches) for r in scan_licenses(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert got[0][:2] == ("MIT", 1.0) and got[3][0] == "CC-BY-NC-4.0" and got[7][0] is None
    assert scan_licenses(df.union(df)).count() == 2 * len(texts)
    assert scan_licenses(df.limit(0)).count() == 0


def windows_by_hand(text, templates, least=0.75):
    """(score, name, first byte, end) of the best windows of a text, every window counted from scratch."""
    low = text.lower().encode()
    places = [m.span() for m in re.finditer(rb"[a-z0-9]+", low)]
    pairs = [(low[a:b], low[c:d]) for (a, b), (c, d) in zip(places, places[1:])]
    hits = []
    for name, t in templates:
        them = bigrams(re.findall(rb"[a-z0-9]+", t.lower().encode()))
        most = int((len(re.findall(rb"[a-z0-9]+", t.lower().encode())) - 1) * (2 - least) / least + 1e-9)
        for i in range(len(pairs)):
            if them and pairs[i] in them:
                scores = [2 * len(set(pairs[i : j + 1]) & them) / (len(set(pairs[i : j + 1])) + len(them)) for j in range(i, min(i + most, len(pairs)))]
                end = max(range(len(scores)), key=lambda k: (scores[k], -k))
                hits += [(scores[end], name, i, i + end + 2)] if scores[end] >= least else []
    out, taken = [], set()
    for score, name, i, j in sorted(hits, key=lambda h: (-h[0], h[2] - h[3], h[1], h[2])):
        if not taken & set(range(i, j)):
            taken |= set(range(i, j))
            out.append((score, name, places[i][0], places[j - 1][1]))
    return out


def test_windows_against_every_window():
    rng = random.Random(8)
    templates = [t for t in TEMPLATES if len(t[1]) < 260]
    finder = Windows(templates, 0.75)
    for _ in range(60):
        words = []
        for _ in range(rng.randint(0, 4)):
            t = rng.choice(templates)[1].split()
            words += [w for w in t if rng.random() < 0.95] + [rng.choice(["other", "words", "the", "License", "version"]) for _ in range(rng.randint(0, 12))]
        text = rng.choice([" ", "\n", " * "]).join(words)
        assert finder.found(text.lower().encode()) == windows_by_hand(text, templates)


def test_bounds_lose_no_template():
    loose, m = Matcher(TEMPLATES, 1e-6), Matcher(TEMPLATES, 0.75)
    for _, t in TEMPLATES:
        for cut in (1, 2, 3, 5):
            text = b" ".join(t.encode().split()[: len(t.split()) - cut] + [b"zz"] * cut)
            best = loose.best(text)
            assert m.best(text) == (best if best and best[0] >= 0.75 else None)


def test_wrapped_notices_and_whole_files(spark):
    prose = "".join(f"line {i} has words {i * i} about other things\n" for i in range(400))
    apache = next(t for n, t in TEMPLATES if n == "Apache-2.0" and "obtain a copy" in t).split()
    wrapped = "\n".join(" * " + " ".join(apache[i : i + 8]) for i in range(0, len(apache), 8))
    full = dict(full_texts())
    texts = [prose + wrapped + "\n" + prose, "We wrote this last year and it is released under the MIT License. Enjoy it with friends and family.", prose]
    texts += [full["GPL-3.0"], prose + full["MPL-2.0"], "Copyright 2020 A. Reader\n\n" + full["MIT"], full["Apache-2.0"]]
    short = ["BSD-2-Clause", "BSL-1.0", "ISC", "Unlicense", "Zlib"]
    texts += [f"Some software\n\n{full[n]}\nand its readme" for n in short]
    df = spark.createDataFrame([(i, t, "l", 1) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in scan_licenses(df).collect()}
    assert [got[i].license for i in range(7)] == ["Apache-2.0", "MIT", None, "GPL-3.0", "MPL-2.0", "MIT", "Apache-2.0"]
    assert [got[7 + i].license for i in range(len(short))] == short
    assert all(got[i].score > 0.95 for i in (0, 1, 3, 4, 5, 6))
    assert got[1].n_matches == 1 and got[2].n_matches == 0
