"""Licence scans: normalised text against templates by the Dice coefficient of word bigrams.

Lines and the whole text are held against the notices; then windows of words,
wherever lines end, against notices and full licence texts (folder licences).
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillmark.llm.common import table

LEAST = 0.75
WORD = re.compile(rb"[a-z0-9]+")

# Notices and texts of public licences, (licence, template).
TEMPLATES = [
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Released under the BSD License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def full_texts() -> list[tuple[str, str]]:
    """(licence, text) of the files in the folder licences: a fixed list."""
    return sorted((p.stem, p.read_text()) for p in Path(__file__).with_name("licences").glob("*.txt"))


def bigrams(words: list[bytes]) -> frozenset[tuple[bytes, bytes]]:
    return frozenset(zip(words, words[1:]))


class Matcher:
    """Templates by size: a text of n bigrams can reach LEAST only with sizes within a factor (2 - LEAST) / LEAST of n."""

    def __init__(self, templates: list[tuple[str, str]], least: float) -> None:
        sets = sorted(((bigrams(WORD.findall(t.lower().encode())), name) for name, t in templates), key=lambda x: len(x[0]))
        self.sets, self.sizes, self.least, self.factor = sets, [len(s) for s, _ in sets], least, (2 - least) / least
        self.most = self.sizes[-1] * self.factor  # bigrams of a text that can match at all

    def best(self, text: bytes) -> tuple[float, str] | None:
        """The largest Dice coefficient of at least `least`, ties to the smaller name."""
        own = bigrams(WORD.findall(text.lower()))
        n = len(own)
        if not n or n > self.most:
            return None
        found = None
        for i in range(bisect.bisect_left(self.sizes, n / self.factor - 1e-9), bisect.bisect_right(self.sizes, n * self.factor + 1e-9)):
            them, name = self.sets[i]
            score = 2 * len(own & them) / (n + len(them))
            if score >= self.least and (found is None or (-score, name) < (-found[0], found[1])):
                found = (score, name)
        return found


class Windows:
    """Templates against all windows of a text that have at most (2 - least) / least times their words."""

    def __init__(self, templates: list[tuple[str, str]], least: float) -> None:
        self.least, self.factor = least, (2 - least) / least
        split = [(WORD.findall(t.lower().encode()), name) for name, t in templates]
        self.sets = [(bigrams(w), int((len(w) - 1) * self.factor + 1e-9), name) for w, name in split if len(w) > 1]
        self.every = frozenset().union(*(s for s, _, _ in self.sets))

    def found(self, text: bytes) -> list[tuple[float, str, int, int]]:
        """(score, name, first byte, end) of windows that reach `least`, best first, none over another."""
        places = [m.span() for m in WORD.finditer(text)]
        words = [text[a:b] for a, b in places]
        pairs = list(zip(words, words[1:]))
        common = self.every.intersection(pairs)
        # a window with I of a template's T bigrams scores at most 2 * I / (I + T)
        near = [(s, most, name) for s, most, name in self.sets if len(common & s) * self.factor >= len(s) - 1e-9] if common else []
        if not near:
            return []
        last: dict = {}
        before = np.full(len(pairs), -1, np.int64)
        for i, g in enumerate(pairs):
            before[i] = last.get(g, -1)
            last[g] = i
        hits = []
        for s, most, name in near:
            own = np.fromiter((g in s for g in pairs), bool, len(pairs))
            upto = np.r_[0, np.cumsum(own)]
            at = np.flatnonzero(own)
            at = at[(upto[np.minimum(at + most, len(pairs))] - upto[at]) * self.factor >= len(s) - 1e-9]
            for i in at.tolist():
                new = before[i : i + most] < i
                score = 2 * np.cumsum(new & own[i : i + most]) / (np.cumsum(new) + len(s))
                end = int(np.argmax(score))
                if score[end] >= self.least:
                    hits.append((float(score[end]), name, i, i + end + 2))
        taken, out = np.zeros(len(words), bool), []
        for score, name, i, j in sorted(hits, key=lambda h: (-h[0], h[2] - h[3], h[1], h[2])):
            if not taken[i:j].any():
                taken[i:j] = True
                out.append((score, name, places[i][0], places[j - 1][1]))
        return out


def scan(templates: list[tuple[str, str]], full: list[tuple[str, str]], least: float):
    """For mapInArrow: doc_id, licence, score, matched segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, windows = Matcher(templates, least), Windows(templates + full, least)
        for batch in batches:
            names, scores, n = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                raw = text.as_py() or b""
                segments = raw.split(b"\n")
                if len(segments) > 1:
                    segments.append(raw)
                per = [matcher.best(s) for s in segments]
                hits = [h for h in per if h]
                if not per[-1]:  # else the whole text is the match
                    ends = np.cumsum([len(s) + 1 for s in raw.split(b"\n")])
                    for score, name, start, end in windows.found(raw.lower()):
                        line = int(np.searchsorted(ends, start, "right"))
                        if not (per[line] and end <= ends[line]):  # else that line is the match
                            hits.append((score, name))
                top = min(hits, key=lambda h: (-h[0], h[1])) if hits else (0.0, None)
                names.append(top[1])
                scores.append(top[0])
                n.append(len(hits))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(n, pa.int64())], ["doc_id", "license", "score", "n_matches"])

    return run


def scan_licenses(docs: DataFrame, *, templates: list[tuple[str, str]] | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, license, score, n_matches for every row of docs.

    Segments of a text are its lines and, if there are several, the whole; and
    unless the whole matches, windows of its words that no matching line holds,
    which never overlap and are held against the full texts too. Text
    is normalised to runs of a-z and 0-9 in lower case. Every segment is held
    against the templates whose size allows a Dice coefficient of `least`; the
    row names the best over all segments (ties to the smaller name), its score,
    and how many segments match. Without a match: null, 0.0 and 0.

    Null text has no match. Texts are scanned where they are read, very long
    ones whole; the templates are a fixed list. Repeated rows give a row each.
    Only doc_id and text are read of docs. An empty table gives an empty one.
    """
    run = scan(TEMPLATES if templates is None else templates, full_texts() if templates is None else [], least)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, score double, n_matches long")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql() -> str:
    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES)
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    words = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"
    return rf"""
with t as (select name, {grams} as g from (select name, {words.format("t")} as w from (values {rows}) v(name, t))),
d as (select doc_id, coalesce(text, '') as text from documents),
s as (
  select doc_id, unnest(string_split(text, E'\n')) as seg from d
  union all select doc_id, text from d where contains(text, E'\n')
),
b as (select row_number() over () as seg_no, doc_id, {grams} as g from (select doc_id, {words.format("seg")} as w from s) where len(w) > 1),
m as (
  select b.doc_id, b.seg_no, t.name, 2 * len(list_intersect(b.g, t.g)) / cast(len(b.g) + len(t.g) as double) as score
  from b join t on len(b.g) <= len(t.g) * {2 - LEAST} / {LEAST} + 1 and len(t.g) <= len(b.g) * {2 - LEAST} / {LEAST} + 1
),
h as (select doc_id, arg_min(name, (-score, name)) as license, max(score) as score, count(distinct seg_no) as n_matches from m where score >= {LEAST} group by doc_id)
select d.doc_id, h.license, coalesce(h.score, 0.0) as score, coalesce(h.n_matches, 0) as n_matches from d left join h using (doc_id)
"""


SQL = _sql()
