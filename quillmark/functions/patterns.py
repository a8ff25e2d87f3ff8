"""Many phrases in one pass over a text: an automaton built once in each worker."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=16)
def automaton(phrases: tuple[tuple[str, str], ...]):
    """Of (phrase, what it stands for); phrases are whole words in normal form."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for phrase, name in phrases:
        key = f" {phrase} "
        out.add_word(key, out.get(key, ()) + (name,))
    if phrases:
        out.make_automaton()
    return out


def names_in(text: str | None, phrases: tuple[tuple[str, str], ...]) -> list[str]:
    """What stands in a normal text, each once, in the order of the phrases' first places in the text."""
    if not text or not phrases:
        return []
    return list(dict.fromkeys(n for _, names in automaton(phrases).iter(f" {text} ") for n in names))


def standing_in(text: Column, phrases: list[tuple[str, str]]) -> Column:
    """The names whose phrases stand in a normal text, as an array; null texts have none. phrases: a fixed list."""
    fixed = tuple(phrases)

    @F.pandas_udf("array<string>")
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([names_in(x, fixed) for x in t], dtype=object)

    return find(text)
