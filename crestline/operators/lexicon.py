"""Lexicon scoring of short messages.  A lexicon is data: mood, word, weight."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_pattern(word: str) -> str:
    """Java pattern of a lexicon word: itself between word edges, or all of a message if one character."""
    quoted = re.sub(r"([^\w\s])", r"\\\1", word)
    return rf"(?iU)^{quoted}$" if len(word) == 1 else rf"(?iU)\b{quoted}\b"


def words_of(text: Column) -> Column:
    """The words of a message in lower case: what lies between word edges."""
    return F.split(F.lower(text), r"(?U)\W+")


def best_weight(text: Column, words: Mapping[str, float]) -> Column:
    """Largest weight of the words that a message has; 0 if none.

    A message is cut into words once, and plain words are looked up among them, the largest weight first.  Only phrases and words
    of one character are patterns, and a phrase is sought where its first word is there.
    """
    own, best = words_of(text), None
    for weight in sorted({*words.values()}, reverse=True):
        same = sorted(w for w in words if words[w] == weight)
        plain = [w.lower() for w in same if re.fullmatch(r"\w{2,}", w)]
        hits = [F.arrays_overlap(own, F.array(*map(F.lit, plain)))] if plain else []
        for w in (w for w in same if w.lower() not in plain):
            first = re.match(r"\w+", w.lower())
            hit = text.rlike(word_pattern(w))
            hits.append(F.array_contains(own, first[0]) & hit if first else hit)
        met = F.coalesce(reduce(lambda a, b: a | b, hits), F.lit(False))
        best = F.when(met, F.lit(float(weight))) if best is None else best.when(met, F.lit(float(weight)))
    return F.lit(0.0) if best is None else best.otherwise(F.lit(0.0))


def match_count(text: Column, words: Iterable[str]) -> Column:
    """How often any of the words occurs in a message."""
    quoted = "|".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in words)
    return F.coalesce(F.regexp_count(text, F.lit(rf"(?iU)\b(?:{quoted})\b")), F.lit(0))


def has_keyword(text: Column, words: Iterable[str]) -> Column:
    """Whether any of the words stands in the text as a word of its own."""
    quoted = "|".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in words)
    return F.coalesce(text.rlike(rf"(?iU)\b(?:{quoted})\b"), F.lit(False))
