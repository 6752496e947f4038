"""All keywords of the tag rules in one automaton: a text is read once, whatever the number of rules."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules

#: Keywords that rules name one by one.
LEVELS = ["championship", "intermediate", "novice", "beginner", "all levels", "mixed level"]


def _words(value) -> Iterator[str]:
    """All texts in a rule table."""
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict):
        yield from _words(list(value.values()))
    elif isinstance(value, (list, tuple)):
        for x in value:
            yield from _words(x)


TABLES = (LEVELS, rules.AFFILIATIONS, rules.FORMATS, rules.SCOPES, rules.AGES, rules.SPECIALS, rules.MOORLAND, rules.NATIVE, rules.BREED, rules.LONG_FORMAT, rules.SERIES, rules.COUNTY_SHOW, rules.NATIONAL_SHOW, rules.UNAFFILIATED)
KEYWORDS = {k: n for n, k in enumerate(sorted(set(_words(TABLES))))}


def plural(keyword: str) -> bool:
    """Plain words of four letters or more are looked for in the plural too."""
    return re.fullmatch("[a-z]{4,}", keyword) is not None


def inside(text: str, k: int) -> bool:
    """Whether place k of a text is a character of a word."""
    if not 0 <= k < len(text):
        return False
    c = text[k]
    return c.isalnum() or c == "_" or (c > "\x7f" and unicodedata.category(c) in ("Mn", "Me", "Mc", "Pc"))


def border(text: str, k: int) -> bool:
    """Whether a word begins or ends before place k."""
    return inside(text, k - 1) != inside(text, k)


@lru_cache(maxsize=1)
def _automaton():
    from ahocorasick import Automaton

    found = Automaton()
    for keyword, number in KEYWORDS.items():
        found.add_word(keyword, (number, len(keyword), plural(keyword)))
    found.make_automaton()
    return found


def keywords_in(text: str) -> list[int]:
    """The numbers of the keywords that stand in a text as whole words."""
    out = set()
    for last, (number, size, more) in _automaton().iter(text):
        end = last + 1
        if number not in out and border(text, end - size) and (border(text, end) or (more and text[end : end + 1] == "s" and border(text, end + 1))):
            out.add(number)
    return sorted(out)


@dataclass(frozen=True)
class Scanned:
    """A text with the numbers of its keywords."""

    text: Column
    hits: Column

    def rlike(self, pattern: str) -> Column:
        return self.text.rlike(pattern)

    def has(self, keywords: list[str]) -> Column:
        return F.arrays_overlap(self.hits, F.array(*[F.lit(KEYWORDS[k]) for k in keywords]))


def scanned(text: Column) -> Column:
    """A struct of the text and its keywords' numbers, found in Arrow batches, each different text of one once."""

    @F.arrow_udf("array<int>")
    def scan(texts: pa.Array) -> pa.Array:
        known: dict[str, list[int]] = {}
        return pa.array([None if x is None else known[x] if x in known else known.setdefault(x, keywords_in(x)) for x in texts.to_pylist()], pa.list_(pa.int32()))

    return F.struct(text.alias("text"), scan(text).alias("hits"))
