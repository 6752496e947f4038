"""Ranked lexical search against a plain version and SQL's cases."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from meadowlark.llm import lexical
from pyspark.sql import functions as F

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(items, docs, k):
    own = [(d, Counter(terms(t))) for d, t in docs]
    own = [(d, c, sum(c.values())) for d, c in own if c]
    n_docs, total = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(terms(t))
    out = set()
    for i, ts in asked.items():
        scored = []
        for d, c, n in own:
            m = 10 + (90 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if s > 0 and d is not None:
                scored.append((-s, d))
        out |= {(i, rank, d, -s) for rank, (s, d) in enumerate(sorted(scored)[:k], 1)}
    return out


def tables(spark, items, docs):
    return spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("own")), spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit("own"))


def test_terms():
    for text in ["Ünïcode-Straße 42\tA_B\x00c\x7fd", "", None, "x" * 300_000, "  é\x80z", "[a]{b}`c@D"]:
        assert [t.decode() for t in lexical.terms_of(text)] == terms(text)


def test_ranks_against_plain_version(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)] + ["été", "Straße", "X1"]
    docs = [(k, " ".join(rng.choices(words, k=rng.choice([1, 5, 60])))) for k in range(900)]
    docs += [(k + 2000, docs[k % 3][1]) for k in range(40)] + [(7, "w1 w2"), (None, "w1 w1 w3"), (5000, None), (5001, ""), (5002, " .,;"), (5003, "w5 " * 40_000)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([1, 4, 20])))) for k in range(90)]
    items += [(3, "w7 W8 new"), (None, "w1"), (200, None), (201, ""), (202, "nowhere to be found"), (203, docs[0][1])]
    held = lexical.GROUP_BYTES, lexical.ITEMS, lexical.DOCS, lexical.WIDTH
    try:
        for small in (held, (400, 7, 30, 5)):
            lexical.GROUP_BYTES, lexical.ITEMS, lexical.DOCS, lexical.WIDTH = small
            got = [tuple(r) for r in lexical.ranked_search(*tables(spark, items, docs), k=6).collect()]
            assert len(got) == len(set(got)) and set(got) == plain(items, docs, 6)
    finally:
        lexical.GROUP_BYTES, lexical.ITEMS, lexical.DOCS, lexical.WIDTH = held


def test_no_rows(spark):
    some = [(1, "a b")]
    for items, docs in ([], some), (some, []), ([], []), (some, [(1, None), (2, "--")]):
        found = lexical.ranked_search(*tables(spark, items, docs))
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


def test_sums_stay_exact():
    rng = np.random.default_rng(1)
    n = 40
    weights = np.full(n, (lexical.EXACT - 1) // lexical.IMPACT // 3)  # three terms reach the bound, so parts are of three
    tile = lexical.Tile([set(range(n)), {1, 5}], weights)
    doc, term = np.repeat(np.arange(4), n), np.tile(np.arange(n), 4)
    impact = rng.integers(1, lexical.IMPACT, len(doc))
    got = tile.scores(4, doc, term, impact)
    assert tile.width == 3 and weights.sum() * lexical.IMPACT > lexical.EXACT
    for d in range(4):
        own = [int(x) for x in impact[doc == d]]
        assert got[0, d] == sum(int(weights[0]) * x for x in own) and got[1, d] == int(weights[0]) * (own[1] + own[5])
