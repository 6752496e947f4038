"""Spelling variants against words with one letter deleted, and all pairs."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from meadowlark.llm import cells, queries, variants
from meadowlark.llm.common import table
from pyspark.sql import functions as F

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def plain_words(docs, shortest=6, least=5):
    counts = Counter()
    for d, text in docs:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}


def plain_forms(words, factor=5):
    """{word: (form, root, n, n_near, form_n)}: near words share a rest after one deletion at the same place, or one is
    such a rest of the other."""
    rests = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            rests[k, w[:k] + w[k + 1 :]].add(w)
    near = defaultdict(set)
    for (_, rest), own in rests.items():
        for w in own:
            near[w] |= own - {w}
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= factor * n else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None
    return out


def collected(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_query_over_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    rows = queries.op13_spelling_variants(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert collected(rows) == plain_forms(plain_words(docs)) and rows.count() == len(plain_words(docs))


def test_larger_table_and_counts(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    want = plain_words(docs)
    words = variants.counted_words(table(spark, "/root/testdata/sf0.01", "documents")).checkpoint()
    assert {r.word: r.n for r in words.collect()} == want
    assert collected(variants.spelling_variants(words)) == plain_forms(want)


@pytest.mark.parametrize("block,frequent", [(2048, 16), (6, 0), (5, 1000)])
def test_edits_of_all_kinds(spark, block, frequent):
    rng = random.Random(block)
    words = {"aaaaaa": 5, "aaaaaaa": 30, "aaaaaaaa": 200, "ababab": 9, "bababa": 60, "étéété": 5, "étéeté": 50, "x" * 500: 7, "x" * 499 + "y": 8, "x" * 499: 90, "abcdef": 10, "abcdfe": 100}
    for _ in range(60):
        w = "".join(rng.choices("abcd", k=rng.randint(6, 11)))
        words[w] = rng.randint(5, 900)
        for _ in range(6):
            k = rng.randrange(len(w) + 1)
            v = rng.choice([w[:k] + rng.choice("abcdz") + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice("abcdz") + w[k + 1 :]])
            if len(v) >= 6:
                words[v] = rng.randint(5, 900)
    held = cells.BLOCK, cells.PAIRS, variants.FREQUENT, variants.MATRIX
    try:
        cells.BLOCK, cells.PAIRS, variants.FREQUENT, variants.MATRIX = block, 50, frequent, 4000
        df = spark.createDataFrame(list(words.items()), "word string, n long").withColumn("cell", F.lit(1)).repartition(3)
        got = collected(variants.spelling_variants(df))
    finally:
        cells.BLOCK, cells.PAIRS, variants.FREQUENT, variants.MATRIX = held
    assert got == plain_forms(words)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "short WORD lettersÉ " * 6), (None, "nameless " * 9), (4, "x" * 100_000 + " 12 Ālettersé×abc"), (3, "lettersÉ " * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("own")).withColumn("n", F.lit(1))
    assert {r.word: r.n for r in variants.counted_words(df).collect()} == plain_words(rows)
    assert variants.misspelt(3, "lettersÉ") in plain_words(rows)
    for none in (df.limit(0), df.where("doc_id = 1")):
        assert variants.spelling_variants(variants.counted_words(none)).count() == 0


def test_bound_leaves_a_gram():
    """Whatever one edit does, the bound is enough, and every word keeps a gram."""
    rng = random.Random(2)
    words = ["".join(rng.choices("ab", k=rng.randint(6, 9))) for _ in range(300)]
    grams = np.unique(np.concatenate([h.ravel() for h in variants.hashes(variants.letters(words[:150])[0])[:-1]]))
    known = variants.Dictionary(grams, np.full(len(grams), 50))
    for w in words:
        for k in range(len(w) + 1):
            for v in (w[:k] + "b" + w[k:], w[:k] + w[k + 1 :], w[:k] + "c" + w[k + 1 :]):
                if len(v) < 6 or v == w:
                    continue
                got = [variants._grams(*variants.letters([x]), known) for x in (w, v)]
                sets = [Counter(g[s].tolist()) for s, g, _, _ in got]
                common = (sets[0] & sets[1]).total()
                for own, (_, _, _, bound) in zip(sets, got, strict=True):
                    assert 1 <= own.total() - bound[0] <= common
