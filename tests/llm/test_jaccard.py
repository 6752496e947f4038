import random
import re
from fractions import Fraction
from math import comb

import numpy as np
from meadowlark.llm import components, jaccard
from meadowlark.llm.hashing import Joined, mixed

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n=5, t=Fraction(4, 5)):
    sets, root = [], {}
    for d, text in rows:
        w = WORD.findall(text or "")
        sets.append((d, frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else None))
        root[d] = d

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i, (a, s) in enumerate(sets):
        for j in range(i):
            b, u = sets[j]
            if s and u and Fraction(len(s & u), len(s | u)) >= t:
                links[i] += 1
                links[j] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((d, find(d), k) for (d, _), k in zip(rows, links, strict=True))


def corpus(seed, groups=12):
    rng, rows, at = random.Random(seed), [], 0
    for _ in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 8, 40, 150]))]
        for _ in range(rng.choice([1, 1, 2, 9])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10_000)}"
            at += rng.randrange(1, 4)
            rows.append((at, " ".join(w)))
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark, monkeypatch):
    rows = [*corpus(1), (9001, None), (9002, ""), (9003, " \n"), (9004, "one"), (9005, "one"), (9006, "word " * 5000), (9007, "word " * 4000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, size int, component string")
    want = brute(rows)
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.similar_documents(df).collect())
    assert got == want
    monkeypatch.setattr(jaccard, "BLOCK", 3)  # groups larger than a block are compared block by block
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.similar_documents(df).collect()) == want


def test_empty_blocks(spark, monkeypatch):
    """Groups of two to five texts in more blocks than texts: pairs count once, however many blocks are empty."""
    rng, rows = random.Random(4), []
    for size in (2, 2, 3, 3, 4, 5):
        base = [f"b{rng.randrange(10_000)}" for _ in range(200)]
        for _ in range(size):
            w = list(base)
            w[rng.randrange(len(w))] = f"e{rng.randrange(10_000)}"
            rows.append((len(rows) + 1, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 300)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.similar_documents(df).collect()) == brute(rows)


def test_several_texts_of_one_doc_id(spark, monkeypatch):
    """Each text of a repeated doc_id is compared, and the texts share a class."""
    rng = random.Random(5)
    base = [[f"b{rng.randrange(10_000)}" for _ in range(60)] for _ in range(7)]
    near = [" ".join([*b[:-1], "end"]) for b in base]
    text = [" ".join(b) for b in base]
    rows = [
        (1, text[0]), (5, near[0]), (5, text[1]), (5, None), (7, near[1]),  # two groups joined by 5
        (10, text[2]), (10, near[2]),  # near each other only
        (20, text[3]), (21, text[4]), (22, text[3]), (22, text[4]), (22, text[4]),  # copies of two documents
        (30, text[5]), (30, text[6]), (31, text[6] + " more"), (32, near[5]),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.similar_documents(df).collect()) == want
    monkeypatch.setattr(jaccard, "BLOCK", 2)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.similar_documents(df).collect()) == want


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(k).count("1") % 2 else a for k in range(n))


def test_words_that_collide_under_weak_hashes(spark):
    """Thue-Morse words are equal under any polynomial modulo 2^64; they and shingles of them must not be."""
    one, two = thue_morse(4096), thue_morse(4096, "b", "a")
    tail = " ".join(f"w{k}" for k in range(20))
    rows = [(1, f"{one} x y z q"), (2, f"{two} x y z q"), (3, f"{one} {tail}"), (4, f"{two} {tail}"), (5, " ".join(thue_morse(2048))), (6, " ".join(thue_morse(2048, "b", "a")))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.similar_documents(df).collect()) == brute(rows)


def test_one_template_by_buckets(spark, monkeypatch):
    """Texts of one template, about 0.38 alike, and a cluster of near copies among them, in one candidate group: they
    are compared by buckets in small blocks, each pair once."""
    rng = random.Random(8)
    template = [f"t{k}" for k in range(120)]
    rows = [(k, " ".join(template + [f"o{rng.randrange(10**6)}" for _ in range(100)])) for k in range(150)]
    base = rows[7][1].split()
    for k in range(30):
        w = list(base)
        w[rng.randrange(len(w))] = f"e{k}"
        rows.append((200 + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.similar_documents(df).collect()) == brute(rows)


def test_bucket_judges_only_new_pairs():
    import pandas as pd

    words = [b" ".join(b"w%d" % k for k in range(40)), b" ".join([*(b"w%d" % k for k in range(39)), b"x"])]
    sig = jaccard.signatures(jaccard.shingles(Joined([w.decode() for w in words]), 5))
    rows = [{"content": bytes([k]), "side": 0, "size": 36, "copies": 1, "bands": np.array([5, k, 9]), "sig": sig[k].astype(np.uint16).tobytes(), "words": words[k]} for k in (0, 1)]
    cell = pd.DataFrame(rows)
    assert len(jaccard.compare(cell, 5, 0.8, 0, True)) == len(jaccard.compare(cell, 5, 0.8, -1, True)) == 2
    assert jaccard.compare(cell, 5, 0.8, 2, True) == [] and jaccard.compare(cell, 5, 0.99, 0, True) == []


def test_edges(spark):
    assert jaccard.similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.class_id or -1, r.n_links) for r in jaccard.similar_documents(df).collect()) == [(-1, -1, 0), (1, 1, 2), (2, 1, 2), (2, 1, 2)]


def test_posterior():
    """The fewest matches that keep a pair, against a numerical integral of the posterior."""
    grid = (np.arange(200_000) + 0.5) / 200_000
    for n, m in jaccard.least_matches(0.8).items():
        for k, keep in ((m, True), (m - 1, False)):
            if k >= 0:
                density = np.exp(k * np.log(grid) + (n - k) * np.log(1 - grid) - (n * np.log(0.8)))
                assert (density[grid >= 0.8].sum() / density.sum() >= jaccard.TOLERANCE) == keep
    assert comb(3, 1) == 3


def test_intersections_and_signatures():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 6000, rng.integers(1, 3000))) for _ in range(9)]
    got = jaccard.intersections(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(9) for j in range(9) if i != j)
    a, b = mixed(np.arange(4000, dtype=np.uint64)), mixed(np.arange(400, 4400, dtype=np.uint64))
    one, two, none = jaccard.signatures([a, b, a[:0]])
    same = (one == two).mean()
    assert (jaccard.signatures([b])[0] == two).all() and (none == 2**32 - 1).all()
    assert abs(same - 3600 / 4400) < 0.12


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, 101), (101, 100), (7, 7), (200, 5), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in [*range(1, 61), 200]}, 100: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_follow_where_a_pair_is_left(spark, monkeypatch):
    """Pages of one template that are no near copies: the places get their signatures, and the words of none."""
    rng = random.Random(9)
    frame = " ".join(f"frame{k}" for k in range(60))
    docs = [(k, frame + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))) for k in range(120)]
    docs += [(1000 + k, docs[k][1] + " more") for k in range(3)]
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    seen, read = [], jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df: seen.append(read(df)) or seen[-1])
    got = jaccard.similar_documents(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got.collect()) == brute(docs)
    left = next(df for df in seen if df.columns == jaccard.PLACE)
    assert left.select("content").distinct().count() == 6
