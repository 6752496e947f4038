import random
import re

import numpy as np
from meadowlark.llm import hashing, queries, substring
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width):
    """doc_id -> kept words of each row, by sets of windows."""
    first = {}
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in words:
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in words:
        gone = {i + j for i in range(len(w) - width + 1) if d is not None and first[tuple(w[i : i + width])] < d for j in range(width)}
        out.append((d, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(rng.randrange(5, 30))) for _ in range(40)]
    rows = [(rng.randrange(120), "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 6)))) for _ in range(150)]
    rows += [(3, None), (4, ""), (None, rows[0][1]), (500, rows[0][1]), (500, rows[0][1]), (501, "x " * 3000), (502, "x " * 2999)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("wholes", F.lit(1)).withColumn("windows", F.lit("c")).withColumn("cut", F.lit(3)).withColumn("a.b", F.lit(4)).withColumn("other_id", F.lit(5))
    for width in (6, 20):
        done = substring.remove_repeats(df, width)
        assert done.columns == [*df.columns, "n_words", "spans", "kept"]
        got = sorted(((r.doc_id, r.n_words, r.n, r.kept) for r in done.withColumn("n", substring.removed_words(F.col("spans"))).collect()), key=str)
        assert got == brute(rows, width)
    assert substring.remove_repeats(df.limit(0)).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    import hashlib

    rows = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    want = sorted((d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in brute(rows, 50))
    assert sorted(tuple(r) for r in queries.op5_substring_dedup(spark, sf).collect()) == want


def test_words_that_collide_under_weak_hashes(spark):
    """Thue-Morse words are equal under any polynomial modulo 2^64; windows with them are not."""
    one, two = ("".join("ab"[(bin(k).count("1") + side) % 2] for k in range(4096)) for side in (0, 1))
    rest = " ".join(f"w{k}" for k in range(49))
    rows = [(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"{two} {rest} end")]
    done = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_words, sum(s["to"] - s["from"] for s in r.spans), r.kept) for r in done.collect()) == brute(rows, 50)


def test_hashes_and_minima():
    words = hashing.words_of("a b  a\tb c é " * 40 + "w" * 700_000 + " a b")
    one = hashing.word_hashes(words)
    assert len(one) == len(words) and len(set(one.tolist())) == len(set(words))
    w = hashing.windows(one, 4)
    groups = {}
    for k, h in enumerate(w.tolist()):
        groups.setdefault(h, set()).add(tuple(words[k : k + 4]))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({tuple(words[k : k + 4]) for k in range(len(w))})
    p = hashing.PRIME
    values = np.random.default_rng(5).integers(0, p, 9000).astype(np.uint64)
    plain = [sum(int(v) * pow(hashing.BASE, k, p) for k, v in enumerate(values[i : i + 70])) % p for i in range(0, 8900, 700)]
    assert (hashing.windows(values, 70)[0:8900:700] == hashing.mixed(np.array(plain, np.uint64))).all()
    assert hashing.times(values[:-1], values[1:]).tolist() == [int(x) * int(y) % p for x, y in zip(values[:-1], values[1:], strict=True)]
    x = np.random.default_rng(1).integers(0, 99, 57).astype(np.uint64)
    for n in (1, 2, 7, 57, 60):
        assert hashing.sliding_minimum(x, n).tolist() == [int(x[k : k + n].min()) for k in range(57 - n + 1)]
