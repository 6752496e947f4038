import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from meadowlark.llm import packing
from meadowlark.llm.common import table
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(docs, rows, capacity):
    t = Tokenizer.from_file(PATH)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.piece))
        sequences[r.sequence_id].append((r.offset, r.length))
    for d, text in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        got = sorted(pieces[d])
        assert [p[3] for p in got] == list(range(len(got)))
        at = 0
        for k, (start, length, crc, _) in enumerate(got):
            assert start == at and (length == capacity or len(got) == 1 or k == 0) and length <= capacity
            assert crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    for items in sequences.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in rows)
    return len(sequences), -(-total // capacity)


def test_pieces_and_places(spark):
    rng = random.Random(4)
    docs = [(k, " ".join(rng.choice(["word", "horse", "é", "ride"]) for _ in range(rng.choice([0, 1, 5, 30, 90, 400])))) for k in range(120)] + [(900, None), (901, ""), (902, "<|endoftext|>" * 70)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS length", "'x' AS bucket")
    rows = packing.pack(df, PATH, 64).collect()
    used, least = check(docs, rows, 64)
    assert used <= least + 2
    assert packing.pack(df.limit(0), PATH).count() == 0
    twice = packing.pack(df.union(df), PATH, 64).collect()
    assert len(twice) == 2 * len(rows) and len({(r.sequence_id, r.offset) for r in twice}) == len(twice)


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    rows = packing.pack(table(spark, "/root/testdata/sf0.001", "documents"), PATH).collect()
    used, least = check(docs, rows, 2048)
    assert used <= least * 1.01 + 1


def test_fullest_is_the_best_sum():
    rng = random.Random(9)
    for _ in range(200):
        counts = np.zeros(21, np.int64)
        for _ in range(rng.randrange(1, 6)):
            counts[rng.randrange(1, 21)] += rng.randrange(1, 4)
        room = rng.randrange(0, 40)
        sums = {0}
        for size, n in enumerate(counts):
            for _ in range(n):
                sums |= {s + size for s in sums}
        got = packing.fullest(counts, room)
        assert sum(s * n for s, n in got) == max(s for s in sums if s <= room) and all(n <= counts[s] for s, n in got)


def test_plan_uses_every_piece():
    rng = random.Random(2)
    histogram = {rng.randrange(1, 101): rng.randrange(1, 500) for _ in range(40)}
    used = defaultdict(int)
    for filling, times in packing.minimum_bin_slack(histogram, 100):
        assert sum(s * n for s, n in filling) <= 100
        for s, n in filling:
            used[s] += n * times
    assert dict(used) == histogram
