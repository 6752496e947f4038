"""Best-fit packing of token sequences by minimum bin slack (operator 8)."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .bpe import cased_ids, core, safe_pieces, vocabulary
from .common import stored


def piece_rows(docs: DataFrame, path: str, length: int, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. A document is the ids of its whole text (null:
    empty) and end_id; a longer one is cut into full pieces, of which the first may be shorter."""

    def run(batches):
        fast, special = core(path), vocabulary(path).special
        for batch in batches:
            out = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*(i for x in safe_pieces(t, 1 << 18) for i in cased_ids(fast, x, special)), end_id] if t else [end_id], "<u4")
                raw, n = ids.tobytes(), len(ids)
                edges = [0, *range(n % length or length, n + 1, length)]
                out += [(d, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds], names=names)

    names, kinds = ["doc_id", "piece", "start", "length", "ids_crc32"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: np.ndarray, room: int) -> list[tuple[int, int]]:
    """(length, times) of the available lengths whose sum comes nearest to room without passing it: subset sums as
    the bits of one integer, longest lengths first, times of one length in powers of two."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for size in range(min(room, len(counts) - 1), 0, -1):
        left, power = min(int(counts[size]), room // size), 1
        while left:
            take = min(power, left)
            steps.append((size, take, reach))
            reach |= reach << (size * take) & mask
            left, power = left - take, power * 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for size, take, before in reversed(steps):
        if not before >> at & 1:
            at -= size * take
            used[size] = used.get(size, 0) + take
    return sorted(used.items(), reverse=True)


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Fillings ((length, times) pairs) and how many sequences have each. Every sequence starts with the longest
    length left and gets the fullest feasible combination beside it; a filling is used as often as its lengths last.
    The work depends on the number of different lengths (at most the capacity), not on the number of pieces."""
    counts, out = np.zeros(capacity + 1, np.int64), []
    for size, n in histogram.items():
        counts[size] = n
    for seed in range(capacity, 0, -1):
        while counts[seed]:
            counts[seed] -= 1
            used = dict(fullest(counts, capacity - seed))
            counts[seed] += 1
            used[seed] = used.get(seed, 0) + 1
            times = min(int(counts[s]) // n for s, n in used.items())
            for s, n in used.items():
                counts[s] -= n * times
            out.append((sorted(used.items(), reverse=True), times))
    return out


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Packs documents into as few sequences of at most `capacity` tokens as it can; one row per piece: doc_id, piece,
    start, length, ids_crc32, sequence_id, offset.

    Null or empty text: the end token alone. Repeated rows and equal ids are packed each by itself; null doc_id is
    kept. An empty table gives no rows. Only the counts of pieces by length (at most `capacity` numbers) come to the
    driver, where the fillings are chosen. Pieces get their places by their rank among equal lengths, counted in
    buckets that grow in number with the pieces, so no length, however frequent, meets in one task.
    """
    pieces = stored(piece_rows(docs, path, capacity, end_id))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = minimum_bin_slack(histogram, capacity)
    # for each length: at which rank a filling starts, its first sequence, how many of the length it holds, and where
    spans: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks, sequence = dict.fromkeys(histogram, 0), 0
    for filling, times in plan:
        offset = 0
        for size, n in filling:
            spans.setdefault(size, []).append((ranks[size], sequence, n, offset))
            ranks[size] += n * times
            offset += n * size
        sequence += times
    table = {size: np.array(x, np.int64) for size, x in spans.items()}

    buckets = max(256, sum(histogram.values()) // 50_000)
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    by_bucket = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = by_bucket.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "bucket", F.coalesce("base", F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = bucketed.withColumn("rank", within - 1).join(before, ["length", "bucket"])

    def place(batches):
        for b in batches:
            size, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                own = size == s
                span = table[int(s)]
                row = span[np.searchsorted(span[:, 0], rank[own], "right") - 1]
                k = rank[own] - row[:, 0]
                seq[own], off[own] = row[:, 1] + k // row[:, 2], row[:, 3] + k % row[:, 2] * s
            yield pa.RecordBatch.from_arrays([b.column(c) for c in KEPT] + [pa.array(seq), pa.array(off)], names=[*KEPT, "sequence_id", "offset"])

    return ranked.select(*KEPT, (F.col("rank") + F.col("base")).cast("long").alias("rank")).mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


KEPT = ["doc_id", "piece", "start", "length", "ids_crc32"]
