"""Exact top-k search (operator 10): an impact-ordered index, processed score-at-a-time, stopped only on proof."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Vectors of one index block, queries of one chunk, and the width of an impact level.
BLOCK, CHUNK, LEVEL = 16_384, 1024, 64
#: Chunks that go to a block at once.
SET = 8


def scaled(embedding: Column, by: int = 256) -> Column:
    """floor(by * x) of each component x as double; null if the vector is null or empty or a component is null or
    not finite."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    fine = (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(fine, F.transform(x, lambda v: F.floor(v * by).cast("long")))


class Index:
    """Posting segments of a block: for each dimension, the vectors in order of their value, cut into levels."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").T.copy()
        self.value = np.take_along_axis(vectors.T, self.order, axis=1).copy()
        self.place = {int(v): k for k, v in enumerate(ids)}
        dims, starts, ends, tops, bottoms = [], [], [], [], []
        for d, row in enumerate(self.value):
            level = row // LEVEL
            at = np.concatenate([[0], np.flatnonzero(np.diff(level)) + 1, [len(row)]])
            dims += [d] * (len(at) - 1)
            starts += at[:-1].tolist()
            ends += at[1:].tolist()
            tops += row[at[1:] - 1].tolist()
            bottoms += row[at[:-1]].tolist()
        self.dims, self.starts, self.ends, self.tops, self.bottoms = (np.array(x, np.int64) for x in (dims, starts, ends, tops, bottoms))

    def exact(self, query: np.ndarray, places: np.ndarray) -> np.ndarray:
        return self.vectors[places] @ query

    def search(self, query: np.ndarray, own_id: int, k: int) -> list[tuple[int, int]]:
        """(vec_id, score) of the k best by score, then smaller vec_id; rows with own_id take no part.

        Segments are processed by descending impact (the most that one of their postings can add). What a vector has
        yet to gain is at most the sum, over dimensions, of the largest positive impact not processed; negative
        impacts only lower a score. When the bound of all but a few vectors lies below the k-th best exact score
        found, or nothing positive is left, the others are proven out and the possible members are rescored exactly.
        """
        n = len(self.ids)
        impact = np.maximum(query[self.dims] * self.tops, query[self.dims] * self.bottoms)
        use = np.flatnonzero(impact > 0)
        use = use[np.argsort(-impact[use], kind="stable")]
        # the largest impact left in each dimension, summed, after each segment
        dims, size = self.dims[use], impact[use]
        left = np.zeros(len(query), np.int64)
        first = np.unique(dims, return_index=True)
        left[first[0]] = size[first[1]]
        # the next segment of the same dimension is what remains there
        following = np.zeros(len(use), np.int64)
        last: dict[int, int] = {}
        for s in range(len(use) - 1, -1, -1):
            d = int(dims[s])
            following[s] = size[last[d]] if d in last else 0
            last[d] = s
        remaining = left.sum() - np.cumsum(size - following) if len(use) else np.zeros(0, np.int64)

        gained, done, checks = np.zeros(n, np.int64), 0, 6
        floor = None
        for c in range(1, checks + 1):
            upto = len(use) * c // checks
            for s in range(done, upto):
                seg = use[s]
                d, a, b = self.dims[seg], self.starts[seg], self.ends[seg]
                gained[self.order[d, a:b]] += query[d] * self.value[d, a:b]
            done = upto
            open_gain = int(remaining[done - 1]) if done else int(left.sum())
            if c < checks // 2 and open_gain:
                continue
            likely = np.argpartition(-gained, min(4 * k + 4, n - 1))[: 4 * k + 4]
            scores = self.exact(query, likely)[self.ids[likely] != own_id]
            if len(scores) >= k:
                best = int(np.partition(scores, len(scores) - k)[len(scores) - k])
                floor = best if floor is None else max(floor, best)
            possible = n if floor is None else int((gained + open_gain >= floor).sum())
            if possible <= max(256, n // 64):
                break
        open_gain = int(remaining[done - 1]) if done else 0
        members = np.arange(n) if floor is None else np.flatnonzero(gained + open_gain >= floor)
        members = members[self.ids[members] != own_id]
        scores = self.exact(query, members)
        order = np.lexsort((self.ids[members], -scores))[:k]
        return list(zip(self.ids[members][order].tolist(), scores[order].tolist(), strict=True))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows with the highest integer inner products of each query.

    vectors: vec_id long, vector array<long> (see scaled). Queries are the rows for which is_query holds; candidates
    all rows but those with the query's own vec_id; ties go to the smaller vec_id. Rows with null vec_id or vector
    take no part; vectors are compared with those of equal length. Repeated rows are candidates each for itself;
    equal query rows give one result. Inner products must fit 64 bits.

    Rows are dealt by hash into index blocks of bounded size; queries, in chunks, go to every block (the stated query
    set against all rows), each block keeps k per query, and these few meet by query.
    """
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).select(F.col("vec_id").cast("long"), "vector", F.size("vector").alias("dim"), is_query.alias("asks"))
    sizes = {r["dim"]: (r["n"], r["m"]) for r in usable.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("asks").alias("m")).collect()}
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score long"
    if not any(m for _, m in sizes.values()):
        return spark.createDataFrame([], result)

    def dealt(df: DataFrame, each: int, which: int, name: str) -> DataFrame:
        """Packed rows: dim, name (number of the block), ids, data."""
        parts = F.create_map(*[F.lit(x) for dim, v in sizes.items() for x in (dim, max(1, -(-v[which] // each)))])
        part = F.pmod(F.xxhash64("vec_id", "vector"), parts[F.col("dim")]).cast("long")

        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("vec_id", kind="stable")
            data = np.stack(pdf["vector"].to_numpy()).astype("<i8")
            return pd.DataFrame({"dim": [pdf["dim"].iat[0]], name: [pdf["part"].iat[0]], "ids": [pdf["vec_id"].to_numpy("<i8").tobytes()], "data": [data.tobytes()]})

        return df.withColumn("part", part).groupBy("dim", "part").applyInPandas(pack, f"dim int, {name} long, ids binary, data binary")

    def numbers(which: int, each: int) -> Column:
        """0, 1, … up to how many packs of `each` rows a dimension has, less one."""
        most = F.create_map(*[F.lit(x) for dim, v in sizes.items() for x in (dim, max(1, -(-v[which] // each)) - 1)])
        return F.sequence(F.lit(0).cast("long"), most[F.col("dim")].cast("long"))

    asked = usable.where("asks").dropDuplicates(["vec_id", "vector"])
    chunks = dealt(asked, CHUNK, 1, "chunk").withColumn("set", F.col("chunk").cast("long") - F.col("chunk") % SET)
    blocks = dealt(usable, BLOCK, 0, "block")
    # each block meets each set of chunks; a pair of these is bounded and one task's work
    sent = chunks.withColumn("block", F.explode(numbers(0, BLOCK))).select("dim", "block", "set", "ids", "data")
    met = blocks.withColumn("set", F.explode(F.filter(numbers(1, CHUNK), lambda x: x % SET == 0))).select("dim", "block", "set", "ids", "data")

    def search(block: pa.Table, queries: pa.Table) -> pa.Table:
        out = [], [], [], []
        for row in block.to_pylist():
            index = Index(np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["data"], "<i8").reshape(-1, row["dim"]))
            for asking in queries.to_pylist():
                for q, v in zip(np.frombuffer(asking["ids"], "<i8").tolist(), np.frombuffer(asking["data"], "<i8").reshape(-1, row["dim"]), strict=True):
                    mark = zlib.crc32(v.tobytes())
                    for i, s in index.search(v, q, k):
                        for column, x in zip(out, (q, mark, i, s), strict=True):
                            column.append(x)
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["query_id", "mark", "vec_id", "score"])

    keys = ["dim", "block", "set"]
    found = met.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(search, "query_id long, mark long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
