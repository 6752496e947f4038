"""Pairs that meet in cells: members of a cell are dealt to tasks in blocks of bounded size, and the pairs of many cells
are made at once as index arrays inside a task (operators 12 and 13). No pair is ever a row."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_anew, stored

#: Members of one block of a cell, and pairs that are held at a time.
BLOCK, PAIRS = 2048, 1 << 18
#: Where a row stands: its cell, the two blocks that meet, the side of the row's own block, and whether it is at home.
PLACE = ["cell", "lo", "hi", "side"]


def placed(members: DataFrame, cells: DataFrame, salt: str) -> DataFrame:
    """members (cell long, home boolean, and others) with lo, hi and side: a cell of more than a block of members is
    cut into blocks by the hash of column `salt`, and each two of its blocks meet once, so that no task gets a whole
    hot cell. cells: the column cell of all members, one row each, from which the sizes are counted."""
    hot = stored(cells.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).where("blocks > 1"))
    own, other = fresh(members, "own", "other")
    told = join_anew(members, hot, ["cell"], "left")
    told = told.withColumn(own, F.coalesce(F.pmod(F.xxhash64(salt), F.col("blocks")), F.lit(0)).cast("int"))
    told = told.withColumn(other, F.explode(F.sequence(F.lit(0), (F.coalesce("blocks", F.lit(1)) - 1).cast("int"))))
    lo, hi = F.least(own, other), F.greatest(own, other)
    return told.select(*members.columns, lo.alias("lo"), hi.alias("hi"), (F.col(own) != lo).cast("int").alias("side"))


def judged(members: DataFrame, judge: Callable[[dict, np.ndarray], dict], schema: str) -> DataFrame:
    """judge's rows for the members (columns PLACE, home, and others), which get rows of whole cells together.

    judge(columns, starts) gets the columns as Arrow arrays and the number of the first row of each group; rows of a
    group stand in the order that pairs() needs."""
    names = members.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def done(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(rows).combine_chunks()
            columns = {n: table[n].combine_chunks() if table[n].num_chunks != 1 else table[n].chunk(0) for n in names}
            out = judge(columns, np.concatenate([[0], np.flatnonzero(new_groups(table)) + 1]))
            yield from pa.table(out).to_batches()

        def new_groups(rows) -> np.ndarray:
            place = [np.asarray(rows[n]) for n in PLACE[:3]]
            return np.logical_or.reduce([x[1:] != x[:-1] for x in place])

        for b in batches:
            if not b.num_rows:
                continue
            first = tuple(b[n][0].as_py() for n in PLACE[:3])
            if held and first != last:
                yield from done(held)
                held = []
            at = np.flatnonzero(new_groups(b)) + 1
            cut = int(at[-1]) if len(at) else 0  # the last group may go on in the next batch
            if cut:
                yield from done([*held, b.slice(0, cut)])
                held = []
            held.append(b.slice(cut))
            last = tuple(b[n][b.num_rows - 1].as_py() for n in PLACE[:3])
        if held:
            yield from done(held)

    together = members.repartition(*PLACE[:3]).sortWithinPartitions(*PLACE, F.desc("home"))
    return together.mapInArrow(run, schema)


def pairs(columns: dict, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (i, j) of rows that meet in their group, at most PAIRS at a time but for one row's own.

    Within a block every home row meets the homes after it and all visitors; of two blocks, home rows of one meet all
    of the other, visitors its homes. Rows are sorted by side, homes first, so the partners of a row are a range."""
    n = len(columns["cell"])
    home, side = np.asarray(columns["home"].cast(pa.int8())).astype(bool), np.asarray(columns["side"])
    lo, hi = np.asarray(columns["lo"]), np.asarray(columns["hi"])
    sizes = np.diff(np.append(starts, n))
    end = np.repeat(starts + sizes, sizes)
    group = np.repeat(np.arange(len(starts)), sizes)
    second = np.repeat(starts + np.bincount(group, side == 0, len(starts)).astype(int), sizes)
    homes = np.repeat(np.bincount(group, (side == 1) & home, len(starts)).astype(int), sizes)
    within = lo == hi
    first = np.where(within, np.arange(n) + 1, second)
    last = np.where(within, np.where(home, end, first), np.where(side == 1, first, np.where(home, end, second + homes)))
    count = np.maximum(last - first, 0)
    total = np.cumsum(count)
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        c = count[at:upto]
        if c.any():
            i = np.repeat(np.arange(at, upto), c)
            j = np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first[at:upto], c)
            yield i, j
        at = upto


class Roots:
    """Sets of numbers that are united pair by pair; a set's root is its least number."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def unite(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.of[i], self.of[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.of, np.maximum(a, b), np.minimum(a, b))
            while (self.of[self.of] != self.of).any():
                self.of = self.of[self.of]


def fixed(array: pa.Array, dtype: str) -> np.ndarray:
    """A column of binaries of one length as the rows of a matrix."""
    raw = b"".join(array.to_pylist())
    return np.frombuffer(raw, dtype).reshape(len(array), -1) if len(array) else np.zeros((0, 0), dtype)
