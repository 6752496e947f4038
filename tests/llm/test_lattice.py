"""Near vectors against all pairs; the lattice; planned recall."""

import random

import numpy as np
import pytest
from meadowlark.llm import cells, lattice
from pyspark.sql import functions as F


def brute(rows, threshold):
    """(vec_id, n_links, component_id, kept) of each row by all pairs."""
    unit = []
    for i, v in rows:
        fine = i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        w = np.array(v, float) / np.abs(v).max() if fine else None
        unit.append(w / np.sqrt(w @ w) if fine else None)
    links = [[b for b, y in enumerate(unit) if b != a and x is not None and y is not None and len(x) == len(y) and x @ y >= threshold] for a, x in enumerate(unit)]
    out = []
    for a, (i, _) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        least = min((rows[b][0] for b in seen if rows[b][0] is not None), default=None)
        out.append((i, len(links[a]), least, i == least))
    return out


def key(r):
    return tuple(-1 if x is None else x for x in r)


def test_nearest_points():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 8)) * 2
    p = lattice.nearest(x)
    doubled = (2 * p).astype(int)
    assert (2 * p == doubled).all() and ((doubled % 2).sum(axis=1) % 8 == 0).all() and (p.sum(axis=1) % 2 == 0).all()
    best = ((x - p) ** 2).sum(axis=1)
    assert len(lattice.AROUND) == 240 and (best <= 1 + 1e-9).all()
    for v in lattice.AROUND:
        assert (best <= ((x - p - v) ** 2).sum(axis=1) + 1e-9).all()


@pytest.mark.parametrize("block", [2048, 16])
def test_links_against_all_pairs(spark, block):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(40):
        middle = rng.normal(size=16)
        rows += [(len(rows) + k, (middle + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.25])).astype(np.float32).tolist()) for k in range(int(rng.choice([1, 2, 5])))]
    middle = rng.normal(size=16)
    rows += [(1000 + k, (middle + rng.normal(size=16) * 0.05).astype(np.float32).tolist()) for k in range(120)]
    rows += [(2000 + k, rows[-1][1]) for k in range(60)] + [(3000, [2 * x for x in rows[0][1]]), rows[0], (0, rows[1][1])]
    rows += [(None, rows[0][1]), (4001, None), (4002, []), (4003, [0.0] * 16), (4004, [None] + [1.0] * 15), (4005, [float("nan")] * 16), (4006, [float("inf")] * 16)]
    rows += [(5001, [1.0, 2.0, 3.0]), (5002, [1.0, 2.0, 3.1]), (5003, [7.0]), (5004, [-7.0]), (5005, [0.5]), (5006, [1e-30] * 9), (5007, [3e30] * 9), (5008, [-0.0, 1.0]), (5009, [0.0, 1.0])]
    random.Random(1).shuffle(rows)
    held = cells.BLOCK, cells.PAIRS
    try:
        cells.BLOCK, cells.PAIRS = block, 300
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("cell", F.lit("own")).withColumn("node", F.lit("own"))
        got = lattice.near_vectors(df, threshold=0.95)
        assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
        got = sorted((tuple(r) for r in got.collect()), key=key)
    finally:
        cells.BLOCK, cells.PAIRS = held
    want = sorted(brute(rows, 0.95), key=key)
    assert len(got) == len(want)
    # everything found is true, and nearly all is found
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want)
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= 0.97 * len(want)
    assert all(a[1] <= b[1] for a, b in zip(got, want, strict=True))


def test_doubles_and_no_rows(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e-200, 1e-200]), (3, [1.0, -1.0])]
    got = lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), threshold=0.95).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    assert lattice.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    with pytest.raises(ValueError):
        lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), threshold=0.1)


def test_planned_recall():
    """Pairs right at the threshold meet as often as planned, at any size, also where coordinates are used again."""
    for n, dim in ((500, 64), (50_000, 64), (10**7, 64), (10**6, 24), (10**8, 256)):
        plan = lattice.plan_for(n, dim, 0.95)
        rng = np.random.default_rng(n)
        u, w = rng.normal(size=(2, 1500, dim))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        w -= (w * u).sum(axis=1, keepdims=True) * u
        w /= np.linalg.norm(w, axis=1, keepdims=True)
        s = [lattice.sketches(x, plan) for x in (u, 0.95 * u + (1 - 0.95**2) ** 0.5 * w)]
        home, probed = (np.concatenate(x) for x in zip(*(lattice.cells(x, plan) for x in s), strict=True))
        assert (lattice.meeting(home, probed, np.arange(1500), np.arange(1500) + 1500) != 0).mean() >= 0.97, plan
        few = lattice.cells(s[0][:3], plan)
        assert (few[0] == home[:3]).all() and (few[1] == probed[:3]).all()  # however many rows go together
