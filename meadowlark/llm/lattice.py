"""Near duplicates among vectors (operator 12): random projections decoded to points of the lattice E8 in several
tables, neighbouring cells probed, and the cosine verified in double precision."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b
from itertools import combinations, product
from math import ceil, log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import PLACE, Roots, fixed, judged, pairs, placed
from .common import join_anew, stored
from .components import components
from .hashing import mixed

#: Neighbouring cells that a vector probes in each table, and the share of pairs at the threshold that must meet.
PROBES, RECALL = 8, 0.995
#: Scales of the lattice and numbers of lattice blocks of a cell that plan() chooses from.
SCALES, BLOCKS = (3.0, 4.0, 5.0, 6.0, 7.0), (1, 2, 3)
#: Sketches hold coordinates in units of 2^-20; all arithmetic on them is exact, so that every task finds the same cells.
UNIT, SLACK = 1 << 20, 1e-4


def minimal_vectors() -> np.ndarray:
    """The 240 lattice points next to the origin: two coordinates of 1 or -1, or all of a half with an even number of
    minuses."""
    out = []
    for (i, j), (a, b) in product(combinations(range(8), 2), product((1, -1), repeat=2)):
        out.append([a if k == i else b if k == j else 0 for k in range(8)])
    out += [list(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out, float)


AROUND = minimal_vectors()


def nearest(x: np.ndarray) -> np.ndarray:
    """The point of E8 nearest to each row: E8 is D8 (whole coordinates of even sum) and D8 moved by a half."""

    def even(y: np.ndarray) -> np.ndarray:
        f = np.rint(y)
        off = y - f
        k = np.abs(off).argmax(axis=1)
        odd = np.flatnonzero(f.sum(axis=1) % 2)
        f[odd, k[odd]] += np.where(off[odd, k[odd]] >= 0, 1, -1)
        return f

    a, b = even(x), even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


@dataclass(frozen=True)
class Plan:
    """How vectors of `dim` components are dealt into cells: `tables` tables, each of `blocks` lattice points."""

    dim: int
    scale: float
    blocks: int
    tables: int

    @property
    def width(self) -> int:
        """Coordinates that the cells of all tables use."""
        return self.tables * self.blocks * 8

    @property
    def kept(self) -> int:
        """Coordinates of a sketch: of one rotation, so that they bound the cosine."""
        return min(self.width, max(self.dim, 8) // 8 * 8)


def _orthonormal(n: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))
    return q * np.sign(np.diag(r))


@lru_cache(maxsize=64)
def rotation(plan: Plan) -> np.ndarray:
    return _orthonormal(max(plan.dim, 8), 12)[:, : plan.kept]


@lru_cache(maxsize=64)
def further(plan: Plan) -> np.ndarray:
    """Rotations of a sketch for the coordinates that it doesn't have, in whole numbers of 2^-20."""
    n = plan.width - plan.kept
    turns = [_orthonormal(plan.kept, 13 + k) for k in range(-(-n // plan.kept))]
    return np.rint(np.concatenate(turns, axis=1)[:, :n] * UNIT)


def sketches(unit: np.ndarray, plan: Plan) -> np.ndarray:
    """Rotated coordinates of unit vectors in fixed point."""
    wide = np.zeros((len(unit), max(plan.dim, 8)))
    wide[:, : plan.dim] = unit
    return np.rint(wide @ rotation(plan) * UNIT).astype("<i4")


def coordinates(sketch: np.ndarray, plan: Plan) -> np.ndarray:
    """All coordinates: those of the sketch, and further rotations of them, whose sums of whole numbers are exact."""
    if plan.width == plan.kept:
        return sketch
    return np.concatenate([sketch, np.rint(sketch.astype(float) @ further(plan) / UNIT)], axis=1)


def cells(sketch: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(n x tables) home cells and (n x tables x PROBES) probed cells of sketches, as 64-bit numbers."""
    n, size, sketch = len(sketch), plan.blocks * 8, coordinates(sketch, plan)
    shift = np.random.default_rng(8).integers(0, 32, plan.width) / 16
    home, probed = np.zeros((n, plan.tables), np.uint64), np.zeros((n, plan.tables, PROBES), np.uint64)
    for t in range(plan.tables):
        at = slice(t * size, (t + 1) * size)
        x = sketch[:, at] * (plan.scale / UNIT) + shift[at]
        point = nearest(x.reshape(-1, 8)).reshape(n, size)
        closer = ((x - point).reshape(-1, 8) @ AROUND.T).reshape(n, plan.blocks * len(AROUND))
        steps = np.argpartition(-closer, PROBES, axis=1)[:, :PROBES]
        seed = np.uint64(plan.dim * 64 + t)
        home[:, t] = numbered(point, seed)
        for p in range(PROBES):
            moved = point.reshape(n, plan.blocks, 8).copy()
            moved[np.arange(n), steps[:, p] // len(AROUND)] += AROUND[steps[:, p] % len(AROUND)]
            probed[:, t, p] = numbered(moved.reshape(n, size), seed)
    return home, probed


def numbered(points: np.ndarray, seed: np.uint64) -> np.ndarray:
    doubled = (points * 2).astype(np.int64).view(np.uint64)
    key = np.full(len(points), mixed(np.array([seed + np.uint64(1)]))[0], np.uint64)
    for k in range(points.shape[1]):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + doubled[:, k])
    return key


def meeting(home: np.ndarray, probed: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The one cell in which each pair counts: in the first table where the two share a home, or one probes the other's;
    where both do, the smaller number. 0 if they never meet."""
    out = np.zeros(len(i), np.uint64)
    left = np.arange(len(i))
    none = np.uint64(2**64 - 1)
    for t in range(home.shape[1]):
        a, b = home[i[left], t], home[j[left], t]
        best = np.where(a == b, a, none)
        for p in range(probed.shape[2]):
            best = np.minimum(best, np.where(probed[i[left], t, p] == b, b, none))
            best = np.minimum(best, np.where(probed[j[left], t, p] == a, a, none))
        out[left] = np.where(best == none, np.uint64(0), best)
        left = left[best == none]
        if not len(left):
            break
    return out


@lru_cache(maxsize=64)
def chance(dim: int, scale: float, blocks: int, threshold: float) -> float:
    """Share of pairs of unit vectors at the threshold that meet in one table, by a simulation of 2,000 pairs."""
    rng, n = np.random.default_rng(5), 2000
    u, w = rng.normal(size=(2, n, dim))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w -= (w * u).sum(axis=1, keepdims=True) * u
    w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-300)
    v = threshold * u + (1 - threshold**2) ** 0.5 * w
    plan = Plan(dim, scale, blocks, 1)
    home, probed = (np.concatenate(x) for x in zip(cells(sketches(u, plan), plan), cells(sketches(v, plan), plan), strict=True))
    return float((meeting(home, probed, np.arange(n), np.arange(n) + n) != 0).mean())


@lru_cache(maxsize=64)
def plan_for(n: int, dim: int, threshold: float) -> Plan:
    """The cheapest plan that lets RECALL of the pairs at the threshold meet: finer cells for more vectors, and as many
    tables as their chance of meeting calls for. Costs are rows sent, and members compared in a cell of evenly spread
    vectors."""
    best = None
    for blocks, scale in product(BLOCKS, SCALES):
        p = min(0.999, chance(dim, scale, blocks, threshold))
        if p < 0.05:
            continue
        tables = ceil(log(1 - RECALL) / log(1 - p))
        held = n / max(1.0, (4 * pi * scale**2 / max(dim, 8)) ** (4 * blocks))
        cost = tables * (1 + PROBES) * (1 + held / 50)
        if best is None or cost < best[0]:
            best = cost, Plan(dim, scale, blocks, tables)
    return best[1]


def near_vectors(vectors: DataFrame, embedding: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors: near duplicates by cosine >= threshold (0.5 to 1).

    n_links counts the other rows at the threshold or above, equal ones included; component_id is the smallest vec_id
    that links reach, kept tells vec_id = component_id. Rows without a vec_id, and vectors that are null, empty, zero,
    or hold a null or a component that isn't finite, link with nothing: 0 links, themselves as component. Vectors meet
    those of equal length only. Repeated rows and equal vectors count each for itself; no rows: no rows. Other
    columns are not read.

    Equal vectors go on as one. Each is rotated; every table decodes 8 (or 16, 24) coordinates of its own to lattice
    points, whose cell is its home, and it visits the PROBES cells whose points are next nearest. Cells get only
    sketches (the rotated coordinates of all tables); these rule pairs out by the Cauchy-Schwarz bound, without loss.
    Members that are left meet once more with their vectors, and the cosine decides. A pair that meets in several
    cells counts in one of them (meeting()). Hot cells are dealt in blocks; all pairs of a cell are compared, none is
    capped and none becomes a row: a cell gives each member's links and a member that it is connected with. What may
    be missed are pairs that meet in no table: by simulation fewer than 1 - RECALL of those at the threshold itself.
    """
    rows = _rows(vectors, embedding, threshold)
    dims = {r["dim"]: r["n"] for r in rows.where("dim > 0").groupBy("dim").agg(F.count("*").alias("n")).collect()}
    plans = {d: plan_for(n, d, threshold) for d, n in dims.items()}
    kind = "<f8" if vectors.schema[embedding].dataType.elementType.typeName() == "double" else "<f4"
    known = stored(_sketched(rows, plans, kind))
    points = known.where("node IS NOT NULL").groupBy("node").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vector").alias("vector"), F.first("sketch").alias("sketch"), F.first("dim").alias("dim")
    )
    points = stored(points)
    found = _links(points, plans, threshold, kind)
    linked = stored(components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))))
    named = linked.join(points.select("node", "rep"), "node")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = join_anew(named, least, ["component"]).select("node", "component_id")
    facts = points.select("node", "rep", "n").join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(classes, "node", "left")
    facts = facts.where("n > 1 OR links IS NOT NULL").select(
        "node", F.coalesce("component_id", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")
    )
    told = join_anew(known.select("vec_id", "node"), stored(facts), ["node"], "left")
    component = F.coalesce("component_id", "vec_id")
    return told.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _rows(vectors: DataFrame, embedding: str, threshold: float) -> DataFrame:
    """vec_id, vector, dim: the number of components, 0 where the vector links with nothing."""
    if not 0.5 <= threshold <= 1:
        raise ValueError("threshold must be from 0.5 to 1")
    v = F.col(embedding)
    fine = F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.forall(v, _finite) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector"), F.when(fine, F.size(v)).otherwise(0).alias("dim"))


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1, in doubles; the largest component is scaled first, so that no square overflows."""
    v = v.astype(float)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _sketched(rows: DataFrame, plans: dict[int, Plan], kind: str) -> DataFrame:
    def run(batches):
        for b in batches:
            dim = np.asarray(b["dim"])
            node, vector, sketch = ([None] * len(dim) for _ in range(3))
            for d in np.unique(dim[dim > 0]).tolist():
                at = np.flatnonzero(dim == d)
                values = np.asarray(b["vector"].take(pa.array(at)).flatten()).astype(kind).reshape(len(at), d) + 0.0
                for k, v, s in zip(at.tolist(), values, sketches(_unit(values), plans[d]), strict=True):
                    vector[k], sketch[k] = v.tobytes(), s.tobytes()
                    node[k] = blake2b(vector[k], digest_size=16).digest()
            arrays = [b["vec_id"], b["dim"], *(pa.array(x, pa.binary()) for x in (node, vector, sketch))]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "dim", "node", "vector", "sketch"])

    return rows.mapInArrow(run, "vec_id long, dim int, node binary, vector binary, sketch binary")


def _links(points: DataFrame, plans: dict[int, Plan], threshold: float, kind: str) -> DataFrame:
    """node, links, root of each point in each cell where it has links."""

    def celled(columns: tuple[str, ...]):
        def run(batches):
            for b in batches:
                dim = np.asarray(b["dim"])
                for d in np.unique(dim).tolist():
                    at = np.flatnonzero(dim == d)
                    own = b.take(pa.array(at))
                    home, probed = cells(fixed(own["sketch"], "<i4"), plans[d])
                    every = np.concatenate([home[:, :, None], probed], axis=2).reshape(len(at), -1)
                    at_home = np.zeros(every.shape, bool).reshape(len(at), home.shape[1], -1)
                    at_home[:, :, 0] = True
                    out = {"cell": pa.array(every.reshape(-1).view(np.int64)), "home": pa.array(at_home.reshape(-1))}
                    again = pa.array(np.repeat(np.arange(len(at)), every.shape[1]))
                    out |= {c: own[c].take(again) for c in ("node", "sketch", "dim") if c in columns}
                    yield from pa.table({c: out[c] for c in columns}).to_batches(max_chunksize=20_000)

        return run

    light = points.select("dim", "sketch").mapInArrow(celled(("cell",)), "cell long")
    heavy = points.select("dim", "node", "sketch").mapInArrow(celled(("cell", "home", "node", "sketch", "dim")), "cell long, home boolean, node binary, sketch binary, dim int")
    members = placed(heavy, light, "node")

    def counted(columns: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs count in their own cell."""
        if not len(i):
            return np.zeros(0, bool)
        used, places = np.unique(np.concatenate([i, j]), return_inverse=True)
        d = columns["dim"][int(used[0])].as_py()
        home, probed = cells(fixed(columns["sketch"].take(pa.array(used)), "<i4"), plans[d])
        at = meeting(home, probed, places[: len(i)], places[len(i) :])
        return at == np.asarray(columns["cell"])[i].view(np.uint64)

    def by_length(columns: dict, starts: np.ndarray):
        """The rows of groups of one length of vectors at a time; cells never mix lengths."""
        dim = np.asarray(columns["dim"])
        sizes = np.diff(np.append(starts, len(dim)))
        for d in np.unique(dim).tolist():
            which = dim[starts] == d
            at = pa.array(np.flatnonzero(np.repeat(which, sizes)))
            yield d, {c: x.take(at) for c, x in columns.items()}, np.concatenate([[0], np.cumsum(sizes[which])[:-1]]).astype(int)

    def possible(columns: dict, starts: np.ndarray) -> dict:
        outs = []
        for d, own, begins in by_length(columns, starts):
            x = fixed(own["sketch"], "<i4").astype(np.float32) / UNIT
            rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", x, x)))
            keep = np.zeros(len(x), bool)
            for i, j in pairs(own, begins):
                left = np.einsum("ij,ij->i", x[i], x[j]) + rest[i] * rest[j] >= threshold - SLACK
                i, j = i[left], j[left]
                counts = counted(own, i, j)
                keep[i[counts]] = keep[j[counts]] = True
            at = pa.array(np.flatnonzero(keep))
            outs.append(pa.table({c: v.take(at) for c, v in own.items()}))
        table = pa.concat_tables(outs)
        return {c: table[c] for c in columns}

    def exact(columns: dict, starts: np.ndarray) -> dict:
        nodes, links, roots = [], [], []
        for d, own, begins in by_length(columns, starts):
            unit, copies = _unit(fixed(own["vector"], kind)), np.asarray(own["n"])
            sums, sets = np.zeros(len(unit)), Roots(len(unit))
            for i, j in pairs(own, begins):
                near = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
                i, j = i[near], j[near]
                counts = counted(own, i, j)
                i, j = i[counts], j[counts]
                sums += np.bincount(i, copies[j], len(unit)) + np.bincount(j, copies[i], len(unit))
                sets.unite(i, j)
            at = np.flatnonzero(sums)
            nodes.append(own["node"].take(pa.array(at)))
            links.append(sums[at].astype(np.int64))
            roots.append(own["node"].take(pa.array(sets.of[at])))
        return {"node": pa.chunked_array(nodes, pa.binary()), "links": np.concatenate(links), "root": pa.chunked_array(roots, pa.binary())}

    left = judged(members, possible, "cell long, home boolean, node binary, sketch binary, dim int, lo int, hi int, side int")
    left = stored(left)
    whole = left.join(points.select("node", "vector", "n"), "node").select(*PLACE, "home", "node", "sketch", "dim", "vector", "n")
    return stored(judged(whole, exact, "node binary, links long, root binary"))
