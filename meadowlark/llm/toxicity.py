"""Toxicity (operator 7): a linear classifier of character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

GRAMS = (4, 5, 6)
BITS = 22
#: Most labelled rows of either class that the classifier is fitted on, by order of a hash of doc_id.
MOST_TOXIC, MOST_CLEAN = 1200, 1800
#: Most bytes of text that these rows have together, by class; a row of more than a hundredth of that isn't learned from.
MOST_BYTES = 64_000_000
SPACE = re.compile(r"\s+")


def grams(text: str | None) -> np.ndarray:
    """Hashed character n-grams of the lower-cased text, white space as one space, with repeats."""
    cased = SPACE.sub(" ", f" {(text or '').lower()} ")
    c = np.frombuffer(cased.encode("utf-32-le", "replace"), np.uint32)
    h, out = c, []
    for n in range(2, max(GRAMS) + 1):
        if len(c) < n:
            break
        h = h[:-1] * np.uint32(0x01000193) + c[n - 1 :]
        if n in GRAMS:
            z = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1 + 2 * n)
            out.append(z >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


@dataclass(frozen=True)
class Model:
    """Weights of the n-grams that matter, and the intercept. Pickled with the function that uses it."""

    places: bytes
    weights: bytes
    bias: float
    dense: list = field(default_factory=list, compare=False)

    def __getstate__(self) -> dict:
        return {"places": self.places, "weights": self.weights, "bias": self.bias, "dense": []}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)

    def score(self, text: str | None) -> float:
        if not self.dense:
            weight = np.zeros(1 << BITS, np.float32)
            weight[np.frombuffer(self.places, np.uint32)] = np.frombuffer(self.weights, np.float32)
            self.dense.extend((weight, weight != 0))
        weight, telling = self.dense
        found = grams(text)
        found = np.unique(found[telling[found]])
        z = self.bias + float(weight[found].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[np.ndarray], toxic: np.ndarray, least_rows: int = 4, least_ratio: float = 2.0, ridge: float = 1e-4, rounds: int = 300, cut: float = 0.7) -> Model:
    """Fits on n-gram sets. The log-count ratio of an n-gram compares how often each class has it; features are
    presence times ratio; n-grams in fewer than least_rows rows or with a ratio below least_ratio are left out.
    Logistic loss with a ridge, by accelerated gradient descent; then the intercept moves so that the gap between the
    classes, if there is one, lies around the score `cut`. With one class only the score is constant."""
    toxic = np.asarray(toxic, np.float64)
    if not len(rows) or toxic.min() == toxic.max():
        return Model(b"", b"", 5.0 if len(rows) and toxic.min() == 1 else -5.0)
    size = 1 << BITS
    count = np.zeros((2, size), np.float32)
    for row, label in zip(rows, toxic, strict=True):
        count[int(label), row] += 1
    (q, p), n, m = count, toxic.sum(), (1 - toxic).sum()
    ratio = np.log((p + 0.5) / (n + 1)) - np.log((q + 0.5) / (m + 1))
    chosen = np.flatnonzero((p + q >= least_rows) & (np.abs(ratio) >= least_ratio))
    column = np.full(size, -1, np.int32)
    column[chosen] = np.arange(len(chosen))
    kept = [c[c >= 0] for c in (column[row] for row in rows)]
    col, own = np.concatenate(kept), np.repeat(np.arange(len(rows), dtype=np.int32), [len(c) for c in kept])
    r = ratio[chosen].astype(np.float64)
    value = r[col]
    w, b, vw, vb = np.zeros(len(chosen)), np.log(n / m), np.zeros(len(chosen)), 0.0
    step = len(rows) / 50 * 4.0 / (np.bincount(own, value * value, len(rows)).max() + 1)
    for k in range(rounds):
        momentum = k / (k + 3)
        aw, ab = w + momentum * vw, b + momentum * vb
        z = np.bincount(own, value * aw[col], len(rows)) + ab
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic
        nw = aw - step * (np.bincount(col, value * g[own], len(chosen)) / len(rows) + ridge * aw)
        nb = ab - 0.5 * g.mean()
        vw, vb, w, b = nw - w, nb - b, nw, nb
    final = (w * r).astype(np.float32)
    told = np.abs(final) >= 0.01 * np.abs(final).max()
    z = np.bincount(own, np.where(told, final, 0)[col], len(rows)) + b
    clean, bad = np.quantile(z[toxic == 0], 0.999), np.quantile(z[toxic == 1], 0.005)
    if bad > clean:  # the classes part: the middle of the gap gets the score cut
        b += np.log(cut / (1 - cut)) - (clean + bad) / 2
    return Model(chosen[told].astype(np.uint32).tobytes(), final[told].tobytes(), float(b))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, most_bytes: int = MOST_BYTES) -> Model:
    """Fits on at most most_toxic and most_clean labelled rows that aren't held out, most_bytes of either class: those
    with the least hashes of doc_id. Their n-gram sets (no more numbers than characters times n-gram sizes) meet in
    one task, which fits; the driver gets the weights. Texts that are scored have no such bound."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("order", F.xxhash64("doc_id"))
    chosen = known.where("toxic = 1").orderBy("order", "doc_id").limit(most_toxic).union(known.where("toxic = 0").orderBy("order", "doc_id").limit(most_clean))

    @F.arrow_udf("binary")
    def sets(texts: pa.Array) -> pa.Array:
        return pa.array([np.unique(grams(x)).tobytes() for x in texts.to_pylist()], pa.binary())

    def fitted(batches):
        ids, toxic, rows = [], [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            toxic += b.column(1).to_pylist()
            rows += [np.frombuffer(x.as_buffer(), np.uint32) for x in b.column(2)]  # views of the batch, no copies
        order = sorted(range(len(ids)), key=lambda k: (ids[k], len(rows[k]), rows[k].tobytes()[:64]))
        m = fit([rows[k] for k in order], np.array([toxic[k] for k in order]))
        yield pa.RecordBatch.from_arrays([pa.array([m.places]), pa.array([m.weights]), pa.array([m.bias])], names=["places", "weights", "bias"])

    # at most most_toxic + most_clean short rows: a proven bound for the broadcasts and the window
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    sized = docs.select("doc_id", size.alias("size")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic", "order").agg(F.sum("size").alias("size")).where(F.col("size") <= most_bytes // 100)
    so_far = F.sum("size").over(Window.partitionBy("toxic").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    allowed = sized.withColumn("so_far", so_far).where(F.col("so_far") <= most_bytes).select("doc_id", "toxic")
    sample = docs.select("doc_id", "text").join(F.broadcast(allowed), "doc_id")
    got = sample.select("doc_id", "toxic", sets(F.col("text")).alias("grams")).repartition(1).mapInArrow(fitted, "places binary, weights binary, bias double").first()
    return Model(bytes(got["places"]), bytes(got["weights"]), got["bias"]) if got else fit([], np.zeros(0))


def toxicity_score(text: Column, model: Model) -> Column:
    """Score of each whole text, 0 to 1, higher: likelier toxic; null and empty texts get the intercept's."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(x) for x in texts.to_pylist()], pa.float64())

    return score(text)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """docs (doc_id, text and any other columns; clashing ones are replaced) with held_out, score and predicted
    (1 from the threshold on). Learns from labels that aren't held out; the text is a score's only input. Null
    doc_id: never trained on, not held out."""
    model = train(docs, labels)
    scored = docs.withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False))).withColumn("score", toxicity_score(F.col("text"), model))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
