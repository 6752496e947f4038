"""N-gram Jaccard join (operator 6) with Bayesian pruning of candidates (BayesLSH) and exact verification."""

from __future__ import annotations

from fractions import Fraction
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_anew, stored
from .components import components
from .hashing import Joined, digest, joined, mixed, windows, words_of

#: Bands of equal MinHash values make candidates: at a similarity of 0.8 a pair shares none of 36 bands of 5 with a
#: probability of 6e-7, and less above.
BANDS, ROWS = 36, 5
#: MinHash values compared at a time, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 30, 1e-6
#: Texts, and bytes of their words, of one block of a large candidate group.
BLOCK, BLOCK_BYTES = 256, 2_000_000


@lru_cache(maxsize=1)
def family() -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and masks of the MinHash functions, fixed for good."""
    seeds = (mixed(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
    return seeds[: BANDS * ROWS, None] | np.uint32(1), seeds[BANDS * ROWS :, None]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values of 32 bits, a row for each set of hashes; of an empty set the largest number."""
    a, b = family()
    least = np.full((len(a), len(sets)), np.iinfo(np.uint32).max, np.uint32)
    own = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32) if sets else own
    for k in range(0, len(values), 1024):
        part = values[None, k : k + 1024] * a
        part ^= b
        here = own[k : k + 1024]
        begin = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]]))
        of = here[begin]
        least[:, of] = np.minimum(least[:, of], np.minimum.reduceat(part, begin, axis=1))
    return np.ascontiguousarray(least.T)


def shingles(texts: Joined, n: int) -> list[np.ndarray]:
    """Of each text the distinct hashes of its runs of n words; of fewer words, of all together; of none, none."""
    every, out = windows(texts.hashes, n), []
    for k, words in enumerate(texts.words):
        if len(words) >= n:
            out.append(np.unique(texts.of(every, k, n)))
        else:
            out.append(windows(texts.hashes[texts.starts[k] : texts.starts[k + 1]], len(words)) if words else np.zeros(0, np.uint64))
    return out


#: Where a text is compared: its group or bucket, the two blocks that meet there and its own of them, and the task.
PLACE = ["content", "component", "band", "lo", "hi", "side", "cell"]


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A key of each band of each row of MinHash values."""
    rows = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
    for k in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
    return key


@lru_cache(maxsize=8)
def least_matches(threshold: float) -> dict[int, int]:
    """After n compared values, the fewest matches at which the posterior probability that the similarity reaches the
    threshold is TOLERANCE at least. Under a uniform prior the posterior is a Beta distribution, whose upper tail is
    a binomial sum: P(similarity >= t | m of n) = P(Binomial(n + 1, t) <= m)."""
    t, out = Fraction(str(threshold)), {}
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        below, m = Fraction(0), 0
        while True:
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= TOLERANCE:
                break
            m += 1
        out[n] = m
    return out


def likely(sig: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (i, j) that the comparison of more and more MinHash values doesn't rule out."""
    found = np.zeros(len(i), np.int32)
    for n, least in least_matches(threshold).items():
        if not len(i):
            break
        found += (sig[i, n - STEP : n] == sig[j, n - STEP : n]).sum(axis=1, dtype=np.int32)
        keep = found >= least
        i, j, found = i[keep], j[keep], found[keep]
    return i, j


def numbered(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The n-word shingles of each text of words, as numbers given to the words themselves: equal numbers, equal words."""
    known: dict[bytes, int] = {}
    out = []
    for text in texts:
        gaps = [k for k, c in enumerate(text) if c == 32] if len(text) < 200 else np.flatnonzero(np.frombuffer(text, np.uint8) == 32).tolist()
        starts, ends = [0, *(k + 1 for k in gaps)], [*gaps, len(text)]
        m = min(n, len(starts))
        out.append(np.array(sorted({known.setdefault(text[a:b], len(known)) for a, b in zip(starts, ends[m - 1 :], strict=False)}), np.int64))
    return out


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over the values that two sets share at least."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[place]
    owner, rank = owner[rank >= 0], rank[rank >= 0]
    order = np.argsort(rank, kind="stable")
    owner, rank = owner[order], rank[order]
    total, width = np.zeros((len(sets), len(sets))), 4096
    for k in range(0, int(rank[-1]) + 1 if len(rank) else 0, width):
        lo, hi = np.searchsorted(rank, [k, k + width])
        x = np.zeros((len(sets), width), np.float32)
        x[owner[lo:hi], rank[lo:hi] - k] = 1
        total += x @ x.T
    return total.astype(np.int64)


def candidates(cell: pd.DataFrame, threshold: float, band: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of one block (same) or two that sizes and MinHash values leave. Of two, only pairs across are
    compared, so there are none if either is empty. From a bucket of a band, a pair is judged only if it shares no
    earlier one (band -1: every pair)."""
    side, size = cell["side"].to_numpy(), cell["size"].to_numpy()
    near = np.minimum(size[:, None], size[None, :]) >= threshold * np.maximum(size[:, None], size[None, :])
    near &= np.triu(np.ones(near.shape, bool), 1) if same else (side[:, None] == 0) & (side[None, :] == 1)
    i, j = np.nonzero(near)
    if band > 0 and len(i):
        keys = np.stack(cell["bands"].to_numpy())[:, :band]
        for k in range(band):
            new = keys[i, k] != keys[j, k]
            i, j = i[new], j[new]
    if not len(i):
        return i, j
    return likely(np.stack([np.frombuffer(x, np.uint16) for x in cell["sig"]]), i, j, threshold)


def compare(cell: pd.DataFrame, n: int, threshold: float, band: int, same: bool) -> list[tuple[bytes, int, bytes]]:
    """(content, links, least content reached) of the texts of one block (same) or two that have links here."""
    cell = cell.drop_duplicates("content").sort_values(["content"])
    i, j = candidates(cell, threshold, band, same)
    if not len(i):
        return []
    used, places = np.unique(np.concatenate([i, j]), return_inverse=True)
    sets = numbered([cell["words"].iat[k] for k in used], n)
    exact, i_at, j_at = np.array([len(s) for s in sets]), places[: len(i)], places[len(i) :]
    shared = intersections(sets)[i_at, j_at]
    t = Fraction(str(threshold))
    true = shared * t.denominator >= t.numerator * (exact[i_at] + exact[j_at] - shared)
    i, j = i[true], j[true]
    copies, content = cell["copies"].to_numpy(), cell["content"].to_numpy()
    links = np.bincount(i, copies[j], len(copies)) + np.bincount(j, copies[i], len(copies))
    root = np.arange(len(copies))  # in order of content, so the least place is the least content
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (root == before).all():
            break
    own = np.unique(np.concatenate([i, j]))
    return [(content[k], int(links[k]), content[root[k]]) for k in own.tolist()]


def similar_documents(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, rep_id, class_id, n_links for each row of docs (doc_id, text): near duplicates by Jaccard similarity of
    the sets of n-word shingles (words [^\\x20\\x09-\\x0D]+, unchanged), at least threshold.

    rep_id is the smallest doc_id with the same words, class_id the smallest doc_id of the documents that links
    connect, n_links the number of other documents that are similar enough, copies included. Null or empty text: no
    shingles, a class of its own, no links. Fewer than n words: one shingle of all. Null doc_id: null class, 0 links.
    Rows with one doc_id count as one document each when copies are counted; with different texts they share a class.

    Copies meet by their words' digest and go on as one, so each different text is compared once, whatever its
    doc_ids. Texts that share a MinHash band are candidates. Star links to the smallest of each bucket connect
    candidates to groups (two aggregates and a join, no pairs). A group that fills one block at most is compared as a
    whole inside a task. A larger one is compared in blocks by blocks, or by its buckets, a pair in the first one that
    it shares, whichever sends its texts to fewer places; so unlike texts that chains of chance bands connect cost
    what their buckets cost. No pair is ever a row: a task gives each text's links and the least text it reached.
    MinHash values only rule pairs out; a pair that is left is verified by its shingles' words. Nothing is capped; the
    tolerance and the number of bands only bound the chance of missing a true pair.
    """

    def sketch(batches):
        for b in batches:
            ids, contents, lengths, sizes, keys, sigs = b.column(0).to_pylist(), [], [], [], [], []
            for _, j in joined(b.column(1).to_pylist()):
                sets = shingles(j, n)
                sig = signatures(sets)
                bands, low = band_keys(sig).view(np.int64), sig.astype(np.uint16)
                for k, words in enumerate(j.words):
                    whole = b" ".join(words)
                    contents.append(digest(whole) if words else None)
                    lengths.append(len(whole))
                    sizes.append(len(sets[k]))
                    keys.append(bands[k] if words else None)
                    sigs.append(low[k].tobytes() if words else None)
            arrays = [pa.array(ids, pa.int64()), pa.array(contents, pa.binary()), pa.array(lengths, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "content", "bytes", "size", "bands", "sig"])

    known = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = stored(known.mapInArrow(sketch, "doc_id long, content binary, bytes long, size long, bands array<long>, sig binary"))
    contents = stored(sketches.where("content IS NOT NULL").groupBy("content").agg(F.min("doc_id").alias("rep_id"), F.count("*").alias("copies")))
    # the rows of a content agree in all but doc_id, so any one of them will do
    reps = sketches.join(contents.withColumnRenamed("rep_id", "doc_id"), ["content", "doc_id"]).dropDuplicates(["content"]).withColumn("node", node_of(F.col("content")))
    banded = reps.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("band", "lo")
    linked = components(join_anew(banded, buckets, ["band"]).where("node > lo").select(F.col("node").alias("a"), F.col("lo").alias("b")))
    members = stored(reps.join(stored(linked), "node").select("content", "doc_id", "bytes", "size", "copies", "bands", "sig", "component"))

    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES))
    groups = stored(members.groupBy("component").agg(blocks.alias("blocks"), F.count("*").alias("n"), F.sum("bytes").alias("bytes")))
    large = groups.where("blocks > 1")
    by_band = members.join(large.select("component"), "component").select("component", "bytes", F.explode("bands").alias("band"))
    bucketed = stored(by_band.groupBy("band").agg(F.min("component").alias("component"), blocks.alias("blocks"), F.count("*").alias("n"), F.sum("bytes").alias("bytes")).where("n > 1"))
    cost = bucketed.groupBy("component").agg(F.sum(F.col("n") * F.col("blocks")).alias("sent"))
    by_bands = (F.col("blocks") > 1) & (F.coalesce("sent", F.lit(0)) < F.col("n") * F.col("blocks"))
    ways = stored(groups.join(cost, "component", "left").select("component", "blocks", "n", "bytes", by_bands.alias("by_band")))

    # a task's group: one pair of blocks of a large group or bucket, or small ones that are about a block together
    small = ways.where("NOT by_band").union(bucketed.select("component", "blocks", "n", "bytes", F.lit(True))).where("blocks = 1")
    totals = small.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    few = F.lit(max(1, totals[0] // BLOCK_BYTES, totals[1] // BLOCK))
    told = members.join(ways.select("component", "blocks", "by_band"), "component")
    whole = told.where("NOT by_band").select("content", "component", F.lit(-1).alias("band"), "blocks")
    split = told.where("by_band").select("content", F.posexplode("bands").alias("band", "key"))
    split = join_anew(split, bucketed.select(F.col("band").alias("key"), "blocks"), ["key"]).select("content", F.col("key").alias("component"), "band", "blocks")
    own = F.pmod(F.xxhash64("content"), F.col("blocks"))
    places = whole.union(split).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    cell = F.when(F.col("blocks") > 1, F.xxhash64("component", "band", lo, hi)).otherwise(F.pmod(F.xxhash64("component", "band"), few))
    places = places.select("content", "component", "band", lo.alias("lo"), hi.alias("hi"), (F.col("own") != lo).cast("int").alias("side"), cell.alias("cell"))

    def worded(batches):
        for b in batches:
            words = [b" ".join(words_of(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([digest(w) for w in words], pa.binary()), pa.array(words, pa.binary())], names=["content", "words"])

    def prune(pdf: pd.DataFrame) -> pd.DataFrame:
        """The rows that have a pair left in their group."""
        out = [pdf.iloc[:0]]
        for (_, band, lo, hi), part in pdf.groupby(["component", "band", "lo", "hi"], sort=False):
            part = part.drop_duplicates("content")
            if len(part) > 1 and len(pair := np.concatenate(candidates(part, threshold, band, lo == hi))):
                out.append(part.iloc[np.unique(pair)])
        return pd.concat(out)[PLACE]

    # a text is sent to the places of its group as sizes, bands and MinHash values, of less than 700 bytes; its words
    # follow to those where a pair is left
    sketched = places.join(members.select("content", "size", "bands", "sig"), "content")
    places = stored(sketched.groupBy("cell").applyInPandas(prune, ", ".join(f"{c} {places.schema[c].dataType.simpleString()}" for c in PLACE)))
    members = members.join(stored(places.select("content").distinct()), "content", "left_semi")

    # the texts of doc_ids that stand for a content; of a repeated doc_id also others, which no content here meets
    ids = stored(members.select("doc_id").distinct())
    texts = known.join(ids, "doc_id", "left_semi").select("text").mapInArrow(worded, "content binary, words binary").groupBy("content").agg(F.first("words").alias("words"))
    loaded = texts.join(members.select("content", "size", "copies", "bands", "sig"), "content")
    celled = places.join(loaded, "content")

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [x for (_, band, lo, hi), part in pdf.groupby(["component", "band", "lo", "hi"], sort=False) if len(part) > 1 for x in compare(part, n, threshold, band, lo == hi)]
        return pd.DataFrame(out, columns=["content", "links", "least"])

    found = stored(celled.groupBy("cell").applyInPandas(judge, "content binary, links long, least binary"))
    # texts of one doc_id are one class
    several = stored(sketches.where("content IS NOT NULL").groupBy("doc_id").agg(F.min("content").alias("first"), F.max("content").alias("last")).where("first < last").select("doc_id", "first"))
    together = sketches.join(several, "doc_id").where("content > first").select(F.col("content").alias("a"), F.col("first").alias("b"))
    classes = stored(components(found.select(F.col("content").alias("a"), F.col("least").alias("b")).union(together)).join(contents.select(F.col("content").alias("node"), "rep_id"), "node"))
    least = classes.groupBy("component").agg(F.min("rep_id").alias("class_id"))
    links = found.groupBy("content").agg(F.sum("links").alias("links"))
    facts = contents.join(links, "content", "left").join(join_anew(classes.select(F.col("node").alias("content"), "component"), least, ["component"]).drop("component"), "content", "left")
    facts = stored(facts.select("content", "rep_id", F.coalesce("class_id", "rep_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    result = join_anew(sketches.where("content IS NOT NULL").select("doc_id", "content"), facts, ["content"]).select("doc_id", "rep_id", "class_id", "n_links")
    # rows without words: alone, or in the class of their doc_id's other texts
    wordless = stored(sketches.where("content IS NULL").select("doc_id"))
    kin = sketches.where("content IS NOT NULL").join(wordless.distinct(), "doc_id", "left_semi").join(facts, "content").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    wordless = wordless.join(kin, "doc_id", "left")
    zero, null = F.lit(0).cast("long"), F.lit(None).cast("long")
    result = result.union(wordless.select("doc_id", F.col("doc_id").alias("rep_id"), F.coalesce("class_id", "doc_id"), zero))
    return result.union(docs.where(F.col("doc_id").isNull()).select(null, null, null, zero))


def node_of(content: Column) -> Column:
    """64 bits of a digest. Two contents with equal ones are only compared with each other's candidates."""
    return F.conv(F.hex(F.substring(content, 1, 8)), 16, -10).cast("long")
