"""Ranked lexical search (operator 11): item vocabulary tiles times document impact tiles as dense float64 products."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Bytes of items' texts that one pass over the documents serves, items of a tile, documents of a tile, and the widest
#: part of a tile's vocabulary that is multiplied at once.
GROUP_BYTES, ITEMS, DOCS, WIDTH = 8 << 20, 64, 256, 4096
#: Whole numbers up to here are exact in float64.
EXACT = 1 << 53
#: A term's part of a score before its weight: below IMPACT for any document.
IMPACT = 1_000_000
SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes(32 if c in SEPARATORS and not 65 <= c <= 90 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and all characters beyond ASCII, in UTF-8; only A-Z are lower-cased."""
    return (text or "").encode().translate(_TABLE).split()


def counted(texts: list[str | None], known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text, and (text, number of a known term, occurrences) as three arrays."""
    lengths, found = np.zeros(len(texts), np.int64), []
    for k, text in enumerate(texts):
        terms = terms_of(text)
        lengths[k] = len(terms)
        found.append(np.fromiter(map(known.get, terms, repeat(-1)), np.int64, len(terms)))
    owner, term = np.repeat(np.arange(len(texts)), lengths), np.concatenate(found) if found else np.zeros(0, np.int64)
    key, tf = np.unique((owner * (len(known) or 1) + term)[term >= 0], return_counts=True)
    return lengths, key // (len(known) or 1), key % (len(known) or 1), tf


def weight(n_docs: int, df: int) -> int:
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


class Tile:
    """Some items, the vocabulary that they use, and their weights as a matrix, cut so that no sum reaches 2^53."""

    def __init__(self, items: list[set[int]], weights: np.ndarray):
        self.columns = np.array(sorted(set().union(*items)), np.int64)
        place = {c: k for k, c in enumerate(self.columns.tolist())}
        self.matrix = np.zeros((len(items), len(self.columns)))
        for row, item in enumerate(items):
            at = sorted(item)
            self.matrix[row, [place[c] for c in at]] = weights[at]
        most = int(weights[self.columns].max(initial=1))
        self.width = max(1, min(WIDTH, (EXACT - 1) // (max(1, most) * IMPACT)))

    def scores(self, n: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray) -> np.ndarray:
        """items x n scores: a dense product for each part of the vocabulary, added up as 64-bit integers."""
        total = np.zeros((len(self.matrix), n), np.int64)
        if not len(self.columns):
            return total
        at = np.minimum(np.searchsorted(self.columns, term), len(self.columns) - 1)
        own = self.columns[at] == term
        doc, at, impact = doc[own], at[own], impact[own]
        for begin in range(0, len(self.columns), self.width):
            upto = min(begin + self.width, len(self.columns))
            part = (at >= begin) & (at < upto) if self.width < len(self.columns) else slice(None)
            dense = np.zeros((upto - begin, n))
            dense[at[part] - begin, doc[part]] = impact[part]
            total += (self.matrix[:, begin:upto] @ dense).astype(np.int64)
        return total


class Best:
    """The k best documents of each item so far: highest score first, then smallest doc_id."""

    def __init__(self, items: int, k: int):
        self.k, self.score, self.doc = k, np.zeros((items, k), np.int64), np.zeros((items, k), np.int64)

    def add(self, first: int, scores: np.ndarray, docs: np.ndarray) -> None:
        """A tile's scores of the items from `first` on. Of a tile all documents that reach the item's k-th score stay,
        ties at the tile's own k-th included, so none is lost to one with a larger doc_id."""
        floors = np.maximum(self.score[first : first + len(scores), -1], 1)
        reached = scores >= floors[:, None]
        for row in np.flatnonzero(reached.any(axis=1)).tolist():
            at = np.flatnonzero(reached[row])
            if len(at) > self.k:
                own = scores[row, at]
                at = at[own >= np.partition(own, len(own) - self.k)[len(own) - self.k]]
            s, d = np.append(self.score[first + row], scores[row, at]), np.append(self.doc[first + row], docs[at])
            order = np.lexsort((d, -s))[: self.k]
            self.score[first + row], self.doc[first + row] = s[order], d[order]


def _tiles(docs: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[str | None]]]:
    """(doc_ids, texts) of DOCS documents or of a few million characters."""
    for b in docs:
        ids = np.asarray(b["doc_id"].fill_null(0))
        at, held = 0, 0
        size = np.asarray(pc.binary_length(b["text"]).fill_null(0)).tolist()
        for k, own in enumerate(size):
            if k > at and (k - at >= DOCS or held + own > 4 << 20):
                yield ids[at:k], b["text"].slice(at, k - at).to_pylist()
                at, held = k, 0
            held += own
        if at < b.num_rows:
            yield ids[at:], b["text"].slice(at).to_pylist()


def ranked_search(items: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: for each item (item_id, text) the k documents (doc_id, text) that score
    highest, those of score 0 never, equal scores by smaller doc_id.

    With N documents that have terms, L terms in all, n in a document, df documents that hold a term and tf its
    occurrences: m = 10 + (90 n N) div L, a term's weight floor(1000 ln((2N + 2) / (2 df + 1))), and a score the sum of
    weight * (10^9 tf div (1000 tf + 8 m)) over the item's different terms. Numbers must fit: 90 n N below 2^63.

    Null or empty texts have no terms: such documents don't count and aren't found, such items have no rows. Rows with
    a null doc_id count in N, L and df but are never returned; rows with a null item_id are ignored; rows of one
    item_id are one item with the terms of all; rows of one doc_id are documents each for itself and may both be
    found. No documents or no items: no rows.

    Items are a stated query set. They are dealt by hash into groups of about GROUP_BYTES of text; each group's terms
    go with the tasks (a size bounded by it and one item), and the documents stay where they are read: a first pass
    counts, a second multiplies and keeps k documents of each item per task, and only these meet by item. Products of
    whole numbers below 2^53 are exact in float64; wider vocabularies are multiplied in parts (Tile).
    """
    asked = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes")).first()["bytes"]
    groups = max(1, -(-size // GROUP_BYTES))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for g in range(groups):
        own: dict[int, set[bytes]] = {}
        for r in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).toLocalIterator():
            own.setdefault(r["item_id"], set()).update(terms_of(r["text"]))
        found = _search(read, {i: t for i, t in own.items() if t}, k)
        out = found if out is None else out.union(found)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return out.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search(docs: DataFrame, items: dict[int, set[bytes]], k: int) -> DataFrame:
    """item_id, doc_id, score: the k best of each task."""
    schema = "item_id long, doc_id long, score long"
    known = {t: c for c, t in enumerate(sorted(set().union(*items.values())))} if items else {}

    def count(batches):
        n_docs, n_terms, df = 0, 0, np.zeros(len(known), np.int64)
        for _, texts in _tiles(batches):
            lengths, _, term, _ = counted(texts, known)
            n_docs += int((lengths > 0).sum())
            n_terms += int(lengths.sum())
            df += np.bincount(term, minlength=len(known))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *at.tolist()], pa.int64()), pa.array([n_docs, n_terms, *df[at].tolist()], pa.int64())], names=["what", "n"])

    sums = {r["what"]: r["n"] for r in docs.mapInArrow(count, "what long, n long").groupBy("what").agg(F.sum("n").alias("n")).collect()} if known else {}
    n_docs, n_terms = sums.get(-2) or 0, sums.get(-1) or 0
    if not n_terms:
        return docs.sparkSession.createDataFrame([], schema)
    weights = np.array([weight(n_docs, sums.get(c, 0)) for c in range(len(known))], np.int64)
    held = {i: {known[t] for t in terms if known[t] in sums} for i, terms in sorted(items.items())}
    ids = np.array([i for i, terms in held.items() if terms], np.int64)

    def search(batches):
        tiles = [(a, Tile([held[i] for i in ids[a : a + ITEMS].tolist()], weights)) for a in range(0, len(ids), ITEMS)]
        best = Best(len(ids), k)
        for doc_ids, texts in _tiles(batches):
            lengths, doc, term, tf = counted(texts, known)
            m = 10 + 90 * lengths * n_docs // n_terms
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
            for first, tile in tiles:
                best.add(first, tile.scores(len(texts), doc, term, impact), doc_ids)
        row, at = np.nonzero(best.score)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[row], best.doc[row, at], best.score[row, at])], names=["item_id", "doc_id", "score"])

    return docs.where("doc_id IS NOT NULL").mapInArrow(search, schema)
