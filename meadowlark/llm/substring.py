"""Substring dedup (operator 5): Rabin-Karp hashes of word windows, counted in Spark; repeated ones become intervals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_anew, named, stored
from .hashing import digest, joined, number, sliding_minimum, windows, word_hashes, words_of

#: Words of the grams by which windows are sampled; a window is known by the gram of least hash within it.
GRAM = 12


def anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window, the least hash of the grams within it. Equal windows have equal anchors, so a window can
    repeat only if its anchor does; neighbours mostly share theirs."""
    gram = min(GRAM, width)
    return sliding_minimum(windows(hashes, gram), width - gram + 1)


def as_long(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), as_long(flat))


def confirmed(words: list[bytes], starts: np.ndarray, width: int) -> list[int]:
    """Digests of the windows' own words, 64 bits."""
    if not len(starts):
        return []
    whole, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate([[0], ends[:-1] + 1])[starts].tolist()
    return [number(whole[a:b]) for a, b in zip(first, ends[starts + width - 1].tolist(), strict=True)]


def runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


def find_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """doc_id, wholes array<binary>, windows array<struct<h long, d long>>: of each document with repeated windows,
    the digests of its word sequence if a smaller doc_id has it whole, else the windows that also start under a
    smaller doc_id: Rabin-Karp hash and digest of the words.

    Windows of copies are those of the copy with the smallest doc_id, so only that one goes on. Windows whose anchor
    occurs in one document only are unique and are left out before the count. The others are counted in Spark by hash
    (61 bits) and a digest of the window's words themselves (64 bits of BLAKE2), 125 bits in all. Minima are
    aggregated before the shuffle; joins on hot windows are of a large side with one row per key, whose partitions
    adaptive execution splits.
    """

    def sketch(batches):
        for b in batches:
            ids, contents, found, doc_ids = [], [], [], b.column(0).to_pylist()
            for at, j in joined(b.column(1).to_pylist()):
                every = anchors(j.hashes, width)
                for k, words in enumerate(j.words):
                    if len(words) >= width:
                        m = j.of(every, k, width)
                        ids.append(doc_ids[at + k])
                        contents.append(digest(b" ".join(words)))
                        found.append(np.unique(m[runs(m)]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(contents, pa.binary()), lists(found)], names=["doc_id", "content", "anchors"])

    known = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = stored(known.mapInArrow(sketch, "doc_id long, content binary, anchors array<long>"))
    first = sketches.groupBy("content").agg(F.min("doc_id").alias("first"))
    no_window = F.lit(None).cast("struct<h:long,d:long>").alias("w")
    copies = join_anew(sketches.select("doc_id", "content"), first, ["content"]).where("doc_id > first").select("doc_id", "content", no_window)
    kept = sketches.join(first.select("content", F.col("first").alias("doc_id")), ["content", "doc_id"], "left_semi")
    own = kept.select("doc_id", F.explode("anchors").alias("anchor"))
    shared = own.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    chosen = join_anew(own, shared, ["anchor"]).groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))

    def candidates(batches):
        for b in batches:
            ids, one, two, doc_ids, shared_here = [], [], [], b.column(0).to_pylist(), b.column(2)
            for at, j in joined(b.column(1).to_pylist()):
                every, hashes = anchors(j.hashes, width), windows(j.hashes, width)
                for k, words in enumerate(j.words):
                    if len(words) < width:
                        continue
                    m, known = j.of(every, k, width), set(np.asarray(shared_here[at + k].values).view(np.uint64).tolist())
                    begin = runs(m)
                    hit = np.flatnonzero(np.repeat([v in known for v in m[begin].tolist()], np.diff(begin, append=len(m))))
                    here = dict.fromkeys(zip(j.of(hashes, k, width)[hit].view(np.int64).tolist(), confirmed(words, hit, width), strict=True))
                    ids += [doc_ids[at + k]] * len(here)
                    one += [h for h, _ in here]
                    two += [x for _, x in here]
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64())], names=["doc_id", "h", "d"])

    hashed = known.join(chosen, "doc_id").select("doc_id", "text", "anchors").mapInArrow(candidates, "doc_id long, h long, d long")
    counted = hashed.groupBy("h", "d").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h", "d", "lo")
    repeated = join_anew(hashed, counted, ["h", "d"]).where("doc_id > lo").select("doc_id", F.lit(None).cast("binary").alias("content"), F.struct("h", "d").alias("w"))
    return repeated.union(copies).groupBy("doc_id").agg(F.collect_set("content").alias("wholes"), F.collect_set("w").alias("windows"))


def cut(text: str | None, wholes: list[bytes], repeated: set[tuple[int, int]], width: int) -> tuple[int, list[tuple[int, int]], bytes]:
    """(number of words, maximal removal intervals [from, to) in words, kept words joined by one space)."""
    words = words_of(text)
    n = len(words)
    whole = b" ".join(words)
    if n < width or not (repeated or wholes):
        return n, [], whole
    if wholes and digest(whole) in wholes:
        return n, [(0, n)], b""
    hashes = windows(word_hashes(words), width)
    starts = np.flatnonzero(np.isin(hashes, np.array([h for h, _ in repeated], np.int64).view(np.uint64)))
    told = zip(hashes[starts].view(np.int64).tolist(), confirmed(words, starts, width), strict=True)
    starts = starts[np.array([x in repeated for x in told], bool)]
    if not len(starts):
        return n, [], whole
    breaks = np.flatnonzero(np.diff(starts) > width)
    lo, hi = starts[np.concatenate([[0], breaks + 1])], starts[np.concatenate([breaks, [len(starts) - 1]])] + width
    spans = list(zip(lo.tolist(), hi.tolist(), strict=True))
    kept, at = [], 0
    for a, b in spans:
        kept += words[at:a]
        at = b
    return n, spans, b" ".join(kept + words[at:])


def remove_repeats(docs: DataFrame, width: int = 50, names: tuple[str, str, str] = ("n_words", "spans", "kept")) -> DataFrame:
    """docs (doc_id, text and any other columns) with three columns of the given names: number of words, maximal
    removal intervals in words, and the words left, joined by one space.

    A window is `width` consecutive words of one document; each word covered by a window whose words also start in a
    document with a smaller doc_id goes, judged on the input. Null or empty text: no words. Fewer words than a
    window: nothing goes. Null doc_id: it takes no part, nothing goes. Rows with the same doc_id count as one
    document: they don't remove each other's words. Columns of docs with one of the names are replaced.
    """
    kept_columns = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    docs = docs.select(*[named(c) for c in kept_columns])
    wholes, hashes, result, other = fresh(docs, "wholes", "windows", "cut", "other_id")
    found = find_repeats(docs, width).select(F.col("doc_id").alias(other), F.col("wholes").alias(wholes), F.col("windows").alias(hashes))
    kind = "struct<n_words:long,spans:array<struct<from:long,to:long>>,kept:string>"
    arrow = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), ("kept", pa.string())])

    @F.arrow_udf(kind)
    def judged(texts: pa.Array, whole: pa.Array, repeated: pa.Array) -> pa.Array:
        out = []
        for t, w, r in zip(texts.to_pylist(), whole.to_pylist(), repeated.to_pylist(), strict=True):
            n, spans, kept = cut(t, w or [], {(x["h"], x["d"]) for x in r or []}, width)
            out.append({"n_words": n, "spans": [{"from": a, "to": b} for a, b in spans], "kept": kept.decode()})
        return pa.array(out, arrow)

    # rows with a doc_id are dealt by it as in find_repeats, so that Spark can reuse the shuffle of doc_id and text
    known = docs.where(F.col("doc_id").isNotNull())
    known = known.join(found, known["doc_id"] == found[other], "left").drop(other)
    nothing = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in (wholes, hashes)]
    every = known.union(docs.where(F.col("doc_id").isNull()).select(*[named(c) for c in kept_columns], *nothing))
    done = every.withColumn(result, judged(F.col("text"), F.col(wholes), F.col(hashes)))
    return done.select(*[named(c) for c in kept_columns], *[F.col(f"{result}.{f}").alias(n) for f, n in zip(("n_words", "spans", "kept"), names, strict=True)])


def removed_words(spans: Column) -> Column:
    """Number of words in removal intervals."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
