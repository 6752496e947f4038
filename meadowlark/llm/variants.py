"""Spelling variants (operator 13): near words by an index of variable-length grams, and the form that each belongs to."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import ceil, log, log2
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import PLACE, judged, pairs, placed
from .common import join_anew, stored
from .hashing import mixed

#: Shortest and longest gram. Words must have 2 * LONGEST - 2 letters at least, so that one edit leaves a gram (lower bound
#: of _grams()).
SHORTEST, LONGEST = 2, 4
#: A gram is extended while more words than this have it; at most this many grams of a length are extended.
FREQUENT, EXTENDED = 16, 100_000
#: What stands before and after a word: no characters.
START, END = 0x110000, 0x110001
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Runs that are counted in a task before their counts are sent on, and cells of the letter matrix of some words.
HELD, MATRIX = 200_000, 1 << 20
#: Letters of runs: A-Z (lower-cased), a-z, and U+00C0 to U+00FF, which latin-1 writes as single bytes.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs_of(text: str | None) -> list[bytes]:
    """Maximal runs of [A-Za-z\\u00C0-\\u00FF], in latin-1, only A-Z lower-cased."""
    return (text or "").encode("latin-1", "replace").translate(_LETTERS).split()


def misspelt(doc_id: int, run: str, every: int = 199) -> str:
    """The run, or the run without one letter where `every` divides the checksum of `<doc_id>:<run>`."""
    h = crc32(f"{doc_id}:{run}".encode())
    return run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run


def counted_words(docs: DataFrame, shortest: int = 6, least: int = 5, every: int = 199) -> DataFrame:
    """word, n: the words of at least `shortest` letters that occur `least` times or more in all documents (doc_id,
    text), after misspelt() has changed some. Null and empty texts have none; a null doc_id reads as the word null."""

    def run(batches):
        counts: Counter[str] = Counter()
        for b in batches:
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                prefix = crc32(b"null:" if doc_id is None else b"%d:" % doc_id)
                for raw, n in Counter([w for w in runs_of(text.as_py()) if len(w) >= shortest]).items():
                    word = raw.decode("latin-1")
                    h = crc32(raw if word.isascii() else word.encode(), prefix)
                    if h % every == 0:
                        word = word[: h % len(word)] + word[h % len(word) + 1 :]
                        if len(word) < shortest:
                            continue
                    counts[word] += n
                if len(counts) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
                    counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return read.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each word between START and END, and the words' lengths."""
    size = np.array([len(w) for w in words], np.int64)
    out = np.zeros((len(words), int(size.max(initial=0)) + 2), np.uint64)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    row = np.repeat(np.arange(len(words)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + 1] = flat
    out[:, 0] = START
    out[np.arange(len(words)), size + 1] = END
    return out, size


def chunks(words: list[str]) -> Iterator[np.ndarray]:
    """Numbers of words of like length, so many that their letters fit a matrix of bounded size."""
    order = np.argsort([len(w) for w in words], kind="stable")
    at = 0
    for k, n in enumerate(order.tolist()):
        if k > at and (k + 1 - at) * (len(words[n]) + 2) > MATRIX:
            yield order[at:k]
            at = k
    if at < len(order):
        yield order[at:]


def hashes(codes: np.ndarray) -> list[np.ndarray]:
    """Of each place the gram of SHORTEST letters, of one more, and so on; those that reach over END mean nothing."""
    out, h = [], codes
    for q in range(2, LONGEST + 1):
        n = codes.shape[1] - q + 1
        h = mixed(h[:, :n] * MULTIPLIER + codes[:, q - 1 :]) if n > 0 else h[:, :0]
        if q >= SHORTEST:
            out.append(h)
    return out


class Dictionary:
    """The grams that are extended by a letter, with the number of their occurrences."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        order = np.argsort(grams)
        self.grams, self.counts = grams[order], counts[order]

    def occurrences(self, grams: np.ndarray) -> np.ndarray:
        """0 for grams that are not extended."""
        if not len(self.grams):
            return np.zeros(grams.shape, np.int64)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        return np.where(self.grams[at] == grams, self.counts[at], 0)


def _grams(codes: np.ndarray, size: np.ndarray, known: Dictionary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word and place: is there a gram of its decomposition, the gram, and its weight; and each word's bound.

    At each place the gram grows from SHORTEST letters while it is frequent, up to LONGEST letters or the word's end; it
    stays if it ends later than all before it. What stands at a place depends on the gram's own letters alone, so an
    edit at letter i changes only grams that hold i, and drops or adds others only where a gram that begins at or
    before i could end at the same place or later: all grams that an edit at i affects end at i to i + LONGEST - 1.
    The bound is the largest number of such ends, over all i. Ends differ, so it is LONGEST at most; and with
    2 * LONGEST - 2 letters the first or the last gram lies outside any such range, so at least one gram is left.
    """
    n, width = codes.shape
    places = np.arange(width)
    length = np.full((n, width), SHORTEST)
    gram, weight = np.zeros((n, width), np.uint64), np.zeros((n, width), np.int64)
    grows = np.ones((n, width), bool)
    for q, h in enumerate(hashes(codes), SHORTEST):
        fits = places[: h.shape[1]][None, :] + q - 1 <= size[:, None] + 1
        now = grows[:, : h.shape[1]] & fits
        gram[:, : h.shape[1]][now], length[:, : h.shape[1]][now] = h[now], q
        often = known.occurrences(h) if q < LONGEST else np.zeros(h.shape, np.int64)
        if q == LONGEST:  # a gram of full length is as frequent as the one before it, for the order
            weight[:, : h.shape[1]][now] = before[:, : h.shape[1]][now]
        before = often
        grows[:, : h.shape[1]] = now & (often > 0)
        grows[:, h.shape[1] :] = False
    end = np.where(places[None, :] <= size[:, None], places[None, :] + length - 1, -1)
    earlier = np.concatenate([np.full((n, 1), -1), np.maximum.accumulate(end, axis=1)[:, :-1]], axis=1)
    stays = end > earlier
    ends = np.zeros((n, width + LONGEST), np.int64)
    ends[np.nonzero(stays)[0], end[stays]] = 1
    total = np.concatenate([np.zeros((n, 1), np.int64), np.cumsum(ends, axis=1)], axis=1)
    near = total[:, LONGEST : LONGEST + width] - total[:, :width]
    near[(places[None, :] < 1) | (places[None, :] > size[:, None])] = 0
    return stays, gram, weight, near.max(axis=1)


def tokens(words: list[str], known: Dictionary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of words of like length: the cells where a word is at home, those it visits (0: none), a set of its grams in 64
    bits, and its bound.

    Of the grams of a word in a fixed order (rare ones first, then by place) the first bound + 1 are enough: one edit
    leaves one of them at least, and the first that it leaves is the same gram in the other word, at the same place or,
    in a word longer by one letter, at the next. A cell is a gram with a place and a length, so a word visits the cells
    of words shorter by one letter."""
    codes, size = letters(words)
    stays, gram, weight, bound = _grams(codes, size, known)
    mask = np.bitwise_or.reduce(np.where(stays, np.uint64(1) << (gram >> np.uint64(58)), np.uint64(0)), axis=1)
    place = np.broadcast_to(np.arange(codes.shape[1]), gram.shape)
    order = np.lexsort((place, gram, np.where(stays, weight, np.iinfo(np.int64).max)), axis=-1)[:, : LONGEST + 1]
    rows = np.arange(len(words))[:, None]
    used = (np.arange(order.shape[1])[None, :] <= bound[:, None]) & stays[rows, order]
    first = gram[rows, order]

    def cell(at: np.ndarray, length: np.ndarray) -> np.ndarray:
        return np.where(used, mixed(first ^ mixed(at.astype(np.uint64) * MULTIPLIER + length[:, None].astype(np.uint64))), np.uint64(0))

    visits = np.concatenate([cell(order, size - 1), cell(order - 1, size - 1)], axis=1)
    visits = np.sort(visits, axis=1)
    visits[:, 1:][visits[:, 1:] == visits[:, :-1]] = 0
    return cell(order, size), visits, mask, bound


def one_edit(words: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of words (i no longer than j) differ by one inserted, deleted or replaced letter: what they share at
    the start and at the end leaves one letter of the longer."""
    if not len(i):
        return np.zeros(0, bool)
    used, places = np.unique(np.concatenate([i, j]), return_inverse=True)
    i, j = places[: len(i)], places[len(i) :]
    size = np.array([len(words[k]) for k in used.tolist()])
    width = int(size.max())
    out = np.zeros(len(i), bool)
    step = max(1, (MATRIX << 2) // width)
    ahead, back = np.zeros((2, len(used), width + 1), np.uint32)
    for k, n in enumerate(used.tolist()):
        row = np.frombuffer(words[n].encode("utf-32-le", "surrogatepass"), "<u4")
        ahead[k, : len(row)], back[k, : len(row)] = row, row[::-1]
    for a in range(0, len(i), step):
        p, q = i[a : a + step], j[a : a + step]
        # the last column is 0 in both; a different one ends the search there
        start = np.where((x := ahead[p] != ahead[q]).any(axis=1), x.argmax(axis=1), width)
        finish = np.where((x := back[p] != back[q]).any(axis=1), x.argmax(axis=1), width)
        start, finish = np.minimum(start, size[p]), np.minimum(finish, size[p])
        same = size[p] == size[q]
        out[a : a + step] = np.where(same, start + finish == size[p] - 1, (size[q] == size[p] + 1) & (start + finish >= size[p]))
    return out


@lru_cache(maxsize=2)
def _dictionary(grams: bytes, counts: bytes) -> Dictionary:
    return Dictionary(np.frombuffer(grams, np.uint64), np.frombuffer(counts, np.int64))


def frequent_grams(words: DataFrame) -> tuple[bytes, bytes]:
    """The grams of fewer than LONGEST letters that are extended, and their numbers: at most EXTENDED of each length."""

    def run(batches):
        for b in batches:
            all_words = b["word"].to_pylist()
            for at in chunks(all_words):
                codes, size = letters([all_words[k] for k in at.tolist()])
                for q, h in enumerate(hashes(codes)[:-1], SHORTEST):
                    fits = np.arange(h.shape[1])[None, :] + q - 1 <= size[:, None] + 1
                    gram, n = np.unique(h[fits], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), q)), pa.array(gram.view(np.int64)), pa.array(n)], names=["q", "gram", "n"])

    counts = stored(words.select("word").mapInArrow(run, "q long, gram long, n long").groupBy("q", "gram").agg(F.sum("n").alias("n")))
    limit = {r["q"]: max(FREQUENT, r["n"] // EXTENDED) for r in counts.groupBy("q").agg(F.sum("n").alias("n")).collect()}
    found: list[tuple[int, int]] = []
    for q, most in sorted(limit.items()):
        found += [(r["gram"], r["n"]) for r in counts.where((F.col("q") == q) & (F.col("n") > most)).select("gram", "n").collect()]
    return np.array([g for g, _ in found], np.int64).tobytes(), np.array([n for _, n in found], np.int64).tobytes()


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, form, form_n for the words (word, n; each once, 6 letters at least) that have near words: the
    number of words at one edit, and of these the one of largest n, ties to the smallest in code-point order.

    The dictionary of grams is pruned by frequency: rare grams stay short, frequent ones are extended, so that the
    lists of the index are short. A word stands in the lists of a few of its grams (tokens()); lists are merged in
    tasks, a pair stays if neither word lacks more grams of the other than an edit can affect, and is then verified
    letter by letter. It counts in the smallest of the cells where the two meet. Nothing is capped; long lists are dealt
    in blocks."""
    grams, counts = frequent_grams(words)

    def listed(light: bool):
        def run(batches):
            known = _dictionary(grams, counts)
            for b in batches:
                all_words = b["word"].to_pylist()
                for at in chunks(all_words):
                    home, visits, mask, bound = tokens([all_words[k] for k in at.tolist()], known)
                    cells = np.concatenate([home, visits], axis=1)
                    row, column = np.nonzero(cells)
                    out = {"cell": pa.array(cells[row, column].view(np.int64))}
                    if not light:
                        source = pa.array(at[row])
                        out |= {"home": pa.array(column < home.shape[1]), "word": b["word"].take(source), "n": b["n"].take(source)}
                        out |= {"mask": pa.array(mask[row].view(np.int64)), "bound": pa.array(bound[row].astype(np.int32))}
                    yield from pa.table(out).to_batches(max_chunksize=50_000)

        return run

    light = words.select("word").mapInArrow(listed(True), "cell long")
    heavy = words.select("word", "n").mapInArrow(listed(False), "cell long, home boolean, word string, n long, mask long, bound int")

    def merged(columns: dict, starts: np.ndarray) -> dict:
        known = _dictionary(grams, counts)
        mask, bound = np.asarray(columns["mask"]).view(np.uint64), np.asarray(columns["bound"])
        size, cell = np.asarray(pa_lengths(columns["word"])), np.asarray(columns["cell"]).view(np.uint64)
        first, second = [], []
        for i, j in pairs(columns, starts):
            kept = (np.bitwise_count(mask[i] & ~mask[j]) <= bound[i]) & (np.bitwise_count(mask[j] & ~mask[i]) <= bound[j])
            kept &= np.abs(size[i] - size[j]) <= 1
            i, j = i[kept], j[kept]
            short = np.where(size[i] <= size[j], i, j)
            first.append(short)
            second.append(i + j - short)
        i, j = np.concatenate(first or [np.zeros(0, int)]), np.concatenate(second or [np.zeros(0, int)])
        used, places = np.unique(np.concatenate([i, j]), return_inverse=True)
        words, i, j = columns["word"].take(pa.array(used)).to_pylist(), places[: len(i)], places[len(i) :]
        near = one_edit(words, i, j)
        i, j = i[near], j[near]
        near = own_cell(words, known, i, j) == cell[used[(places[: len(near)])[near]]]
        i, j = i[near], j[near]
        # both ways: each word's near words, of which the best comes first
        own, other = np.concatenate([i, j]), np.concatenate([j, i])
        n = np.asarray(columns["n"])[used]
        rank = np.empty(len(words), np.int64)
        rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        order = np.lexsort((rank[other], -n[other], own))
        own, other = own[order], other[order]
        at, begin, count = np.unique(own, return_index=True, return_counts=True)
        best = other[begin]
        return {
            "word": pa.array([words[k] for k in at.tolist()], pa.string()), "near": pa.array(count), "best": pa.array([words[k] for k in best.tolist()], pa.string()), "best_n": pa.array(n[best]),
        }

    found = judged(placed(heavy, light, "word"), merged, "word string, near long, best string, best_n long")
    first = F.min_by("best", F.struct(-F.col("best_n"), F.col("best")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), first.alias("form"), F.max("best_n").alias("form_n"))


def pa_lengths(words: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    return pc.utf8_length(words)


def own_cell(words: list[str], known: Dictionary, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest cell in which each pair (i no longer than j) meets."""
    if not len(i):
        return np.zeros(0, np.uint64)
    used, places = np.unique(np.concatenate([i, j]), return_inverse=True)
    i, j = places[: len(i)], places[len(i) :]
    home, visits = np.zeros((len(used), LONGEST + 1), np.uint64), np.zeros((len(used), 2 * LONGEST + 2), np.uint64)
    own = [words[k] for k in used.tolist()]
    size = np.array([len(w) for w in own])
    for at in chunks(own):
        h, v, _, _ = tokens([own[k] for k in at.tolist()], known)
        home[at, : h.shape[1]], visits[at, : v.shape[1]] = h, v
    best = np.full(len(i), np.iinfo(np.uint64).max)
    met = np.where((size[i] == size[j])[:, None], np.pad(home, ((0, 0), (0, LONGEST + 1)))[j], visits[j])
    for k in range(LONGEST + 1):
        for m in range(met.shape[1]):
            a = home[i, k]
            best = np.minimum(best, np.where((a == met[:, m]) & (a != 0), a, best))
    return best


def spelling_variants(words: DataFrame, factor: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n for words (word, n), each once: form is the near word of largest n (ties:
    the smallest in code-point order) if that is at least `factor` times the word's own n, else null; root is the last
    word that forms lead to, the word itself without one. Words of any length from 6 letters on; no rows: no rows."""
    words = stored(words.select("word", "n"))
    told = words.join(near_words(words), "word", "left")
    much = F.coalesce(F.col("form_n") >= factor * F.col("n"), F.lit(False))
    null = F.lit(None)
    told = stored(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(much, F.col("form")).otherwise(null).alias("form"), F.when(much, F.col("form_n")).otherwise(null).alias("form_n")))
    # n grows by the factor with every step, so a chain has few steps, and each round doubles what it has come
    most, least = told.agg(F.max("n"), F.min("n")).first()
    steps = 1 + (int(log(max(most, 1) / max(least, 1)) / log(factor)) if most else 0)
    roots = told.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(max(1, ceil(log2(steps + 1)))):
        roots = stored(roots)
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = join_anew(roots, ahead, ["root"], "left").select("word", F.coalesce("next", "root").alias("root"))
    out = told.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
