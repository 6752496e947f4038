"""Rabin-Karp hashes of word windows in numpy, modulo the prime 2^61 - 1, over keyed digests of the words."""

from __future__ import annotations

import hashlib

import numpy as np

PRIME = (1 << 61) - 1
#: Key of the word digests and multiplier of the windows: random numbers, fixed for good.
KEY, BASE = bytes.fromhex("8f1bbcdc6ed9eba15a827999ca62c1d6"), 0x0B5A_D4EC_EDA1_CE2A
#: Words whose digests are kept at a time, and the length up to which they are.
KEPT, SHORT = 100_000, 64
M29, M30, M31, M32, P = (np.uint64((1 << k) - 1) for k in (29, 30, 31, 32, 61))
S29, S30, S31, S32, S61 = (np.uint64(k) for k in (29, 30, 31, 32, 61))


class _Digests(dict):
    """Word to number, computed when first asked for; bounded."""

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=KEY).digest(), "little") % PRIME
        if len(word) <= SHORT:
            if len(self) >= KEPT:
                self.clear()
            self[word] = value
        return value


_digests = _Digests()
_powers: list[np.ndarray] = []


def words_of(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of a text, unchanged."""
    return (text or "").encode().split()


def normal(text: str | None) -> bytes:
    """The words of a text, joined by one space."""
    return b" ".join(words_of(text))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A keyed digest of each word, below PRIME."""
    return np.fromiter(map(_digests.__getitem__, words), np.uint64, len(words))


class Joined:
    """The words of several texts and their hashes, one after the other, so that numpy works on long arrays. Values of
    windows that reach from one text into the next mean nothing; those of a text begin at its start."""

    def __init__(self, texts: list[str | None]):
        self.words = [words_of(t) for t in texts]
        self.starts = np.cumsum([0, *map(len, self.words)])
        self.hashes = word_hashes([w for words in self.words for w in words])

    def of(self, values: np.ndarray, k: int, width: int) -> np.ndarray:
        """The values of text k's own windows."""
        return values[self.starts[k] : max(self.starts[k + 1] - width + 1, self.starts[k])]


def joined(texts: list[str | None], most: int = 1 << 18):
    """(first place, Joined) for texts of about `most` characters together, longer ones alone."""
    at, held = 0, 0
    for k, t in enumerate(texts):
        if held and held + len(t or "") > most:
            yield at, Joined(texts[at:k])
            at, held = k, 0
        held += len(t or "")
    if at < len(texts):
        yield at, Joined(texts[at:])


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    x = (x & P) + (x >> S61)
    return np.where(x >= P, x - P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, for numbers below it, by halves of 31 bits (2^62 is 2, 2^61 is 1)."""
    a1, a0, b1, b0 = a >> S31, a & M31, b >> S31, b & M31
    mid = a1 * b0 + a0 * b1
    return reduced(((a1 * b1) << np.uint64(1)) + (mid >> S30) + ((mid & M30) << S31) + a0 * b0)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^0, BASE^1, ... and their inverses, n at least."""
    if not _powers or len(_powers[0]) < n:
        made = []
        for base in (BASE, pow(BASE, -1, PRIME)):
            out = np.ones(1, np.uint64)
            while len(out) < max(n, 1 << 12):
                out = np.concatenate([out, times(out, np.uint64(pow(base, len(out), PRIME)))])
            made.append(out)
        if len(made[0]) > 1 << 21:  # too large to keep
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def mixed(z: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def windows(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` consecutive values, from sums of values times powers."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(values))
    terms = times(values, up[: len(values)])
    sums = np.zeros((2, len(values) + 1), np.uint64)
    np.cumsum(terms & M32, out=sums[0, 1:])
    np.cumsum(terms >> S32, out=sums[1, 1:])
    low, high = sums[:, width:] - sums[:, :n]
    total = ((high & M29) << S32) + (high >> S29) + (low & P) + (low >> S61)
    return mixed(times(reduced(total), down[:n]))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of `width` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    rows = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    rows[: len(values)] = values
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def number(data: bytes) -> int:
    """64 bits of a digest, signed."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)
