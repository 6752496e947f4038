"""Byte-level BPE: safe cuts, fast batch counting, and encoding by forced boundaries (operators 1, 4 and 8)."""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Between a visible ASCII character and ASCII white space. No token of a byte-level BPE with the usual word pattern
#: crosses such a place, and what stands before it is cut into words alike with or without what follows.
SAFE_CUT = re.compile(r"(?<=[!-~])(?=[\t-\r ])")
#: White space outside ASCII, which the pattern's look-ahead treats as white space too.
WIDE_SPACE = re.compile("[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Runs of white space so long that the merge core's word matcher would overflow its stack.
LONG_SPACE = re.compile("[\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{5000,}")
#: The word pattern of byte-level BPE files (fixed value of the public tokenizer).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED = 300_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def safe_pieces(text: str, limit: int = 1 << 16) -> list[str]:
    """Pieces of about limit characters whose token lists, concatenated, are the whole text's."""
    out, at = [], 0
    while len(text) - at > limit:
        found = SAFE_CUT.search(text, at + limit // 2)
        if not found:
            break
        out.append(text[at : found.start()])
        at = found.start()
    out.append(text[at:])
    return out


class Vocabulary:
    """A tokenizers .json file of a byte-level BPE, as bytes of each id, merge ranks and special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        alphabet = byte_alphabet()
        self.ranked = (
            model["type"] == "BPE"
            and split.get("type") == "ByteLevel"
            and split.get("use_regex", True)
            and not split.get("add_prefix_space")
            and not spec["normalizer"]
            and not any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
        )
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if not self.ranked or any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} is no plain byte-level BPE")
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            if model["vocab"][left + right] != 256 + rank:
                raise ValueError(f"{path}: merges aren't in the order of ids")
        self.token = {i: bytes(alphabet[c] for c in t) for t, i in model["vocab"].items() if t not in self.special}
        self.ranks = {t: i for i, t in self.token.items()}
        self.token |= {i: t.encode() for t, i in self.special.items()}


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=4)
def core(path: str):
    """tiktoken's merge core over the same vocabulary: equal ids at about four times the speed of tokenizers' own."""
    import tiktoken

    v = vocabulary(path)
    return tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=v.ranks, special_tokens=v.special)


def plain_ids(fast, text: str) -> list[int]:
    """ids of a text without special strings. A long run of white space is one word but for its last character,
    which belongs to the word after it, so it is given to the merges directly."""
    out, at = [], 0
    if len(text) >= 5000:
        for run in LONG_SPACE.finditer(text):
            end = run.end() - (run.end() < len(text))
            out += fast.encode_ordinary(text[at : run.start()])
            out += fast._encode_single_piece(text[run.start() : end])
            at = end
    return out + fast.encode_ordinary(text[at:] if at else text)


def cased_ids(fast, text: str, special: dict[str, int]) -> list[int]:
    """ids of a text whose special strings count as special tokens."""
    if len(text) < 5000 or not LONG_SPACE.search(text):
        return fast.encode(text, allowed_special="all")
    parts = re.split("(" + "|".join(map(re.escape, special)) + ")", text) if special else [text]
    return [i for x in parts for i in ([special[x]] if x in special else plain_ids(fast, x))]


# -- operator 1 ---------------------------------------------------------------------------------------------------


def balanced(texts: list[str], most: int, cuttable: bool):
    """(owners, pieces) of at most `most` bytes of UTF-8 each, but for single larger pieces: long texts are cut at safe
    places if they may be, short ones are put together."""
    owners, pieces, held = [], [], 0
    for k, text in enumerate(texts):
        for piece in safe_pieces(text) if cuttable else (text,):
            size = len(piece) if piece.isascii() else len(piece.encode())
            if pieces and held + size > most:
                yield owners, pieces
                owners, pieces, held = [], [], 0
            owners.append(k)
            pieces.append(piece)
            held += size
    if pieces:
        yield owners, pieces


@lru_cache(maxsize=4)
def counter(path: str):
    """A function from a list of texts to their token counts, which encodes them by one call of the library that the
    file's kind calls for, and whether texts may be cut for it."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return (lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]), False
    try:
        fast = core(path)
    except ValueError:
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        return (lambda texts: [len(x) for x in t.encode_batch_fast(texts, add_special_tokens=False)]), False
    special = vocabulary(path).special

    def lengths(texts: list[str]) -> list[int]:
        spaced = {k for k, x in enumerate(texts) if len(x) >= 5000 and LONG_SPACE.search(x)}
        out = [len(x) for x in fast.encode_batch(["" if k in spaced else x for k, x in enumerate(texts)], num_threads=1, allowed_special="all")]
        for k in spaced:
            out[k] = len(cased_ids(fast, texts[k], special))
        return out

    return lengths, True


def token_counts(text: Column, path: str, batch_bytes: int = 1 << 20) -> Column:
    """Number of tokens of each whole text (null: 0), without begin, end or other added tokens.

    Texts are encoded in batches of about batch_bytes; only lengths leave the function. Files of plain byte-level
    BPE run on the faster merge core and cut long texts at safe places; all others (sentencepiece models, BPE with
    normalizers) are encoded whole. Empty text: 0. Any extra columns stay beside it, as this is a column expression.
    """

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        lengths_of, cuttable = counter(path)
        total = np.zeros(len(texts), np.int64)
        for owners, pieces in balanced(["" if x is None else x for x in texts.to_pylist()], batch_bytes, cuttable):
            np.add.at(total, owners, lengths_of(pieces))
        return pa.array(total)

    return count(text)


# -- operator 4 ---------------------------------------------------------------------------------------------------


class ForcedBoundaryCodec:
    """Encodes a text by cutting it where no token can reach across, and each fragment by itself.

    A byte pair that occurs inside no vocabulary token marks a certain cut for the merges. The word pattern must
    agree too, so a pair also has to be one at which the pattern starts anew whatever stands around it: see `cuts`.
    Fragments are mostly words or marks, so their ids are kept in a bounded table.
    """

    def __init__(self, path: str):
        v = vocabulary(path)
        self.core, self.special, self.cache = core(path), v.special, {}
        self.bytes_of = v.token
        self.inside = np.zeros((256, 256), bool)
        for t in v.token.values():
            a = np.frombuffer(t, np.uint8)
            self.inside[a[:-1], a[1:]] = True
        self.cut_ascii, self.cut_all = self.cuts(False).ravel(), self.cuts(True).ravel()
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(v.special, key=len, reverse=True))) + ")") if v.special else None

    def cuts(self, wide: bool) -> np.ndarray:
        """[left byte, right byte]: may a text be cut there? wide: bytes of longer characters count too, which
        holds for texts without white space outside ASCII."""
        kind = np.array(["?"] * 256)
        for b in range(128):
            c = chr(b)
            kind[b] = "S" if c in "\t\n\v\f\r " else "A" if c == "'" else "L" if c.isalpha() else "N" if c.isdigit() else "P" if "!" <= c <= "~" else "?"
        if wide:
            kind[0x80:0xC0] = "c"  # the last byte of a longer character, or one within it
            kind[0xC0:] = "w"  # its first byte
        allowed = np.zeros((256, 256), bool)
        for left, right in ("LS", "NS", "PS", "AS", "LN", "NL", "LP", "NP", "LA", "NA", "PL", "PN", "cS", "cL", "cN", "cP", "Lw", "Nw", "Pw", "cw"):
            allowed |= (kind == left)[:, None] & (kind == right)[None, :]
        return allowed & ~self.inside

    def plain(self, text: str) -> bytes:
        """ids of a text without special strings, as little-endian unsigned 32-bit integers."""
        raw = text.encode()
        a = np.frombuffer(raw, np.uint8)
        cut = self.cut_ascii if WIDE_SPACE.search(text) else self.cut_all
        at = np.flatnonzero(cut[(a[:-1].astype(np.uint16) << 8) | a[1:]]) + 1
        edges = [0, *at.tolist(), len(raw)]
        cache = self.cache
        if len(cache) > CACHED:
            cache.clear()
        out = []
        for i, j in pairwise(edges):
            fragment = raw[i:j]
            got = cache.get(fragment)
            if got is None:
                got = np.array(plain_ids(self.core, fragment.decode()), "<u4").tobytes()
                if j - i <= 64:
                    cache[fragment] = got
            out.append(got)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.splitter is None or not any(s in text for s in self.special):
            return self.plain(text)
        return b"".join(np.array([self.special[x]], "<u4").tobytes() if x in self.special else self.plain(x) for x in self.splitter.split(text) if x)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> ForcedBoundaryCodec:
    return ForcedBoundaryCodec(path)


def bpe_encode(text: Column, path: str) -> Column:
    """ids of each whole text as binary, little-endian unsigned 32-bit; special strings count as special; null: empty."""

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        c = codec(path)
        return pa.array([c.encode(x or "") for x in texts.to_pylist()], pa.binary())

    return encode(text)


def bpe_decode(ids: Column, path: str) -> Column:
    """The text of ids from bpe_encode, special tokens kept; bytes that are no UTF-8 become U+FFFD; null: empty."""

    @F.arrow_udf("string")
    def decode(values: pa.Array) -> pa.Array:
        c = codec(path)
        return pa.array([c.decode(x or b"") for x in values.to_pylist()], pa.string())

    return decode(ids)


def bpe_round_trip(df: DataFrame, path: str) -> DataFrame:
    """df with ids (binary) of its text column and decoded, the text decoded from them; see bpe_encode and bpe_decode.
    Columns of df with these names are replaced."""
    with_ids = df.withColumn("ids", bpe_encode(F.col("text"), path))
    return with_ids.withColumn("decoded", bpe_decode(F.col("ids"), path))
