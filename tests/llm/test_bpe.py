import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from meadowlark.llm import bpe
from pyspark.sql import functions as F
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
TRUE = Tokenizer.from_file(PATH)
PIECES = list("abzSst09.,!?'\n\t \r") + ["  ", "é", "ß", "»", "中", "。", "　", " ", "\x85", "\x1c", "'s", "'ll", "<|endoftext|>", "😀", "½", " the", "Word"]


def ids(text):
    return TRUE.encode(text, add_special_tokens=False).ids


def encoded(text):
    return np.frombuffer(bpe.codec(PATH).encode(text), "<u4").tolist()


@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join))
@settings(max_examples=1500, deadline=None)
def test_equal_ids_and_round_trip(text):
    assert encoded(text) == ids(text)
    assert bpe.codec(PATH).decode(bpe.codec(PATH).encode(text)) == TRUE.decode(ids(text), skip_special_tokens=False)
    lengths, cuttable = bpe.counter(PATH)
    assert cuttable and sum(lengths(bpe.safe_pieces(text, 4))) == len(ids(text))


@given(st.text(max_size=60))
@settings(max_examples=800, deadline=None)
def test_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert encoded(text) == ids(text)


@pytest.mark.parametrize("text", ["a" * 50_000, " " * 300_000 + "x", "\n " * 40_000, "é" * 30_000, "!" * 50_000, "中" * 20_000, " " * 30_000 + "<|endoftext|>" + "\t" * 9000])
def test_long_texts(text):
    assert encoded(text) == ids(text)
    lengths, _ = bpe.counter(PATH)
    assert sum(lengths(bpe.safe_pieces(text))) == len(ids(text))


def test_forced_pairs_occur_in_no_token():
    c = bpe.codec(PATH)
    for t in random.Random(1).sample(list(bpe.vocabulary(PATH).ranks), 3000):
        a = np.frombuffer(t, np.uint8)
        assert c.inside[a[:-1], a[1:]].all()
    assert not (c.cuts(True) & c.inside).any()


def test_counts_of_other_kinds(spark):
    rows = [(1, "Hello World, a test"), (2, ""), (3, None), (4, "Straße 中文 " * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        got = {r.doc_id: r.n for r in df.select("doc_id", bpe.token_counts(F.col("text"), path).alias("n")).collect()}
        if name.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            want = {k: len(sp.encode(t or "")) for k, t in rows}
        else:
            want = {k: len(Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids) for k, t in rows}
        assert got == want


def test_columns(spark):
    df = spark.createDataFrame([(None, "x y", "ids"), (2, None, "q"), (2, None, "q")], "doc_id long, text string, ids string")
    got = bpe.bpe_round_trip(df, PATH).collect()
    assert sorted(r.decoded for r in got) == ["", "", "x y"]
    assert bpe.bpe_round_trip(df.limit(0), PATH).count() == 0


def test_batches_by_bytes():
    """No batch passes the limit in bytes of UTF-8 but a single piece that can't be cut; nothing is lost."""
    texts = ["é" * 700, "ab cd " * 500, "", "中" * 300, "x" * 5000, "ü" * 400]
    for cuttable in (True, False):
        got = list(bpe.balanced(texts, 2000, cuttable))
        assert all(len(p) == 1 or sum(len(x.encode()) for x in p) <= 2000 for _, p in got)
        joined = [""] * len(texts)
        for owners, pieces in got:
            for k, x in zip(owners, pieces, strict=True):
                joined[k] += x
        assert joined == texts


def test_counts_of_other_files(spark):
    """Files that the merge core can't take are encoded whole by their own libraries."""
    import sentencepiece

    texts = ["", "A text of words, two  spaces", None, "été 中文 " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, x string")
    for name in ("piece_bpe_32k.model", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        if path.endswith(".model"):
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            want = [len(model.encode(x or "")) for x in texts]
        else:
            want = [len(Tokenizer.from_file(path).encode(x or "", add_special_tokens=False).ids) for x in texts]
        assert [r.n for r in df.select("k", bpe.token_counts(F.col("x"), path).alias("n")).orderBy("k").collect()] == want
