"""The queries and the pipeline over whole small tables against plain versions."""

import hashlib
import zlib

import corpus_pipeline
import numpy as np
import pytest
import test_jaccard
import test_packing
import test_substring
from meadowlark.llm import queries, toxicity
from meadowlark.llm.common import table
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}


def test_counts_and_round_trip(spark, docs):
    t = Tokenizer.from_file(queries.vocabulary_path())
    ids = {d: t.encode(x, add_special_tokens=False).ids for d, x in docs.items()}
    for r in queries.op1_token_counts(spark, SF).collect():
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), len(ids[r.doc_id]), len(ids[r.doc_id]) > 1024)
    for r in queries.op4_bpe_round_trip(spark, SF).collect():
        want = ids[r.doc_id]
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_media(spark, docs):
    for r in queries.op2_media_columns(spark, SF).collect():
        raw = docs[r.doc_id].encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes > 0 and len(r.media_sha256) == 64


def test_near_duplicates(spark, docs):
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in queries.op6_ngram_jaccard_join(spark, SF).collect())
    assert got == test_jaccard.brute(sorted(docs.items()))


def test_pipeline_stage_by_stage(spark, docs):
    now = table(spark, SF, "documents")
    columns = now.columns
    stages = dict(corpus_pipeline.STAGES)

    def texts(df):
        assert df.columns == columns
        return sorted((r.doc_id, r.text or "") for r in df.collect())

    model = toxicity.train(now, table(spark, SF, "labels"))
    kept = stages["toxicity"](spark, now, SF).checkpoint()
    assert texts(kept) == sorted((d, x) for d, x in docs.items() if not x or model.score(x) < 0.7)
    unique = stages["ngram_jaccard_join"](spark, kept, SF).checkpoint()
    assert texts(unique) == [(d, docs[d]) for d, c, _ in test_jaccard.brute(texts(kept)) if d == c]
    cut = stages["substring_dedup"](spark, unique, SF).checkpoint()
    want = [(d, k if gone else docs[d]) for d, _, gone, k in test_substring.brute(texts(unique), 50)]
    assert texts(cut) == sorted(want) and cut.where(F.length("text") != F.col("n_chars")).count() == 0
    packed = stages["best_fit_packing"](spark, cut, SF).collect()
    used, least = test_packing.check(texts(cut), packed, 2048)
    assert used <= least * 1.01 + 1


def test_stages_bear_odd_tables(spark):
    rows = [(None, None, "x", "1"), (1, "", None, "2"), (2, None, "en", "3"), (2, None, "en", "3"), (3, "a b c d e f g", "en", "4"), (4, "a b c d e f g", "en", "5")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").withColumn("n_chars", F.length("text").cast("long"))
    for name in "class_id rows own_id n_words spans kept wholes windows cut a.b __class __rows __kept x`y anchors content".split():
        odd = odd.withColumn(name, F.lit("own"))
    for df in (odd, odd.limit(0), odd.drop("n_chars")):
        now = df
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, SF).checkpoint()
            assert now.columns == df.columns, name
        assert now.where("kept = 'own' AND `a.b` = 'own'").count() == now.count() == (0 if df.isEmpty() else 4)
        assert corpus_pipeline.STAGES[-1][1](spark, now, SF).count() == now.count()


def test_which_of_repeated_rows_stays(spark):
    """Rows that differ in other columns only: one stays, the same one however the rows are dealt."""
    rows = [(1, "a b c d e f g", f"s{k}") for k in range(40)] + [(2, "a b c d e f g", "x"), (3, None, "y"), (3, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    stage = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"]
    got = [sorted(tuple(r) for r in stage(spark, x, SF).collect()) for x in (df, df.repartition(7), df.orderBy(F.desc("source")))]
    assert got[0] == got[1] == got[2] and [r[0] for r in got[0]] == [1, 3]
