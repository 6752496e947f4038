"""The corpus pipeline: toxicity, n-gram Jaccard join, substring dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
run() writes each stage's result as Parquet into the shared folder and reads it as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meadowlark.llm import jaccard, packing, substring, toxicity
from meadowlark.llm.common import fresh, named, stored, table
from meadowlark.llm.queries import vocabulary_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score 0.7 or more) go; null and empty texts stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.where((F.coalesce(F.col("text"), F.lit("")) == "") | (toxicity.toxicity_score(F.col("text"), model) < 0.7))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest doc_id stays; of rows with this doc_id the one
    that is least by hash, text and the hash of all columns. Rows with null doc_id stay, and rows without words whose
    doc_id has no other row."""
    columns = [named(c) for c in docs.columns]
    own, kept_id, rows = fresh(docs, "own_id", "class_id", "rows")
    judged = jaccard.similar_documents(docs.select("doc_id", "text")).where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(own))
    marks = stored(judged.agg(F.min("class_id").alias(kept_id), F.count("*").alias(rows)).where(f"{kept_id} <> {own} OR {rows} > 1"))
    marked = docs.join(marks, docs["doc_id"].cast("long") == marks[own], "left")
    alone = marked.where(F.col(kept_id).isNull()).select(*columns)
    again = marked.where(F.col(kept_id) == F.col(own)).select(F.col(own), F.struct(F.xxhash64(*columns).alias("h"), F.col("text").alias("t"), F.struct(*columns).alias("row")).alias("r"))
    least = again.groupBy(own).agg(F.min_by("r.row", F.struct("r.h", "r.t")).alias("r"))
    return alone.union(least.select("r.*"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that a smaller doc_id has too go; texts without any stay as they are. A column n_chars, where
    there is one, is kept true."""
    names = fresh(docs, "n_words", "spans", "kept")
    done = substring.remove_repeats(docs, names=tuple(names))
    hit, kept = F.size(names[1]) > 0, F.col(names[2])
    new = {"text": F.when(hit, kept).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.length(kept).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return done.select(*[new[c].alias(c) if c in new else named(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left and their places in sequences of 2048 tokens."""
    return packing.pack(docs, vocabulary_path())


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_duplicates), ("substring_dedup", cut_repeats), ("best_fit_packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs


#: Classification, MinHash and token ids can't be expressed in SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None
