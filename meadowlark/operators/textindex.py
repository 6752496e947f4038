"""Substring search by an index of trigrams: terms meet the few texts that have their rarest trigrams, then the texts
themselves decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scans import ROWS

#: Characters of the texts that one task cuts into trigrams, on average: what it holds of them until its sorted shuffle.
CUT = 4 * ROWS
#: Trigrams of a term that are looked up: the rarest ones.
LOOKED_UP = 3


def trigrams(text: Column) -> Column:
    """The different runs of three characters of a text in lower case; none for shorter texts."""
    low = F.lower(text)
    places = F.when(F.length(low) >= 3, F.sequence(F.lit(1), F.length(low) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda k: F.substring(low, k, F.lit(3))))


class TextIndex:
    """Three tables in a folder: texts (id, text), postings (gram, id) in files by ranges of grams, sorted, so that a
    gram's ids are read from a few row groups; and how many texts each gram has."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, texts: DataFrame, path: str) -> TextIndex:
        """texts: id, text (ids once each; null texts can't be found)."""
        spark = texts.sparkSession
        texts.select("id", "text").where("text IS NOT NULL").write.mode("overwrite").parquet(f"{path}/texts")
        index = cls(spark, path)
        n = index.texts().agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()[0]  # that many at most
        # a text makes a row a character: tasks are as many as these ask for, not as the files that the texts come in
        grams = index.texts().repartition(max(1, -(-n // CUT))).select(F.explode(trigrams(F.col("text"))).alias("gram"), "id")
        # grams alone decide the range but for hot ones: their ids are cut too
        ranged = grams.repartitionByRange(max(1, -(-n // ROWS)), "gram", "id").sortWithinPartitions("gram", "id")
        ranged.write.mode("overwrite").parquet(f"{path}/postings")
        index.postings().groupBy("gram").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/counts")
        return index

    def texts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/texts")

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def counts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/counts")

    def find(self, term: str) -> DataFrame:
        """id, text of the texts that contain the term, whatever its case. Terms of fewer than three characters, and
        the empty one, which all texts contain, are looked for in all texts."""
        hit = F.contains(F.lower("text"), F.lower(F.lit(term)))
        own = self.spark.range(1).select(F.explode(trigrams(F.lit(term))).alias("gram"))
        known = own.join(self.counts(), "gram", "left").orderBy(F.col("n").asc_nulls_first(), "gram").limit(LOOKED_UP).collect()
        if not known:
            return self.texts().where(hit)
        if any(r["n"] is None for r in known):  # a gram that no text has
            return self.texts().where(F.lit(False))
        grams = [r["gram"] for r in known]
        ids = self.postings().where(F.col("gram").isin(grams)).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("id")
        return self.texts().join(ids, "id", "left_semi").where(hit)
