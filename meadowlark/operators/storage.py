"""Folders for tables that a job writes and reads again, and the session that it runs in."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir). Where it is unset, as in tests, a
    folder of our own if the driver is the only machine, else an error: other machines wouldn't see it."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(spark: SparkSession, df: DataFrame, name: str, paths: list[str]) -> DataFrame:
    """df written as a table in the shared folder and read again by a session: its size is known then, and whoever reads
    it takes the columns that they need. Its path is added to those that the caller discards."""
    paths.append(scratch(spark, name))
    df.write.parquet(paths[-1])
    return spark.read.schema(df.schema).parquet(paths[-1])


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes folders that a finished job needs no more, such as a stream's landing place and offsets."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Spark's limit for one generated method, and HotSpot's for a method that it compiles, in bytes.
METHOD = ("spark.sql.codegen.hugeMethodLimit", 8000)


@contextmanager
def short_methods(spark: SparkSession) -> Iterator[None]:
    """Plans of many expressions as methods that the JVM compiles. HotSpot leaves larger ones to its interpreter, several
    times slower, and Spark's limit is by default as large as a method may be; where a stage's code goes beyond the limit
    Spark makes many short methods instead of one. The session's own setting is put back, and kept if it is lower."""
    before = spark.conf.get(METHOD[0])
    spark.conf.set(METHOD[0], min(int(before), METHOD[1]))
    try:
        yield
    finally:
        spark.conf.set(METHOD[0], before)
