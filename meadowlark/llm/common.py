"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that no column of df has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Where it is unset, as in tests, a folder of our own
    if the driver is the only machine, else an error: other machines wouldn't see it."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df written once as a Parquet table in the shared folder and read again.

    It cuts lineage, survives lost executors, and its true size is known to the optimizer, so that a join with it
    is broadcast only if it is below spark.sql.autoBroadcastJoinThreshold. The table is deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/meadowlark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.parquet(path)


def join_anew(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with an aggregate that has one row per key, with columns named as in a plain join on keys.

    An aggregate comes out dealt by its keys, and a join on them would take place in the same stage, where Spark can't
    split a hot key's partition. Joining on an expression of the keys makes Spark deal both sides anew for the join
    alone (the aggregate is small by then), and adaptive execution splits the large side's hot partitions.
    """
    own = dict(zip(keys, fresh(left, *[f"key_{k}" for k in range(len(keys))]), strict=True))
    other = right.withColumnsRenamed(own)
    longs = {k for k in keys if left.schema[k].dataType.typeName() == "long"}

    def anew(df: DataFrame, name: str, key: str) -> Column:
        if key in longs:
            return F.bitwise_not(df[name])
        return F.concat((df[name].cast("string") if left.schema[key].dataType.typeName() == "boolean" else df[name]).cast("binary"), F.lit(b"\x00"))

    return left.join(other, [anew(left, k, k) == anew(other, own[k], k) for k in keys], how).drop(*own.values())


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    except Exception:  # the session has ended already: the cluster's own cleaning applies
        return
