"""Ordered work over groups of any size: ranges of rows whose number follows the count, and what one carries to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one range at most, but for rows with the same order.
ROWS = 1_000_000
SEGMENT = "__segment"


def ranges(df: DataFrame, order: list[str | Column], rows: int | None = None) -> tuple[DataFrame, int]:
    """df with SEGMENT, the number of its range in the given order, and how many ranges there are. A table that fits
    one range isn't shuffled; a larger one is cut once, by samples, and written to the checkpoint folder, so that a row
    keeps its range whatever is asked of it."""
    n = df.count()
    parts = max(1, -(-n // (rows or ROWS)))
    if parts == 1:
        return df.withColumn(SEGMENT, F.lit(0)), 1
    return df.repartitionByRange(parts, *order).withColumn(SEGMENT, F.spark_partition_id()).checkpoint(), parts


def numbered(keys: DataFrame, order: list[str | Column], start: int, rows: int | None = None) -> DataFrame:
    """keys with `number`: start + 1, + 2, … in the given order, without a window over all rows of a large table: ranges
    are counted, and rows numbered within, from the sum of the counts before. One count runs while the plan is built."""
    ranged, parts = ranges(keys, order, rows)
    inside = F.row_number().over(Window.partitionBy(SEGMENT).orderBy(*order))
    if parts == 1:
        return ranged.withColumn("number", F.lit(start) + inside).drop(SEGMENT)
    counts = ranged.groupBy(SEGMENT).agg(F.count("*").alias("__n"))
    base = counts.select(SEGMENT, F.coalesce(F.sum("__n").over(Window.orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    return ranged.withColumn("__k", inside).join(base, SEGMENT).withColumn("number", F.lit(start) + F.col("__base") + F.col("__k")).drop(SEGMENT, "__k", "__base")


def _carried(ranged: DataFrame, groups: list[str], last: Column, before: Column) -> DataFrame:
    """groups, SEGMENT, __carry: of each group's ranges what those before it leave, from one row for each range. `last`
    aggregates a range to __last; `before` says over these, in order, what comes before one."""
    each = ranged.groupBy(*groups, SEGMENT).agg(last.alias("__last"))
    return each.select(*[F.col(g).alias(f"__g_{g}") for g in groups], F.col(SEGMENT).alias("__s"), before.alias("__carry"))


def _with_carry(ranged: DataFrame, carries: DataFrame, groups: list[str]) -> DataFrame:
    same = ranged[SEGMENT] == carries["__s"]
    for g in groups:
        same = same & ranged[g].eqNullSafe(carries[f"__g_{g}"])
    return ranged.join(carries, same, "left").drop("__s", *[f"__g_{g}" for g in groups])


def lagged(df: DataFrame, groups: list[str], order: list[str], value: str, name: str, rows: int | None = None) -> DataFrame:
    """df with `name`, the value of the row before in its group (null for the first). A group larger than a range is
    scanned in ranges; the first row of a range gets the last value of the ranges before it."""
    ranged, parts = ranges(df, [*groups, *order], rows)
    w = Window.partitionBy(*groups, SEGMENT).orderBy(*order)
    if parts == 1:
        return ranged.withColumn(name, F.lag(value).over(w)).drop(SEGMENT)
    between = Window.partitionBy(*groups).orderBy(SEGMENT)
    carries = _carried(ranged, groups, F.max_by(F.struct(value), F.struct(*order)), F.lag("__last").over(between))
    inside = ranged.withColumns({"__first": F.row_number().over(w) == 1, name: F.lag(value).over(w)})
    told = _with_carry(inside, carries, groups)
    return told.withColumn(name, F.when(F.col("__first"), F.col("__carry")[value]).otherwise(F.col(name))).drop(SEGMENT, "__first", "__carry")


def filled(df: DataFrame, groups: list[str], order: list[str], value: str, rows: int | None = None) -> DataFrame:
    """df with nulls of `value` replaced by the last one before in its group that isn't null. Ranges of a large group
    are filled apart; where one begins with nulls it takes what the ranges before it leave."""
    ranged, parts = ranges(df, [*groups, *order], rows)
    w = Window.partitionBy(*groups, SEGMENT).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.withColumn(value, F.last(value, ignorenulls=True).over(w))
    if parts == 1:
        return inside.drop(SEGMENT)
    between = Window.partitionBy(*groups).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    latest = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))
    carries = _carried(ranged, groups, latest, F.last("__last", ignorenulls=True).over(between))
    return _with_carry(inside, carries, groups).withColumn(value, F.coalesce(value, "__carry")).drop(SEGMENT, "__carry")
