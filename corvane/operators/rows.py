"""Rows picked by order: latest per key, pages, first of equal keys, top-k; intervals and gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in ``order``; give a unique last column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def latest_values(df: DataFrame, keys: Sequence[str], order: str, tie: str, values: Sequence[str]) -> DataFrame:
    """A few columns of the latest row per key, by partial aggregation instead of a sort of all rows."""
    agg = df.groupBy(*keys).agg(F.max(F.struct(order, tie, *values)).alias("_m"))
    return agg.select(*keys, *[F.col(f"_m.{c}").alias(c) for c in dict.fromkeys([order, tie, *values])])


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """Page ``number`` (from 1)."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_info(df: DataFrame, size: int) -> DataFrame:
    """``total, total_pages``."""
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn("total_pages", F.ceil(F.col("total") / size))


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def keep_first(df: DataFrame, keys: Sequence[Column], *order: Column) -> DataFrame:
    """Of rows with equal key expressions the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def keep_top(df: DataFrame, keys: Sequence[str], k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each key in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def seed_pairs(a: DataFrame, b: DataFrame, present: DataFrame, most: int = 10_000) -> DataFrame:
    """All pairs of two small tables that ``present`` does not hold, to fill a table of links; each side is checked to be small."""
    if max(a.limit(most + 1).count(), b.limit(most + 1).count()) > most:
        raise ValueError(f"more than {most} rows to pair")
    return a.crossJoin(F.broadcast(b)).join(present, present.columns, "left_anti")


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """``keys, start, end``: the union of each key's intervals; touching ones join. Rows without both ends or with start > end are left out."""
    rows = df.filter((F.col(start) <= F.col(end))).select(*keys, F.col(start).alias("s"), F.col(end).alias("e")).distinct()
    w = Window.partitionBy(*keys).orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = rows.withColumn("new", F.when(before.isNull() | (F.col("s") > before), 1).otherwise(0))
    island = flagged.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "island").agg(F.min("s").alias(start), F.max("e").alias(end)).drop("island")


def gaps(df: DataFrame, keys: Sequence[str], start: str, end: str, *tie: str) -> DataFrame:
    """Each row with the end of the row before it and the days between; null on the first row of a key."""
    w = Window.partitionBy(*keys).orderBy(start, *tie)
    out = df.withColumn("prev_end", F.lag(end).over(w))
    return out.withColumn("gap_days", F.datediff(F.col(start), F.col("prev_end")))


def chunks(tokens: Column, size: int, stride: int) -> Column:
    """Overlapping windows over an array; the first that reaches the end is the last. An empty array gives none."""
    n = F.size(tokens)
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(float(stride)))).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(tokens, i * stride + 1, F.lit(size)))).otherwise(F.array().cast("array<array<string>>"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if it has fewer partitions than that, for costly work row by row; large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df`` marked to be sent to all tasks if it has at most ``most`` rows, which are counted; larger ones as they are.

    For tables of rules or names: Spark does not know the size of rows made in a program, and would deal the large side out over the few
    keys of such a table.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
