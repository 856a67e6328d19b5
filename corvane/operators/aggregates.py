"""Aggregations: rates, buckets, histograms, keyed counts, evaluation measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def money(c: str | Column) -> Column:
    """Cents-exact sums whatever the order of addition."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)"))


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole, rounded; null when whole is 0."""
    return F.round(F.try_divide(part * F.lit(100.0), F.nullif(whole, F.lit(0))), digits)


def half_up(c: Column, digits: int) -> Column:
    """Rounding by floor, in plain double arithmetic, so that every engine agrees on ties."""
    return F.floor(c * 10**digits + F.lit(0.5)) / F.lit(float(10**digits))


def or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def status_stats(df: DataFrame, status: str, good: str, bad: str, value: str) -> DataFrame:
    """One row: total, good and bad counts, rate of good, mean value of good rows; zero rather than null."""
    total, ok = F.count(F.lit(1)), F.count_if(F.col(status) == good)
    return df.agg(
        total.alias("total"), ok.alias("successful"), F.count_if(F.col(status) == bad).alias("failed"),
        F.coalesce(pct(ok, total), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.round(F.avg(F.when(F.col(status) == good, F.col(value))), 2), F.lit(0.0)).alias("avg_value"),
    )


def by_period(df: DataFrame, ts: str, fmt: str, **aggs: Column) -> DataFrame:
    """Group by a formatted time: day ``yyyy-MM-dd`` or month ``yyyy-MM``."""
    return df.groupBy(F.date_format(ts, fmt).alias("period")).agg(*[c.alias(n) for n, c in aggs.items()])


def histogram(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def histogram_map(df: DataFrame, column: str) -> DataFrame:
    """One row: ``total`` and a map of counts by value."""
    h = histogram(df.filter(F.col(column).isNotNull()), column)
    return h.agg(or_zero(F.sum("n")).alias("total"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(column, "n")))).alias("counts"))


def counts_by_key(left: DataFrame, right: DataFrame, key_left: str, key_right: str, **aggs: Column) -> DataFrame:
    """Per-row counts over another table: one grouped pass and a left join in place of a correlated query for each row; none is 0."""
    g = right.groupBy(F.col(key_right).alias("_k")).agg(*[c.alias(n) for n, c in aggs.items()])
    out = left.join(g, F.col(key_left) == F.col("_k"), "left").drop("_k")
    return out.withColumns({n: or_zero(F.col(n)) for n in aggs})


def json_key_counts(df: DataFrame, column: str) -> DataFrame:
    """How often each top-level key occurs in a column of JSON objects."""
    return df.select(F.explode(F.json_object_keys(column)).alias("json_key")).groupBy("json_key").agg(F.count(F.lit(1)).alias("n"))


def set_scores(pred: Column, truth: Column) -> dict[str, Column]:
    """tp, fp, fn, precision, recall and f1 of two arrays taken as sets; empty against empty scores 0."""
    tp = F.size(F.array_intersect(pred, truth))
    fp, fn = F.size(F.array_except(pred, truth)), F.size(F.array_except(truth, pred))
    return {"tp": tp, "fp": fp, "fn": fn} | prf(tp, fp, fn)


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))}


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def micro(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sums of tp, fp and fn, then the measures."""
    g = df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return g.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn")))


def macro(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Means of the records' measures."""
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def majority(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each key; ties go to the smallest."""
    n = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("o"), F.col(value).alias("v"))).alias("m")).select(*keys, F.col("m.v").alias(value), (-F.col("m.o")).alias("n"))
