"""Duplicate records by a cascade of normalised keys, and merging of duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def find_duplicates(new: DataFrame, existing: DataFrame, new_id: str, old_id: str, keys: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """``new_id, old_id, reason``: for each new record the match of the first rule that has one (the smallest id of it).

    ``keys`` lists (reason, key of new, key of existing) in order of strength. Each rule is one equi-join on
    a key computed once; existing keys are first brought down to one id a key, so a key that many records
    share does not multiply rows.
    """
    found = None
    for rank, (reason, a, b) in enumerate(keys):
        left = new.select(F.col(new_id), a.alias("_k")).filter("_k is not null and _k <> ''")
        right = existing.select(F.col(old_id), b.alias("_k")).filter("_k is not null and _k <> ''").groupBy("_k").agg(F.min(old_id).alias(old_id))
        hit = left.join(right, "_k").select(new_id, F.struct(F.lit(rank).alias("rank"), F.col(old_id).alias("old"), F.lit(reason).alias("reason")).alias("m"))
        found = hit if found is None else found.union(hit)
    best = found.groupBy(new_id).agg(F.min("m").alias("m"))
    return best.select(new_id, F.col("m.old").alias(old_id), F.col("m.reason").alias("reason"))


def merge_fill(df: DataFrame, key: str, order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """One record per key: each column's first filled value in ``order``."""
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    return df.groupBy(key).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), rank)).alias(c) for c in columns])


def duplicate_pairs(df: DataFrame, id_col: str, key: Column) -> DataFrame:
    """``first_id, id`` of every record whose key an earlier record has: a star per key, not all pairs."""
    keyed = df.select(F.col(id_col).alias("id"), key.alias("_k")).filter("_k is not null and _k <> ''")
    first = keyed.groupBy("_k").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return keyed.join(first, "_k").filter("id <> first_id").select("first_id", "id")


def move_children(children: DataFrame, parent: str, pairs: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """``children`` under the records that stay: rows of a duplicate get its first record as ``parent``, unless that has a row of the
    same ``keys`` already; of several that move onto one key the first by ``order`` does.  ``pairs`` is ``first_id, id``."""
    moved = children.join(pairs.select(F.col("first_id").alias("_to"), F.col("id").alias("_from")), F.col(parent) == F.col("_from"), "left")
    moved = moved.withColumn("_moved", F.col("_from").isNotNull()).withColumn(parent, F.coalesce("_to", F.col(parent)))
    w = Window.partitionBy(parent, *keys).orderBy("_moved", order)
    rows = moved.withColumn("_rn", F.row_number().over(w))
    return rows.filter(~F.col("_moved") | (F.col("_rn") == 1)).select(children.columns)
