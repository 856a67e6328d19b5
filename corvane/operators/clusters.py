"""Groups of duplicates: records linked by any of several keys, also over chains, and what becomes of each group.

Records that share a key are linked as a star round the smallest id, so a key that many records share gives one link a record.
Groups are the connected components of all links.  They are found by contraction: every record hooks on its smallest linked record,
chains of hooks are shortened, and links are carried over to the records that are left, until none is; each round removes every
record that has a smaller neighbour.  Rounds are joins on ids whose results are written to the shared folder; nothing is collected.

Defined cases: null and empty keys link nothing, null ids take no part; repeated ids are one record; an empty table has no groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.dedupe import duplicate_pairs, merge_fill, move_children
from corvane.sources.shared import stored


def _shortened(hooks: DataFrame) -> DataFrame:
    """``id, root`` with chains followed to their end: each step doubles the way."""
    while True:
        on = hooks.select(F.col("id").alias("root"), F.col("root").alias("next"))
        hooks = stored(hooks.join(on, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if hooks.filter("moved").isEmpty():
            return hooks.drop("moved")


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """``id, root`` of every linked record but the smallest of its group, which is the root."""
    left = stored(links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("id"), F.least(a, b).alias("to")).distinct())
    found = None
    while not left.isEmpty():
        hooks = _shortened(stored(left.groupBy("id").agg(F.min("to").alias("root"))))
        if found is None:
            found = hooks
        else:
            on = hooks.select(F.col("id").alias("root"), F.col("root").alias("next"))
            found = stored(found.join(on, "root", "left").select("id", F.coalesce("next", "root").alias("root")).union(hooks))
        ends = left.join(hooks, "id").select("to", F.col("root").alias("x"))
        ends = ends.join(hooks.select(F.col("id").alias("to"), F.col("root").alias("y")), "to", "left").select("x", F.coalesce("y", "to").alias("y"))
        left = stored(ends.filter("x <> y").select(F.greatest("x", "y").alias("id"), F.least("x", "y").alias("to")).distinct())
    return found if found is not None else left.select("id", F.col("to").alias("root"))


def duplicate_groups(df: DataFrame, id_col: str, keys: Sequence[Column]) -> DataFrame:
    """``id_col, group_id`` of every record; ``group_id`` is the smallest id that any chain of shared keys reaches."""
    links = None
    for key in keys:
        star = duplicate_pairs(df.filter(F.col(id_col).isNotNull()), id_col, key)
        links = star if links is None else links.union(star)
    roots = connected(links, "first_id", "id")
    ids = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    return ids.join(roots, "id", "left").select(F.col("id").alias(id_col), F.coalesce("root", "id").alias("group_id"))


def survivors(df: DataFrame, id_col: str, groups: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``group_id, survivor, members``: of each group the record that comes first in ``order`` (then by id), and the number of records."""
    first = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(id_col).alias("id"))
    return df.join(groups, id_col).groupBy("group_id").agg(F.min(first)["id"].alias("survivor"), F.count_distinct(id_col).alias("members"))


def merged(df: DataFrame, id_col: str, groups: DataFrame, order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """One record a group: its survivor's id, the number of members, and each column's first filled value in ``order``."""
    filled = merge_fill(df.join(groups, id_col), "group_id", [*order, F.col(id_col)], columns)
    return filled.join(survivors(df, id_col, groups, order), "group_id").select(F.col("survivor").alias(id_col), "members", *columns)


def adopted(children: DataFrame, parent: str, groups: DataFrame, heads: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """``children`` under the survivors of their parents' groups, over whole chains: of several that move onto one key the first by
    ``order`` does, and none onto a key that the survivor has already."""
    moves = groups.join(heads.select("group_id", "survivor"), "group_id").select(F.col("survivor").alias("first_id"), F.col(groups.columns[0]).alias("id"))
    return move_children(children, parent, moves.filter("first_id <> id"), keys, order)
