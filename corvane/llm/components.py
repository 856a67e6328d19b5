"""Connected components over DataFrames, by alternating large-star and small-star steps.

Each step links a node's neighbours to the smallest of them, so the edge count
never grows and the depth of the graph shrinks geometrically.  Rounds end when
the edge set stays as it was; every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._common import cut


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node that is not the smallest of its component; root is the smallest.

    Nodes without edges, self loops and null ends have no row.  An empty edge table gives an empty result.
    """
    e = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    e = cut(e)
    state = _state(e)
    for _ in range(rounds):
        if not state[0]:
            break
        # large star: what is linked to lo goes to the smallest of lo and its neighbours; only as hi has lo smaller ones.
        # least is written out, so that the join's sides are plain shuffles, of which adaptive execution can split a hub's.
        least = cut(e.groupBy("hi").agg(F.min("lo").alias("m")))
        large = e.join(least.withColumnRenamed("hi", "lo"), "lo", "left").select(F.col("hi").alias("u"), F.coalesce("m", "lo").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        e = cut(small.union(least.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct())
        before, state = state, _state(e)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
