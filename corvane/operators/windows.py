"""Overlapping windows over tokens, and one answer for each token out of the windows' answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def windows(n: Column, size: int, stride: int) -> Column:
    """``array<struct<start, end>>`` over ``n`` tokens: windows of ``size`` every ``stride``, up to the first that reaches the end."""
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(float(stride))).cast("int"))
    every = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * stride).cast("int").alias("start"), F.least(i * stride + size, n).cast("int").alias("end")))
    return F.when(n > 0, every).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def reconcile(answers: DataFrame, key: str) -> DataFrame:
    """``key, pos, tag``: of the answers for a token that of the window in which it stands deepest (the earlier in a tie).

    ``answers(key, start, end, pos, tag)`` has tags in BIO form and positions counted in the whole text.  Depth is the distance to
    the nearer end of the window, where that is not an end of the text.  A tag I- whose run does not begin is made to begin, and
    a tag B- in the midst of a run that the two windows on either side of a border split is left: the deeper window has seen both sides.
    """
    far = F.lit(1 << 30)
    ends = answers.groupBy(key).agg(F.max("end").alias("_n"))
    left = F.when(F.col("start") == 0, far).otherwise(F.col("pos") - F.col("start"))
    right = F.when(F.col("end") == F.col("_n"), far).otherwise(F.col("end") - 1 - F.col("pos"))
    met = answers.join(ends, key).withColumn("_deep", F.least(left, right))
    best = met.groupBy(key, "pos").agg(F.max_by("tag", F.struct("_deep", -F.col("start"))).alias("tag"))
    before = F.lag("tag").over(Window.partitionBy(key).orderBy("pos"))
    kind = F.substring("tag", 3, 1000)
    starts = F.col("tag").startswith("I-") & ~F.coalesce(F.substring(before, 3, 1000) == kind, F.lit(False))
    return best.select(key, "pos", F.when(starts, F.concat(F.lit("B-"), kind)).otherwise(F.col("tag")).alias("tag"))
