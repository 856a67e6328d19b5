"""Records of several sources merged by a table of rules, one a field, in one plan whatever the number of fields.

Values come as rows ``key, source, field, value, score``.  ``policy`` has a row for each field:

- ``rule`` is ``first`` (the first source of ``sources`` with a filled value), ``confident`` (the first whose score reaches ``least``, else the
  first filled one), ``longest`` (the longest value; the first source of equals), ``common`` (the value that most sources give, case aside) or
  ``union`` (all items of values split at ``;``, each once case aside, in order of source and place);
- ``sources`` names them in order; a source that is not named comes last, by name.

Each merged value carries the source that gave it (for a union all of them) and whether filled sources disagree.

Defined cases: null and blank values count for nothing; a field without a rule uses ``first`` by name of source; rows that repeat change
nothing; a key and field without a filled value has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.rows import small


def merge_by_policy(values: DataFrame, policy: DataFrame) -> DataFrame:
    """``key, field, value, source, conflict``; ``policy(field, rule, sources array, least)``."""
    v = values.select("key", "source", "field", F.trim("value").alias("value"), "score").filter("value <> ''")
    p = policy.select("field", "rule", "sources", F.col("least").cast("double").alias("least"))
    met = v.join(small(p), "field", "left").fillna("first", ["rule"])
    place = F.coalesce(F.nullif(F.array_position("sources", F.col("source")), F.lit(0)), F.lit(1 << 30))
    met = met.withColumn("place", place).withColumn("folded", F.lower("value"))
    doubt = F.when(F.col("rule") == "confident", (~F.coalesce(F.col("score") >= F.col("least"), F.lit(False))).cast("int")).otherwise(0)
    size = F.when(F.col("rule") == "longest", -F.length("value")).otherwise(0)
    rank = F.struct(doubt.alias("a"), size.cast("long").alias("b"), F.col("place").alias("c"), F.col("source").alias("d"), F.col("value").alias("e"))
    # equal values first, case aside, with their votes where votes count; then the best of them, and whether there are several
    votes = F.when(F.col("rule") == "common", F.col("folded"))
    plain = met.filter("rule <> 'union'").select("key", "field", "rule", "folded", "source", votes.alias("voted"), rank.alias("m"))
    dealt = plain.repartition("key", "field")  # the groups below are all within a key and field, and their rows move once
    same = dealt.groupBy("key", "field", "rule", "voted", "source").agg(F.min("m").alias("m"), F.min("folded").alias("low"), F.max("folded").alias("high"))
    same = same.groupBy("key", "field", "rule", "voted").agg(F.min("m").alias("m"), F.min("low").alias("low"), F.max("high").alias("high"), F.count("source").alias("votes"))
    best = F.struct(F.col("m.a").alias("a"), F.when(F.col("rule") == "common", -F.col("votes")).otherwise(F.col("m.b")).alias("b"), F.col("m.c").alias("c"), F.col("m.d").alias("d"), F.col("m.e").alias("e"))
    one = same.groupBy("key", "field").agg(F.min(best).alias("m"), (F.min("low") < F.max("high")).alias("conflict"))
    one = one.select("key", "field", F.col("m.e").alias("value"), F.col("m.d").alias("source"), "conflict")
    lists = met.filter("rule = 'union'").select("key", "field", "place", "source", "value").repartition("key", "field")
    items = lists.select("key", "field", "place", "source", F.posexplode(F.split("value", r"\s*;\s*")).alias("at", "item")).filter("item <> ''")
    first = items.groupBy("key", "field", F.lower("item").alias("folded")).agg(F.min(F.struct("place", "source", "at", "item")).alias("m"), F.collect_set("source").alias("from"))
    listed: Column = F.array_sort(F.collect_list("m"))
    many = first.groupBy("key", "field").agg(listed.alias("l"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("from")))).alias("s"))
    many = many.select("key", "field", F.array_join("l.item", ";").alias("value"), F.array_join("s", ",").alias("source"), F.lit(False).alias("conflict"))
    return one.unionByName(many)
