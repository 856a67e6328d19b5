"""Token tags (begin, inside, outside): consistency, entity spans, balance, weak tags, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kind(label: Column) -> Column:
    return F.regexp_replace(label, "^[BI]-", "")


def inconsistent(df: DataFrame, sent: str, pos: str, label: str) -> DataFrame:
    """Tokens tagged I-x whose current entity (the last B- since the last O) is not of type x."""
    w = Window.partitionBy(sent).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    state = F.last(F.when(F.col(label).startswith("B-"), kind(F.col(label))).when(F.col(label) == "O", F.lit("O")), True).over(w)
    return df.withColumn("_state", F.coalesce(state, F.lit("O"))).filter(F.col(label).startswith("I-") & (F.col("_state") != kind(F.col(label)))).drop("_state")


def entities(df: DataFrame, sent: str, pos: str, token: str, label: str) -> DataFrame:
    """``sent, start, type, text, n_tokens`` of each B- token and the I- tokens of its type that follow it."""
    w = Window.partitionBy(sent).orderBy(pos)
    opens = F.col(label).startswith("B-") | (F.col(label) == "O") | (F.lag(label).over(w).isNull())
    run = df.withColumn("_new", opens.cast("int")).withColumn("_run", F.sum("_new").over(w))
    rows = run.filter(F.col(label) != "O").groupBy(sent, "_run").agg(F.sort_array(F.collect_list(F.struct(pos, token, label))).alias("r"))
    rows = rows.withColumn("type", kind(F.col("r")[0][label])).filter(F.col("r")[0][label].startswith("B-"))
    own = F.filter("r", lambda x: kind(x[label]) == F.col("type"))
    return rows.select(sent, F.col("r")[0][pos].alias("start"), "type", F.array_join(F.transform(own, lambda x: x[token]), " ").alias("text"), F.size(own).alias("n_tokens"))


def ambiguous(ents: DataFrame) -> DataFrame:
    """Entity texts (lower case) that carry more than one type."""
    return ents.groupBy(F.lower("text").alias("text")).agg(F.sort_array(F.collect_set("type")).alias("types")).filter(F.size("types") > 1)


def suspicious(ents: DataFrame) -> DataFrame:
    """Entities of one character or of digits only."""
    return ents.filter((F.length("text") == 1) | F.col("text").rlike("^[0-9]+$"))


def uneven(df: DataFrame, label: str, most: float = 100.0) -> DataFrame:
    """``largest, smallest, ratio, uneven``: the commonest and rarest type (without O), and whether one is over ``most`` times the other."""
    n = balance(df, label).filter("type <> 'O'")
    out = n.agg(F.max("n").alias("largest"), F.min("n").alias("smallest"))
    return out.withColumn("ratio", F.round(F.try_divide("largest", "smallest"), 2)).withColumn("uneven", F.coalesce(F.col("ratio") > most, F.lit(False)))


def balance(df: DataFrame, label: str) -> DataFrame:
    """``type, n, pct`` of tags without their B- or I-."""
    n = df.groupBy(kind(F.col(label)).alias("type")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total)).select("type", "n", F.round(F.col("n") * 100.0 / F.col("total"), 2).alias("pct"))


def tag_spans(tokens: Column, spans: Column) -> Column:
    """Tags of ``tokens`` (start, end) by ``spans`` (start, end, type): the first token that overlaps a span begins it."""

    # each token's first span, then each compared with its left neighbour's: tokens are in order
    hit = lambda t: F.get(F.filter(spans, lambda s: (t["start"] < s["end"]) & (t["end"] > s["start"])), F.lit(0))
    hits = F.transform(tokens, hit)
    same = lambda h, i: (i > 0) & F.get(hits, i - 1).eqNullSafe(h)
    return F.transform(hits, lambda h, i: F.when(h.isNull(), "O").otherwise(F.concat(F.when(same(h, i), "I-").otherwise("B-"), h["type"])))


def split(df: DataFrame, key: Column, parts: int, held: int, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: 'test' for ``held`` of ``parts`` parts of the keys, dealt by a hash with a seed, else 'train'."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("long")
    return df.withColumn("split", F.when(F.pmod(drawn, F.lit(parts)) >= parts - held, "test").otherwise("train"))
