"""Sinks and table maintenance: exports, upserts, replacement of partitions, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.rows import keep_first


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    """CSV with a header, doubled quotes and ISO timestamps."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", quote_all).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def json_rows(df: DataFrame) -> DataFrame:
    """``value``: each row as one JSON object, nulls left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def replace_partitions(df: DataFrame, path: str, key: str) -> None:
    """Replace exactly the partitions of ``key`` that ``df`` holds (delete-then-insert by key)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with equal keys; others stay."""
    return old.join(new.select(keys).distinct(), keys, "left_anti").unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of ``new`` enter only where their key is free; of equal new keys the first in ``order`` (by all columns unless given)."""
    first = keep_first(new, [F.col(k) for k in keys], *[F.col(c) for c in order or new.columns])
    return old.unionByName(first.join(old.select(keys), keys, "left_anti"))


def soft_delete(df: DataFrame, where: Column, now: Column) -> DataFrame:
    return df.withColumn("status", F.when(where, F.lit("deleted")).otherwise(F.col("status"))).withColumn("deleted_at", F.when(where, now).otherwise(F.col("deleted_at")))


def expire_not_seen(current: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """``current`` with ``is_active`` false where the key was not seen now."""
    found = seen.select(key).distinct().withColumn("_seen", F.lit(True))
    return current.join(found, key, "left").withColumn("is_active", F.coalesce(F.col("_seen"), F.lit(False))).drop("_seen")


def conll_lines(df: DataFrame, sent: str, pos: str, token: str, label: str) -> DataFrame:
    """One text per sentence: token, tab and label a line, then a blank line. Write with ``df.write.text``."""
    rows = df.groupBy(sent).agg(F.sort_array(F.collect_list(F.struct(pos, token, label))).alias("rows"))
    lines = F.transform("rows", lambda r: F.concat_ws("\t", r[token], r[label]))
    return rows.select(sent, F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("value"))


def import_candidates(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """CSV rows that name someone new: keyed by the digest of the e-mail, skills split, confidence by filled fields.

    Of rows with one e-mail the first by all columns enters; rows without an e-mail have no key and all enter.
    """
    mail = F.lower(F.trim("email"))
    rows = rows.filter(F.trim("name") != "").withColumn("email_key", F.when(mail != "", F.md5(mail)))
    keyed = keep_first(rows.filter("email_key is not null"), [F.col("email_key")], *[F.col(c) for c in rows.columns])
    fresh = keyed.join(existing.select("email_key"), "email_key", "left_anti").unionByName(rows.filter("email_key is null"))
    filled = lambda c, w: F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", w).otherwise(0.0)
    score = F.round(F.lit(0.40) + filled("email", 0.15) + filled("phone", 0.15) + filled("skills", 0.20), 2)
    skills = F.filter(F.transform(F.split("skills", ";"), lambda x: F.trim(x)), lambda s: s != "")
    return fresh.withColumn("confidence", score).withColumn("skills", skills)
