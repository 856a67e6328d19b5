"""Parsed records: priority merge of sources, conflicts, validation with warnings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.strings import EMAIL


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[F.when(~blank(c), c) for c in columns])


def confident(rule: Column, model: Column, score: Column, least: float) -> Column:
    """The model's value where its score reaches ``least``, else the rule's, each if filled."""
    return F.when((score >= least) & ~blank(model), model).otherwise(first_filled(rule, model))


def longer(a: Column, b: Column) -> Column:
    return F.when(F.length(F.coalesce(b, F.lit(""))) > F.length(F.coalesce(a, F.lit(""))), b).otherwise(a)


def union_ignore_case(a: Column, b: Column) -> Column:
    """Items of both arrays, each once by lower case, first spelling kept."""
    both = F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))
    start = F.array().cast("array<string>")
    return F.aggregate(both, start, lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))


def conflicts(pairs: Sequence[tuple[str, Column, Column]]) -> Column:
    """Names of fields that differ between two sources or that neither has."""
    bad = lambda a, b: (blank(a) & blank(b)) | (~blank(a) & ~blank(b) & (F.lower(F.trim(a)) != F.lower(F.trim(b))))
    return F.array_compact(F.array(*[F.when(bad(a, b), F.lit(n)) for n, a, b in pairs]))


def valid_name(c: Column) -> Column:
    """The name, or null when it holds an address, a digit or under two letters."""
    return F.when(~c.contains("@") & ~c.rlike("[0-9]") & (F.length(F.trim(c)) >= 2), F.trim(c))


def valid_email(c: Column) -> Column:
    return F.when(c.rlike(f"^{EMAIL}$"), F.lower(c))


def valid_phone(c: Column) -> Column:
    """The number as given, or null when it has not 7 to 15 digits."""
    n = F.length(F.regexp_replace(c, "[^0-9]", ""))
    return F.when((n >= 7) & (n <= 15), c)


def valid_years(c: Column) -> Column:
    return F.when((c >= 0) & (c <= 60), c)


def valid_skills(c: Column) -> Column:
    """Skills of 2 to 50 characters that are no addresses."""
    return F.filter(c, lambda s: (F.length(F.trim(s)) >= 2) & (F.length(s) <= 50) & ~s.contains("http") & ~s.contains("@"))


def warnings(checks: Sequence[tuple[str, Column, Column]]) -> Column:
    """Names of fields that were given but did not pass: (name, given, kept)."""
    return F.array_compact(F.array(*[F.when(given.isNotNull() & kept.isNull(), F.lit(f"invalid {n}")) for n, given, kept in checks]))
