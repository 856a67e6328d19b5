"""Lists and JSON in columns: lenient reading, fallback paths, order by importance or length."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` names it: plain columns are written out at each place."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def bound_as(kind: str, value: Column, f: Callable[[Column], Column]) -> Column:
    """``bound`` for a result of the SQL type ``kind``, by a fold over one value: what ``f`` gives is kept as it is, where an array's items are copied."""
    return F.aggregate(F.array(value), F.expr(f"cast(null as {kind})"), lambda _, v: f(v))


def none() -> Column:
    return F.array().cast("array<string>")


def json_list(c: Column) -> Column:
    """A JSON array of strings as an array; other filled text as its one item; null or blank as none."""
    return F.coalesce(F.from_json(c, "array<string>"), F.when(F.trim(c) != "", F.array(c)), none())


def json_holds(c: Column, wanted: Sequence[str]) -> Column:
    """Whether the JSON array holds all wanted strings."""
    return F.size(F.array_intersect(json_list(c), F.array(*map(F.lit, wanted)))) == len(set(wanted))


def first_path(c: Column, *paths: str) -> Column:
    """The first filled value among JSON paths such as ``$.contact.email``."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(c, p)), F.lit("")) for p in paths])


def blob(*parts: Column) -> Column:
    """Filled parts as one lower-case text; nulls and blanks are left out. Turn arrays into text with ``words`` first."""
    return F.lower(F.concat_ws(" ", *[F.nullif(F.trim(p), F.lit("")) for p in parts]))


def words(items: Column) -> Column:
    """An array as text."""
    return F.array_join(items, " ")


def importance(item: Column, high: Sequence[str], medium: Sequence[str], low: Sequence[str]) -> Column:
    """3, 2 and 1 for holding a word of each kind, half a point more for up to ten characters."""
    low_case = F.lower(item)
    holds = lambda ws: reduce(Column.__or__, [low_case.contains(w) for w in ws], F.lit(False))
    points = sum((F.when(holds(ws), n).otherwise(0) for ws, n in ((high, 3), (medium, 2), (low, 1))), F.lit(0))
    return points + F.when(F.length(item) <= 10, 0.5).otherwise(0.0)


def by_importance(items: Column, high: Sequence[str], medium: Sequence[str], low: Sequence[str]) -> Column:
    """Items by falling importance, equal ones by their first place."""
    keyed = F.transform(items, lambda x: F.struct((-importance(x, high, medium, low)).alias("p"), F.array_position(items, x).alias("at"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def longest_first(items: Column) -> Column:
    """Items by falling length, equal ones by name."""
    return F.transform(F.array_sort(F.transform(items, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda s: s["x"])


def extraction_quality(likeness: Column, words_missing: Column, sections_missing: Column, losses: Column) -> Column:
    """Likeness of two texts less 0.002 a missing word (0.1 at most), 0.05 a missing section and 0.03 a loss of structure, within 0 to 1."""
    q = likeness - F.least(words_missing * 0.002, F.lit(0.1)) - sections_missing * 0.05 - losses * 0.03
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), q))


def first_unmet(steps: Sequence[tuple[str, Column]], done: str) -> tuple[Column, Column]:
    """The first step of an ordered list whose condition does not hold, and the percentage of steps before it."""
    stage = F.coalesce(*[F.when(~F.coalesce(met, F.lit(False)), F.lit(name)) for name, met in steps], F.lit(done))
    names = F.array(*[F.lit(n) for n, _ in steps], F.lit(done))
    return stage, F.floor((F.array_position(names, stage) - 1) * 100 / len(steps)).cast("int")
