"""Predicates: substring search, ranges, windows before a given now, row scopes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escape_like(term: str) -> str:
    """``term`` as literal text of a LIKE pattern."""
    return term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_any(term: str, columns: Sequence[str]) -> Column:
    """Case-blind substring in any of the columns."""
    return reduce(Column.__or__, [F.col(c).ilike(f"%{escape_like(term)}%") for c in columns])


def contains_all(terms: Sequence[str], columns: Sequence[str]) -> Column:
    """Every term in some column."""
    return reduce(Column.__and__, [contains_any(t, columns) for t in terms], F.lit(True))


def any_like(column: str, terms: Sequence[str]) -> Column:
    return reduce(Column.__or__, [F.col(column).ilike(f"%{escape_like(t)}%") for t in terms], F.lit(False))


def in_list(column: str, values: str) -> Column:
    """Case-blind membership in a comma-separated list."""
    return F.lower(column).isin([v.strip().lower() for v in values.split(",") if v.strip()])


def has_skills(skills: str, text: str, wanted: Sequence[str]) -> Column:
    """Every wanted skill is in the array of skills or in the text."""
    one = lambda w: F.exists(skills, lambda s: F.lower(s) == w.lower()) | F.col(text).ilike(f"%{escape_like(w)}%")
    return reduce(Column.__and__, [F.coalesce(one(w), F.lit(False)) for w in wanted], F.lit(True))


def number_range(column: str, low: float | None = None, high: float | None = None) -> Column:
    out = F.lit(True)
    if low is not None:
        out = out & (F.col(column) >= low)
    return out if high is None else out & (F.col(column) <= high)


def date_range(column: str, start: str | None, end: str | None, now: str, days: int = 30) -> Column:
    """From start to end, both ends included; neither given: the last ``days`` before ``now``."""
    c = F.col(column)
    if start is None and end is None:
        return c >= F.expr(f"timestamp_ntz '{now}' - make_interval(0, 0, 0, {int(days)})")
    out = F.lit(True)
    if start is not None:
        out = out & (c >= F.expr(f"timestamp_ntz '{start}'"))
    return out if end is None else out & (c <= F.expr(f"timestamp_ntz '{end}'"))


def filled(column: str) -> Column:
    return F.col(column).isNotNull() & (F.col(column) != "")


def not_in(column: str, values: Sequence[object]) -> Column:
    """Values that are none of the list; null is neither."""
    return ~F.col(column).isin(list(values))


def of_tenant(column: str, tenant: object, shared: bool = False) -> Column:
    """Rows of one tenant, with ``shared`` also those of none."""
    own = F.col(column) == tenant
    return own | F.col(column).isNull() if shared else own


def state_of(steps: Sequence[tuple[str, str]], first: str) -> Column:
    """The state that the latest filled column of ``(state, column)`` gives, in order; ``first`` where none is filled."""
    return F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(s)) for s, c in reversed(steps)], F.lit(first))


def not_deleted(status: str, deleted_at: str | None = None) -> Column:
    """Rows whose status is null or not 'deleted' (and without a deletion time)."""
    out = F.col(status).isNull() | (F.col(status) != "deleted")
    return out if deleted_at is None else out & F.col(deleted_at).isNull()


def scope(df: DataFrame, role: str, user: object, owner: str, users: DataFrame | None = None, user_key: str = "id", lead: str = "team_lead_id") -> DataFrame:
    """Rows a user may see: all for an admin, the team's for a lead, own ones for a member, none for others."""
    if role == "admin":
        return df
    if role == "lead" and users is not None:
        team = users.filter((F.col(lead) == user) | (F.col(user_key) == user)).select(F.col(user_key).alias(owner)).distinct()
        return df.join(team, owner, "left_semi")
    if role == "member":
        return df.filter(F.col(owner) == user)
    return df.filter(F.lit(False))
