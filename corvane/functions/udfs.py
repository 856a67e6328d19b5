"""The few functions that built-ins cannot express, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence: one row of the table is one integer, whose bits are worked on together."""
    if len(a) > len(b):
        a, b = b, a
    n = 0
    while n < len(a) and a[n] == b[n]:
        n += 1
    a, b = a[n:], b[n:]
    k = 0
    while k < len(a) and a[-1 - k] == b[-1 - k]:
        k += 1
    a, b = a[: len(a) - k], b[: len(b) - k]
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        if (m := places.get(c)) is not None:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return n + k + len(a) - row.bit_count()


@pandas_udf(DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of two texts that their longest common subsequence makes up, 0 to 1 (two empty texts: 1); null where either is null.

    The work is the product of the lengths over 64 and the memory linear, whole texts are compared.
    """
    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        return 2 * common_length(x, y) / (len(x) + len(y)) if x or y else 1.0

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


_GAP = re.compile(r"\S {4,}(?=\S)")


@pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching runs of two texts, 0 to 1; null where either is null."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


@pandas_udf(StringType())
def reading_order(text: pd.Series) -> pd.Series:
    """Pages set in two columns as left column, then right one; other texts as they are.

    A text counts as two columns when at least three lines and half of all have one wide gap at about the same place.
    """

    def fix(t: str | None) -> str | None:
        if t is None:
            return None
        lines = t.split("\n")
        at = sorted(m.end() for line in lines if (m := _GAP.search(line)))
        if len(at) < 3 or 2 * len(at) < len(lines):
            return t
        mid = at[len(at) // 2]
        left, right = [], []
        for line in lines:
            m = _GAP.search(line)
            if m and abs(m.end() - mid) <= 8:
                left.append(line[: m.end()].rstrip())
                right.append(line[m.end() :])
            else:
                left.append(line)
        return "\n".join(left + right)

    return text.map(fix)
