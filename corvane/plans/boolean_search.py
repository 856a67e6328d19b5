"""Boolean text search as a column predicate: ``java AND (spark OR "data lake") NOT intern``.

Words side by side are joined by AND; NOT binds tightest, then AND, then OR; quotes make a phrase.  The
words AND, OR and NOT count as operators in any case, but only as whole words.  The predicate is made of
``ilike`` on one column, so Spark evaluates it in the scan's own stage.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.operators.filters import escape_like

_TOKEN = re.compile(r'\s*(?:(?P<open>\()|(?P<close>\))|"(?P<phrase>[^"]*)"|(?P<bad>")|(?P<word>[^\s()"]+))')


class SearchError(ValueError):
    """What is wrong with a query, and where."""

    def __init__(self, message: str, position: int):
        super().__init__(f"{message} at {position}")
        self.position = position


def predicate(query: str, column: str) -> Column:
    """The predicate of ``query`` on ``column``; null text matches nothing, also under NOT."""
    tokens: list[tuple[str, str, int]] = []
    for m in _TOKEN.finditer(query.rstrip()):
        kind, text = m.lastgroup, m.group(m.lastgroup)
        if kind == "bad":
            raise SearchError("unterminated phrase", m.start("bad"))
        if kind == "word" and text.upper() in ("AND", "OR", "NOT"):
            kind = text.upper()
        tokens.append((kind, text, m.start(m.lastgroup)))
    if not tokens:
        raise SearchError("empty query", 0)
    tokens.append(("end", "", len(query)))
    at = 0

    def take(*kinds: str) -> bool:
        nonlocal at
        hit = tokens[at][0] in kinds
        at += hit
        return hit

    def either() -> Column:
        out = both()
        while take("OR"):
            out = out | both()
        return out

    def both() -> Column:
        out = one()
        while take("AND") or tokens[at][0] in ("NOT", "open", "word", "phrase"):
            out = out & one()
        return out

    def one() -> Column:
        return ~atom() if take("NOT") else atom()

    def atom() -> Column:
        kind, text, place = tokens[at]
        if take("word", "phrase"):
            return F.col(column).ilike(f"%{escape_like(text)}%")
        if take("open"):
            out = either()
            if not take("close"):
                raise SearchError("expected )", tokens[at][2])
            return out
        raise SearchError(f"unexpected {kind}", place)

    out = either()
    if tokens[at][0] != "end":
        raise SearchError(f"unexpected {tokens[at][0]}", tokens[at][2])
    return out


def check(query: str) -> str | None:
    """None for a well-formed query, else what is wrong. Needs an active session, as columns do."""
    try:
        predicate(query, "text")
    except SearchError as e:
        return str(e)
    return None
