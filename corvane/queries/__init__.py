"""Reports and searches over the example tables; importing this package registers them all."""

from corvane.queries import boards, extracts, groups, kpis, lists, lookups, people, postings, scores, states, texts  # noqa: F401
from corvane.queries.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
