"""All named queries (importing the query modules registers them)."""

from . import queries_branches, queries_eval, queries_learn, queries_rules, queries_stats  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["QUERIES", "ORACLE_SQL"]
