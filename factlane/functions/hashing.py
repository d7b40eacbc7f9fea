"""Deterministic, partition-independent pseudo-random numbers.

Every random choice (split order, random baseline, bootstrap draws, stand-in
model answers) is a function of the row key and a seed, so a rerun, a retried
task or a different partitioning gives the same rows. The hash is the leading
hex digits of ``md5(seed|key)`` so the same value can be written in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_of


def hash_key(*parts) -> Column:
    """``md5`` of the parts joined by ``|`` (all cast to string)."""
    return F.md5(F.concat_ws("|", *[col_of(p).cast("string") for p in parts]))


def hash_int(*parts, digits: int = 8) -> Column:
    """Leading ``digits`` hex digits of ``hash_key`` as a non-negative bigint
    (``digits`` <= 15 keeps it below 2**60)."""
    return F.conv(F.substring(hash_key(*parts), 1, digits), 16, 10).cast("bigint")


def hash_mod(n: int, *parts, digits: int = 8) -> Column:
    return hash_int(*parts, digits=digits) % F.lit(n)


def hash_bit(*parts) -> Column:
    """0 or 1 with equal chance."""
    return (hash_int(*parts) % 2).cast("int")


def run_seed(run_id, seeds: list[int]) -> Column:
    """``seeds[run_id % len(seeds)]``."""
    return F.element_at(F.array(*[F.lit(s) for s in seeds]), (col_of(run_id) % len(seeds) + 1).cast("int"))
