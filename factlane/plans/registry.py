"""Named queries: a Spark job per inventory row, each with its DuckDB twin.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE_SQL[name]`` (DuckDB
SQL over the pre-registered views of the same tables). Rows without a SQL twin
are checked by row count and by unit tests against brute force.

Doubles are rounded to 6 digits on both sides; counts are bigint on both sides.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (report precision; makes engines comparable)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# --- SQL building blocks (DuckDB) --------------------------------------------

def sql_hash(*parts: str, digits: int = 8) -> str:
    joined = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(('0x' || substr(md5(concat_ws('|', {joined})), 1, {digits})) AS BIGINT)"


def sql_list(words) -> str:
    return "[" + ", ".join(sql_str(w) for w in words) + "]"


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_contains_any(expr: str, words) -> str:
    if not words:
        return "false"
    return "(" + " OR ".join(f"contains({expr}, {sql_str(w)})" for w in words) + ")"


def sql_word_regex(words) -> str:
    import re
    alt = "|".join(re.escape(w) for w in words)
    return sql_str(r"(^|[^\p{L}\p{N}_])(" + alt + r")($|[^\p{L}\p{N}_])")


def sql_domain(expr: str, domains: dict) -> str:
    whens = " ".join(f"WHEN {sql_contains_any(expr, ws)} THEN {sql_str(name)}" for name, ws in domains.items())
    return f"(CASE {whens} END)"


SQL_SEEDS = "[42, 123, 456, 789, 999]"


def sql_claims(domain: str = "lang") -> str:
    return f"""
    claims AS (
      SELECT CASE WHEN d.doc_id % 2 = 0 THEN 'UGC' ELSE 'NGC' END AS dataset,
             d.doc_id AS claim_id, d.text AS claim, d.{domain} AS domain, CAST(l.quality AS INTEGER) AS label
      FROM documents d JOIN labels l ON d.doc_id = l.doc_id
    )"""


def sql_runs(n_runs: int = 5) -> str:
    return f"""
    runs AS (SELECT CAST(r AS INTEGER) AS run_id, {SQL_SEEDS}[r % 5 + 1] AS seed FROM range(0, {n_runs}) t(r))"""


def sql_split(src: str = "claims", by_domain: bool = True, test_share: float = 0.3, seed: str = "seed",
              group: tuple = ("dataset", "run_id"), name: str = "split", cross_runs: bool = True) -> str:
    """Plain ranking version of the exact stratified split (the Spark job uses
    bucketed ranking; both must agree)."""
    g = ", ".join(group)
    s1 = ("concat_ws('_', coalesce(CAST(domain AS VARCHAR), 'nan'), coalesce(CAST(label AS VARCHAR), 'nan'))"
          if by_domain else "coalesce(CAST(label AS VARCHAR), 'nan')")
    src_rows = f"{src} CROSS JOIN runs" if cross_runs else src
    return f"""
    {name}_keyed AS (
      SELECT *, {sql_hash(seed, 'claim_id', digits=15)} AS h, {s1} AS s1,
             coalesce(CAST(label AS VARCHAR), 'nan') AS s2
      FROM {src_rows}),
    {name}_s1 AS (SELECT {g}, s1, count(*) AS ns FROM {name}_keyed GROUP BY {g}, s1),
    {name}_flags AS (
      SELECT {g}, sum(ns) AS big_n, CAST(ceil({test_share}::DOUBLE * sum(ns)) AS BIGINT) AS ntest,
             min(ns) AS mn, count(*) AS k
      FROM {name}_s1 GROUP BY {g}),
    {name}_flags2 AS (
      SELECT *, big_n - ntest AS ntrain, (mn >= 2 AND ntest >= k AND big_n - ntest >= k) AS prim
      FROM {name}_flags),
    {name}_fk AS (
      SELECT k.*, f.big_n, f.ntrain, f.prim, CASE WHEN f.prim THEN k.s1 ELSE k.s2 END AS s
      FROM {name}_keyed k JOIN {name}_flags2 f USING ({g})),
    {name}_strata AS (
      SELECT {g}, s, any_value(big_n) AS big_n, any_value(ntrain) AS ntrain, count(*) AS ns
      FROM {name}_fk GROUP BY {g}, s),
    {name}_q1 AS (
      SELECT *, (CAST(ntrain AS HUGEINT) * ns) // big_n AS fl, (CAST(ntrain AS HUGEINT) * ns) % big_n AS rem
      FROM {name}_strata),
    {name}_q2 AS (
      SELECT *, ntrain - sum(fl) OVER (PARTITION BY {g}) AS need,
             row_number() OVER (PARTITION BY {g} ORDER BY rem DESC, s ASC) AS rk
      FROM {name}_q1),
    {name}_quota AS (SELECT {g}, s, fl + CASE WHEN rk <= need THEN 1 ELSE 0 END AS quota FROM {name}_q2),
    {name}_ranked AS (
      SELECT *, row_number() OVER (PARTITION BY {g}, s ORDER BY h, claim_id) AS rn FROM {name}_fk),
    {name} AS (
      SELECT r.* EXCLUDE (h, s1, s2, s, big_n, ntrain, prim, rn),
             CASE WHEN r.rn <= q.quota THEN 'train' ELSE 'test' END AS split,
             CASE WHEN r.prim THEN 'strata' ELSE 'fallback' END AS stratified_by
      FROM {name}_ranked r JOIN {name}_quota q USING ({g}, s))"""


def sql_with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)
