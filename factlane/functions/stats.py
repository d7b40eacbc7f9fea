"""Distribution tails as Column expressions.

Spark has no Student-t or chi-square function, so the tails are written in
closed form and evaluated inside the JVM with ``aggregate`` over a short
``sequence``:

* Student t, integer degrees of freedom: with theta = atan(|t| / sqrt(v)),
  P(|T| < |t|) = 2/pi (theta + sin cos (1 + 2/3 cos^2 + 2*4/(3*5) cos^4 + ...)) for
  odd v and sin (1 + 1/2 cos^2 + 1*3/(2*4) cos^4 + ...) for even v
  (Abramowitz and Stegun 26.7.3-4).
* Chi-square with one degree of freedom: sf(x) = erfc(sqrt(x/2)): near 0 as 1 - erf
  with erf(z) = 2/sqrt(pi) exp(-z^2) sum_k 2^k z^(2k+1) / (2k+1)!!  (all terms
  positive), further out by a continued fraction of its own.

The 95 % two-sided t critical values are a constant table (degrees of freedom
1..T_TABLE_MAX), solved once by bisection on the same closed form and joined
as a broadcast table; above the table an asymptotic expansion is exact to
double precision.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import col_of

T_TABLE_MAX = 1000
_ERF_TERMS = 300
_ERFC_DEPTH = 100


def _empty_int_array() -> Column:
    return F.array().cast("array<int>")


def _series(ratio, c: Column, m: Column) -> Column:
    """sum_{k=0..m} a_k c^k with a_0 = 1 and a_k = a_{k-1} * ratio(k)."""
    ks = F.when(m > 0, F.sequence(F.lit(1), m.cast("int"))).otherwise(_empty_int_array())
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc, k):
        term = acc["term"] * c * ratio(k.cast("double"))
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    return F.aggregate(ks, start, step)["total"]


def t_central_prob(t, df) -> Column:
    """P(|T| < |t|) for Student's t with integer ``df`` >= 1."""
    t, df = col_of(t), col_of(df).cast("int")
    theta = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    c = F.pow(F.cos(theta), 2)
    odd = (df % 2) == 1
    odd_sum = _series(lambda k: (2 * k) / (2 * k + 1), c, (df - 3) / 2)
    even_sum = _series(lambda k: (2 * k - 1) / (2 * k), c, (df - 2) / 2)
    odd_val = F.when(df == 1, 2 / math.pi * theta).otherwise(
        2 / math.pi * (theta + F.sin(theta) * F.cos(theta) * odd_sum))
    return F.when(odd, odd_val).otherwise(F.sin(theta) * even_sum)


def t_two_sided_p(t, df) -> Column:
    """Two-sided p-value of a t statistic; null when t or df is null."""
    t = col_of(t)
    p = F.lit(1.0) - t_central_prob(t, df)
    return F.when(t.isNull() | col_of(df).isNull() | (col_of(df) < 1), F.lit(None).cast("double")).otherwise(
        F.greatest(p, F.lit(0.0)))


def erf(z) -> Column:
    z = col_of(z).cast("double")
    ks = F.sequence(F.lit(1), F.lit(_ERF_TERMS))
    start = F.struct(z.alias("term"), z.alias("total"))

    def step(acc, k):
        term = acc["term"] * 2 * z * z / (2 * k + 1)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    s = F.aggregate(ks, start, step)["total"]
    val = 2 / math.sqrt(math.pi) * F.exp(-z * z) * s
    return F.when(z > 8, F.lit(1.0)).otherwise(F.least(val, F.lit(1.0)))


def erfc(z) -> Column:
    """1 - erf(z) for z >= 0, directly: from 2 on by its continued fraction
    exp(-z^2) / sqrt(pi) / (z + 1/2 / (z + 2/2 / (z + 3/2 / ...))), so that small
    tails keep all their digits (down to the smallest double, at z = 27)."""
    z = col_of(z).cast("double")
    ks = F.sequence(F.lit(_ERFC_DEPTH), F.lit(1), F.lit(-1))
    inner = F.aggregate(ks, z, lambda acc, k: z + k.cast("double") / 2 / acc)
    return F.when(z < 2, F.lit(1.0) - erf(z)).otherwise(F.exp(-z * z) / math.sqrt(math.pi) / inner)


def chi2_1_sf(x) -> Column:
    """Upper tail of chi-square with one degree of freedom."""
    x = col_of(x).cast("double")
    return F.when(x <= 0, F.lit(1.0)).otherwise(erfc(F.sqrt(x / 2)))


def stars(p) -> Column:
    """Significance marks; null p (undefined test) counts as not significant."""
    from ..constants import NOT_SIGNIFICANT, SIGNIFICANCE_LEVELS

    p = col_of(p)
    expr = None
    for bound, mark in SIGNIFICANCE_LEVELS:
        expr = F.when(p < bound, mark) if expr is None else expr.when(p < bound, mark)
    return expr.otherwise(NOT_SIGNIFICANT)


# --- t critical values -------------------------------------------------------

def _t_central_prob_py(t: float, v: int) -> float:
    theta = math.atan(abs(t) / math.sqrt(v))
    c = math.cos(theta) ** 2
    total, term = 1.0, 1.0
    if v % 2 == 1:
        for k in range(1, (v - 3) // 2 + 1):
            term *= c * (2 * k) / (2 * k + 1)
            total += term
        if v == 1:
            return 2 / math.pi * theta
        return 2 / math.pi * (theta + math.sin(theta) * math.cos(theta) * total)
    for k in range(1, (v - 2) // 2 + 1):
        term *= c * (2 * k - 1) / (2 * k)
        total += term
    return math.sin(theta) * total


@lru_cache(maxsize=None)
def t_critical(v: int, confidence: float = 0.95) -> float:
    """Two-sided critical value: P(|T| < x) = confidence."""
    lo, hi = 0.0, 1.0
    while _t_central_prob_py(hi, v) < confidence:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if _t_central_prob_py(mid, v) < confidence:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def _normal_quantile(p: float) -> float:
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if 0.5 * math.erfc(-mid / math.sqrt(2)) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def t_critical_table(spark: SparkSession, confidence: float = 0.95, max_df: int = T_TABLE_MAX) -> DataFrame:
    """(df int, t_crit double) for df 1..max_df; a constant table of ``max_df`` rows."""
    rows = [(v, t_critical(v, confidence)) for v in range(1, max_df + 1)]
    return spark.createDataFrame(rows, "df int, t_crit double")


def t_critical_large_df(df, confidence: float = 0.95) -> Column:
    """Cornish-Fisher expansion of the t quantile; exact to ~1e-12 for df > 1000."""
    z = _normal_quantile(0.5 + confidence / 2)
    v = col_of(df).cast("double")
    g1 = (z ** 3 + z) / 4
    g2 = (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96
    g3 = (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384
    return F.lit(z) + g1 / v + g2 / (v * v) + g3 / (v * v * v)


def with_t_critical(df: DataFrame, df_col: str, out: str = "t_crit", confidence: float = 0.95) -> DataFrame:
    """Attach the critical value for the degrees of freedom in ``df_col``."""
    spark = df.sparkSession
    table = F.broadcast(t_critical_table(spark, confidence).withColumnRenamed("df", "__df")
                        .withColumnRenamed("t_crit", "__tc"))
    joined = df.join(table, col_of(df_col) == F.col("__df"), "left")
    value = F.when(col_of(df_col) > T_TABLE_MAX, t_critical_large_df(df_col, confidence)).otherwise(F.col("__tc"))
    return joined.withColumn(out, value).drop("__df", "__tc")
