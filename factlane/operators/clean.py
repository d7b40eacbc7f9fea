"""Cleaning and row filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE_CLASS, col_of

NON_SPACE = "[^" + SPACE_CLASS[1:]


def _blank(text) -> "F.Column":
    """Empty after a Python-style strip, tested as "no non-space character"
    (the regex stops at the first visible character instead of rewriting the
    whole text)."""
    return ~col_of(text).rlike(NON_SPACE)


def clean_claims(df: DataFrame, required=("claim", "label", "domain"), text: str = "claim") -> DataFrame:
    """Drop rows missing a required value or with a blank claim."""
    return df.dropna(subset=list(required)).where(~_blank(text))


def clean_report(df: DataFrame, required=("claim", "label", "domain"), text: str = "claim",
                 by=("dataset",)) -> DataFrame:
    """P9 report: (by..., before, after, removed) in one aggregate pass."""
    keep = F.lit(True)
    for c in required:
        keep = keep & F.col(c).isNotNull()
    keep = keep & ~F.coalesce(_blank(text), F.lit(True))
    return (df.groupBy(*by).agg(F.count(F.lit(1)).alias("before"), F.count_if(keep).alias("after"))
            .withColumn("removed", F.col("before") - F.col("after")))


def drop_unanswered_report(results: DataFrame, by=("dataset", "run_id"), label: str = "label",
                           pred: str = "prediction") -> DataFrame:
    """P10 report: (by..., n_total, n_clean, dropped, coverage)."""
    ok = F.col(label).isNotNull() & F.col(pred).isNotNull()
    return (results.groupBy(*by).agg(F.count(F.lit(1)).alias("n_total"), F.count_if(ok).alias("n_clean"))
            .withColumn("dropped", F.col("n_total") - F.col("n_clean"))
            .withColumn("coverage", F.col("n_clean") / F.col("n_total")))


def valid_pair(label="label", pred="prediction") -> "F.Column":
    """P11."""
    return col_of(label).isNotNull() & col_of(pred).isNotNull()


def correct_flag(label="label", pred="prediction") -> "F.Column":
    """label == prediction (null when either is missing)."""
    return col_of(label) == col_of(pred)


def error_kind(label="label", pred="prediction") -> "F.Column":
    """P13: 'FP' (label 0, predicted 1), 'FN' (label 1, predicted 0), else null."""
    y, p = col_of(label), col_of(pred)
    return F.when((y == 0) & (p == 1), F.lit("FP")).when((y == 1) & (p == 0), F.lit("FN"))


def skip_missing_claim(prediction, claim="claim") -> "F.Column":
    """No prediction for a missing claim."""
    return F.when(col_of(claim).isNull(), F.lit(None).cast("int")).otherwise(prediction)
