"""Baselines (B1-B3, B6) and arg-max.

Random draws are seeded hashes of the row key (same answer on every rerun and
partitioning). The majority label is one tiny aggregate per group, broadcast
back to the rows after its row count is checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BASELINE_SEED, SUSPICIOUS_KEYWORDS
from ..functions.hashing import hash_bit
from ..functions.text import array_argmax, col_of, contains_any


def random_baseline(key="claim_id", seed=BASELINE_SEED) -> Column:
    """B1: 0/1 with equal chance; ``seed`` an int or a column."""
    s = F.lit(seed) if isinstance(seed, int) else col_of(seed)
    return hash_bit(s, col_of(key))


def keyword_baseline(text="claim", keywords=SUSPICIOUS_KEYWORDS) -> Column:
    """0 when the lower-cased claim holds a suspicious keyword, else 1."""
    return F.when(contains_any(F.lower(col_of(text)), keywords), F.lit(0)).otherwise(F.lit(1))


def majority_labels(train: DataFrame, group=("dataset", "run_id"), label: str = "label",
                    out: str = "majority_baseline") -> DataFrame:
    """B2: most frequent label per group; ties go to the smaller label."""
    return (train.where(F.col(label).isNotNull()).groupBy(*group)
            .agg(F.mode(F.col(label), True).cast("int").alias(out)))


def with_majority(df: DataFrame, train: DataFrame, group=("dataset", "run_id"), label: str = "label",
                  out: str = "majority_baseline") -> DataFrame:
    """Attach the train part's majority label to every row of the group (a
    broadcast of one row per group, behind a check of its row count)."""
    from ..session import join_small

    return join_small(df, majority_labels(train, group, label, out), list(group), "left")


def guard_counts(train: DataFrame, group=("dataset", "run_id"), text: str = "claim", label: str = "label",
                 min_rows: int = 10) -> DataFrame:
    """Valid rows (non-null label, non-blank claim) per group and whether
    the learned baseline must fall back to the majority label."""
    from ..functions.text import ustrip

    valid = col_of(label).isNotNull() & col_of(text).isNotNull() & (ustrip(text) != "")
    return (train.groupBy(*group).agg(F.count_if(valid).alias("n_valid"))
            .withColumn("use_majority", F.col("n_valid") < min_rows))


def argmax_class(scores="scores") -> Column:
    """class = position of the first maximum score."""
    return array_argmax(scores)
