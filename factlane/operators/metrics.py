"""Classification metrics (G1-G17) from one grouped aggregate.

Predictions of every condition (model, baselines) are unpivoted into one
``(condition, pred)`` column pair, pairs with a missing label or prediction are
dropped (P11), and a single ``groupingSets`` aggregate counts tn/fp/fn/tp for
the overall rows and the per-domain rows at once: one hash exchange, with
partial aggregation before it, whatever the data size. Every metric is then
arithmetic on the four counts of a row (the aggregate output is tiny).

Conventions (sklearn-compatible): macro averages run over the labels present
in truth or prediction; undefined precision/recall/F1 are 0; kappa is null
when undefined; MCC is 0 when its denominator is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MODEL_CONDITION

RECORD_COLUMNS = ["accuracy", "precision", "recall", "f1_score", "cohen_kappa", "mcc", "precision_false",
                  "recall_false", "f1_false", "precision_true", "recall_true", "f1_true", "macro_f1", "weighted_f1"]
COUNT_COLUMNS = ["tn", "fp", "fn", "tp", "n_samples"]


def long_predictions(df: DataFrame, conditions: dict[str, str], keys, label: str = "label",
                     pred: str = "pred", baselines_once: bool = True, run_col: str = "run_id") -> DataFrame:
    """Unpivot prediction columns ``{column: condition name}`` into
    ``(keys..., label, condition, pred)``. With ``baselines_once`` only the
    model condition is kept for runs other than 0 (G17)."""
    keys = list(keys)
    cols = list(conditions)
    long = df.select(*keys, label, *[F.col(c).cast("int").alias(c) for c in cols]).unpivot(
        keys + [label], cols, "__var", pred)
    name = None
    for c, cond in conditions.items():
        name = F.when(F.col("__var") == c, cond) if name is None else name.when(F.col("__var") == c, cond)
    long = long.withColumn("condition", name).drop("__var")
    if baselines_once and run_col in keys:
        long = long.where((F.col("condition") == MODEL_CONDITION) | (F.col(run_col) == 0))
    return long


def confusion_counts(df: DataFrame, by, domain: str | None = "domain", label: str = "label",
                     pred: str = "pred", per_domain: bool = True) -> DataFrame:
    """(by..., domain, level, tn, fp, fn, tp, n_samples). ``level`` is
    'overall' (domain null) or 'domain'; rows with a null domain count only in
    the overall rows."""
    by = list(by)
    valid = df.where(F.col(label).isNotNull() & F.col(pred).isNotNull())
    y, p = F.col(label), F.col(pred)
    aggs = [F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
            F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"),
            F.count(F.lit(1)).alias("n_samples")]
    if domain is None or not per_domain:
        out = valid.groupBy(*by).agg(*aggs).withColumn("level", F.lit("overall"))
        if domain is not None:
            out = out.withColumn(domain, F.lit(None).cast("string"))
        return out
    sets = [[F.col(c) for c in by], [F.col(c) for c in by] + [F.col(domain)]]
    out = valid.groupingSets(sets, *[F.col(c) for c in by + [domain]]).agg(
        *aggs, F.grouping(F.col(domain)).alias("__gd"))
    out = out.withColumn("level", F.when(F.col("__gd") == 1, "overall").otherwise("domain")).drop("__gd")
    # domain-level rows only for rows that have a domain
    return out.where((F.col("level") == "overall") | F.col(domain).isNotNull())


def _div0(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def with_metrics(counts: DataFrame) -> DataFrame:
    """G2-G7 from tn/fp/fn/tp (+ ``n_present``: labels seen in truth or prediction)."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    p1, r1, f1 = _div0(tp, tp + fp), _div0(tp, tp + fn), _div0(2 * tp, 2 * tp + fp + fn)
    p0, r0, f0 = _div0(tn, tn + fn), _div0(tn, tn + fp), _div0(2 * tn, 2 * tn + fn + fp)
    has1 = F.when(tp + fn + fp > 0, 1.0).otherwise(0.0)
    has0 = F.when(tn + fp + fn > 0, 1.0).otherwise(0.0)
    k = has0 + has1
    s0, s1 = tn + fp, tp + fn
    pe = ((tn + fp) * (tn + fn) + (fn + tp) * (fp + tp)) / (n * n)
    acc = (tp + tn) / n
    mcc_den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return counts.withColumns({
        "n_present": k.cast("int"),
        "accuracy": acc,
        "precision": (p0 * has0 + p1 * has1) / k,
        "recall": (r0 * has0 + r1 * has1) / k,
        "f1_score": (f0 * has0 + f1 * has1) / k,
        "cohen_kappa": F.try_divide(acc - pe, 1 - pe),
        "mcc": F.when(mcc_den == 0, 0.0).otherwise((tp * tn - fp * fn) / mcc_den),
        "precision_false": p0, "recall_false": r0, "f1_false": f0,
        "precision_true": p1, "recall_true": r1, "f1_true": f1,
        "macro_f1": (f0 * has0 + f1 * has1) / k,
        "weighted_f1": (s0 * f0 + s1 * f1) / n,
        "weighted_precision": (s0 * p0 + s1 * p1) / n,
        "weighted_recall": (s0 * r0 + s1 * r1) / n,
    })


def apply_degenerate(records: DataFrame, on_degenerate: str = "drop") -> DataFrame:
    """A record over a single observed class is dropped (``drop``) or keeps
    its accuracy with every other metric 0 (``zero``)."""
    one = F.col("n_present") < 2
    if on_degenerate == "drop":
        return records.where(~one)
    zeroed = {c: F.when(one, F.lit(0.0)).otherwise(F.col(c))
              for c in RECORD_COLUMNS if c != "accuracy" and c in records.columns}
    return records.withColumns(zeroed)


def metrics_table(long: DataFrame, by, domain: str | None = "domain", label: str = "label", pred: str = "pred",
                  per_domain: bool = True) -> DataFrame:
    """Counts and all metrics for the overall rows and (optionally) the domain rows."""
    return with_metrics(confusion_counts(long, by, domain, label, pred, per_domain))


def metric_records(table: DataFrame, on_degenerate: str = "drop") -> DataFrame:
    """One record per overall row (dataset x condition x run)."""
    return apply_degenerate(table.where(F.col("level") == "overall"), on_degenerate)


def class_report(table: DataFrame, keys) -> DataFrame:
    """G5 long form: (keys..., class, precision, recall, f1, support), one row per
    class present in truth or prediction (never fails on a single class)."""
    keys = list(keys)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    rows = F.array(
        F.struct(F.lit("False").alias("class"), F.col("precision_false").alias("precision"),
                 F.col("recall_false").alias("recall"), F.col("f1_false").alias("f1"),
                 (tn + fp).alias("support"), ((tn + fp + fn) > 0).alias("present")),
        F.struct(F.lit("True").alias("class"), F.col("precision_true").alias("precision"),
                 F.col("recall_true").alias("recall"), F.col("f1_true").alias("f1"),
                 (tp + fn).alias("support"), ((tp + fn + fp) > 0).alias("present")),
    )
    return (table.select(*keys, F.inline(rows)).where(F.col("present")).drop("present"))


def pooled_domain_metrics(long: DataFrame, keys=("dataset",), domain: str = "domain", label: str = "label",
                          pred: str = "pred") -> DataFrame:
    """Domain metrics pooled over all runs (model rows), null domains left out."""
    keys = list(keys)
    rows = long.where(F.col(domain).isNotNull())
    return with_metrics(confusion_counts(rows, keys + [domain], None, label, pred, per_domain=False)
                        .drop("level"))


def accuracy_by(df: DataFrame, keys, label: str = "label", pred: str = "prediction") -> DataFrame:
    """(keys..., accuracy, n) where accuracy = mean(label == pred)."""
    correct = (F.col(label) == F.col(pred)).cast("double")
    return df.groupBy(*keys).agg(F.avg(correct).alias("accuracy"), F.count(F.lit(1)).alias("n"))
