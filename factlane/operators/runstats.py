"""Statistics over runs.

Inputs are metric records (one row per dataset x condition x run, from
``metrics.metric_records``) or per-row results. Every operator is a grouped
aggregate, so any number of datasets / conditions is handled in one job;
undefined statistics (one run, zero variance) are null and count as not
significant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BOOTSTRAP_RESAMPLES, CONFIDENCE_LEVEL, MODEL_CONDITION
from ..functions.hashing import hash_int
from ..functions.stats import chi2_1_sf, stars, t_two_sided_p, with_t_critical

SUMMARY_METRICS = ["accuracy", "precision", "recall", "f1_score"]


def model_rows(records: DataFrame, condition: str = MODEL_CONDITION) -> DataFrame:
    return records.where(F.col("condition") == condition)


def run_summary(records: DataFrame, metrics=SUMMARY_METRICS, keys=("dataset",)) -> DataFrame:
    """A1: mean and population std over runs of each metric (model rows)."""
    aggs = [F.count(F.lit(1)).alias("n_runs")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"mean_{m}"), F.stddev_pop(m).alias(f"std_{m}")]
    return model_rows(records).groupBy(*keys).agg(*aggs)


def executive_summary(records: DataFrame, keys=("dataset",)) -> DataFrame:
    """A2: mean accuracy, sample std, mean macro F1, best run accuracy."""
    return model_rows(records).groupBy(*keys).agg(
        F.avg("accuracy").alias("mean_accuracy"), F.stddev_samp("accuracy").alias("std_accuracy"),
        F.avg("macro_f1").alias("mean_macro_f1"), F.max("accuracy").alias("best_run_accuracy"))


def t_interval(records: DataFrame, metric: str = "accuracy", keys=("dataset",),
               confidence: float = CONFIDENCE_LEVEL) -> DataFrame:
    """A3: Student-t interval of the mean over runs (df = n - 1, sample
    standard error); only groups with more than one run."""
    agg = (model_rows(records).groupBy(*keys)
           .agg(F.count(F.lit(1)).alias("n"), F.avg(metric).alias("mean"),
                (F.stddev_samp(metric) / F.sqrt(F.count(F.lit(1)))).alias("sem"))
           .where(F.col("n") > 1).withColumn("df", (F.col("n") - 1).cast("int")))
    agg = with_t_critical(agg, "df", confidence=confidence)
    return (agg.withColumn("lower", F.col("mean") - F.col("t_crit") * F.col("sem"))
            .withColumn("upper", F.col("mean") + F.col("t_crit") * F.col("sem"))
            .select(*keys, F.lit(metric).alias("metric"), "n", "mean", "lower", "upper"))


def bootstrap_interval(records: DataFrame, metric: str = "accuracy", keys=("dataset",),
                       resamples: int = BOOTSTRAP_RESAMPLES, confidence: float = CONFIDENCE_LEVEL,
                       seed: int = 42) -> DataFrame:
    """A4: bootstrap percentile interval of the mean over runs. Draw j of
    resample r picks run position md5(seed|keys|r|j) mod n; resample means are
    averaged per (group, r) and cut at the linear percentiles."""
    keys = list(keys)
    alpha = 1 - confidence
    runs = (model_rows(records).select(*keys, "run_id", F.col(metric).alias("__v"))
            .withColumn("__pos", (F.row_number().over(Window.partitionBy(*keys).orderBy("run_id")) - 1)
                        .cast("bigint")))
    sizes = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    draws = (sizes.withColumn("__r", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
             .withColumn("__j", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))))
             .withColumn("__pos", hash_int(F.lit(seed), *[F.col(k) for k in keys], F.col("__r"), F.col("__j"))
                         % F.col("__n")))
    means = draws.join(runs, keys + ["__pos"]).groupBy(*keys, "__r").agg(F.avg("__v").alias("__m"))
    return means.groupBy(*keys).agg(
        F.percentile("__m", F.lit(alpha / 2)).alias("lower"),
        F.percentile("__m", F.lit(1 - alpha / 2)).alias("upper")).withColumn("metric", F.lit(metric))


def one_sample_tests(records: DataFrame, metric: str = "accuracy", keys=("dataset",)) -> DataFrame:
    """A5 + A7 + A10: model runs vs every baseline record of the same group:
    improvement in accuracy and F1, one-sample t-test of the run values
    against the baseline value, two-sided p and stars."""
    keys = list(keys)
    m = model_rows(records).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_runs"), F.avg(metric).alias("model_mean"),
        F.stddev_samp(metric).alias("model_sd"), F.avg("f1_score").alias("model_f1"))
    b = records.where(F.col("condition") != MODEL_CONDITION).select(
        *keys, F.col("condition").alias("baseline"), F.col(metric).alias("baseline_value"),
        F.col("f1_score").alias("baseline_f1"))
    j = m.join(b, keys)
    t = F.try_divide(F.col("model_mean") - F.col("baseline_value"), F.col("model_sd") / F.sqrt(F.col("n_runs")))
    t = F.when(F.col("n_runs") > 1, t)
    p = t_two_sided_p(t, F.col("n_runs") - 1)
    return j.select(*keys, "baseline", "n_runs", "model_mean", "baseline_value",
                    (F.col("model_mean") - F.col("baseline_value")).alias("improvement"),
                    (F.col("model_f1") - F.col("baseline_f1")).alias("f1_improvement"),
                    t.alias("t_stat"), p.alias("p_value"), stars(p).alias("significance"))


def per_run_accuracy(answered: DataFrame, preds=("prediction", "random_baseline"), keys=("dataset", "run_id"),
                     label: str = "label") -> DataFrame:
    """Accuracy of several prediction columns per run (one aggregate)."""
    return answered.groupBy(*keys).agg(
        *[F.avg((F.col(label) == F.col(p)).cast("double")).alias(f"acc_{p}") for p in preds])


def paired_test(per_run: DataFrame, a: str = "acc_prediction", b: str = "acc_random_baseline",
                keys=("dataset",)) -> DataFrame:
    """A6 + A8: paired t-test of two per-run series and Cohen's d with a pooled
    std built from population stds and n - 1 weights. One run: t = 0, p = 1."""
    d = F.col(a) - F.col(b)
    g = per_run.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_runs"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"),
        F.stddev_pop(a).alias("std_a"), F.stddev_pop(b).alias("std_b"),
        F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd_diff"))
    n = F.col("n_runs")
    t = F.when(n <= 1, F.lit(0.0)).otherwise(F.try_divide(F.col("mean_diff"), F.col("sd_diff") / F.sqrt(n)))
    p = F.when(n <= 1, F.lit(1.0)).otherwise(t_two_sided_p(t, n - 1))
    pooled = F.sqrt(F.try_divide((n - 1) * F.col("std_a") ** 2 + (n - 1) * F.col("std_b") ** 2, 2 * n - 2))
    d_eff = F.when((F.col("std_a") > 0) & (F.col("std_b") > 0) & (pooled > 0),
                   (F.col("mean_a") - F.col("mean_b")) / pooled)
    return g.select(*keys, "n_runs", "mean_a", "std_a", "mean_b", t.alias("t_stat"), p.alias("p_value"),
                    stars(p).alias("significance"), d_eff.alias("cohens_d"))


def mcnemar(df: DataFrame, label: str = "label", pred1: str = "prediction", pred2: str = "keyword_baseline",
            keys=("dataset",)) -> DataFrame:
    """McNemar with continuity correction on the disagreements b, c."""
    c1 = F.col(pred1) == F.col(label)
    c2 = F.col(pred2) == F.col(label)
    g = df.groupBy(*keys).agg(F.count_if(c1 & ~c2).alias("b"), F.count_if(~c1 & c2).alias("c"))
    stat = F.try_divide(F.pow(F.abs(F.col("b") - F.col("c")) - 1, 2), (F.col("b") + F.col("c")).cast("double"))
    return g.select(*keys, "b", "c", F.when(F.col("b") + F.col("c") > 0, stat).alias("statistic"),
                    F.when(F.col("b") + F.col("c") == 0, F.lit(1.0)).otherwise(chi2_1_sf(stat)).alias("p_value"))


def cross_domain_summary(pooled: DataFrame, keys=("dataset",), domain: str = "domain") -> DataFrame:
    """A11 + W4: mean / population std of domain accuracy and F1, best and
    worst domain (ties: the domain listed first / last after a stable sort by
    accuracy over alphabetical order), range; only with more than one domain."""
    keys = list(keys)
    summary = (pooled.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_domains"),
        F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("std_accuracy"),
        F.avg("f1_score").alias("mean_f1"), F.stddev_pop("f1_score").alias("std_f1"),
        F.max("accuracy").alias("best_accuracy"), F.min("accuracy").alias("worst_accuracy"))
        .where(F.col("n_domains") > 1)
        .withColumn("accuracy_range", F.col("best_accuracy") - F.col("worst_accuracy")))
    return summary.join(_best_worst(pooled, keys, domain), keys)


def _best_worst(pooled: DataFrame, keys, domain: str) -> DataFrame:
    keys = list(keys)
    w_best = Window.partitionBy(*keys).orderBy(F.desc("accuracy"), F.asc(domain))
    w_worst = Window.partitionBy(*keys).orderBy(F.asc("accuracy"), F.desc(domain))
    ranked = pooled.select(*keys, domain, "accuracy").withColumn("__rb", F.row_number().over(w_best)).withColumn(
        "__rw", F.row_number().over(w_worst))
    return ranked.groupBy(*keys).agg(
        F.max(F.when(F.col("__rb") == 1, F.col(domain))).alias("best_domain"),
        F.max(F.when(F.col("__rw") == 1, F.col(domain))).alias("worst_domain"))


def final_report(records: DataFrame, keys=("dataset",)) -> DataFrame:
    """Runs done, means and population stds, best run accuracy, mean kappa."""
    aggs = [F.count(F.lit(1)).alias("runs_completed")]
    for m in SUMMARY_METRICS:
        aggs += [F.avg(m).alias(f"mean_{m}"), F.stddev_pop(m).alias(f"std_{m}")]
    aggs += [F.max("accuracy").alias("best_run_accuracy"), F.avg("cohen_kappa").alias("mean_cohen_kappa")]
    return model_rows(records).groupBy(*keys).agg(*aggs)


def baseline_comparison(records: DataFrame, baselines=("Random", "Majority", "Keyword")) -> DataFrame:
    """Mean accuracy of each baseline pooled over all datasets."""
    return (records.where(F.col("condition").isin(list(baselines))).groupBy("condition")
            .agg(F.avg("accuracy").alias("mean_accuracy"), F.count(F.lit(1)).alias("n_records")))


def best_run(records: DataFrame, keys=("dataset",), metric: str = "accuracy") -> DataFrame:
    """The run with the highest metric (first run on ties)."""
    return model_rows(records).groupBy(*keys).agg(
        F.max_by(F.col("run_id"), F.struct(F.col(metric), (F.lit(0) - F.col("run_id")))).alias("best_run_id"),
        F.max(metric).alias(f"best_{metric}"))
