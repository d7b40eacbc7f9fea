"""End-to-end evaluation jobs.

* ``split_results``   - the split evaluation: clean -> runs -> exact stratified
  70/30 split per dataset and run -> model answers on the test part ->
  baselines fitted on the train part (random, majority, optional TF-IDF+LR).
* ``full_results``    - the full-set evaluation: every claim in every run,
  structured answers parsed into class + confidence, random (run seed),
  majority and keyword baselines.
* ``run_metrics``     - one grouped aggregate over a results frame: records per
  dataset x condition x run, plus domain rows.

Models are pluggable: ``answers`` is either a Column (a stand-in computed in
the JVM) or a DataFrame of answers keyed by (dataset, run_id, claim_id) that
``score_batches`` produced and the caller persisted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.baselines import keyword_baseline, random_baseline, with_majority
from ..operators.clean import clean_claims
from ..operators.metrics import long_predictions, metric_records, metrics_table
from ..operators.parsing import confidence_level, lenient_label, structured_label
from ..operators.scoring import attach_answers, simulated_prediction, simulated_structured_answer
from ..operators.splits import fan_out_runs, stratified_split
from ..session import cut_lineage

KEYS = ["dataset", "run_id", "claim_id"]


def split_frame(claims: DataFrame, n_runs: int = K.N_RUNS, seeds=K.RUN_SEEDS, by=("domain", "label"),
                test_share: float = K.TEST_SHARE, bucket_bits: int = 16) -> DataFrame:
    """Claims x runs with ``split`` and ``stratified_by``."""
    return stratified_split(fan_out_runs(claims, n_runs, seeds), by=by, fallback=("label",),
                            test_share=test_share, bucket_bits=bucket_bits)


def claim_keys(claims: DataFrame, clean: bool = True) -> DataFrame:
    """The cleaned evaluation set without its text, kept in the checkpoint
    folder: the split reads it several times, and the text (the bulk of the
    bytes) is read once, here, for the blank-claim test."""
    if clean:
        claims = clean_claims(claims)
    return cut_lineage(claims.select("dataset", "claim_id", "domain", "label"))


def split_parts(claims: DataFrame, n_runs: int = K.N_RUNS, seeds=K.RUN_SEEDS, by=("domain", "label"),
                clean: bool = True) -> DataFrame:
    """(dataset, claim_id, domain, label, run_id, seed, split, stratified_by) for
    every claim and run. Its inputs (the claim keys and the split's cut table)
    are materialised, so each consumer (train part, test part, reports)
    re-derives the assignment with a narrow scan and a broadcast comparison,
    which is cheaper than writing five copies of the keys."""
    return split_frame(claim_keys(claims, clean), n_runs, seeds, by)


def with_claim_text(rows: DataFrame, claims: DataFrame) -> DataFrame:
    """Attach the claim text to keyed rows (an equi-join on claim_id)."""
    return rows.join(claims.select("claim_id", "claim"), "claim_id")


def split_results(claims: DataFrame, n_runs: int = K.N_RUNS, seeds=K.RUN_SEEDS, by=("domain", "label"),
                  prediction=None, with_tfidf: bool = False, clean: bool = True) -> DataFrame:
    """Results of the split evaluation (test rows only): dataset, claim_id,
    domain, label, run_id, seed, split, prediction, random_baseline,
    majority_baseline (+ tfidf_baseline; + answer when ``prediction`` is a
    DataFrame of answers keyed by dataset, run_id, claim_id). Text is attached by the caller
    (``with_claim_text``) where a step needs it."""
    parts = split_parts(claims, n_runs, seeds, by, clean)
    train = parts.where(F.col("split") == "train")
    test = parts.where(F.col("split") == "test")
    if isinstance(prediction, DataFrame):
        test = attach_answers(test, prediction).withColumn("prediction", lenient_label("answer"))
    else:
        test = test.withColumn("prediction", prediction if prediction is not None
                               else simulated_prediction("label", "seed", "claim_id"))
    test = (test
            .withColumn("random_baseline", random_baseline("claim_id", K.BASELINE_SEED)))
    test = with_majority(test, train)
    if with_tfidf:
        from ..operators.tfidf import tfidf_lr_baseline
        text = clean_claims(claims) if clean else claims
        test = tfidf_lr_baseline(train, test, claims=text.select("claim_id", "claim"))
    return test


def full_results(claims: DataFrame, n_runs: int = K.N_RUNS, seeds=K.RUN_SEEDS, answers=None,
                 keywords=K.SUSPICIOUS_KEYWORDS, clean: bool = True) -> DataFrame:
    """Results of the full-set evaluation before dropping unanswered rows:
    claims x runs + answer, prediction, confidence, reasoning and baselines."""
    if clean:
        claims = clean_claims(claims)
    runs = fan_out_runs(claims, n_runs, seeds)
    if answers is None:
        answers = simulated_structured_answer(simulated_prediction("label", "seed", "claim_id"), "seed", "claim_id")
    runs = attach_answers(runs, answers) if isinstance(answers, DataFrame) else runs.withColumn("answer", answers)
    runs = with_majority(runs, claims, group=("dataset",))
    return (runs.withColumn("prediction", structured_label("answer"))
            .withColumn("confidence", confidence_level("answer"))
            .withColumn("reasoning", F.col("answer"))
            .withColumn("random_baseline", random_baseline("claim_id", F.col("seed")))
            .withColumn("keyword_baseline", keyword_baseline("claim", keywords)))


def answered(results: DataFrame) -> DataFrame:
    """P10: rows with both a label and a model prediction."""
    return results.dropna(subset=["label", "prediction"])


def run_metrics(results: DataFrame, conditions: dict[str, str], baseline_rows: str = "labelled",
                per_domain: bool = True, on_degenerate: str = "drop") -> tuple[DataFrame, DataFrame]:
    """(table, records): ``table`` has overall and domain rows; ``records`` are
    the overall rows after the degenerate-input rule. ``baseline_rows``:
    'labelled' scores baselines on every labelled row (split evaluation),
    'answered' only where the model answered too (full evaluation)."""
    src = answered(results) if baseline_rows == "answered" else results
    long = long_predictions(src, conditions, ["dataset", "run_id", "claim_id", "domain"], pred="pred")
    table = metrics_table(long, ["dataset", "condition", "run_id"], "domain", per_domain=per_domain)
    return table, metric_records(table, on_degenerate)


SPLIT_CONDITIONS = {"prediction": K.MODEL_CONDITION, "random_baseline": "Random", "majority_baseline": "Majority"}
FULL_CONDITIONS = {"prediction": K.MODEL_CONDITION, "random_baseline": "Random", "majority_baseline": "Majority",
                   "keyword_baseline": "Keyword"}


def run_split_evaluation(claims: DataFrame, out_dir: str, n_runs: int = K.N_RUNS, seeds=K.RUN_SEEDS,
                         by=("domain", "label"), prediction=None, with_tfidf: bool = True) -> dict[str, str]:
    """The split evaluation end to end. Test-part results are written
    partitioned by dataset and run (one directory each, prunable); every
    report is then computed from that table: metric records and domain rows,
    run statistics, t-interval, tests against the baselines, pooled domain
    metrics, the cross-domain summary and the final report."""
    from ..operators import metrics as M
    from ..operators import runstats as A
    from ..sources.sinks import write_partitioned

    spark = claims.sparkSession
    paths = {n: f"{out_dir}/{n}" for n in ("results", "metrics", "records", "run_summary", "t_interval",
                                          "baseline_tests", "pooled_domains", "cross_domain", "final_report")}
    res = split_results(claims, n_runs, seeds, by, prediction=prediction, with_tfidf=with_tfidf)
    write_partitioned(res, paths["results"], keys=("dataset", "run_id"))
    results = spark.read.parquet(paths["results"])
    conditions = dict(SPLIT_CONDITIONS)
    if with_tfidf:
        conditions["tfidf_baseline"] = "TF-IDF+LR"
    table, records = run_metrics(results, conditions)
    table.write.mode("overwrite").parquet(paths["metrics"])
    records = cut_lineage(records, "records")
    records.write.mode("overwrite").parquet(paths["records"])
    A.run_summary(records).write.mode("overwrite").parquet(paths["run_summary"])
    A.t_interval(records).write.mode("overwrite").parquet(paths["t_interval"])
    A.one_sample_tests(records).write.mode("overwrite").parquet(paths["baseline_tests"])
    long = long_predictions(answered(results), {"prediction": K.MODEL_CONDITION},
                            ["dataset", "run_id", "claim_id", "domain"], pred="pred")
    pooled = cut_lineage(M.pooled_domain_metrics(long), "pooled")
    pooled.write.mode("overwrite").parquet(paths["pooled_domains"])
    A.cross_domain_summary(pooled).write.mode("overwrite").parquet(paths["cross_domain"])
    A.final_report(records).write.mode("overwrite").parquet(paths["final_report"])
    return paths


def run_full_evaluation(claims: DataFrame, out_dir: str, n_runs: int = K.N_RUNS, seeds=K.RUN_SEEDS, answers=None,
                        keywords=K.SUSPICIOUS_KEYWORDS) -> dict[str, str]:
    """The full-set evaluation end to end: answered results partitioned by
    dataset and run, then every report from that table: records and domain rows,
    executive summary, paired test against the random baseline, McNemar against
    the keyword baseline, baseline comparison, and for run 0 accuracy by domain,
    error counts, accuracy by length quartile and by confidence, and error
    examples with their claims."""
    from ..operators import metrics as M
    from ..operators import reports as W
    from ..operators import runstats as A
    from ..operators.clean import error_kind
    from ..sources.sinks import write_partitioned

    spark = claims.sparkSession
    names = ("results", "metrics", "records", "executive_summary", "paired_test", "mcnemar", "baseline_comparison",
             "domain_accuracy", "error_counts", "length_accuracy", "confidence_accuracy", "error_examples")
    paths = {n: f"{out_dir}/{n}" for n in names}
    write_partitioned(answered(full_results(claims, n_runs, seeds, answers, keywords)), paths["results"],
                      keys=("dataset", "run_id"))
    results = spark.read.parquet(paths["results"])
    table, records = run_metrics(results, FULL_CONDITIONS, baseline_rows="answered", on_degenerate="zero")
    table.write.mode("overwrite").parquet(paths["metrics"])
    records = cut_lineage(records, "records")
    first = results.where(F.col("run_id") == 0)  # prunes to one partition per dataset
    kind = error_kind("label", "prediction")
    reports = {
        "records": records,
        "executive_summary": A.executive_summary(records),
        "paired_test": A.paired_test(cut_lineage(A.per_run_accuracy(results), "per-run")),
        "mcnemar": A.mcnemar(first),
        "baseline_comparison": A.baseline_comparison(records),
        "domain_accuracy": M.accuracy_by(first.where(F.col("domain").isNotNull()), ["dataset", "domain"]),
        "error_counts": first.groupBy("dataset", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).where("kind IS NOT NULL"),
        "length_accuracy": W.length_quartile_accuracy(first),
        "confidence_accuracy": M.accuracy_by(first, ["dataset", "confidence"]),
        "error_examples": W.error_examples(first),
    }
    for name, df in reports.items():
        df.write.mode("overwrite").parquet(paths[name])
    return paths
