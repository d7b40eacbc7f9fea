"""Metrics and run statistics against hand-computed values (fixture F-D)."""

import pytest
from pyspark.sql import functions as F

from factlane.operators import metrics as M
from factlane.operators import runstats as A
from factlane.operators.baselines import majority_labels
from factlane.operators.reports import length_quartile_accuracy


def _pairs(spark, pairs, domain=None):
    rows = [("D", "Model", 0, i, domain, y, p) for i, (y, p) in enumerate(pairs)]
    return spark.createDataFrame(rows, "dataset string, condition string, run_id int, claim_id int, domain string, "
                                       "label int, pred int")


def _record(spark, pairs, on_degenerate="drop"):
    table = M.metrics_table(_pairs(spark, pairs), ["dataset", "condition", "run_id"], "domain")
    return M.metric_records(table, on_degenerate).collect()


def test_mixed(spark):
    pairs = [(1, 1)] * 3 + [(0, 0)] * 4 + [(0, 1)] * 2 + [(1, 0)]
    r = _record(spark, pairs)[0]
    expect = {"accuracy": .7, "precision_true": .6, "recall_true": .75, "f1_true": .666667, "precision_false": .8,
              "recall_false": .666667, "f1_false": .727273, "precision": .7, "recall": .708333, "f1_score": .696970,
              "macro_f1": .696970, "weighted_precision": .72, "weighted_f1": .703030, "cohen_kappa": .4,
              "mcc": .408248}
    for k, v in expect.items():
        assert r[k] == pytest.approx(v, abs=1e-6), k
    assert (r["tn"], r["fp"], r["fn"], r["tp"], r["n_samples"]) == (4, 2, 1, 3, 10)


def test_one_class(spark):
    pairs = [(1, 1)] * 5
    assert _record(spark, pairs) == []  # dropped
    table = M.metrics_table(_pairs(spark, pairs), ["dataset", "condition", "run_id"], "domain")
    row = table.where(F.col("level") == "overall").first()
    assert row["accuracy"] == 1 and row["precision"] == 1 and row["cohen_kappa"] is None and row["mcc"] == 0
    z = _record(spark, pairs, "zero")[0]
    assert z["accuracy"] == 1 and z["cohen_kappa"] == 0 and z["f1_true"] == 0 and z["macro_f1"] == 0


def test_never_predicted(spark):
    r = _record(spark, [(0, 0), (0, 0), (1, 0), (1, 0)])[0]
    assert (r["precision_true"], r["recall_true"], r["f1_true"]) == (0, 0, 0)
    assert r["accuracy"] == .5 and r["cohen_kappa"] == 0 and r["mcc"] == 0


def test_empty_gives_no_record(spark):
    assert _record(spark, [(1, None), (None, 0)]) == []


def test_domain_rows_and_report(spark):
    rows = [("D", "Model", 0, i, d, y, p) for i, (d, y, p) in
            enumerate([("a", 1, 1), ("a", 0, 1), ("b", 1, 1), (None, 0, 0)])]
    df = spark.createDataFrame(rows, "dataset string, condition string, run_id int, claim_id int, domain string, "
                                     "label int, pred int")
    table = M.metrics_table(df, ["dataset", "condition", "run_id"], "domain")
    levels = {(r["level"], r["domain"]): r["n_samples"] for r in table.collect()}
    assert levels == {("overall", None): 4, ("domain", "a"): 2, ("domain", "b"): 1}
    rep = M.class_report(table.where(F.col("domain") == "b"), ["domain"]).collect()
    assert [r["class"] for r in rep] == ["True"]  # single present class, no failure


@pytest.mark.parametrize("b,c,stat,p", [(6, 2, 1.125, .288844), (0, 0, None, 1.0), (3, 3, 1 / 6, .683091)])
def test_mcnemar(spark, b, c, stat, p):
    rows = [(1, 1, 0)] * b + [(1, 0, 1)] * c + [(1, 1, 1)] * 2
    df = spark.createDataFrame([("D",) + r for r in rows], "dataset string, label int, prediction int, "
                                                           "keyword_baseline int")
    r = A.mcnemar(df).first()
    assert (r["b"], r["c"]) == (b, c)
    assert r["p_value"] == pytest.approx(p, abs=1e-6)
    if stat is None:
        assert r["statistic"] is None
    else:
        assert r["statistic"] == pytest.approx(stat, abs=1e-9)


ACCS = [.70, .72, .68, .74, .71]


def _records(spark, accs, baselines=()):
    rows = [("D", "Model", i, a, a, a, a, a, a) for i, a in enumerate(accs)]
    rows += [("D", name, 0, v, v, v, v, v, v) for name, v in baselines]
    return spark.createDataFrame(rows, "dataset string, condition string, run_id int, accuracy double, "
                                       "precision double, recall double, f1_score double, macro_f1 double, "
                                       "cohen_kappa double")


def test_run_summaries(spark):
    rec = _records(spark, ACCS)
    s = A.run_summary(rec).first()
    assert s["mean_accuracy"] == pytest.approx(.71) and s["std_accuracy"] == pytest.approx(.02)
    e = A.executive_summary(rec).first()
    assert e["std_accuracy"] == pytest.approx(.022361, abs=1e-6) and e["best_run_accuracy"] == pytest.approx(.74)
    ci = A.t_interval(rec).first()
    assert ci["lower"] == pytest.approx(.682236, abs=1e-6) and ci["upper"] == pytest.approx(.737764, abs=1e-6)
    best = A.best_run(rec).first()
    assert best["best_run_id"] == 3


def test_best_run_tie_takes_first(spark):
    rec = _records(spark, [.7, .8, .8])
    assert A.best_run(rec).first()["best_run_id"] == 1


@pytest.mark.parametrize("base,t,p,stars", [(.69, 2.0, .116117, "ns"), (.65, 6.0, .003883, "**")])
def test_one_sample(spark, base, t, p, stars):
    r = A.one_sample_tests(_records(spark, ACCS, [("Random", base)])).first()
    assert r["t_stat"] == pytest.approx(t, abs=1e-6) and r["p_value"] == pytest.approx(p, abs=1e-6)
    assert r["significance"] == stars
    assert r["improvement"] == pytest.approx(.71 - base)


def test_paired_and_cohens_d(spark):
    base = [.50, .52, .48, .51, .49]
    df = spark.createDataFrame([("D", i, a, b) for i, (a, b) in enumerate(zip(ACCS, base))],
                               "dataset string, run_id int, acc_prediction double, acc_random_baseline double")
    r = A.paired_test(df).first()
    assert r["t_stat"] == pytest.approx(33.203915, abs=1e-5)
    assert r["p_value"] == pytest.approx(4.9e-6, abs=1e-7)
    assert r["significance"] == "***"
    assert r["cohens_d"] == pytest.approx(12.124356, abs=1e-5)


def test_paired_single_run(spark):
    df = spark.createDataFrame([("D", 0, .7, .5)], "dataset string, run_id int, acc_prediction double, "
                                                  "acc_random_baseline double")
    r = A.paired_test(df).first()
    assert (r["t_stat"], r["p_value"], r["significance"]) == (0.0, 1.0, "ns")


def test_bootstrap_single_run_is_the_mean(spark):
    r = A.bootstrap_interval(_records(spark, [.7])).first()
    assert r["lower"] == pytest.approx(.7) and r["upper"] == pytest.approx(.7)


def test_bootstrap_within_range(spark):
    r = A.bootstrap_interval(_records(spark, ACCS)).first()
    assert min(ACCS) <= r["lower"] <= .71 <= r["upper"] <= max(ACCS)


def test_length_quartiles(spark):
    rows = [("D", i, "x" * n, 1, 1 if n % 2 else 0) for i, n in enumerate(range(1, 9))]
    df = spark.createDataFrame(rows, "dataset string, claim_id int, claim string, label int, prediction int")
    got = {r["length_bin"]: r["n"] for r in length_quartile_accuracy(df).collect()}
    assert got == {"Short": 2, "Medium": 2, "Long": 2, "Very Long": 2}
    acc = {r["length_bin"]: r["accuracy"] for r in length_quartile_accuracy(df).collect()}
    assert acc["Short"] == .5


def test_majority_tie(spark):
    df = spark.createDataFrame([("D", 0, y) for y in [0, 1, 0, 1]], "dataset string, run_id int, label int")
    assert majority_labels(df).first()["majority_baseline"] == 0


def test_cross_domain_summary(spark):
    df = spark.createDataFrame([("D", "a", .8, .7), ("D", "b", .6, .5), ("D", "c", .8, .6), ("E", "a", .5, .5)],
                               "dataset string, domain string, accuracy double, f1_score double")
    rows = {r["dataset"]: r for r in A.cross_domain_summary(df).collect()}
    assert set(rows) == {"D"}  # one domain: no summary
    r = rows["D"]
    assert (r["best_domain"], r["worst_domain"]) == ("a", "b")
    assert r["accuracy_range"] == pytest.approx(.2)
