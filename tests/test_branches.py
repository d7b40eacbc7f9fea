"""Byte-bounded scoring with resume, exact quantiles, CSV rejects, run manifests."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factlane.functions import stats
from factlane.operators import scoring as S
from factlane.operators.reports import exact_quantiles, length_quartile_accuracy
from factlane.sources import csvio, posts, sinks


def sized():
    """A scorer that answers with the rows and bytes of its call (made here, so that
    the workers need not import this file)."""
    class Sized:
        def __call__(self, prompts, seeds):
            size = sum(len(p.encode()) for p in prompts if p)
            return pd.Series([f"{len(prompts)}/{size}"] * len(prompts), index=prompts.index)
    return Sized


def test_batches_are_bounded_by_bytes_and_rows(spark):
    rows = [(k, "é" * (10_000 if k % 5 == 0 else 40)) for k in range(60)] + [(100, None), (101, ""), (102, "x" * 200_000)]
    df = spark.createDataFrame(rows, "id int, prompt string").coalesce(1)
    out = S.score_batches(df, sized(), seed="none", max_rows=7, max_bytes=30_000).collect()
    assert len(out) == 63
    for r in out:
        n, size = map(int, r["answer"].split("/"))
        assert n <= 7 and (size <= 30_000 or n == 1)


def test_long_prompts_reach_the_scorer_whole(spark):
    text = " ".join(f"word{k}" for k in range(20_000))
    df = spark.createDataFrame([(k, text + str(k)) for k in range(12)], "id int, prompt string")
    out = S.score_batches(df, sized(), seed="none", max_bytes=300_000).collect()
    for r in out:  # a prompt of 180 kB or so stands alone
        assert r["answer"] == f"1/{len(text) + len(str(r['id']))}"


def test_report_counts_attempts_and_errors(spark):
    class Raises:
        def __call__(self, prompts, seeds):
            if (prompts == "bad").any():
                raise ValueError("no " + prompts.iloc[0])
            return prompts

    df = spark.createDataFrame([(0, "a"), (1, "bad"), (2, "c"), (3, None)], "id int, prompt string").coalesce(1)
    out = {r["id"]: r for r in S.score_batches(df, Raises, seed="none", retries=2, sentinel="Error", report=True).collect()}
    assert [out[k]["answer"] for k in range(4)] == ["a", "Error", "c", None]
    assert [out[k]["failed"] for k in range(4)] == [False, True, False, False]
    assert out[1]["attempts"] == 3 and out[1]["error"] == "ValueError: no bad"
    assert out[0]["attempts"] == 2 and out[0]["error"].startswith("ValueError")  # its batch failed, it did not


def test_resume_scores_only_what_is_missing(spark, tmp_path):
    df = spark.createDataFrame([(k, f"p{k}") for k in range(40)], "claim_id int, prompt string")
    path, keys = str(tmp_path / "answers"), ["claim_id"]
    make = lambda: S.BusyModel(["yes", "no"], most=2)
    assert S.stored_answers(spark, path, keys) is None
    S.score_stored(df.where("claim_id < 25"), path, make, keys, parts=4, retries=0, seed="none")
    first = spark.read.parquet(path)
    done = {r["claim_id"] for r in first.where("not failed").collect()}
    assert first.count() == 25 and 0 < len(done) < 25
    out = S.score_stored(df, path, make, keys, retries=2, seed="none").collect()
    assert len(out) == 40 and not any(r["failed"] for r in out)
    assert spark.read.parquet(path).count() == 25 + 40 - len(done)  # answered rows were left alone
    S.score_stored(df, path, make, keys, seed="none")
    assert spark.read.parquet(path).count() == 65 - len(done)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 501])
def test_exact_quantiles(spark, n):
    rng = np.random.default_rng(n)
    values = {"a": rng.integers(0, 5000, n), "b": rng.zipf(1.4, n) % 100_000, "c": np.full(n, 7)}
    rows = [(g, int(v)) for g, vs in values.items() for v in vs]
    counts = spark.createDataFrame(rows, "g string, v int").groupBy("g", "v").agg(F.count("*").alias("n"))
    shares = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)
    got = {r["g"]: r["q"] for r in exact_quantiles(counts, ["g"], "v", "n", shares).collect()}
    for g, vs in values.items():
        assert np.allclose(got[g], np.quantile(vs, shares), rtol=0, atol=1e-9)


def test_equal_lengths_are_an_error(spark):
    rows = [("A", "x" * (k + 1), 1, 1) for k in range(20)] + [("B", "same", 1, k % 2) for k in range(20)]
    df = spark.createDataFrame(rows, "dataset string, claim string, label int, prediction int")
    with pytest.raises(ValueError, match="edges must be unique.*'B'"):
        length_quartile_accuracy(df)
    out = {(r["dataset"], r["length_bin"]): (r["accuracy"], r["n"]) for r in length_quartile_accuracy(df, on_duplicates="report").collect()}
    assert out[("B", None)] == (0.5, 20) and len(out) == 5 and all(n == 5 for (d, _), (_, n) in out.items() if d == "A")
    assert length_quartile_accuracy(df.where("dataset = 'A'")).count() == 4


def test_small_tails_keep_their_digits(spark):
    xs = [0.0, 1e-9, 0.3, 1.0, 3.99, 4.0, 7.9, 8.0, 8.1, 20.0, 64.0, 100.0, 300.0, 1200.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", stats.chi2_1_sf("x").alias("p")).collect()
    for r in got:
        assert math.isclose(r["p"], math.erfc(math.sqrt(r["x"] / 2)), rel_tol=1e-11)


def test_rejected_csv_rows_and_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text('claim,label,domain\n"one, two",1,Health\nthree,yes,War\n"li\nne",0,NA\nshort,1\nlong,1,War,more\n')
    rows = csvio.read_csv_checked(spark, str(tmp_path / "a.csv"), "claim string, label int, domain string")
    got = {r["claim"]: (r["label"], r["domain"], r["reject_reason"]) for r in rows.collect()}
    assert got["one, two"] == (1, "Health", None) and got["li\nne"] == (0, None, None)
    assert got["three"] == (None, "War", "bad_value") and got["short"][2] == got["long"][2] == "bad_value"
    assert [tuple(r) for r in csvio.rejected_rows(rows).collect()] == [("a.csv", "bad_value", 3)]
    (tmp_path / "b.csv").write_text("claim,topic\nx,y\n")
    report = csvio.column_report(spark, {"a": str(tmp_path / "a.csv"), "b": str(tmp_path / "b.csv")}).collect()
    assert [(r["input"], r["missing"], r["complete"]) for r in report] == [("a", "", True), ("b", "label,domain", False)]


def test_named_lines_are_read_by_suffix(spark, tmp_path):
    lines = spark.createDataFrame([("u1.jsonl", '{"post_id": 1}'), ("u1.jsonl", ""), ("u2.jsonl", "[1]"), ("u2.jsonl.bak", '{"post_id": 9}'), ("x.txt", "{}")],
                                  "filename string, value string").repartition(2)
    sinks.write_named_lines(lines, str(tmp_path / "f"))
    read = posts.classify_lines(posts.read_lines(spark, str(tmp_path / "f"))).collect()
    assert sorted((r["filename"].split("-")[0], r["line_status"]) for r in read) == [("u1", "invalid_json"), ("u1", "ok"), ("u2", "not_object")]


def test_run_manifest(spark, tmp_path):
    df = spark.createDataFrame([(k, "UGC" if k % 2 else "NGC", k % 3) for k in range(30)], "claim_id int, dataset string, run_id int")
    folder = str(tmp_path / "runs")
    sinks.write_run(df, folder, "results", tag="20240101_000000")
    tag = sinks.write_run(df.limit(5), folder, "results")
    assert tag > "20240101_000000"
    assert sinks.read_run(spark, folder, "results").count() == 5  # the latest run
    assert sinks.read_run(spark, folder, "results", "20240101_000000").count() == 30
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.write_run(df, folder, "results", tag="20240101_000000")
    df.limit(1).write.mode("append").partitionBy("dataset", "run_id").parquet(f"{folder}/results_20240101_000000")
    with pytest.raises(ValueError, match="the manifest says"):
        sinks.read_run(spark, folder, "results", "20240101_000000")
