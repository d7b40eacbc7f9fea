"""End-to-end jobs: extraction chain over a post folder, split evaluation over the driver tables."""

import json

from factlane.operators.scoring import FlakyVerifier
from factlane.plans import evaluation as EV
from factlane.plans.extraction import run_extraction
from factlane.sources import tables

from conftest import SMOKE_DIR


def test_extraction_job_drops_repeats_on_request(spark, tmp_path):
    src = tmp_path / "posts"
    src.mkdir()
    row = {"post_id": 1, "text": "The vaccine is safe", "langs": ["eng"]}
    (src / "a.jsonl").write_text(json.dumps(row) + "\n")
    (src / "b.jsonl").write_text(json.dumps(row | {"text": "The vaccine is here"}) + "\n" + json.dumps(row | {"post_id": None}) + "\n")
    for dedup, n in ((False, 3), (True, 2)):
        paths = run_extraction(spark, str(src), str(tmp_path / f"out{dedup}"), dedup=dedup)
        rows = spark.read.option("header", True).csv(paths["claims"]).collect()
        assert len(rows) == n and {r["filename"] for r in rows if r["post_id"]} == ({"a.jsonl"} if dedup else {"a.jsonl", "b.jsonl"})


def test_extraction_job(spark, tmp_path):
    src = tmp_path / "posts"
    src.mkdir()
    rows = [{"post_id": 1, "text": "The vaccine is safe", "langs": ["eng"]},
            {"post_id": 2, "text": "Trump was in Ukraine", "langs": ["eng"]},
            {"post_id": 3, "text": "This works", "langs": ["eng"]},
            {"post_id": 4, "text": "It is sunny", "langs": ["eng"]}]
    (src / "7.jsonl").write_text("\n".join(json.dumps(r) for r in rows) + "\nnot json\n", encoding="utf-8")
    paths = run_extraction(spark, str(src), str(tmp_path / "out"), lambda: FlakyVerifier(["Verifiable"], 3))
    funnel = {r["stage"]: r["n"] for r in spark.read.parquet(paths["funnel"]).collect()}
    assert funnel["claims"] == 3 and funnel["read"] == 4
    assert spark.read.parquet(paths["bad_lines"]).first()["n_lines"] == 1
    doms = {r["domain"]: r["n"] for r in spark.read.parquet(paths["domain_counts"]).collect()}
    assert doms == {"Health": 1, "Politics": 1}
    ver = spark.read.parquet(paths["verifiable"]).collect()
    assert len(ver) == 2 and {r["verifiable_class"] for r in ver} <= {"Verifiable", "Error"}


def test_split_evaluation_job(spark, tmp_path):
    paths = EV.run_split_evaluation(tables.evaluation_claims(spark, SMOKE_DIR), str(tmp_path / "eval"))
    results = spark.read.parquet(paths["results"])
    assert {r[0] for r in results.select("run_id").distinct().collect()} == set(range(5))
    assert spark.read.parquet(paths["results"]).where("dataset = 'UGC' AND run_id = 0").count() > 0
    rec = spark.read.parquet(paths["records"])
    assert {r["condition"] for r in rec.collect()} == {"Model", "Random", "Majority", "TF-IDF+LR"}
    assert spark.read.parquet(paths["final_report"]).count() == 2


def test_full_evaluation_job(spark, tmp_path):
    paths = EV.run_full_evaluation(tables.evaluation_claims(spark, SMOKE_DIR), str(tmp_path / "full"))
    read = {n: spark.read.parquet(p) for n, p in paths.items()}
    n0 = read["results"].where("run_id = 0").count()
    assert {r["condition"] for r in read["records"].collect()} == {"Model", "Random", "Majority", "Keyword"}
    assert sum(r["n"] for r in read["length_accuracy"].collect()) == n0
    assert sum(r["n"] for r in read["confidence_accuracy"].collect()) == n0
    assert read["executive_summary"].count() == read["paired_test"].count() == read["mcnemar"].count() == 2
    wrong = read["results"].where("run_id = 0 AND label <> prediction").count()
    assert sum(r["n"] for r in read["error_counts"].collect()) == wrong
    assert 0 < read["error_examples"].count() <= 20
