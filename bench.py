"""Benchmark of the headline queries.

Runs Q1 claim funnel, Q2 grouped metrics, Q3 answer parsing and Q4 run
statistics (plus the split they share) on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]``; each query is run once to
warm up, then timed three times (median), writing to the no-op sink so no
result travels to the driver. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = {
    "q1_claim_funnel": ["p6_claim_funnel", "q1_claim_domains"],
    "q2_grouped_metrics": ["g8_metrics_record"],
    "q3_answer_parsing": ["r10_reasoning"],
    "q4_run_statistics": ["a5_one_sample_ttest"],
}
EXTRA = ["t2_stratified_split", "r4_batch_scoring", "a4_bootstrap_interval", "g11_pooled_domains",
         "g14_length_quartiles", "b4_tfidf_weights"]
# Model fits: timed once, without a warm-up run.
ONCE = ["b5_tfidf_lr", "b9_text_classifier"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    from factlane.plans.catalog import QUERIES
    from factlane.session import local_session

    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, app="factlane-bench")
    n_docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    n_labels = spark.read.parquet(f"{sf_dir}/labels.parquet").count()
    input_rows = {"q1_claim_funnel": n_docs, "q2_grouped_metrics": n_labels * 5, "q3_answer_parsing": n_labels * 5,
                  "q4_run_statistics": n_labels * 5}

    def run(names):
        t0 = time.perf_counter()
        for n in names:
            QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    timings, rates = {}, {}
    for q, names in list(HEADLINE.items()) + [(n, [n]) for n in EXTRA]:
        run(names)  # warm-up
        ts = [run(names) for _ in range(repeats)]
        timings[q] = round(statistics.median(ts), 3)
        if q in input_rows:
            rates[q] = round(input_rows[q] / timings[q], 1)
    for q in ONCE:
        timings[q] = round(run([q]), 3)
    total = round(sum(timings[q] for q in HEADLINE), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_sec", "value": total, "unit": "sec", "queries": timings,
                      "rows_per_sec": rates, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
