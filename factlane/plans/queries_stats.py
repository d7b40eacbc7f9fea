"""Queries for run statistics (A*), joins and unions (J*, U*), windows (W*)
and scalar functions (F*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as TX
from ..functions.hashing import run_seed
from ..functions.stats import t_critical
from ..operators import metrics as M
from ..operators import reports as W
from ..operators import runstats as A
from ..operators.clean import clean_claims
from ..operators.scoring import attach_answers
from ..operators.splits import fan_out_runs
from ..session import cut_lineage
from ..sources import tables
from . import evaluation as E
from .queries_eval import (SQL_ANSWERS, SQL_POOLED, SQL_RUN0, SQL_SPLIT_MET, answers_frame, claims_of,
                           first_run_answered, split_table)
from .queries_rules import TEST_SUSPICIOUS
from .registry import query, rounded, sql_hash, sql_runs, sql_with
from .sql_eval import sql_clean_claims, sql_full_results, sql_split_results, sql_strip


# ---- SQL forms of the distribution tails ------------------------------------

def sql_t_p(t: str, df: str) -> str:
    theta = f"atan(abs({t}) / sqrt({df}))"
    c = f"pow(cos({theta}), 2)"
    odd_sum = (f"list_sum(list_transform(range(0, CAST(({df} - 3) // 2 AS BIGINT) + 1), lambda k: "
               f"exp(2 * (k * ln(2) + lgamma(k + 1)) - lgamma(2 * k + 2)) * pow({c}, k)))")
    even_sum = (f"list_sum(list_transform(range(0, CAST(({df} - 2) // 2 AS BIGINT) + 1), lambda k: "
                f"exp(lgamma(2 * k + 1) - 2 * (k * ln(2) + lgamma(k + 1))) * pow({c}, k)))")
    central = (f"CASE WHEN {df} = 1 THEN 2 / pi() * {theta} WHEN {df} % 2 = 1 THEN "
               f"2 / pi() * ({theta} + sin({theta}) * cos({theta}) * {odd_sum}) ELSE sin({theta}) * {even_sum} END")
    return f"(CASE WHEN {t} IS NULL OR {df} < 1 THEN NULL ELSE greatest(1 - ({central}), 0.0) END)"


def sql_chi2_sf(x: str) -> str:
    z = f"sqrt({x} / 2)"
    s = (f"list_sum(list_transform(range(0, 301), lambda k: "
         f"exp((2 * k + 1) * ln({z}) + k * ln(4) + lgamma(k + 1) - lgamma(2 * k + 2))))")
    erf = f"least(2 / sqrt(pi()) * exp(-{z} * {z}) * {s}, 1.0)"
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= 0 THEN 1.0 WHEN {z} > 8 THEN 0.0 "
            f"ELSE greatest(1 - {erf}, 0.0) END)")


def sql_stars(p: str) -> str:
    return (f"(CASE WHEN {p} < 0.001 THEN '***' WHEN {p} < 0.01 THEN '**' WHEN {p} < 0.05 THEN '*' "
            f"ELSE 'ns' END)")


SQL_T_TABLE = ("t_table AS (SELECT * FROM (VALUES " +
               ", ".join(f"({v}, {t_critical(v)!r})" for v in range(1, 61)) + ") t(df, t_crit))")

SQL_RECORDS = SQL_SPLIT_MET + """,
    rec AS (SELECT * FROM met WHERE level = 'overall' AND n_present = 2)"""


def split_records(spark, sf_dir):
    _, records = split_table(spark, sf_dir)
    return records


# ---- A: statistics over runs -------------------------------------------------

@query("a1_run_summary", SQL_RECORDS + f"""
SELECT dataset, count(*) AS n_runs,
       {', '.join(f'round(avg({m}), 6) AS mean_{m}, round(stddev_pop({m}), 6) AS std_{m}' for m in A.SUMMARY_METRICS)}
FROM rec WHERE condition = 'Model' GROUP BY dataset""")
def a1_run_summary(spark, sf_dir):
    """A1: mean +- population std over runs (split evaluation)."""
    return rounded(A.run_summary(split_records(spark, sf_dir)))


@query("a2_executive_summary", SQL_RECORDS + """
SELECT dataset, round(avg(accuracy), 6) AS mean_accuracy, round(stddev_samp(accuracy), 6) AS std_accuracy,
       round(avg(macro_f1), 6) AS mean_macro_f1, round(max(accuracy), 6) AS best_run_accuracy
FROM rec WHERE condition = 'Model' GROUP BY dataset""")
def a2_executive_summary(spark, sf_dir):
    return rounded(A.executive_summary(split_records(spark, sf_dir)))


@query("a3_t_interval", SQL_RECORDS + f""", {SQL_T_TABLE},
    agg AS (SELECT dataset, count(*) AS n, avg(accuracy) AS mean, stddev_samp(accuracy) / sqrt(count(*)) AS sem
            FROM rec WHERE condition = 'Model' GROUP BY dataset HAVING count(*) > 1)
SELECT dataset, 'accuracy' AS metric, n, round(mean, 6) AS mean, round(mean - t_crit * sem, 6) AS lower,
       round(mean + t_crit * sem, 6) AS upper
FROM agg JOIN t_table ON t_table.df = agg.n - 1""")
def a3_t_interval(spark, sf_dir):
    """A3: 95 % Student-t interval of mean accuracy over runs."""
    return rounded(A.t_interval(split_records(spark, sf_dir)))


@query("a4_bootstrap_interval", SQL_RECORDS + f""",
    runs_pos AS (SELECT dataset, accuracy AS v, row_number() OVER (PARTITION BY dataset ORDER BY run_id) - 1 AS pos
                 FROM rec WHERE condition = 'Model'),
    sizes AS (SELECT dataset, count(*) AS n FROM runs_pos GROUP BY dataset),
    draws AS (SELECT s.dataset, r.r, j.j, {sql_hash('42', 's.dataset', 'r.r', 'j.j')} % s.n AS pos
              FROM sizes s, range(1, 1001) r(r), range(1, 1000) j(j) WHERE j.j <= s.n),
    means AS (SELECT d.dataset, d.r, avg(p.v) AS m FROM draws d JOIN runs_pos p USING (dataset, pos)
              GROUP BY d.dataset, d.r)
SELECT dataset, round(quantile_cont(m, 0.025), 6) AS lower, round(quantile_cont(m, 0.975), 6) AS upper,
       'accuracy' AS metric
FROM means GROUP BY dataset""")
def a4_bootstrap_interval(spark, sf_dir):
    """A4: bootstrap interval (1,000 resamples) of mean accuracy over runs."""
    return rounded(A.bootstrap_interval(split_records(spark, sf_dir)))


@query("a5_one_sample_ttest", SQL_RECORDS + f""",
    m AS (SELECT dataset, count(*) AS n_runs, avg(accuracy) AS model_mean, stddev_samp(accuracy) AS model_sd,
                 avg(f1_score) AS model_f1 FROM rec WHERE condition = 'Model' GROUP BY dataset),
    b AS (SELECT dataset, condition AS baseline, accuracy AS baseline_value, f1_score AS baseline_f1
          FROM rec WHERE condition <> 'Model'),
    j AS (SELECT *, CASE WHEN n_runs > 1 THEN (model_mean - baseline_value) / nullif(model_sd / sqrt(n_runs), 0)
                    END AS t_stat FROM m JOIN b USING (dataset)),
    jp AS (SELECT *, {sql_t_p('t_stat', 'n_runs - 1')} AS p_value FROM j)
SELECT dataset, baseline, n_runs, round(model_mean, 6) AS model_mean, round(baseline_value, 6) AS baseline_value,
       round(model_mean - baseline_value, 6) AS improvement, round(model_f1 - baseline_f1, 6) AS f1_improvement,
       round(t_stat, 6) AS t_stat, round(p_value, 6) AS p_value, {sql_stars('p_value')} AS significance
FROM jp""")
def a5_one_sample_ttest(spark, sf_dir):
    """A5 + A7 + A10: model runs vs each baseline: improvement, t, p, stars."""
    return rounded(A.one_sample_tests(cut_lineage(split_records(spark, sf_dir), "records")))


def full_answered(spark, sf_dir):
    return E.answered(E.full_results(claims_of(spark, sf_dir), keywords=TEST_SUSPICIOUS))


SQL_FULL_ANSWERED = sql_with(*sql_full_results(), """
    ans AS (SELECT * FROM full_results WHERE label IS NOT NULL AND prediction IS NOT NULL)""")


@query("a6_paired_ttest", SQL_FULL_ANSWERED + f""",
    pr AS (SELECT dataset, run_id,
                  avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS a,
                  avg(CASE WHEN label = random_baseline THEN 1.0 ELSE 0.0 END) AS b
           FROM ans GROUP BY dataset, run_id),
    g AS (SELECT dataset, count(*) AS n_runs, avg(a) AS mean_a, avg(b) AS mean_b, stddev_pop(a) AS std_a,
                 stddev_pop(b) AS std_b, avg(a - b) AS mean_diff, stddev_samp(a - b) AS sd_diff
          FROM pr GROUP BY dataset),
    t AS (SELECT *, CASE WHEN n_runs <= 1 THEN 0.0 ELSE mean_diff / nullif(sd_diff / sqrt(n_runs), 0) END AS t_stat,
                 sqrt(((n_runs - 1) * std_a * std_a + (n_runs - 1) * std_b * std_b) / nullif(2 * n_runs - 2, 0))
                   AS pooled
          FROM g),
    tp AS (SELECT *, CASE WHEN n_runs <= 1 THEN 1.0 ELSE {sql_t_p('t_stat', 'n_runs - 1')} END AS p_value FROM t)
SELECT dataset, n_runs, round(mean_a, 6) AS mean_a, round(std_a, 6) AS std_a, round(mean_b, 6) AS mean_b,
       round(t_stat, 6) AS t_stat, round(p_value, 6) AS p_value, {sql_stars('p_value')} AS significance,
       round(CASE WHEN std_a > 0 AND std_b > 0 AND pooled > 0 THEN (mean_a - mean_b) / pooled END, 6) AS cohens_d
FROM tp""")
def a6_paired_ttest(spark, sf_dir):
    """A6 + A8: paired t-test model vs random baseline over runs, Cohen's d."""
    per_run = A.per_run_accuracy(full_answered(spark, sf_dir))
    return rounded(A.paired_test(per_run))


@query("a9_mcnemar", SQL_RUN0 + f""",
    bc AS (SELECT dataset,
                  count(*) FILTER (WHERE prediction = label AND keyword_baseline <> label) AS b,
                  count(*) FILTER (WHERE prediction <> label AND keyword_baseline = label) AS c
           FROM run0 GROUP BY dataset),
    st AS (SELECT *, CASE WHEN b + c > 0 THEN pow(abs(b - c) - 1, 2) / (b + c) END AS statistic FROM bc)
SELECT dataset, b, c, round(statistic, 6) AS statistic,
       round(CASE WHEN b + c = 0 THEN 1.0 ELSE {sql_chi2_sf('statistic')} END, 6) AS p_value FROM st""")
def a9_mcnemar(spark, sf_dir):
    """McNemar test, model vs keyword baseline, first run."""
    return rounded(A.mcnemar(first_run_answered(spark, sf_dir)))


@query("a11_cross_domain_summary", SQL_POOLED + """,
    bw AS (SELECT dataset,
                  max(domain) FILTER (WHERE rb = 1) AS best_domain, max(domain) FILTER (WHERE rw = 1) AS worst_domain
           FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY accuracy DESC, domain ASC) AS rb,
                           row_number() OVER (PARTITION BY dataset ORDER BY accuracy ASC, domain DESC) AS rw
                 FROM pooled) GROUP BY dataset),
    s AS (SELECT dataset, count(*) AS n_domains, avg(accuracy) AS mean_accuracy, stddev_pop(accuracy) AS std_accuracy,
                 avg(f1_score) AS mean_f1, stddev_pop(f1_score) AS std_f1, max(accuracy) AS best_accuracy,
                 min(accuracy) AS worst_accuracy
          FROM pooled GROUP BY dataset HAVING count(*) > 1)
SELECT s.dataset, n_domains, round(mean_accuracy, 6) AS mean_accuracy, round(std_accuracy, 6) AS std_accuracy,
       round(mean_f1, 6) AS mean_f1, round(std_f1, 6) AS std_f1, round(best_accuracy, 6) AS best_accuracy,
       round(worst_accuracy, 6) AS worst_accuracy, round(best_accuracy - worst_accuracy, 6) AS accuracy_range,
       best_domain, worst_domain
FROM s JOIN bw USING (dataset)""")
def a11_cross_domain_summary(spark, sf_dir):
    """A11 + W4: cross-domain summary over pooled domain metrics."""
    res = E.answered(E.split_results(claims_of(spark, sf_dir)))
    long = M.long_predictions(res, {"prediction": K.MODEL_CONDITION}, ["dataset", "run_id", "claim_id", "domain"],
                              pred="pred")
    return rounded(A.cross_domain_summary(M.pooled_domain_metrics(long)))


@query("a12_final_report", SQL_RECORDS + f"""
SELECT dataset, count(*) AS runs_completed,
       {', '.join(f'round(avg({m}), 6) AS mean_{m}, round(stddev_pop({m}), 6) AS std_{m}' for m in A.SUMMARY_METRICS)},
       round(max(accuracy), 6) AS best_run_accuracy, round(avg(cohen_kappa), 6) AS mean_cohen_kappa
FROM rec WHERE condition = 'Model' GROUP BY dataset""")
def a12_final_report(spark, sf_dir):
    return rounded(A.final_report(split_records(spark, sf_dir)))


SQL_FULL_RECORDS = sql_with(*sql_full_results(), """
    answered_rows AS (SELECT * FROM full_results WHERE label IS NOT NULL AND prediction IS NOT NULL)""")


@query("a13_baseline_comparison", SQL_FULL_ANSWERED + """
SELECT condition, round(avg(acc), 6) AS mean_accuracy, count(*) AS n_records FROM (
  SELECT dataset, 'Random' AS condition, avg(CASE WHEN label = random_baseline THEN 1.0 ELSE 0.0 END) AS acc
  FROM ans WHERE run_id = 0 GROUP BY dataset
  UNION ALL
  SELECT dataset, 'Majority', avg(CASE WHEN label = majority_baseline THEN 1.0 ELSE 0.0 END)
  FROM ans WHERE run_id = 0 GROUP BY dataset
  UNION ALL
  SELECT dataset, 'Keyword', avg(CASE WHEN label = keyword_baseline THEN 1.0 ELSE 0.0 END)
  FROM ans WHERE run_id = 0 GROUP BY dataset)
GROUP BY condition""")
def a13_baseline_comparison(spark, sf_dir):
    """Baseline accuracy pooled over both datasets (full evaluation)."""
    res = E.full_results(claims_of(spark, sf_dir), keywords=TEST_SUSPICIOUS)
    _, records = E.run_metrics(res, E.FULL_CONDITIONS, baseline_rows="answered", per_domain=False,
                               on_degenerate="zero")
    return rounded(A.baseline_comparison(records))


# ---- J / U: joins and unions -------------------------------------------------

@query("j1_attach_answers", sql_with(*SQL_ANSWERS) + """
SELECT a.dataset, a.run_id, a.claim_id, a.label, a.answer FROM answers a""")
def j1_attach_answers(spark, sf_dir):
    """Answers keyed by (dataset, run_id, claim_id) left-joined to the claims
    of every run (the key replaces the reference's row positions)."""
    runs = fan_out_runs(clean_claims(claims_of(spark, sf_dir)))
    answers = answers_frame(spark, sf_dir).select("dataset", "run_id", "claim_id", "answer")
    return attach_answers(runs, answers).select(
        "dataset", "run_id", "claim_id", "label", "answer")


@query("j2_run_fanout", sql_with(sql_clean_claims(), sql_runs()) + """
SELECT dataset, run_id, seed, claim_id FROM clean CROSS JOIN runs""")
def j2_run_fanout(spark, sf_dir):
    """Every claim x every run with the run's seed."""
    return fan_out_runs(clean_claims(claims_of(spark, sf_dir))).select("dataset", "run_id", "seed", "claim_id")


@query("j3_paired_predictions", SQL_RUN0 + """
SELECT dataset, claim_id, label, prediction, keyword_baseline, prediction = label AS model_correct,
       keyword_baseline = label AS baseline_correct FROM run0""")
def j3_paired_predictions(spark, sf_dir):
    """Two predictors on the same claim (first run, answered rows)."""
    r0 = first_run_answered(spark, sf_dir)
    return r0.select("dataset", "claim_id", "label", "prediction", "keyword_baseline",
                     (F.col("prediction") == F.col("label")).alias("model_correct"),
                     (F.col("keyword_baseline") == F.col("label")).alias("baseline_correct"))


@query("j4_model_vs_baseline", SQL_RECORDS + """
SELECT m.dataset, m.run_id, round(m.accuracy, 6) AS model_accuracy, b.condition AS baseline,
       round(b.accuracy, 6) AS baseline_accuracy
FROM (SELECT * FROM rec WHERE condition = 'Model') m
JOIN (SELECT * FROM rec WHERE condition <> 'Model') b ON m.dataset = b.dataset""")
def j4_model_vs_baseline(spark, sf_dir):
    """Run-level model metrics paired with the dataset's baseline records (written once: both sides read them)."""
    rec = cut_lineage(split_records(spark, sf_dir), "records")
    m = rec.where(F.col("condition") == K.MODEL_CONDITION).select("dataset", "run_id",
                                                                  F.col("accuracy").alias("model_accuracy"))
    b = rec.where(F.col("condition") != K.MODEL_CONDITION).select(
        "dataset", F.col("condition").alias("baseline"), F.col("accuracy").alias("baseline_accuracy"))
    return rounded(m.join(b, "dataset"))


@query("u1_union_datasets", sql_with(sql_clean_claims()) + """
SELECT dataset, count(*) AS n, count(*) FILTER (WHERE label = 1) AS n_true FROM clean GROUP BY dataset""")
def u1_union_datasets(spark, sf_dir):
    """Two master sets unioned by column name with a dataset column."""
    c = clean_claims(claims_of(spark, sf_dir))
    frames = {name: c.where(F.col("dataset") == name).drop("dataset") for name in K.DATASETS}
    u = W.union_datasets(frames)
    return u.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("n_true"))


@query("u2_union_runs", sql_with(*sql_split_results()) + """
SELECT dataset, count(DISTINCT run_id) AS n_runs, count(*) AS n_rows, count(prediction) AS n_answered
FROM results GROUP BY dataset""")
def u2_union_runs(spark, sf_dir):
    """All runs of a dataset as one table (the run_id-keyed results)."""
    res = E.split_results(claims_of(spark, sf_dir))
    return res.groupBy("dataset").agg(F.count_distinct("run_id").alias("n_runs"), F.count(F.lit(1)).alias("n_rows"),
                                      F.count("prediction").alias("n_answered"))


@query("u3_distinct_domains", sql_with(sql_clean_claims("source")) + """
SELECT DISTINCT dataset, domain FROM clean WHERE domain IS NOT NULL""")
def u3_distinct_domains(spark, sf_dir):
    """Distinct non-null domains per dataset."""
    return W.distinct_domains(clean_claims(claims_of(spark, sf_dir, "source")), keys=("dataset",))


# ---- W: sort, top-k, window ----------------------------------------------------

@query("w1_domains_by_accuracy", SQL_POOLED + """
SELECT dataset, domain, round(accuracy, 6) AS accuracy,
       CAST(row_number() OVER (PARTITION BY dataset ORDER BY accuracy DESC, domain ASC) AS BIGINT) AS rank
FROM pooled""")
def w1_domains_by_accuracy(spark, sf_dir):
    """Domains ranked by pooled accuracy (ties alphabetical)."""
    from pyspark.sql import Window
    res = E.answered(E.split_results(claims_of(spark, sf_dir)))
    long = M.long_predictions(res, {"prediction": K.MODEL_CONDITION}, ["dataset", "run_id", "claim_id", "domain"],
                              pred="pred")
    pooled = M.pooled_domain_metrics(long)
    w = Window.partitionBy("dataset").orderBy(F.desc("accuracy"), F.asc("domain"))
    return rounded(pooled.select("dataset", "domain", "accuracy",
                                 F.row_number().over(w).cast("bigint").alias("rank")))


@query("w2_error_examples", SQL_RUN0 + """
SELECT dataset, kind, rank, claim_id, claim, substr(claim, 1, 100) || '...' AS preview FROM (
  SELECT dataset, CASE WHEN label = 0 THEN 'FP' ELSE 'FN' END AS kind, claim_id, claim,
         CAST(row_number() OVER (PARTITION BY dataset, CASE WHEN label = 0 THEN 'FP' ELSE 'FN' END
                                 ORDER BY claim_id) AS BIGINT) AS rank
  FROM run0 WHERE (label = 0 AND prediction = 1) OR (label = 1 AND prediction = 0))
WHERE rank <= 5""")
def w2_error_examples(spark, sf_dir):
    """First five false positives and negatives per dataset, with preview."""
    return W.error_examples(first_run_answered(spark, sf_dir))


@query("w3_best_run", SQL_RECORDS + """
SELECT dataset, best_run_id, round(best_accuracy, 6) AS best_accuracy FROM (
  SELECT dataset, run_id AS best_run_id, accuracy AS best_accuracy,
         row_number() OVER (PARTITION BY dataset ORDER BY accuracy DESC, run_id ASC) AS rn
  FROM rec WHERE condition = 'Model') WHERE rn = 1""")
def w3_best_run(spark, sf_dir):
    """Best run by accuracy (first run on ties)."""
    return rounded(A.best_run(split_records(spark, sf_dir)))


@query("w6_share_of_total", sql_with(sql_clean_claims("source")) + """
SELECT domain, n, round(CAST(n AS DOUBLE) / sum(n) OVER (), 6) AS share FROM (
  SELECT domain, count(*) AS n FROM clean GROUP BY domain)""")
def w6_share_of_total(spark, sf_dir):
    """Share of total per value (claims per source)."""
    from ..operators.claims import value_counts
    return rounded(value_counts(clean_claims(claims_of(spark, sf_dir, "source")), "domain", normalize=True))


# ---- F: scalar functions -----------------------------------------------------

@query("f_scalar_functions", sql_with(sql_clean_claims()) + f"""
SELECT claim_id,
       md5(lower(claim)) AS f1_lower_md5,
       length({sql_strip('claim')}) AS f2_stripped_length,
       contains(lower(claim), 'the') OR contains(lower(claim), 'und') AS f3_contains_any,
       starts_with(lower(claim), 'th') AS f4_starts_with,
       regexp_matches(lower(claim), '(^|[^\\p{{L}}\\p{{N}}_])(is|are)($|[^\\p{{L}}\\p{{N}}_])') AS f6_regex,
       len(string_split(claim, chr(10))) AS f7_lines,
       upper(substr(domain, 1, 1)) || lower(substr(domain, 2)) AS f8_capitalized,
       length(claim) AS f9_length,
       substr(claim, 1, 100) AS f10_head,
       concat_ws('_', domain, CAST(label AS VARCHAR)) AS f11_concat,
       TRY_CAST(CAST(label AS VARCHAR) AS INTEGER) AS f12_cast,
       coalesce(domain, 'none') AS f13_coalesce,
       list_contains([domain], 'en') AS f14_list_contains,
       round(sqrt(abs(length(claim) - 100.0)) + pow(label, 2), 6) AS f16_math,
       [42, 123, 456, 789, 999][(claim_id % 5) + 1] AS f18_seed
FROM clean""")
def f_scalar_functions(spark, sf_dir):
    """The scalar and array functions the rules use, on every claim."""
    c = clean_claims(claims_of(spark, sf_dir))
    return rounded(c.select(
        "claim_id",
        F.md5(F.lower("claim")).alias("f1_lower_md5"),
        F.length(TX.ustrip("claim")).cast("bigint").alias("f2_stripped_length"),
        TX.contains_any(F.lower("claim"), ["the", "und"]).alias("f3_contains_any"),
        TX.starts_with(F.lower("claim"), "th").alias("f4_starts_with"),
        TX.contains_word(F.lower("claim"), ["is", "are"]).alias("f6_regex"),
        F.size(F.split("claim", "\n")).cast("bigint").alias("f7_lines"),
        TX.capitalize("domain").alias("f8_capitalized"),
        F.length("claim").cast("bigint").alias("f9_length"),
        TX.truncate("claim", 100).alias("f10_head"),
        F.concat_ws("_", "domain", F.col("label").cast("string")).alias("f11_concat"),
        F.col("label").cast("string").try_cast("int").alias("f12_cast"),
        F.coalesce("domain", F.lit("none")).alias("f13_coalesce"),
        F.array_contains(F.array("domain"), "en").alias("f14_list_contains"),
        (F.sqrt(F.abs(F.length("claim") - 100.0)) + F.pow("label", 2)).alias("f16_math"),
        run_seed(F.col("claim_id"), K.RUN_SEEDS).alias("f18_seed"),
    ))


@query("f15_json_parse", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def f15_json_parse(spark, sf_dir):
    """JSON object parse (event properties)."""
    ev = tables.load(spark, sf_dir, "events")
    return ev.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
