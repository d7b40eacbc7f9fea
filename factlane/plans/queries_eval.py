"""Queries for prompts, scoring and parsing (R*), splits (T*), baselines (B*)
and metrics (G*) over the evaluation set (documents joined with labels)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions.hashing import hash_mod
from ..operators import baselines as B
from ..operators import metrics as M
from ..operators import parsing as P
from ..operators import prompts as R
from ..operators import splits as S
from ..operators.clean import clean_claims, correct_flag, error_kind
from ..operators.scoring import FlakyVerifier, TemplateScorer, score_batches
from ..session import cut_lineage
from ..sources import tables
from . import evaluation as E
from .queries_rules import TEST_SUSPICIOUS
from .registry import (query, rounded, sql_claims, sql_contains_any, sql_hash, sql_runs, sql_split, sql_str,
                       sql_with)
from .sql_eval import (rnd, sql_clean_claims, sql_confidence, sql_counts, sql_full_results, sql_lenient, sql_long,
                       sql_metrics, sql_split_results, sql_strip, sql_structured)

# Stand-in model answers (the answer fixtures): every parser branch occurs.
ANSWER_TEMPLATES = [
    " True", "false.", "true or false", "False, not true", "untrue", "it is true, not false", "", None,
    "Classification: True\nConfidence: High", "classification:false\nconfidence:low",
    "Classification: unsure\nClassification:True", "Classification: False. Or classification: true",
    "Confidence: Low\nConfidence: High", "CONFIDENCE: medium", "Confidence:  high",
]
VERIFY_ANSWERS = ["Verifiable", "Not Verifiable", " verifiable. ", "Not verifiable."]


def claims_of(spark, sf_dir, domain="lang"):
    return tables.evaluation_claims(spark, sf_dir, domain)


def answers_frame(spark, sf_dir):
    """claims x runs with a stand-in answer picked by hash(seed, claim_id)."""
    runs = S.fan_out_runs(clean_claims(claims_of(spark, sf_dir)))
    arr = F.array(*[F.lit(t).cast("string") for t in ANSWER_TEMPLATES])
    idx = (hash_mod(len(ANSWER_TEMPLATES), "seed", "claim_id") + 1).cast("int")
    return runs.withColumn("answer", F.element_at(arr, idx))


def _sql_template_list(items) -> str:
    return "[" + ", ".join("NULL" if t is None else sql_str(t).replace("\n", "' || chr(10) || '") for t in items) + "]"


SQL_ANSWERS = [sql_clean_claims(), sql_runs(), f"""
    answers AS (
      SELECT c.*, r.run_id, r.seed,
             {_sql_template_list(ANSWER_TEMPLATES)}[{sql_hash('seed', 'claim_id')} % {len(ANSWER_TEMPLATES)} + 1]
               AS answer
      FROM clean c CROSS JOIN runs r)"""]


# ---- prompts -----------------------------------------------------------------

def _sql_py(e: str, null_as: str = "None") -> str:
    return f"coalesce(CAST({e} AS VARCHAR), {sql_str(null_as)})"


def _sql_lit(s: str) -> str:
    return sql_str(s).replace("\n", "' || chr(10) || '")


SQL_SHORT_PROMPT = (f"({_sql_lit(K.SHORT_PROMPT_HEAD)} || {_sql_py('domain')} || {_sql_lit(K.SHORT_PROMPT_MID)} || "
                    f"{_sql_py('claim')} || {_sql_lit(K.SHORT_PROMPT_TAIL)})")
SQL_STRUCT_PROMPT = (f"({_sql_lit(K.STRUCTURED_PROMPT_HEAD)} || {_sql_py('domain')} || "
                     f"{_sql_lit(K.STRUCTURED_PROMPT_MID)} || {_sql_py('claim')} || "
                     f"{_sql_lit(K.STRUCTURED_PROMPT_TAIL)})")
SQL_VERIFY_PROMPT = f"({_sql_lit(K.VERIFY_PROMPT_HEAD)} || {_sql_py('claim', 'nan')} || {_sql_lit(K.VERIFY_PROMPT_TAIL)})"


@query("r1_short_prompt", sql_with(sql_clean_claims()) + f"""
SELECT dataset, claim_id, {SQL_SHORT_PROMPT} AS prompt FROM clean""")
def r1_short_prompt(spark, sf_dir):
    return clean_claims(claims_of(spark, sf_dir)).select("dataset", "claim_id", R.short_prompt().alias("prompt"))


@query("r2_structured_prompt", sql_with(sql_clean_claims()) + f"""
SELECT dataset, claim_id, {SQL_STRUCT_PROMPT} AS prompt FROM clean""")
def r2_structured_prompt(spark, sf_dir):
    return clean_claims(claims_of(spark, sf_dir)).select("dataset", "claim_id",
                                                         R.structured_prompt().alias("prompt"))


@query("r3_verifiability_prompt", sql_with(sql_clean_claims()) + f"""
SELECT dataset, claim_id, {SQL_VERIFY_PROMPT} AS prompt FROM clean""")
def r3_verifiability_prompt(spark, sf_dir):
    return clean_claims(claims_of(spark, sf_dir)).select("dataset", "claim_id",
                                                         R.verifiability_prompt("claim").alias("prompt"))


# ---- batch scoring -----------------------------------------------------------

def _py_md5_sql(seed: str, text: str) -> str:
    return f"CAST(('0x' || substr(md5(CAST({seed} AS VARCHAR) || '|' || {text}), 1, 8)) AS BIGINT)"


@query("r4_batch_scoring", sql_with(sql_clean_claims(), sql_runs()) + f""",
    scored AS (
      SELECT c.dataset, r.run_id, c.claim_id,
             {_sql_template_list(ANSWER_TEMPLATES)}[{_py_md5_sql('r.seed', SQL_SHORT_PROMPT)}
               % {len(ANSWER_TEMPLATES)} + 1] AS answer
      FROM clean c CROSS JOIN runs r)
SELECT dataset, run_id, claim_id, answer, {sql_lenient('answer')} AS prediction FROM scored""")
def r4_batch_scoring(spark, sf_dir):
    """Prompts -> Arrow batches -> scorer (built once per task) -> answers,
    kept in the checkpoint folder (a retried stage never re-scores) -> parsed."""
    runs = S.fan_out_runs(clean_claims(claims_of(spark, sf_dir)))
    prompts = runs.select("dataset", "run_id", "seed", "claim_id", R.short_prompt().alias("prompt"))
    scored = cut_lineage(score_batches(prompts, lambda: TemplateScorer(ANSWER_TEMPLATES)))
    return scored.select("dataset", "run_id", "claim_id", "answer", P.lenient_label("answer").alias("prediction"))


@query("r5_retry_sentinel", sql_with(sql_clean_claims()) + f""",
    v AS (SELECT dataset, claim_id, {_py_md5_sql("'0'", SQL_VERIFY_PROMPT)} AS h FROM clean),
    lab AS (SELECT dataset, claim_id, CASE WHEN h % 10 = 0 THEN 'Error'
               ELSE {_sql_template_list(VERIFY_ANSWERS)}[(h // 10) % {len(VERIFY_ANSWERS)} + 1] END AS answer FROM v)
SELECT dataset, claim_id, {sql_strip('answer')} AS verifiable_label,
       CASE WHEN lower(regexp_replace({sql_strip('answer')}, '[\\s\\p{{P}}\\p{{S}}]+\\z', '')) = 'error' THEN 'Error'
            WHEN lower(regexp_replace({sql_strip('answer')}, '[\\s\\p{{P}}\\p{{S}}]+\\z', '')) = 'not verifiable'
              THEN 'Not Verifiable'
            WHEN lower(regexp_replace({sql_strip('answer')}, '[\\s\\p{{P}}\\p{{S}}]+\\z', '')) = 'verifiable'
              THEN 'Verifiable' ELSE 'Other' END AS verifiable_class
FROM lab""")
def r5_retry_sentinel(spark, sf_dir):
    """R3 -> R4/R5 -> R9: verifiability prompts scored with retries; texts the
    model never answers get the sentinel "Error"; answers stripped and normalised."""
    claims = clean_claims(claims_of(spark, sf_dir)).select("dataset", "claim_id",
                                                           R.verifiability_prompt("claim").alias("prompt"))
    scored = cut_lineage(score_batches(claims, lambda: FlakyVerifier(VERIFY_ANSWERS), seed="__none__",
                                       retries=K.VERIFY_RETRIES, sentinel=K.ERROR_LABEL))
    return scored.select("dataset", "claim_id", P.verifiable_answer("answer").alias("verifiable_label"),
                         P.verifiable_class("answer").alias("verifiable_class"))


# ---- parsers -----------------------------------------------------------------

@query("r6_lenient_parse", sql_with(*SQL_ANSWERS) + f"""
SELECT dataset, run_id, claim_id, {sql_lenient('answer')} AS prediction FROM answers""")
def r6_lenient_parse(spark, sf_dir):
    return answers_frame(spark, sf_dir).select("dataset", "run_id", "claim_id",
                                               P.lenient_label("answer").alias("prediction"))


@query("r7_structured_parse", sql_with(*SQL_ANSWERS) + f"""
SELECT dataset, run_id, claim_id, {sql_structured('answer')} AS prediction FROM answers""")
def r7_structured_parse(spark, sf_dir):
    return answers_frame(spark, sf_dir).select("dataset", "run_id", "claim_id",
                                               P.structured_label("answer").alias("prediction"))


@query("r8_confidence_parse", sql_with(*SQL_ANSWERS) + f"""
SELECT dataset, run_id, claim_id, {sql_confidence('answer')} AS confidence FROM answers""")
def r8_confidence_parse(spark, sf_dir):
    return answers_frame(spark, sf_dir).select("dataset", "run_id", "claim_id",
                                               P.confidence_level("answer").alias("confidence"))


@query("r10_reasoning", sql_with(*sql_full_results()) + """
SELECT dataset, run_id, claim_id, prediction, confidence, reasoning FROM full_results""")
def r10_reasoning(spark, sf_dir):
    """R7 + R8 + R10 on the full-set frame: class, confidence and raw answer."""
    res = E.full_results(claims_of(spark, sf_dir), keywords=TEST_SUSPICIOUS)
    return res.select("dataset", "run_id", "claim_id", "prediction", "confidence", "reasoning")


# ---- splits ------------------------------------------------------------------

@query("t1_strata_key", sql_with(sql_clean_claims()) + """
SELECT dataset, claim_id, concat_ws('_', domain, CAST(label AS VARCHAR)) AS stratum FROM clean""")
def t1_strata_key(spark, sf_dir):
    return clean_claims(claims_of(spark, sf_dir)).select("dataset", "claim_id",
                                                         S.strata_key("domain", "label").alias("stratum"))


@query("t2_stratified_split", sql_with(sql_clean_claims(), sql_runs(), sql_split("clean")) + """
SELECT dataset, run_id, claim_id, split, stratified_by FROM split""")
def t2_stratified_split(spark, sf_dir):
    """Exact 70/30 split by domain x label, per dataset and run."""
    return E.split_parts(claims_of(spark, sf_dir)).select(
        "dataset", "run_id", "claim_id", "split", "stratified_by")


@query("t3_split_fallback", sql_with(sql_clean_claims("source"), sql_runs(), sql_split("clean")) + """
SELECT dataset, run_id, claim_id, split, stratified_by FROM split""")
def t3_split_fallback(spark, sf_dir):
    """domain = source has strata of one row, so the split falls back to label."""
    return E.split_parts(claims_of(spark, sf_dir, "source")).select(
        "dataset", "run_id", "claim_id", "split", "stratified_by")


@query("t4_label_split", sql_with(sql_clean_claims(), sql_split("clean", by_domain=False, seed="42", group=("g",),
                                                                 cross_runs=False).replace(
    "FROM clean)", "FROM (SELECT *, 0 AS g FROM clean))", 1)) + """
SELECT claim_id, split FROM split""")
def t4_label_split(spark, sf_dir):
    """T4: both datasets together, split by label only with seed 42."""
    return S.label_split(clean_claims(claims_of(spark, sf_dir)), seed=42).select("claim_id", "split")


@query("t5_crosstab", sql_with(sql_clean_claims(), sql_runs(), sql_split("clean")) + """
SELECT dataset, run_id, part AS split, domain,
       count(*) FILTER (WHERE label = 0) AS n_label_0, count(*) FILTER (WHERE label = 1) AS n_label_1
FROM (SELECT *, split AS part FROM split UNION ALL SELECT *, 'all' AS part FROM split)
GROUP BY ALL""")
def t5_crosstab(spark, sf_dir):
    """T5: domain x label counts before the split ('all') and per part."""
    parts = E.split_parts(claims_of(spark, sf_dir))
    both = parts.unionByName(parts.withColumn("split", F.lit("all")))
    return S.crosstab(both)


@query("t6_balance_shares", sql_with(sql_clean_claims(), sql_runs(), sql_split("clean")) + f"""
SELECT dataset, run_id, split, kind, value, n, {rnd(['share'])} FROM (
  SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY dataset, run_id, split, kind) AS share FROM (
    SELECT dataset, run_id, split, 'label' AS kind, CAST(label AS VARCHAR) AS value, count(*) AS n
    FROM split GROUP BY ALL
    UNION ALL
    SELECT dataset, run_id, split, 'domain', domain, count(*) FROM split GROUP BY ALL))""")
def t6_balance_shares(spark, sf_dir):
    """Class and domain shares per part."""
    parts = E.split_parts(claims_of(spark, sf_dir))
    lab = S.part_shares(parts.withColumn("value", F.col("label").cast("string")), "value").withColumn(
        "kind", F.lit("label"))
    dom = S.part_shares(parts.withColumn("value", F.col("domain")), "value").withColumn("kind", F.lit("domain"))
    return rounded(lab.unionByName(dom).select("dataset", "run_id", "split", "kind", "value", "n", "share"))


@query("t7_part_sizes", sql_with(sql_clean_claims(), sql_runs(), sql_split("clean")) + f"""
SELECT dataset, run_id, split, n, {rnd(['pct'])} FROM (
  SELECT *, n * 100.0 / sum(n) OVER (PARTITION BY dataset, run_id) AS pct FROM (
    SELECT dataset, run_id, split, count(*) AS n FROM split GROUP BY ALL))""")
def t7_part_sizes(spark, sf_dir):
    parts = E.split_parts(claims_of(spark, sf_dir))
    return rounded(S.part_sizes(parts))


# ---- baselines ---------------------------------------------------------------

@query("b1_random_baseline", sql_with(*sql_split_results()) + """
SELECT dataset, run_id, claim_id, random_baseline FROM results""")
def b1_random_baseline(spark, sf_dir):
    res = E.split_results(claims_of(spark, sf_dir))
    return res.select("dataset", "run_id", "claim_id", "random_baseline")


@query("b2_majority_baseline", sql_with(*sql_split_results()) + """
SELECT dataset, run_id, majority_baseline FROM maj""")
def b2_majority_baseline(spark, sf_dir):
    parts = E.split_parts(claims_of(spark, sf_dir))
    return B.majority_labels(parts.where(F.col("split") == "train"))


@query("b3_keyword_baseline", sql_with(sql_clean_claims()) + f"""
SELECT dataset, claim_id, CASE WHEN {sql_contains_any('lower(claim)', TEST_SUSPICIOUS)} THEN 0 ELSE 1 END
       AS keyword_baseline FROM clean""")
def b3_keyword_baseline(spark, sf_dir):
    c = clean_claims(claims_of(spark, sf_dir))
    return c.select("dataset", "claim_id", B.keyword_baseline("claim", TEST_SUSPICIOUS).alias("keyword_baseline"))


@query("b3_keyword_baseline_reference_list", sql_with(sql_clean_claims()) + f"""
SELECT dataset, claim_id, CASE WHEN {sql_contains_any('lower(claim)', K.SUSPICIOUS_KEYWORDS)} THEN 0 ELSE 1 END
       AS keyword_baseline FROM clean""")
def b3_keyword_baseline_reference_list(spark, sf_dir):
    c = clean_claims(claims_of(spark, sf_dir))
    return c.select("dataset", "claim_id", B.keyword_baseline("claim").alias("keyword_baseline"))


@query("b6_learned_baseline_guard", sql_with(*sql_split_results()) + f"""
SELECT dataset, run_id, n_valid, n_valid < 10 AS use_majority FROM (
  SELECT dataset, run_id, count(*) FILTER (WHERE label IS NOT NULL AND claim IS NOT NULL
                                           AND {sql_strip('claim')} <> '') AS n_valid
  FROM split WHERE split = 'train' GROUP BY ALL)""")
def b6_learned_baseline_guard(spark, sf_dir):
    claims = claims_of(spark, sf_dir)
    parts = E.split_parts(claims)
    return B.guard_counts(E.with_claim_text(parts.where(F.col("split") == "train"), claims))


@query("b7_inner_split", sql_with(sql_clean_claims(), sql_runs(), sql_split("clean"),
                                  sql_split("train_rows", by_domain=False, seed="42", test_share=0.2,
                                            name="inner_sp", cross_runs=False)
                                  .replace("FROM train_rows)", "FROM (SELECT * EXCLUDE (split, stratified_by) "
                                           "FROM split WHERE split = 'train'))", 1)) + """
SELECT dataset, run_id, claim_id, split AS inner_split FROM inner_sp""")
def b7_inner_split(spark, sf_dir):
    """80/20 label-stratified split of each train part, seed 42."""
    parts = E.split_parts(claims_of(spark, sf_dir))
    train = parts.where(F.col("split") == "train").drop("split", "stratified_by")
    inner = S.label_split(train, test_share=K.INNER_TEST_SHARE, seed=42, group=("dataset", "run_id"),
                          part_col="inner_split")
    return inner.select("dataset", "run_id", "claim_id", "inner_split")


@query("b10_argmax", """
SELECT vec_id, label, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS predicted
FROM embeddings""")
def b10_argmax(spark, sf_dir):
    """class = position of the first maximum score (embeddings as score vectors)."""
    emb = tables.load(spark, sf_dir, "embeddings")
    return emb.select("vec_id", "label", B.argmax_class("embedding").alias("predicted"))


# ---- metrics -----------------------------------------------------------------

def split_table(spark, sf_dir):
    res = E.split_results(claims_of(spark, sf_dir))
    table, records = E.run_metrics(res, E.SPLIT_CONDITIONS)
    return table, records


SQL_SPLIT_MET = sql_with(*sql_split_results(), sql_long("results", E.SPLIT_CONDITIONS), sql_counts(),
                         sql_metrics())
RECORD = ["accuracy", "precision", "recall", "f1_score", "cohen_kappa", "mcc", "precision_false", "recall_false",
          "f1_false", "precision_true", "recall_true", "f1_true", "macro_f1", "weighted_f1"]
KEYS = ["dataset", "condition", "run_id"]


def _sel(df, cols):
    return rounded(df.select(*cols))


@query("g1_confusion_matrix", SQL_SPLIT_MET + """
SELECT dataset, condition, run_id, tn, fp, fn, tp FROM met WHERE level = 'overall'""")
def g1_confusion_matrix(spark, sf_dir):
    table, _ = split_table(spark, sf_dir)
    return table.where(F.col("level") == "overall").select(*KEYS, "tn", "fp", "fn", "tp")


@query("g2_accuracy", SQL_SPLIT_MET + f"""
SELECT dataset, condition, run_id, {rnd(['accuracy'])} FROM met WHERE level = 'overall'""")
def g2_accuracy(spark, sf_dir):
    table, _ = split_table(spark, sf_dir)
    return _sel(table.where(F.col("level") == "overall"), KEYS + ["accuracy"])


@query("g3_macro_prf", SQL_SPLIT_MET + f"""
SELECT dataset, condition, run_id, domain, level, {rnd(['precision', 'recall', 'f1_score'])} FROM met""")
def g3_macro_prf(spark, sf_dir):
    table, _ = split_table(spark, sf_dir)
    return _sel(table, KEYS + ["domain", "level", "precision", "recall", "f1_score"])


@query("g4_weighted_prf", SQL_SPLIT_MET + f"""
SELECT dataset, condition, run_id, domain, level,
       {rnd(['weighted_precision', 'weighted_recall', 'weighted_f1'])} FROM met""")
def g4_weighted_prf(spark, sf_dir):
    table, _ = split_table(spark, sf_dir)
    return _sel(table, KEYS + ["domain", "level", "weighted_precision", "weighted_recall", "weighted_f1"])


@query("g5_class_report", SQL_SPLIT_MET + f"""
SELECT dataset, condition, run_id, class, {rnd(['precision', 'recall', 'f1'])}, support FROM (
  SELECT dataset, condition, run_id, 'False' AS class, precision_false AS precision, recall_false AS recall,
         f1_false AS f1, tn + fp AS support, tn + fp + fn > 0 AS present FROM met WHERE level = 'overall'
  UNION ALL
  SELECT dataset, condition, run_id, 'True', precision_true, recall_true, f1_true, tp + fn, tp + fn + fp > 0
  FROM met WHERE level = 'overall') WHERE present""")
def g5_class_report(spark, sf_dir):
    table, _ = split_table(spark, sf_dir)
    return rounded(M.class_report(table.where(F.col("level") == "overall"), KEYS))


@query("g6_cohen_kappa", SQL_SPLIT_MET + f"""
SELECT dataset, condition, run_id, domain, level, {rnd(['cohen_kappa'])} FROM met""")
def g6_cohen_kappa(spark, sf_dir):
    table, _ = split_table(spark, sf_dir)
    return _sel(table, KEYS + ["domain", "level", "cohen_kappa"])


@query("g7_mcc", SQL_SPLIT_MET + f"""
SELECT dataset, condition, run_id, domain, level, {rnd(['mcc'])} FROM met""")
def g7_mcc(spark, sf_dir):
    table, _ = split_table(spark, sf_dir)
    return _sel(table, KEYS + ["domain", "level", "mcc"])


@query("g8_metrics_record", SQL_SPLIT_MET + f"""
SELECT dataset, condition, run_id, {rnd(RECORD)}, tn, fp, fn, tp, n_samples
FROM met WHERE level = 'overall' AND n_present = 2""")
def g8_metrics_record(spark, sf_dir):
    """The full metrics record per dataset x condition x run (split evaluation)."""
    _, records = split_table(spark, sf_dir)
    return _sel(records, KEYS + RECORD + ["tn", "fp", "fn", "tp", "n_samples"])


@query("g9_degenerate_zero", SQL_SPLIT_MET + f"""
SELECT dataset, condition, run_id, domain, {rnd(['accuracy'])},
       {', '.join(f"round(CASE WHEN n_present < 2 THEN 0.0 ELSE {c} END, 6) AS {c}" for c in RECORD if c != 'accuracy')},
       n_present
FROM met WHERE level = 'domain'""")
def g9_degenerate_zero(spark, sf_dir):
    """Domain-level records, single-class groups zero-filled except accuracy."""
    table, _ = split_table(spark, sf_dir)
    dom = M.apply_degenerate(table.where(F.col("level") == "domain"), "zero")
    return _sel(dom, KEYS + ["domain"] + RECORD + ["n_present"])


@query("g10_domain_metrics", SQL_SPLIT_MET + f"""
SELECT dataset, run_id, domain, {rnd(['accuracy', 'precision', 'recall', 'f1_score'])}, tn, fp, fn, tp
FROM met WHERE level = 'domain' AND condition = 'Model'""")
def g10_domain_metrics(spark, sf_dir):
    """Per-domain model metrics per dataset and run (null domains left out)."""
    table, _ = split_table(spark, sf_dir)
    dom = table.where((F.col("level") == "domain") & (F.col("condition") == K.MODEL_CONDITION))
    return _sel(dom, ["dataset", "run_id", "domain", "accuracy", "precision", "recall", "f1_score",
                      "tn", "fp", "fn", "tp"])


SQL_POOLED = sql_with(*sql_split_results(), sql_long("results", {"prediction": "Model"}),
                      sql_counts("(SELECT * FROM long WHERE domain IS NOT NULL)", "pc", ("dataset", "domain"),
                                 per_domain=False), sql_metrics("pc", "pooled"))


@query("g11_pooled_domains", SQL_POOLED + f"""
SELECT dataset, domain, n_samples, {rnd(['accuracy', 'precision', 'recall', 'f1_score'])} FROM pooled""")
def g11_pooled_domains(spark, sf_dir):
    """G11 + W1: domain metrics pooled over all runs, sorted by accuracy."""
    res = E.answered(E.split_results(claims_of(spark, sf_dir)))
    long = M.long_predictions(res, {"prediction": K.MODEL_CONDITION}, ["dataset", "run_id", "claim_id", "domain"],
                              pred="pred")
    pooled = M.pooled_domain_metrics(long)
    return _sel(pooled.orderBy("dataset", F.desc("accuracy"), "domain"),
                ["dataset", "domain", "n_samples", "accuracy", "precision", "recall", "f1_score"])


def first_run_answered(spark, sf_dir):
    res = E.full_results(claims_of(spark, sf_dir), keywords=TEST_SUSPICIOUS)
    return E.answered(res).where(F.col("run_id") == 0)


SQL_RUN0 = sql_with(*sql_full_results(), """
    run0 AS (SELECT * FROM full_results WHERE label IS NOT NULL AND prediction IS NOT NULL AND run_id = 0)""")


@query("g12_domain_accuracy", SQL_RUN0 + f"""
SELECT dataset, domain, {rnd(['accuracy'])}, n FROM (
  SELECT dataset, domain, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n
  FROM run0 GROUP BY ALL)""")
def g12_domain_accuracy(spark, sf_dir):
    """(mean, count) of correctness per domain, first run."""
    return rounded(M.accuracy_by(first_run_answered(spark, sf_dir), ["dataset", "domain"]))


@query("g13_error_counts", SQL_RUN0 + """
SELECT dataset, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS n_fp,
       count(*) FILTER (WHERE label = 1 AND prediction = 0) AS n_fn FROM run0 GROUP BY dataset""")
def g13_error_counts(spark, sf_dir):
    r0 = first_run_answered(spark, sf_dir).withColumn("kind", error_kind("label", "prediction"))
    return r0.groupBy("dataset").agg(F.count_if(F.col("kind") == "FP").alias("n_fp"),
                                     F.count_if(F.col("kind") == "FN").alias("n_fn"))


@query("g14_length_quartiles", SQL_RUN0 + f""",
    lens AS (SELECT *, length(claim) AS claim_length FROM run0),
    edges AS (SELECT dataset, quantile_cont(claim_length, [0.25, 0.5, 0.75]) AS q FROM lens GROUP BY dataset)
SELECT dataset, length_bin, {rnd(['accuracy'])}, n FROM (
  SELECT l.dataset,
         CASE WHEN claim_length <= q[1] THEN 'Short' WHEN claim_length <= q[2] THEN 'Medium'
              WHEN claim_length <= q[3] THEN 'Long' ELSE 'Very Long' END AS length_bin,
         avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n
  FROM lens l JOIN edges e USING (dataset) GROUP BY ALL)""")
def g14_length_quartiles(spark, sf_dir):
    """Accuracy by claim-length quartile (linear quantile edges)."""
    from ..operators.reports import length_quartile_accuracy
    return rounded(length_quartile_accuracy(first_run_answered(spark, sf_dir)))


@query("g15_confidence_accuracy", SQL_RUN0 + f"""
SELECT dataset, confidence, {rnd(['accuracy'])}, n FROM (
  SELECT dataset, confidence, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n
  FROM run0 GROUP BY ALL)""")
def g15_confidence_accuracy(spark, sf_dir):
    return rounded(M.accuracy_by(first_run_answered(spark, sf_dir), ["dataset", "confidence"]))


@query("g16_domain_counts", sql_with(sql_clean_claims()) + f"""
SELECT dataset, domain, n, {rnd(['share'])} FROM (
  SELECT dataset, domain, count(*) AS n,
         CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY dataset) AS share
  FROM clean GROUP BY dataset, domain)""")
def g16_domain_counts(spark, sf_dir):
    """Value counts of the domain per dataset, with shares."""
    c = clean_claims(claims_of(spark, sf_dir))
    return rounded(S.part_shares(c.withColumnRenamed("domain", "value"), "value", keys=("dataset",))
                   .withColumnRenamed("value", "domain"))


SQL_FULL_MET = sql_with(*sql_full_results(), """
    answered_rows AS (SELECT * FROM full_results WHERE label IS NOT NULL AND prediction IS NOT NULL)""",
                        sql_long("answered_rows", E.FULL_CONDITIONS), sql_counts(per_domain=False), sql_metrics())


@query("g17_baselines_once_split", SQL_SPLIT_MET + f"""
SELECT dataset, condition, run_id, n_samples, {rnd(['accuracy', 'macro_f1'])} FROM met WHERE level = 'overall'""")
def g17_baselines_once_split(spark, sf_dir):
    """G17 (split evaluation): baselines scored once (run 0) on every labelled test row."""
    table, _ = split_table(spark, sf_dir)
    return _sel(table.where(F.col("level") == "overall"), KEYS + ["n_samples", "accuracy", "macro_f1"])


@query("g17_baselines_once_full", SQL_FULL_MET + f"""
SELECT dataset, condition, run_id, n_samples, {rnd(['accuracy', 'macro_f1'])} FROM met""")
def g17_baselines_once_full(spark, sf_dir):
    """G17 (full evaluation): baselines only on rows the model answered."""
    res = E.full_results(claims_of(spark, sf_dir), keywords=TEST_SUSPICIOUS)
    table, _ = E.run_metrics(res, E.FULL_CONDITIONS, baseline_rows="answered", per_domain=False)
    return _sel(table, KEYS + ["n_samples", "accuracy", "macro_f1"])


# ---- row-level flags (P10-P16) -----------------------------------------------

# Claims of some ids are blanked or nulled, labels of others nulled, so that
# every reason for removal occurs.
SQL_DAMAGED = """
    damaged AS (
      SELECT dataset, claim_id, domain,
             CASE claim_id % 10 WHEN 3 THEN ' ' || chr(10) WHEN 4 THEN NULL ELSE claim END AS claim,
             CASE claim_id % 10 WHEN 5 THEN NULL ELSE label END AS label
      FROM claims)"""


def damaged_claims(spark, sf_dir):
    digit = F.col("claim_id") % 10
    return (claims_of(spark, sf_dir)
            .withColumn("claim", F.when(digit == 3, " \n").when(digit != 4, F.col("claim")))
            .withColumn("label", F.when(digit != 5, F.col("label"))))


@query("p9_clean_report", sql_with(sql_claims(), SQL_DAMAGED) + f"""
SELECT dataset, count(*) AS before,
       count(*) FILTER (WHERE claim IS NOT NULL AND label IS NOT NULL AND domain IS NOT NULL
                        AND {sql_strip('claim')} <> '') AS after,
       count(*) - count(*) FILTER (WHERE claim IS NOT NULL AND label IS NOT NULL AND domain IS NOT NULL
                        AND {sql_strip('claim')} <> '') AS removed
FROM damaged GROUP BY dataset""")
def p9_clean_report(spark, sf_dir):
    from ..operators.clean import clean_report
    return clean_report(damaged_claims(spark, sf_dir))


@query("g8_scored_answers", sql_with(*sql_split_results()) + f""",
    scored AS (
      SELECT t.dataset, t.run_id, t.label,
             {{answer}} AS answer
      FROM split t JOIN runs r USING (run_id) WHERE t.split = 'test'),
    parsed AS (SELECT dataset, run_id, label, {sql_lenient('answer')} AS prediction FROM scored)
SELECT dataset, run_id, count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
       count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp, count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
       count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp
FROM parsed WHERE prediction IS NOT NULL AND label IS NOT NULL GROUP BY dataset, run_id""".replace("{answer}", (
    f"{_sql_template_list(ANSWER_TEMPLATES)}[{_py_md5_sql('r.seed', SQL_SHORT_PROMPT)} % {len(ANSWER_TEMPLATES)} + 1]")))
def g8_scored_answers(spark, sf_dir):
    """R1 -> R4 -> J1 -> R6 -> G8: prompts of all runs scored in batches, the
    answers joined to the test rows, parsed, and counted against the labels."""
    claims = claims_of(spark, sf_dir)
    runs = S.fan_out_runs(clean_claims(claims))
    prompts = runs.select("dataset", "run_id", "seed", "claim_id", R.short_prompt().alias("prompt"))
    answers = cut_lineage(score_batches(prompts, lambda: TemplateScorer(ANSWER_TEMPLATES)), "answers")
    _, records = E.run_metrics(E.split_results(claims, prediction=answers), {"prediction": K.MODEL_CONDITION},
                               per_domain=False)
    return records.select("dataset", "run_id", "tn", "fp", "fn", "tp")


@query("p10_drop_unanswered", sql_with(*sql_split_results()) + """
SELECT dataset, run_id, count(*) AS n_total, count(prediction) AS n_clean,
       count(*) - count(prediction) AS dropped, round(count(prediction) / count(*), 6) AS coverage
FROM results GROUP BY dataset, run_id""")
def p10_drop_unanswered(spark, sf_dir):
    from ..operators.clean import drop_unanswered_report
    return rounded(drop_unanswered_report(E.split_results(claims_of(spark, sf_dir))))


@query("p12_correct_flag", sql_with(*sql_split_results()) + """
SELECT dataset, run_id, claim_id, label = prediction AS correct FROM results WHERE prediction IS NOT NULL""")
def p12_correct_flag(spark, sf_dir):
    res = E.answered(E.split_results(claims_of(spark, sf_dir)))
    return res.select("dataset", "run_id", "claim_id", correct_flag().alias("correct"))


@query("p13_error_rows", sql_with(*sql_split_results()) + """
SELECT dataset, run_id, claim_id, CASE WHEN label = 0 THEN 'FP' ELSE 'FN' END AS kind
FROM results WHERE (label = 0 AND prediction = 1) OR (label = 1 AND prediction = 0)""")
def p13_error_rows(spark, sf_dir):
    res = E.split_results(claims_of(spark, sf_dir)).withColumn("kind", error_kind())
    return res.where(F.col("kind").isNotNull()).select("dataset", "run_id", "claim_id", "kind")


@query("p15_result_columns", sql_with(*sql_split_results()) + """
SELECT dataset, run_id, claim_id, label, prediction, random_baseline, majority_baseline, 'test' AS split
FROM results""")
def p15_result_columns(spark, sf_dir):
    """The per-run results frame (constants and derived columns added,
    temporary columns dropped)."""
    res = E.split_results(claims_of(spark, sf_dir))
    return res.select("dataset", "run_id", "claim_id", "label", "prediction", "random_baseline",
                      "majority_baseline", "split")


@query("p16_missing_claim", """
SELECT l.doc_id AS claim_id, CASE WHEN d.text IS NULL OR l.doc_id % 7 = 0 THEN NULL ELSE 1 END AS scored
FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id""")
def p16_missing_claim(spark, sf_dir):
    """A label whose document (claim) is missing is not scored."""
    from ..operators.clean import skip_missing_claim
    labels = tables.load(spark, sf_dir, "labels").select("doc_id")
    # the claims of some ids are missing
    docs = tables.load(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("text"))
    j = labels.join(docs, "doc_id", "left")
    return j.select(F.col("doc_id").alias("claim_id"), skip_missing_claim(F.lit(1), "text").alias("scored"))
