"""Queries for TF-IDF (B4, W5), the learned baselines (B5, B6, B9) and token
encoding (B8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import metrics as M
from ..operators import tfidf as T
from ..operators.clean import clean_claims
from ..operators.splits import label_split
from ..session import cut_lineage
from . import evaluation as E
from .queries_eval import claims_of
from .registry import query, rounded, sql_runs, sql_split, sql_str, sql_with
from .sql_eval import sql_clean_claims, sql_counts, sql_long, sql_metrics, sql_split_results

SQL_TERMS = f"""
    toks AS (SELECT claim_id, regexp_extract_all(lower(claim), {sql_str(T.TOKEN_PATTERN)}) AS t FROM clean),
    terms AS (
      SELECT claim_id, term, count(*) AS tf FROM (
        SELECT claim_id, unnest(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term
        FROM toks)
      GROUP BY claim_id, term),
    train AS (SELECT dataset, run_id, claim_id FROM split WHERE split = 'train'),
    ndocs AS (SELECT dataset, run_id, count(*) AS n FROM train GROUP BY dataset, run_id),
    st AS (SELECT dataset, run_id, term, sum(tf) AS total, count(*) AS df
           FROM train JOIN terms USING (claim_id) GROUP BY dataset, run_id, term),
    vocab AS (SELECT *, row_number() OVER (PARTITION BY dataset, run_id ORDER BY total DESC, term ASC) AS rk FROM st
              QUALIFY rk <= {K.TFIDF_MAX_FEATURES}),
    vidf AS (SELECT v.*, ln((1.0 + n) / (1.0 + df)) + 1 AS idf FROM vocab v JOIN ndocs USING (dataset, run_id))"""

SQL_TFIDF_BASE = [sql_clean_claims(), sql_runs(), sql_split("clean"), SQL_TERMS]

def _tfidf_inputs(spark, sf_dir):
    claims = claims_of(spark, sf_dir)
    parts = E.split_parts(claims)
    terms = T.term_bags(clean_claims(claims).select("claim_id", "claim"))
    train = parts.where(F.col("split") == "train")
    return parts, terms, cut_lineage(T.fit_vocabulary(train, terms), "vocabulary")


@query("w5_top_vocabulary", sql_with(*SQL_TFIDF_BASE) + """
SELECT dataset, run_id, term, CAST(total AS BIGINT) AS total, df, CAST(rk AS BIGINT) AS rank, round(idf, 6) AS idf
FROM vidf""")
def w5_top_vocabulary(spark, sf_dir):
    """The 1,000 most frequent 1-2-grams of each training part, with idf."""
    _, _, vocab = _tfidf_inputs(spark, sf_dir)
    return rounded(vocab.select("dataset", "run_id", "term", "total", "df", "rank", "idf"))


@query("b4_tfidf_weights", sql_with(*SQL_TFIDF_BASE) + """,
    test AS (SELECT dataset, run_id, claim_id FROM split WHERE split = 'test'),
    w AS (SELECT t.dataset, t.run_id, t.claim_id, v.term, tm.tf * v.idf AS w
          FROM test t JOIN terms tm USING (claim_id)
          JOIN vidf v ON v.dataset = t.dataset AND v.run_id = t.run_id AND v.term = tm.term)
SELECT dataset, run_id, claim_id, term,
       round(w / sqrt(sum(w * w) OVER (PARTITION BY dataset, run_id, claim_id)), 6) AS weight FROM w""")
def b4_tfidf_weights(spark, sf_dir):
    """L2-normalised TF-IDF weights of every test row under its run's vocabulary."""
    parts, terms, vocab = _tfidf_inputs(spark, sf_dir)
    w = T.tfidf_weights(parts.where(F.col("split") == "test"), terms, vocab)
    return rounded(w.select("dataset", "run_id", "claim_id", "term", "weight"))


@query("b5_tfidf_lr")
def b5_tfidf_lr(spark, sf_dir):
    """B5 + B6: TF-IDF + logistic regression fitted on each train part (all
    dataset x run models in one MLlib job), predictions for the test parts."""
    return _tfidf_results(spark, sf_dir).select("dataset", "run_id", "claim_id", "label", "tfidf_baseline")


def _tfidf_results(spark, sf_dir):
    return E.split_results(claims_of(spark, sf_dir), with_tfidf=True)


@query("b5_tfidf_lr_metrics")
def b5_tfidf_lr_metrics(spark, sf_dir):
    """G8 over the split evaluation with the TF-IDF+LR baseline as a condition."""
    _, records = E.run_metrics(_tfidf_results(spark, sf_dir), {**E.SPLIT_CONDITIONS, "tfidf_baseline": "TF-IDF+LR"})
    return rounded(records.select("dataset", "condition", "run_id", "accuracy", "f1_score", "n_samples"))


@query("a5_tfidf_tests")
def a5_tfidf_tests(spark, sf_dir):
    """A5 + A10 with the TF-IDF+LR baseline as a third condition."""
    from ..operators import runstats as A

    _, records = E.run_metrics(_tfidf_results(spark, sf_dir), {**E.SPLIT_CONDITIONS, "tfidf_baseline": "TF-IDF+LR"})
    return rounded(A.one_sample_tests(cut_lineage(records, "records")))


def _b5_models(spark, sf_dir):
    claims = claims_of(spark, sf_dir)
    train = E.split_parts(claims).where(F.col("split") == "train").select("dataset", "run_id", "claim_id", "label")
    text = clean_claims(claims).select("claim_id", "claim")
    return train, T.fit_group_models(train, text)


@query("b5_lr_optimality", sql_with(*SQL_TFIDF_BASE) + """
SELECT dataset, run_id, term, df, true AS stationary FROM vidf""")
def b5_lr_optimality(spark, sf_dir):
    """For every weight, whether the penalised log-loss is stationary there:
    sum over train rows of value * (chance - label), plus the weight, is 0. The
    sums are plain joins and aggregates over the stored weights, apart from the
    solver; the loss is convex, so a stationary point is the model."""
    from ..operators.logistic import INTERCEPT, margins

    train, models = _b5_models(spark, sf_dir)
    group = ["dataset", "run_id"]
    rows = train.where(F.col("label").isNotNull())
    values = cut_lineage(T.tfidf_weights(rows, models.terms, models.vocabulary), "train-values")
    raw = values.select(*group, "claim_id", "index", F.col("weight").alias("value"))
    chance = margins(rows, raw, models.weights, group, "claim_id", normalise=False).withColumn("p", 1 / (1 + F.exp(-F.col("margin"))))
    rest = chance.join(rows, [*group, "claim_id"]).select(*group, "claim_id", (F.col("p") - F.col("label")).alias("rest"))
    pull = values.join(rest, [*group, "claim_id"]).groupBy(*group, "index").agg(F.sum(F.col("weight") * F.col("rest")).alias("pull"))
    weights = models.weights.where(F.col("index") != INTERCEPT)
    return (models.vocabulary.join(weights, [*group, "index"], "left").join(pull, [*group, "index"], "left")
            .select(*group, "term", "df", (F.abs(F.col("pull") + F.col("weight")) < 1e-3).alias("stationary")))


@query("b5_expected_positives", sql_with(sql_clean_claims(), sql_runs(), sql_split("clean")) + """
SELECT dataset, run_id, count(label) AS n_train, CAST(sum(label) AS BIGINT) AS n_true, round(CAST(sum(label) AS DOUBLE), 2) AS expected_true
FROM split WHERE split = 'train' GROUP BY dataset, run_id""")
def b5_expected_positives(spark, sf_dir):
    """The chances of each train part sum to its number of true claims, as a
    free intercept demands."""
    from ..operators.logistic import margins

    train, models = _b5_models(spark, sf_dir)
    group = ["dataset", "run_id"]
    rows = train.where(F.col("label").isNotNull())
    scored = margins(rows, T.group_features(rows, models.terms, models.vocabulary), models.weights, group, "claim_id")
    return (scored.join(rows, [*group, "claim_id"]).groupBy(*group)
            .agg(F.count("*").alias("n_train"), F.sum("label").cast("bigint").alias("n_true"),
                 F.round(F.sum(1 / (1 + F.exp(-F.col("margin")))), 2).alias("expected_true")))


ENC_LEN = K.ENCODER_MAX_LENGTH


@query("b8_token_encoding", sql_with(sql_clean_claims()) + f""",
    etoks AS (SELECT claim_id, regexp_extract_all(lower(claim), {sql_str(T.ENCODER_TOKEN_PATTERN)}) AS t FROM clean),
    cnt AS (SELECT tok, count(*) AS n FROM (SELECT unnest(t) AS tok FROM etoks) GROUP BY tok),
    vocab AS (SELECT tok, CAST(row_number() OVER (ORDER BY n DESC, tok ASC) + 3 AS INTEGER) AS id FROM cnt
              QUALIFY row_number() OVER (ORDER BY n DESC, tok ASC) <= {30522 - T.N_SPECIAL}),
    pos AS (SELECT claim_id, unnest(t[1:{ENC_LEN - 2}]) AS tok, unnest(range(0, len(t[1:{ENC_LEN - 2}]))) AS pos
            FROM etoks),
    ids AS (SELECT p.claim_id, list(coalesce(v.id, 1) ORDER BY p.pos) AS body
            FROM pos p LEFT JOIN vocab v USING (tok) GROUP BY p.claim_id),
    enc AS (SELECT c.claim_id, [2] || coalesce(i.body, []) || [3] AS s FROM clean c LEFT JOIN ids i USING (claim_id))
SELECT claim_id,
       array_to_string(s || list_transform(range({ENC_LEN} - len(s)), lambda x: 0), ',') AS input_ids,
       array_to_string(list_transform(range(len(s)), lambda x: 1)
                       || list_transform(range({ENC_LEN} - len(s)), lambda x: 0), ',') AS attention_mask
FROM enc""")
def b8_token_encoding(spark, sf_dir):
    """Fixed-length (512) token ids and attention masks of every claim."""
    docs = clean_claims(claims_of(spark, sf_dir)).select("claim_id", "claim")
    vocab = T.encoder_vocabulary(docs)
    enc = T.encode_tokens(docs, vocab)
    as_text = lambda c: F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), ",")
    return enc.select("claim_id", as_text("input_ids").alias("input_ids"),
                      as_text("attention_mask").alias("attention_mask"))


def _b9_model(spark, sf_dir):
    from ..operators.classifier import fit_text_classifier

    return fit_text_classifier(label_split(clean_claims(claims_of(spark, sf_dir)), seed=42))


@query("b9_text_classifier")
def b9_text_classifier(spark, sf_dir):
    """Both datasets together, label-stratified 70/30 split (seed 42), a
    TF-IDF + logistic-regression classifier whose regularisation is chosen on
    a separate validation part by macro F1, predictions for the test part."""
    from ..operators.classifier import train_text_classifier

    claims = clean_claims(claims_of(spark, sf_dir))
    return train_text_classifier(label_split(claims, seed=42))


@query("b9_expected_positives", sql_with(sql_clean_claims(), sql_split("clean", by_domain=False, seed="42", group=("g",), cross_runs=False).replace(
    "FROM clean)", "FROM (SELECT *, 0 AS g FROM clean))", 1)) + """
SELECT count(label) AS n_train, CAST(sum(label) AS BIGINT) AS n_true, round(CAST(sum(label) AS DOUBLE), 1) AS expected_true
FROM split WHERE split = 'train'""")
def b9_expected_positives(spark, sf_dir):
    """The final model's chances over all train rows sum to the number of
    true claims, as a free intercept demands."""
    chances = _b9_model(spark, sf_dir).margins("train")
    return chances.agg(
        F.count("*").alias("n_train"), F.sum("label").cast("bigint").alias("n_true"),
        F.round(F.sum(1 / (1 + F.exp(-F.col("margin")))), 1).alias("expected_true"))


CANDIDATES = {"prediction": "Model", "random_baseline": "Random", "majority_baseline": "Majority"}


@query("x4_candidate_scores", sql_with(*sql_split_results(), sql_long("results", CANDIDATES, baselines_once=False), sql_counts("long", per_domain=False), sql_metrics()) + """
SELECT dataset, run_id, condition, n_samples AS n, round(macro_f1, 6) AS macro_f1 FROM met""")
def x4_candidate_scores(spark, sf_dir):
    """Macro F1 of all candidate predictions in one grouped aggregate, as
    the classifier's model selection takes it."""
    from ..operators.classifier import candidate_scores

    results = E.split_results(claims_of(spark, sf_dir))
    long = results.select("dataset", "run_id", "label", F.explode(F.array(*[
        F.struct(F.lit(name).alias("condition"), F.col(c).cast("int").alias("pred")) for c, name in CANDIDATES.items()])).alias("c"))
    return rounded(candidate_scores(long.select("dataset", "run_id", "label", "c.*"), ["dataset", "run_id", "condition"], prediction="pred"))


@query("b9_classifier_metrics")
def b9_classifier_metrics(spark, sf_dir):
    """G4 + G10 on the classifier's test predictions: weighted precision,
    recall, F1 overall and per domain."""
    pred = b9_text_classifier(spark, sf_dir).withColumn("dataset", F.lit("combined")).withColumn(
        "condition", F.lit("TF-IDF+LR classifier")).withColumn("run_id", F.lit(0))
    table = M.metrics_table(pred.withColumnRenamed("prediction", "pred"), ["dataset", "condition", "run_id"],
                            "domain")
    return rounded(table.select("level", "domain", "accuracy", "weighted_precision", "weighted_recall",
                                "weighted_f1", "n_samples"))
