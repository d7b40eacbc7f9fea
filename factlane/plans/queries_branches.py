"""Queries whose inputs, made from the tables, reach the branches that the plain
ones do not: failing scorers (R4, X3), groups of equal lengths (G14), a real post
folder (S1-S3, F5), broken CSV files (S4, S5), small tails (A9, A3), small and
one-class groups (G9, B6), run manifests (S8, F19)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import stats
from ..operators import baselines as B
from ..operators import metrics as M
from ..operators import prompts as R
from ..operators.clean import clean_claims
from ..operators.scoring import BusyModel, score_stored, simulated_prediction
from ..session import cut_lineage, scratch_path
from ..sources import csvio, posts, sinks, tables
from .queries_eval import SQL_VERIFY_PROMPT, VERIFY_ANSWERS, _py_md5_sql, _sql_template_list, claims_of
from .queries_eval import first_run_answered, SQL_RUN0, RECORD
from .registry import query, rounded, sql_claims, sql_hash, sql_with
from .sql_eval import rnd, sql_clean_claims, sql_counts, sql_metrics, sql_sim_prediction


def _fresh(spark, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


# ---- R4, X3 ----------------------------------------------------------------------

@query("x3_scoring_report", sql_with(sql_clean_claims()) + f""",
    v AS (SELECT dataset, claim_id, {_py_md5_sql("'0'", SQL_VERIFY_PROMPT)} AS h FROM clean)
SELECT dataset, claim_id, {_sql_template_list(VERIFY_ANSWERS)}[(h // 4) % {len(VERIFY_ANSWERS)} + 1] AS answer,
       CAST(h % 4 + 1 AS INTEGER) AS attempts, CASE WHEN h % 4 > 0 THEN 'RuntimeError: model busy' END AS error, false AS failed
FROM v""")
def x3_scoring_report(spark, sf_dir):
    """R4 + R5 + X3: whole texts as prompts to a model that is busy for up to
    three attempts. A first run allows two, so a quarter of the rows fails and says so; a second run
    over the same store scores only those, with four."""
    claims = clean_claims(claims_of(spark, sf_dir)).select("dataset", "claim_id", R.verifiability_prompt("claim").alias("prompt"))
    store = _fresh(spark, "answers")
    keys = ["dataset", "claim_id"]
    options = dict(keys=keys, seed="__none__", sentinel=K.ERROR_LABEL, max_bytes=256 << 10)
    score_stored(claims, store, lambda: BusyModel(VERIFY_ANSWERS), retries=1, parts=3, **options)
    done = score_stored(claims, store, lambda: BusyModel(VERIFY_ANSWERS), retries=3, **options)
    return done.select(*keys, "answer", "attempts", "error", "failed")


@query("x3_failed_counts", sql_with(sql_clean_claims()) + f""",
    v AS (SELECT dataset, {_py_md5_sql("'0'", SQL_VERIFY_PROMPT)} AS h FROM clean)
SELECT dataset, CAST(least(h % 4 + 1, 2) AS INTEGER) AS attempts, h % 4 > 1 AS failed, count(*) AS n FROM v GROUP BY ALL""")
def x3_failed_counts(spark, sf_dir):
    """Rows by attempts and outcome after a run that allows one retry."""
    claims = clean_claims(claims_of(spark, sf_dir)).select("dataset", "claim_id", R.verifiability_prompt("claim").alias("prompt"))
    done = score_stored(claims, _fresh(spark, "answers"), lambda: BusyModel(VERIFY_ANSWERS), keys=["dataset", "claim_id"], retries=1,
                        seed="__none__", sentinel=K.ERROR_LABEL)
    return done.groupBy("dataset", "attempts", "failed").agg(F.count("*").alias("n"))


# ---- G14 ------------------------------------------------------------------------

@query("g14_equal_lengths", SQL_RUN0 + f""",
    lens AS (SELECT dataset || CASE WHEN claim_id % 3 = 0 THEN '-equal' ELSE '' END AS dataset,
                    length(CASE WHEN claim_id % 3 = 0 THEN claim[1:1] ELSE claim END) AS claim_length, label, prediction FROM run0),
    edges AS (SELECT dataset, quantile_cont(claim_length, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM lens GROUP BY dataset)
SELECT dataset, length_bin, {rnd(['accuracy'])}, n FROM (
  SELECT l.dataset,
         CASE WHEN len(list_distinct(q)) < 5 THEN NULL WHEN claim_length <= q[2] THEN 'Short' WHEN claim_length <= q[3] THEN 'Medium'
              WHEN claim_length <= q[4] THEN 'Long' ELSE 'Very Long' END AS length_bin,
         avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n
  FROM lens l JOIN edges e USING (dataset) GROUP BY ALL)""")
def g14_equal_lengths(spark, sf_dir):
    """G14 with groups whose claims are all of one length: no quartiles there."""
    from ..operators.reports import length_quartile_accuracy
    rows = first_run_answered(spark, sf_dir)
    cut = F.col("claim_id") % 3 == 0
    rows = rows.withColumns({"dataset": F.when(cut, F.concat("dataset", F.lit("-equal"))).otherwise(F.col("dataset")),
                             "claim": F.when(cut, F.substring("claim", 1, 1)).otherwise(F.col("claim"))})
    return rounded(length_quartile_accuracy(rows, on_duplicates="report"))


# ---- S1, S2, S3, F5 ---------------------------------------------------------------

SQL_FOLDER = """
    lines AS (
      SELECT source AS account, 'ok' AS status, doc_id AS post_id, text, lang FROM documents
      UNION ALL SELECT source, 'invalid_json', NULL, NULL, NULL FROM documents WHERE doc_id % 10 IN (0, 1)
      UNION ALL SELECT source, 'not_object', NULL, NULL, NULL FROM documents WHERE doc_id % 10 IN (2, 3, 4))"""


def post_folder(spark, sf_dir) -> str:
    """Documents as a folder of JSONL files: posts, blank, broken and non-object
    lines in ``<source>.jsonl``, and files of other suffixes beside them."""
    docs = tables.load(spark, sf_dir, "documents")
    post = F.to_json(F.struct(F.col("doc_id").alias("post_id"), "text", F.array("lang").alias("langs")))
    kind = F.col("doc_id") % 10
    other = (F.when(kind == 0, F.lit("")).when(kind == 1, F.concat(F.lit('{"post_id": '), F.col("doc_id").cast("string")))
             .when(kind == 2, F.lit("[1, 2]")).when(kind == 3, F.lit("42")).when(kind == 4, F.lit('"text"')))
    lines = docs.select("source", F.explode(F.filter(F.array(post, other), lambda x: x.isNotNull())).alias("value"))
    named = lines.select(F.concat("source", F.lit(".jsonl")).alias("filename"), "value")
    foreign = docs.where(kind == 5).select(F.concat("source", F.lit(".jsonl.bak")).alias("filename"), post.alias("value"))
    notes = docs.where(kind == 6).select(F.lit("notes.txt").alias("filename"), post.alias("value"))
    folder = _fresh(spark, "posts")
    sinks.write_named_lines(named.unionByName(foreign).unionByName(notes), folder)
    return folder


def _account(c="filename"):
    return F.regexp_replace(c, r"-\d+\.jsonl$", "")


@query("s1_post_folder", sql_with(SQL_FOLDER) + """
SELECT account, post_id, text, lang AS langs FROM lines WHERE status = 'ok'""")
def s1_post_folder(spark, sf_dir):
    """S1 + S3 + F5: posts read from files, by suffix, with the account from the
    file's own name."""
    read = posts.read_posts(spark, post_folder(spark, sf_dir))
    return read.select(_account().alias("account"), "post_id", "text", F.array_join("langs", ",").alias("langs"))


@query("s2_post_folder_lines", sql_with(SQL_FOLDER) + """
SELECT account, status, count(*) AS n_lines FROM lines GROUP BY ALL""")
def s2_post_folder_lines(spark, sf_dir):
    """S2 + S3: lines of every account by status."""
    lines = posts.classify_lines(posts.read_lines(spark, post_folder(spark, sf_dir)))
    return lines.groupBy(_account().alias("account"), F.col("line_status").alias("status")).agg(F.count("*").alias("n_lines"))


@query("s1_drop_repeats", """
SELECT source || '.jsonl' AS filename, doc_id AS post_id, text FROM documents
UNION ALL SELECT 'a.jsonl', NULL, text FROM documents WHERE doc_id % 4 = 0""")
def s1_drop_repeats(spark, sf_dir):
    """S1 with one post of each id: repeats in a later file go, posts without an id stay."""
    docs = tables.load(spark, sf_dir, "documents").select(F.concat("source", F.lit(".jsonl")).alias("filename"), F.col("doc_id").alias("post_id"), "text")
    again = docs.where("post_id % 3 = 0").withColumn("filename", F.lit("zz.jsonl"))
    nameless = docs.where("post_id % 4 = 0").select(F.lit("a.jsonl").alias("filename"), F.lit(None).cast("bigint").alias("post_id"), "text")
    return posts.drop_repeats(docs.unionByName(again).unionByName(nameless))


# ---- S4, S5 -----------------------------------------------------------------------

@query("s4_rejected_rows", sql_with(sql_claims()) + """
SELECT dataset, claim_id, claim, domain, CASE WHEN claim_id % 7 > 0 THEN label END AS label,
       CASE WHEN claim_id % 7 = 0 THEN 'bad_value' END AS reject_reason FROM claims""")
def s4_rejected_rows(spark, sf_dir):
    """CSV files whose label is no number in every seventh row: the rows are
    kept apart, with what could be read of them."""
    claims = tables.evaluation_claims(spark, sf_dir).select("dataset", "claim_id", "claim", "domain", F.when(
        F.col("claim_id") % 7 == 0, F.lit("maybe")).otherwise(F.col("label").cast("string")).alias("label"))
    path = _fresh(spark, "csv")
    csvio.write_csv(claims, path)
    return csvio.read_csv_checked(spark, path, "dataset string, claim_id bigint, claim string, domain string, label int").drop("file_name")


@query("s5_column_report", sql_with(sql_claims()) + """,
    f AS (SELECT 'full' AS input, '' AS missing, 'claim_id,claim,label,domain' AS available, true AS complete
          UNION ALL SELECT 'no_domain', 'domain', 'claim_id,claim,label', false
          UNION ALL SELECT 'renamed', 'claim,label', 'claim_id,text,quality,domain', false)
SELECT f.*, (SELECT count(*) FROM claims) AS n_rows FROM f""")
def s5_column_report(spark, sf_dir):
    """Evaluation sets with absent columns, reported by name; the loader
    stops on each of them."""
    claims = tables.evaluation_claims(spark, sf_dir).select("claim_id", "claim", "label", "domain")
    frames = {"full": claims, "no_domain": claims.drop("domain"), "renamed": claims.withColumnsRenamed({"claim": "text", "label": "quality"})}
    paths = {}
    for name, df in frames.items():
        paths[name] = _fresh(spark, "csv")
        csvio.write_csv(df, paths[name])
    counts = None
    for name, path in paths.items():
        back = csvio.read_csv(spark, path)
        try:
            csvio.require_columns(back, name=name)
            stopped = False
        except ValueError:
            stopped = True
        one = back.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("input"), F.lit(not stopped).alias("loads"), "n_rows")
        counts = one if counts is None else counts.unionByName(one)
    report = csvio.column_report(spark, paths).join(counts, "input")
    return report.where(F.col("loads") == F.col("complete")).drop("loads")


# ---- A9, A3 -----------------------------------------------------------------------

# Printed chi-square tails (one degree of freedom) ...
CHI_SQUARE_TAILS = {"0.5": "4.795e-01", "1.0": "3.173e-01", "3.841459": "5.000e-02", "6.634897": "1.000e-02", "10.827566": "1.000e-03",
                    "50.0": "1.537e-12", "100.0": "1.524e-23", "200.0": "2.088e-45", "400.0": "5.507e-89"}
# ... and two-sided 95 % points of Student's t for 1 to 30 degrees of freedom.
T_POINTS = [12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131,
            2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042]


@query("a9_tail_values", f"""
WITH t AS (SELECT unnest([{', '.join(CHI_SQUARE_TAILS)}]::DOUBLE[]) AS statistic, unnest([{', '.join(repr(v) for v in CHI_SQUARE_TAILS.values())}]) AS p_value,
                  unnest(range({len(CHI_SQUARE_TAILS)})) AS k)
SELECT statistic, p_value, count(*) AS n FROM documents JOIN t ON doc_id % {len(CHI_SQUARE_TAILS)} = k GROUP BY ALL""")
def a9_tail_values(spark, sf_dir):
    """Upper tails of the test statistic at printed points, down to 1e-89."""
    points = F.array(*[F.lit(float(x)) for x in CHI_SQUARE_TAILS])
    docs = tables.load(spark, sf_dir, "documents").select(F.element_at(points, (F.col("doc_id") % len(CHI_SQUARE_TAILS) + 1).cast("int")).alias("statistic"))
    p = F.lower(F.format_string("%.3e", stats.chi2_1_sf("statistic")))
    return docs.groupBy("statistic", p.alias("p_value")).agg(F.count("*").alias("n"))


@query("a3_t_points", f"""
WITH t AS (SELECT unnest({T_POINTS}::DOUBLE[]) AS t_crit, unnest(range(1, {len(T_POINTS) + 1})) AS df)
SELECT CAST(df AS INTEGER) AS df, t_crit, count(*) AS n FROM documents JOIN t ON doc_id % {len(T_POINTS)} + 1 = df GROUP BY ALL""")
def a3_t_points(spark, sf_dir):
    """A3: critical values against the printed table."""
    docs = tables.load(spark, sf_dir, "documents").select((F.col("doc_id") % len(T_POINTS) + 1).cast("int").alias("df"))
    return stats.with_t_critical(docs.groupBy("df").agg(F.count("*").alias("n")), "df").withColumn("t_crit", F.round("t_crit", 3)).select("df", "t_crit", "n")


# ---- G9, B6 -----------------------------------------------------------------------

# groups of a few claims (half of them by the label too, so of one class), and every eleventh without predictions
SMALL = 40
SQL_SMALL = sql_with(sql_clean_claims()) + f""",
    small AS (SELECT dataset || '-' || CAST({sql_hash('claim_id')} % {SMALL} AS VARCHAR) || CASE WHEN {sql_hash('claim_id')} % 2 = 0 THEN '-' || CAST(label AS VARCHAR) ELSE '' END AS dataset,
                     0 AS run_id, claim_id, claim, domain, label, {sql_hash('claim_id')} % {SMALL} AS g,
                     CASE WHEN {sql_hash('claim_id')} % {SMALL} % 11 > 0 THEN {sql_sim_prediction("42")} END AS pred, 'Model' AS condition FROM clean)"""


def _small_groups(spark, sf_dir):
    from ..functions.hashing import hash_int
    claims = clean_claims(claims_of(spark, sf_dir))
    h = hash_int("claim_id")
    name = F.concat_ws("-", "dataset", (h % SMALL).cast("string"), F.when(h % 2 == 0, F.col("label").cast("string")))
    return claims.select(name.alias("dataset"), F.lit(0).alias("run_id"), "claim_id", "claim", "domain", "label", F.lit("Model").alias("condition"),
                         F.when(h % SMALL % 11 > 0, simulated_prediction("label", F.lit(42), "claim_id")).alias("pred"))


@query("g9_small_groups", SQL_SMALL + "," + sql_counts("small", per_domain=False) + "," + sql_metrics() + f"""
SELECT 'zero' AS rule, dataset, {rnd(['accuracy'])},
       {', '.join(f"round(CASE WHEN n_present < 2 THEN 0.0 ELSE {c} END, 6) AS {c}" for c in RECORD if c != 'accuracy')}, n_present, n_samples FROM met
UNION ALL
SELECT 'drop', dataset, {rnd(['accuracy'])}, {rnd([c for c in RECORD if c != 'accuracy'])}, n_present, n_samples FROM met WHERE n_present = 2""")
def g9_small_groups(spark, sf_dir):
    """Groups of one class are zero-filled or dropped by the rule, groups without
    predictions have no record."""
    table = cut_lineage(M.metrics_table(_small_groups(spark, sf_dir), ["dataset", "condition", "run_id"], None), "small-groups")
    both = None
    for rule in ("zero", "drop"):
        one = M.apply_degenerate(table, rule).select(F.lit(rule).alias("rule"), "dataset", *RECORD, "n_present", "n_samples")
        both = one if both is None else both.unionByName(one)
    return rounded(both)


@query("b6_small_groups", SQL_SMALL + """,
    c AS (SELECT dataset, run_id, count(*) AS n_valid, count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1 FROM small GROUP BY ALL)
SELECT dataset, n_valid, n_valid < 10 AS use_majority, CAST(CASE WHEN n1 > n0 THEN 1 ELSE 0 END AS INTEGER) AS majority_baseline FROM c""")
def b6_small_groups(spark, sf_dir):
    """Groups of under ten rows fall back to their majority label."""
    rows = _small_groups(spark, sf_dir)
    guard = B.guard_counts(rows)
    return guard.join(B.majority_labels(rows), ["dataset", "run_id"]).select("dataset", "n_valid", "use_majority", "majority_baseline")


@query("b6_one_class_models", SQL_SMALL + """,
    c AS (SELECT dataset, count(*) AS n_valid, min(label) AS lo, max(label) AS hi FROM small GROUP BY dataset)
SELECT s.dataset, s.claim_id, CAST(s.label AS INTEGER) AS tfidf_baseline FROM small s JOIN c USING (dataset) WHERE lo = hi""")
def b6_one_class_models(spark, sf_dir):
    """B5 + B6: groups of one class, under and over ten rows, predict that class."""
    from ..operators.tfidf import tfidf_lr_baseline
    rows = B.with_majority(_small_groups(spark, sf_dir), _small_groups(spark, sf_dir)).drop("pred", "condition")
    classes = rows.groupBy("dataset").agg((F.min("label") == F.max("label")).alias("one"))
    one = rows.join(classes.where("one").select("dataset"), "dataset", "left_semi")
    keyed = one.select("dataset", "run_id", "claim_id", "label", "majority_baseline")
    return tfidf_lr_baseline(keyed, keyed, claims=one.select("claim_id", "claim")).select("dataset", "claim_id", "tfidf_baseline")


# ---- S8, F19 ----------------------------------------------------------------------

@query("s8_run_manifest", sql_with(sql_claims()) + """
SELECT 'results' AS name, '20240229_120000' AS tag, dataset, label, count(*) AS n_rows, true AS stamped FROM claims GROUP BY dataset, label""")
def s8_run_manifest(spark, sf_dir):
    """S8 + F19: a run written under a time tag, read back through its manifest; a
    second run under the current time stands beside it."""
    claims = tables.evaluation_claims(spark, sf_dir).select("claim_id", "domain", "dataset", "label")
    folder = _fresh(spark, "runs")
    sinks.write_run(claims, folder, "results", ("dataset", "label"), tag="20240229_120000")
    now = sinks.write_run(claims.where("label = 1"), folder, "results", ("dataset", "label"))
    rows = sinks.read_run(spark, folder, "results", "20240229_120000")
    listed = spark.read.parquet(f"{folder}/manifest").where(F.col("tag") == "20240229_120000")
    sums = listed.groupBy("name", "tag", "dataset", "label").agg(F.sum("n_rows").alias("n_rows"))
    seen = rows.groupBy("dataset", "label").agg(F.count("*").alias("n"))
    return sums.join(seen, ["dataset", "label"]).where("n = n_rows").select(
        "name", "tag", "dataset", "label", "n_rows", F.lit(now).rlike(r"^\d{8}_\d{6}$").alias("stamped"))
