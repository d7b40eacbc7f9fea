"""DuckDB twins of the evaluation frames, parsers and metrics."""

from __future__ import annotations

from .. import constants as K
from ..functions.text import SPACE_CLASS
from .registry import sql_claims, sql_hash, sql_list, sql_runs, sql_split, sql_str

STRIP_RE = sql_str(rf"\A{SPACE_CLASS}+|{SPACE_CLASS}+\z")


def sql_strip(e: str) -> str:
    return f"regexp_replace({e}, {STRIP_RE}, '', 'g')"


def sql_clean_claims(domain: str = "lang") -> str:
    return sql_claims(domain) + f""",
    clean AS (
      SELECT * FROM claims
      WHERE claim IS NOT NULL AND label IS NOT NULL AND domain IS NOT NULL AND {sql_strip('claim')} <> '')"""


def sql_sim_prediction(seed: str = "seed", key: str = "claim_id") -> str:
    h = f"({sql_hash(seed, key)} % 100)"
    return f"(CASE WHEN {h} < 78 THEN label WHEN {h} < 97 THEN 1 - label ELSE NULL END)"


def sql_split_results(domain: str = "lang") -> list[str]:
    """v2 results (test rows) with prediction and baselines."""
    return [sql_clean_claims(domain), sql_runs(), sql_split("clean"), f"""
    train_lc AS (
      SELECT dataset, run_id, label, count(*) AS c FROM split WHERE split = 'train' AND label IS NOT NULL
      GROUP BY ALL),
    maj AS (
      SELECT dataset, run_id, label AS majority_baseline FROM (
        SELECT *, row_number() OVER (PARTITION BY dataset, run_id ORDER BY c DESC, label ASC) AS rn FROM train_lc)
      WHERE rn = 1),
    results AS (
      SELECT s.*, {sql_sim_prediction()} AS prediction,
             CAST({sql_hash("42", "claim_id")} % 2 AS INTEGER) AS random_baseline, m.majority_baseline
      FROM split s LEFT JOIN maj m USING (dataset, run_id) WHERE s.split = 'test')"""]


def sql_structured_answer(pred: str = "p", seed: str = "seed", key: str = "claim_id") -> str:
    lvl = f"(['High', 'Medium', 'Low'][{sql_hash(sql_str('conf'), seed, key)} % 3 + 1])"
    return (f"(CASE WHEN {pred} = 1 THEN 'Classification: True' || chr(10) || 'Confidence: ' || {lvl} || chr(10) "
            f"|| 'Justification: based on the claim text.' "
            f"WHEN {pred} = 0 THEN 'Classification: False' || chr(10) || 'Confidence: ' || {lvl} || chr(10) "
            f"|| 'Justification: based on the claim text.' "
            f"ELSE 'I cannot determine this from the information given.' END)")


def sql_lenient(a: str) -> str:
    o = f"lower({sql_strip(a)})"
    return (f"(CASE WHEN contains({o}, 'true') AND NOT contains({o}, 'false') THEN 1 "
            f"WHEN contains({o}, 'false') AND NOT contains({o}, 'true') THEN 0 "
            f"WHEN starts_with({o}, 'true') THEN 1 WHEN starts_with({o}, 'false') THEN 0 END)")


def sql_first_line(a: str, prefix: str, needles) -> str:
    cond = " OR ".join(f"contains(x, {sql_str(n)})" for n in needles)
    return (f"(list_filter(list_transform(string_split({a}, chr(10)), lambda x: lower({sql_strip('x')})), "
            f"lambda x: starts_with(x, {sql_str(prefix)}) AND ({cond}))[1])")


def sql_structured(a: str) -> str:
    low = f"lower({a})"
    line = sql_first_line(a, "classification:", ["true", "false"])
    return (f"(CASE WHEN contains({low}, 'classification: true') THEN 1 "
            f"WHEN contains({low}, 'classification: false') THEN 0 "
            f"WHEN {line} IS NOT NULL THEN (CASE WHEN contains({line}, 'true') THEN 1 ELSE 0 END) "
            f"WHEN contains({low}, 'true') AND NOT contains({low}, 'false') THEN 1 "
            f"WHEN contains({low}, 'false') AND NOT contains({low}, 'true') THEN 0 END)")


def sql_confidence(a: str) -> str:
    low = f"lower({a})"
    line = sql_first_line(a, "confidence:", K.CONFIDENCE_LEVELS)
    first = " ".join(f"WHEN contains({low}, 'confidence: {lv}') THEN '{lv.title()}'" for lv in K.CONFIDENCE_LEVELS)
    inner = " ".join(f"WHEN contains({line}, '{lv}') THEN '{lv.title()}'" for lv in K.CONFIDENCE_LEVELS)
    return f"(CASE {first} WHEN {line} IS NOT NULL THEN (CASE {inner} END) ELSE 'Unknown' END)"


def sql_full_results(domain: str = "lang", keywords=None) -> list[str]:
    """v1 frame: every claim x run, parsed structured answers and baselines."""
    from .queries_rules import TEST_SUSPICIOUS
    kw = keywords if keywords is not None else TEST_SUSPICIOUS
    from .registry import sql_contains_any
    return [sql_clean_claims(domain), sql_runs(), f"""
    fan AS (SELECT c.*, r.run_id, r.seed, {sql_sim_prediction()} AS p FROM clean c CROSS JOIN runs r),
    fan2 AS (SELECT * EXCLUDE (p), {sql_structured_answer()} AS answer FROM fan),
    maj_all AS (
      SELECT dataset, label AS majority_baseline FROM (
        SELECT dataset, label, row_number() OVER (PARTITION BY dataset ORDER BY count(*) DESC, label ASC) AS rn
        FROM clean WHERE label IS NOT NULL GROUP BY dataset, label) WHERE rn = 1),
    full_results AS (
      SELECT f.*, {sql_structured('answer')} AS prediction, {sql_confidence('answer')} AS confidence,
             answer AS reasoning, CAST({sql_hash('seed', 'claim_id')} % 2 AS INTEGER) AS random_baseline,
             CASE WHEN {sql_contains_any('lower(claim)', kw)} THEN 0 ELSE 1 END AS keyword_baseline,
             m.majority_baseline
      FROM fan2 f LEFT JOIN maj_all m USING (dataset))"""]


def sql_long(src: str, conditions: dict, name: str = "long", baselines_once: bool = True) -> str:
    parts = []
    for col, cond in conditions.items():
        where = "" if (cond == K.MODEL_CONDITION or not baselines_once) else " WHERE run_id = 0"
        parts.append(f"SELECT dataset, run_id, claim_id, domain, label, '{cond}' AS condition, "
                     f"CAST({col} AS INTEGER) AS pred FROM {src}{where}")
    return f"\n    {name} AS (" + " UNION ALL ".join(parts) + ")"


COUNT_SQL = ("count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE label = 0 AND pred = 1) "
             "AS fp, count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn, "
             "count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp, count(*) AS n_samples")


def sql_counts(src: str = "long", name: str = "counts", keys=("dataset", "condition", "run_id"),
               per_domain: bool = True) -> str:
    k = ", ".join(keys)
    if not per_domain:
        return f"""
    {name} AS (
      SELECT {k}, {COUNT_SQL} FROM {src} WHERE label IS NOT NULL AND pred IS NOT NULL GROUP BY {k})"""
    return f"""
    {name}_raw AS (
      SELECT {k}, domain, CASE WHEN grouping(domain) = 1 THEN 'overall' ELSE 'domain' END AS level, {COUNT_SQL}
      FROM {src} WHERE label IS NOT NULL AND pred IS NOT NULL
      GROUP BY GROUPING SETS (({k}), ({k}, domain))),
    {name} AS (SELECT * FROM {name}_raw WHERE level = 'overall' OR domain IS NOT NULL)"""


def metric_exprs() -> dict[str, str]:
    n = "(dtn + dfp + dfn + dtp)"

    def d0(a, b):
        return f"coalesce(({a}) / nullif({b}, 0), 0.0)"

    p1, r1, f1 = d0("dtp", "dtp + dfp"), d0("dtp", "dtp + dfn"), d0("2 * dtp", "2 * dtp + dfp + dfn")
    p0, r0, f0 = d0("dtn", "dtn + dfn"), d0("dtn", "dtn + dfp"), d0("2 * dtn", "2 * dtn + dfn + dfp")
    has1 = "(CASE WHEN dtp + dfn + dfp > 0 THEN 1.0 ELSE 0.0 END)"
    has0 = "(CASE WHEN dtn + dfp + dfn > 0 THEN 1.0 ELSE 0.0 END)"
    k = f"({has0} + {has1})"
    pe = f"(((dtn + dfp) * (dtn + dfn) + (dfn + dtp) * (dfp + dtp)) / ({n} * {n}))"
    acc = f"((dtp + dtn) / {n})"
    mden = "sqrt((dtp + dfp) * (dtp + dfn) * (dtn + dfp) * (dtn + dfn))"
    s0, s1 = "(dtn + dfp)", "(dtp + dfn)"
    return {
        "n_present": f"CAST({k} AS INTEGER)",
        "accuracy": acc,
        "precision": f"(({p0}) * {has0} + ({p1}) * {has1}) / {k}",
        "recall": f"(({r0}) * {has0} + ({r1}) * {has1}) / {k}",
        "f1_score": f"(({f0}) * {has0} + ({f1}) * {has1}) / {k}",
        "cohen_kappa": f"({acc} - {pe}) / nullif(1 - {pe}, 0)",
        "mcc": f"CASE WHEN {mden} = 0 THEN 0.0 ELSE (dtp * dtn - dfp * dfn) / {mden} END",
        "precision_false": p0, "recall_false": r0, "f1_false": f0,
        "precision_true": p1, "recall_true": r1, "f1_true": f1,
        "macro_f1": f"(({f0}) * {has0} + ({f1}) * {has1}) / {k}",
        "weighted_f1": f"({s0} * {f0} + {s1} * {f1}) / {n}",
        "weighted_precision": f"({s0} * {p0} + {s1} * {p1}) / {n}",
        "weighted_recall": f"({s0} * {r0} + {s1} * {r1}) / {n}",
    }


def sql_metrics(src: str = "counts", name: str = "met") -> str:
    cols = ", ".join(f"{e} AS {k}" for k, e in metric_exprs().items())
    return f"""
    {name} AS (
      SELECT * EXCLUDE (dtn, dfp, dfn, dtp), {cols}
      FROM (SELECT *, CAST(tn AS DOUBLE) AS dtn, CAST(fp AS DOUBLE) AS dfp, CAST(fn AS DOUBLE) AS dfn,
                   CAST(tp AS DOUBLE) AS dtp FROM {src}))"""


def r6(col: str) -> str:
    return f"round({col}, 6) AS {col}"


def rnd(cols) -> str:
    return ", ".join(r6(c) for c in cols)


__all__ = ["sql_clean_claims", "sql_split_results", "sql_full_results", "sql_long", "sql_counts", "sql_metrics",
           "sql_lenient", "sql_structured", "sql_confidence", "sql_strip", "sql_sim_prediction", "sql_list",
           "rnd", "metric_exprs"]
