"""Batch scoring (R4, R5, X3): the one step that runs Python on the executors.

``score_batches`` sends Arrow batches of prompts to a user-supplied scorer that is
built once per task. Batches are bounded by rows and by bytes of prompt, so
whole documents as prompts don't pile up in a worker. Rows that fail are tried again up to
``retries`` times, alone; rows that still fail get the ``sentinel`` (null for truth
answers, "Error" for verifiability). A failure is never silent: ``report`` adds
the number of attempts and the last error of every row.

Scoring is usually the expensive part (a model call per row). ``cut_lineage`` keeps
the answers of one job; ``score_stored`` keeps them in a table, part by part, and a
later run scores only the rows without an answer there.

The registered queries use deterministic stand-in scorers (no model server is
reachable here): their answers are a function of (seed, prompt), computed with
md5, so the same answers can be derived in SQL.
"""

from __future__ import annotations

import hashlib
from typing import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import hash_mod
from ..functions.text import col_of

# Scorer: (prompts: pd.Series[str], seeds: pd.Series[int]) -> pd.Series[str | None]
Scorer = Callable[[pd.Series, pd.Series], pd.Series]


#: Bytes of prompts in one call of the scorer.
BATCH_BYTES = 4 << 20


def _parts(prompts: pd.Series, max_rows: int, max_bytes: int) -> Iterator[slice]:
    """Consecutive rows of at most ``max_rows`` and about ``max_bytes`` (a longer
    prompt stands alone)."""
    begin, held = 0, 0
    for k, text in enumerate(prompts):
        size = len(text.encode()) if isinstance(text, str) else 0
        if k > begin and (k - begin >= max_rows or held + size > max_bytes):
            yield slice(begin, k)
            begin, held = k, 0
        held += size
    if len(prompts) > begin:
        yield slice(begin, len(prompts))


def _answers(scorer: Scorer, prompts: pd.Series, seeds: pd.Series, retries: int, sentinel: str | None) -> list[tuple]:
    """(answer, attempts, last error, failed) of each row. A scorer may return an
    exception in place of a row's answer, or raise for the whole batch; either way the
    failed rows are called again one by one. Scorers with ``counts_attempts`` are
    told the number of the attempt."""
    def call(p, s, attempt):
        extra = (attempt,) if getattr(scorer, "counts_attempts", False) else ()
        return list(scorer(p, s, *extra))

    try:
        first = call(prompts, seeds, 1)
    except Exception as error:
        first = [error] * len(prompts)
    out = []
    for k, answer in enumerate(first):
        attempts, error, failed = 1, None, False
        while isinstance(answer, Exception):
            error = f"{type(answer).__name__}: {answer}"
            if attempts > retries:
                answer, failed = sentinel, True
                break
            attempts += 1
            try:
                answer = call(prompts.iloc[k:k + 1], seeds.iloc[k:k + 1], attempts)[0]
            except Exception as again:
                answer = again
        out.append((answer if isinstance(answer, str) else None, attempts, error, failed))
    return out


def score_batches(df: DataFrame, make_scorer: Callable[[], Scorer], prompt: str = "prompt", seed: str = "seed",
                  out: str = "answer", retries: int = 1, sentinel: str | None = None, report: bool = False,
                  max_rows: int = 1000, max_bytes: int = BATCH_BYTES) -> DataFrame:
    """R4 + R5: ``df`` plus ``out`` (string); ``report`` adds ``attempts`` (int),
    ``error`` (string: the last error, also of rows that succeeded later) and
    ``failed`` (boolean: no attempt succeeded). ``make_scorer`` is called once per
    task on the executor (so clients and models are not pickled per row)."""
    added = [T.StructField(out, T.StringType(), True)]
    if report:
        added += [T.StructField("attempts", T.IntegerType(), True), T.StructField("error", T.StringType(), True), T.StructField("failed", T.BooleanType(), True)]
    # the JVM side cuts its batches by bytes as well
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 * max_bytes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for whole in batches:
            for rows in _parts(whole[prompt], max_rows, max_bytes):
                pdf = whole.iloc[rows].copy()
                seeds = pdf[seed] if seed in pdf.columns else pd.Series([0] * len(pdf), index=pdf.index)
                found = _answers(scorer, pdf[prompt], seeds, retries, sentinel)
                pdf[out] = pd.Series([a for a, *_ in found], index=pdf.index, dtype=object)
                if report:
                    pdf["attempts"] = [n for _, n, _, _ in found]
                    pdf["error"] = pd.Series([e for _, _, e, _ in found], index=pdf.index, dtype=object)
                    pdf["failed"] = [f for *_, f in found]
                yield pdf

    return df.mapInPandas(run, T.StructType(df.schema.fields + added))


def stored_answers(spark: SparkSession, path: str, keys=("dataset", "run_id", "claim_id")) -> DataFrame | None:
    """The latest row of each key in a table of ``score_stored``: an answered one if
    there is any. None without a table."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct((~F.col("failed")).alias("ok"), F.col("scored_at").alias("at")))
    return rows.groupBy(*keys).agg(best.alias("__r")).select(*keys, "__r.*")


def score_stored(df: DataFrame, path: str, make_scorer: Callable[[], Scorer], keys=("dataset", "run_id", "claim_id"),
                 parts: int = 1, retries: int = 1, **options) -> DataFrame:
    """Answers of all rows of ``df`` from the table at ``path``. Rows that have
    no answer there yet (left by an earlier run that ended early, or failed in
    it) are found by an anti-join and scored, in ``parts`` appends, so a run that is
    stopped loses one part at most. Returns the stored rows (keys, answer,
    attempts, error, failed, scored_at) of ``df``'s keys."""
    keys, spark = list(keys), df.sparkSession
    out = options.get("out", "answer")
    held = stored_answers(spark, path, keys)
    todo = df if held is None else df.join(held.where(~F.col("failed")).select(*keys), keys, "left_anti")
    for k in range(parts):
        part = todo.where(F.pmod(F.xxhash64(*keys), F.lit(parts)) == k) if parts > 1 else todo
        scored = score_batches(part, make_scorer, retries=retries, report=True, **options)
        scored.select(*keys, out, "attempts", "error", "failed", F.current_timestamp().alias("scored_at")).write.mode("append").parquet(path)
    return stored_answers(spark, path, keys).join(df.select(*keys), keys, "left_semi")


def attach_answers(rows: DataFrame, answers: DataFrame, keys=("dataset", "run_id", "claim_id"),
                   answer: str = "answer") -> DataFrame:
    """A model's answers, keyed by (dataset, run, claim), left-joined to the
    rows of every run; a row without an answer has null."""
    return rows.join(answers.select(*keys, answer), list(keys), "left")


def _md5_int(seed, prompt) -> int:
    text = f"{seed}|{'' if prompt is None else prompt}"
    return int(hashlib.md5(text.encode("utf-8")).hexdigest()[:8], 16)


class TemplateScorer:
    """Deterministic stand-in model: answer = templates[md5(seed|prompt) % n]."""

    def __init__(self, templates: list[str | None]):
        self.templates = list(templates)

    def __call__(self, prompts: pd.Series, seeds: pd.Series) -> pd.Series:
        n = len(self.templates)
        return pd.Series([self.templates[_md5_int(s, p) % n] for p, s in zip(prompts, seeds)],
                         index=prompts.index, dtype=object)


class FlakyVerifier:
    """Stand-in verifiability model that always fails for some prompts
    (md5 % fail_every == 0), to exercise the retry and the sentinel."""

    def __init__(self, answers: list[str], fail_every: int = 10):
        self.answers, self.fail_every = list(answers), fail_every

    def __call__(self, prompts: pd.Series, seeds: pd.Series) -> pd.Series:
        out = []
        for p, s in zip(prompts, seeds):
            h = _md5_int(s, p)
            if h % self.fail_every == 0:
                raise RuntimeError("model unavailable")
            out.append(self.answers[(h // self.fail_every) % len(self.answers)])
        return pd.Series(out, index=prompts.index, dtype=object)


class BusyModel:
    """Stand-in model that is busy for a prompt's first md5 % (``most`` + 1)
    attempts and then answers, to exercise retries that succeed and that don't."""

    counts_attempts = True

    def __init__(self, answers: list[str], most: int = 3):
        self.answers, self.most = list(answers), most

    def __call__(self, prompts: pd.Series, seeds: pd.Series, attempt: int) -> list:
        out = []
        for p, s in zip(prompts, seeds):
            h = _md5_int(s, p)
            busy = attempt <= h % (self.most + 1)
            out.append(RuntimeError("model busy") if busy else self.answers[(h // (self.most + 1)) % len(self.answers)])
        return out


# --- Column-side stand-ins (same hash family, no Python) ---------------------

def simulated_prediction(label="label", seed="seed", key="claim_id", correct_pct: int = 78,
                         answered_pct: int = 97) -> Column:
    """Stand-in model answer: the true label for ``correct_pct`` % of rows, the
    other label up to ``answered_pct`` %, no answer (null) for the rest."""
    h = hash_mod(100, col_of(seed), col_of(key))
    y = col_of(label).cast("int")
    return (F.when(h < correct_pct, y).when(h < answered_pct, F.lit(1) - y)
            .otherwise(F.lit(None).cast("int")))


def simulated_structured_answer(prediction="prediction", seed="seed", key="claim_id") -> Column:
    """Stand-in structured answer text for a predicted label (null -> an
    answer without a classification)."""
    level = F.element_at(F.array(F.lit("High"), F.lit("Medium"), F.lit("Low")),
                         (hash_mod(3, F.lit("conf"), col_of(seed), col_of(key)) + 1).cast("int"))
    p = col_of(prediction)
    cls = F.when(p == 1, F.lit("True")).when(p == 0, F.lit("False"))
    return F.when(cls.isNull(), F.lit("I cannot determine this from the information given.")).otherwise(
        F.concat(F.lit("Classification: "), cls, F.lit("\nConfidence: "), level,
                 F.lit("\nJustification: based on the claim text.")))
