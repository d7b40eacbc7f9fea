"""The extraction chain as one job: a directory of posts -> claim-like posts
in the language -> domain tags -> (optionally) verifiability labels -> tables.

Each hand-over file of the studied scripts becomes a column or a table in the
same plan; the only materialisations are the outputs and the scored answers
(kept so a retried stage never calls the model twice).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import claims as C
from ..operators.parsing import verifiable_answer, verifiable_class
from ..operators.prompts import verifiability_prompt
from ..operators.scoring import Scorer, score_batches
from ..session import cut_lineage
from ..sources import posts, sinks
from ..sources.csvio import write_csv


def tagged_claims(spark: SparkSession, folder: str, code: str = K.ENGLISH_CODE, phrases=K.HEDGE_PHRASES,
                  verbs=K.AUX_VERBS, domains=K.DOMAIN_KEYWORDS, keep_untagged: bool = False, dedup: bool = False) -> DataFrame:
    """(filename, post_id, text, domain) of the folder's claims; ``dedup`` keeps
    one post of each id."""
    read = posts.read_posts(spark, folder, ("post_id", "text", "langs"))
    return claims_of_posts(posts.drop_repeats(read) if dedup else read, code, phrases, verbs, domains, keep_untagged)


def claims_of_posts(read: DataFrame, code: str = K.ENGLISH_CODE, phrases=K.HEDGE_PHRASES, verbs=K.AUX_VERBS,
                    domains=K.DOMAIN_KEYWORDS, keep_untagged: bool = False) -> DataFrame:
    found = C.extract_claims(read, code=code, phrases=phrases, verbs=verbs)
    return C.tag_domains(found, domains=domains, keep_untagged=keep_untagged).select(
        "filename", "post_id", "text", "domain")


def label_verifiability(claims: DataFrame, make_scorer: Callable[[], Scorer], text: str = "text",
                        retries: int = K.VERIFY_RETRIES) -> DataFrame:
    """Adds ``verifiable_label`` (stripped answer, "Error" after failed
    retries) and ``verifiable_class`` (normalised)."""
    prompted = claims.withColumn("prompt", verifiability_prompt(text))
    scored = cut_lineage(score_batches(prompted, make_scorer, seed="__none__", retries=retries,
                                       sentinel=K.ERROR_LABEL), "verifiability")
    return scored.select(*claims.columns, verifiable_answer("answer").alias("verifiable_label"),
                         verifiable_class("answer").alias("verifiable_class"))


def run_extraction(spark: SparkSession, folder: str, out_dir: str, make_scorer: Callable[[], Scorer] | None = None,
                   dedup: bool = False, **rules) -> dict[str, str]:
    """Write the chain's tables under ``out_dir``: ``funnel`` (stage counts),
    ``bad_lines``, ``claims`` (CSV with lineage and domain), ``claim_lines``
    (one escaped claim per line), ``domain_counts``, and ``verifiable`` when a
    scorer is given. Returns the paths. The folder is read and parsed once."""
    lines = cut_lineage(posts.lines_and_posts(posts.read_lines(spark, folder)), "post-lines")
    parsed = lines.where(F.col("line_status") == posts.OK).drop("line_status")
    parsed = posts.drop_repeats(parsed) if dedup else parsed
    paths = {name: f"{out_dir}/{name}" for name in
             ("funnel", "bad_lines", "claims", "claim_lines", "domain_counts", "verifiable")}
    funnel_args = {k: v for k, v in rules.items() if k in ("code", "phrases", "verbs")}
    C.claim_funnel(parsed, **funnel_args).write.mode("overwrite").parquet(paths["funnel"])
    bad = lines.where(F.col("line_status") != posts.OK).groupBy("filename", F.col("line_status").alias("reason"))
    bad.agg(F.count(F.lit(1)).alias("n_lines")).write.mode("overwrite").parquet(paths["bad_lines"])
    # the tagged claims are written once as Parquet; all later outputs read that
    claims = cut_lineage(claims_of_posts(parsed, **rules), "claims")
    write_csv(claims, paths["claims"])
    sinks.write_claim_lines(claims, paths["claim_lines"])
    C.value_counts(claims, "domain").write.mode("overwrite").parquet(paths["domain_counts"])
    if make_scorer is not None:
        label_verifiability(claims, make_scorer).write.mode("overwrite").parquet(paths["verifiable"])
    else:
        paths.pop("verifiable")
    return paths
