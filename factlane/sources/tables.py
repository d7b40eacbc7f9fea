"""The driver's parquet tables and the views the queries build on them.

``evaluation_claims`` is the evaluation set: documents joined with their
quality labels; ``claim_id`` = doc_id, ``claim`` = text, ``label`` = quality,
``domain`` = a document attribute, ``dataset`` = UGC for even ids, else NGC.
``post_lines`` turns tables into a directory-like set of JSONL lines so the
post reader runs on data that grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Two-letter document language -> three-letter post language code (ISO 639).
LANG_ISO3 = {"en": "eng", "fr": "fra", "de": "deu", "es": "spa"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dataset_of(doc_id) -> "F.Column":
    return F.when(F.col(doc_id) % 2 == 0, F.lit("UGC")).otherwise(F.lit("NGC"))


def evaluation_claims(spark: SparkSession, sf_dir: str, domain: str = "lang") -> DataFrame:
    """(dataset, claim_id, claim, domain, label). The label join is an equi-join
    on doc_id; Spark broadcasts the label side only when its measured size is
    under the broadcast threshold and sort-merges otherwise."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", F.col(domain).alias("domain"))
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id").select(
        dataset_of("doc_id").alias("dataset"),
        F.col("doc_id").alias("claim_id"),
        F.col("text").alias("claim"),
        F.col("domain"),
        F.col("quality").cast("int").alias("label"),
    )


def document_posts(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    """Documents as posts: (filename, post_id, text, langs) with one-element
    ``langs`` holding the two-letter code. ``lang`` keeps only that language
    with a predicate on the stored column, which reaches the Parquet scan
    (row-group / partition pruning); the language rule still runs on ``langs``."""
    docs = load(spark, sf_dir, "documents")
    if lang is not None:
        docs = docs.where(F.col("lang") == lang)
    return docs.select(
        F.concat(F.col("source"), F.lit(".jsonl")).alias("filename"),
        F.col("doc_id").alias("post_id"),
        F.col("text"),
        F.array(F.col("lang")).alias("langs"),
    )


def iso3(c) -> "F.Column":
    expr = None
    for two, three in LANG_ISO3.items():
        expr = F.when(c == two, three) if expr is None else expr.when(c == two, three)
    return expr.otherwise(c)


def post_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(filename, value) lines of a post directory derived from the tables:
    every document as a JSON post object in ``<source>.jsonl``, every line of
    every raw page in ``pages.jsonl`` (mostly not JSON), and every event's
    ``props`` in ``events.jsonl`` (JSON objects without post fields)."""
    docs = load(spark, sf_dir, "documents").select(
        F.concat(F.col("source"), F.lit(".jsonl")).alias("filename"),
        F.to_json(F.struct(
            F.col("doc_id").alias("post_id"),
            (F.col("doc_id") % 1000).alias("user_id"),
            F.lit("bsky.social").alias("instance"),
            F.col("text"),
            F.array(iso3(F.col("lang"))).alias("langs"),
        )).alias("value"))
    pages = load(spark, sf_dir, "pages").select(
        F.lit("pages.jsonl").alias("filename"),
        F.explode(F.split(F.col("html"), "\n")).alias("value"))
    events = load(spark, sf_dir, "events").select(F.lit("events.jsonl").alias("filename"),
                                                  F.col("props").alias("value"))
    return docs.unionByName(pages).unionByName(events)
