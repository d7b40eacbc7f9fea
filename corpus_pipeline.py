"""Corpus preparation over ``documents`` in five stages.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written to the shared folder and read again as
the next stage's ``docs``. All stages but the last return the columns of
``documents``; the last returns the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlane.llm.common import GAP_CHARS, read_table
from factlane.llm.decontaminate import decontaminate
from factlane.llm.jaccard_join import one_per_component
from factlane.llm.language_id import UNDETERMINED, fit, predict
from factlane.llm.source_mix import mix_sources
from factlane.llm.suffix_dedup import Width, remove_repeated_strings
from factlane.session import cut_lineage

#: Passages of 50 words have 270 bytes or more in such corpora; strings of this
#: width inside them must not repeat.
REPEAT_WIDTH = Width(200, 75, 50)
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose language is less sure than this are rejected.
MIN_LANGUAGE_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a determinable language: null text, no letter,
    or no language of at least ``MIN_LANGUAGE_SCORE``."""
    docs = docs.select(*COLUMNS)
    langs, net = fit(docs)
    found = predict(docs, langs, net, COLUMNS, ("__lang", "__score"))
    return found.where((F.col("__lang") != UNDETERMINED) & (F.col("__score") >= MIN_LANGUAGE_SCORE)).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 4-shingle Jaccard similarity of
    0.85 or more, the document of the smallest id stays."""
    return one_per_component(docs.select(*COLUMNS), ("lang", "source", "n_chars")).select(*COLUMNS)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes every byte covered by a string of ``REPEAT_WIDTH`` bytes that starts
    twice (spans shrink to whole characters), in all its places. Documents left
    without a word go; a null text is empty and goes. Equal rows repeat each other."""
    found = remove_repeated_strings(docs.select(*COLUMNS), with_text=True, keep=("lang", "source"), width=REPEAT_WIDTH)
    return found.where(F.trim("kept", F.lit(GAP_CHARS)) != "").select(
        "doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("bigint").alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a verified benchmark item."""
    return decontaminate(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken): the mix of what is left."""
    return mix_sources(docs.select(*COLUMNS))


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("repeated_strings", repeated_strings),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

#: SQL cannot express the learned language stage; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
