"""The extraction chain on Structured Streaming.

New ``*.jsonl`` files dropped into a post directory are read as text lines,
parsed (bad lines split off), filtered to in-language claim-like posts and
tagged with a domain: the same Column rules as the batch chain, all stateless,
so each micro-batch is independent. Sinks keep their progress in a checkpoint
location inside the shared checkpoint folder, so a restarted query (or a lost
executor) neither drops nor repeats a file.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import AUX_VERBS, DOMAIN_KEYWORDS, ENGLISH_CODE, HEDGE_PHRASES
from ..operators import claims as C
from ..session import ensure_checkpoint_dir
from ..sources import posts


def post_line_stream(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """(filename, value) of every line of new ``*.jsonl`` files in ``folder``."""
    reader = spark.readStream.format("text").option("pathGlobFilter", "*.jsonl")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(folder).select(F.col("_metadata.file_name").alias("filename"), F.col("value"))


def claim_stream(spark: SparkSession, folder: str, code: str = ENGLISH_CODE, phrases=HEDGE_PHRASES,
                 verbs=AUX_VERBS, domains=DOMAIN_KEYWORDS, keep_untagged: bool = True) -> DataFrame:
    """Streaming frame of (filename, post_id, text, langs, domain)."""
    parsed = posts.parse_posts(post_line_stream(spark, folder))
    found = C.extract_claims(parsed, code=code, phrases=phrases, verbs=verbs)
    return C.tag_domains(found, domains=domains, keep_untagged=keep_untagged)


def bad_line_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Streaming frame of skipped lines with their reason."""
    lines = posts.classify_lines(post_line_stream(spark, folder))
    return lines.where(F.col("line_status") != posts.OK).select("filename", F.col("line_status").alias("reason"),
                                                                "value")


def _checkpoint_location(spark: SparkSession, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "streams", name)


def write_claims(stream: DataFrame, path: str, name: str | None = None, available_now: bool = True):
    """Append tagged claims as Parquet (exactly once per file through the
    checkpoint). The progress is kept under ``name``, by default one of the output
    path's own, so two streams never share it. Returns the started query."""
    spark = stream.sparkSession
    name = name or f"claims-{hashlib.md5(path.encode()).hexdigest()[:16]}"
    writer = (stream.writeStream.format("parquet").option("path", path)
              .option("checkpointLocation", _checkpoint_location(spark, name)).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def domain_counts(stream: DataFrame) -> DataFrame:
    """Running claims per domain (a streaming aggregate; state = one row per domain)."""
    return stream.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
