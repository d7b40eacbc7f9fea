"""JSONL posts.

A directory of ``<user>.jsonl`` files is read as text lines with the file name
as lineage. Each line is parsed once into a VARIANT; lines that are not JSON,
or JSON that is not an object, are kept apart for the bad-line report instead
of failing the job. Fields are read from the variant with ``try_variant_get``,
so a field of the wrong JSON type becomes null rather than an error (a string
``langs`` is then rejected by the language filter, as in the studied scripts).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Post fields and their Spark types, in file order.
POST_FIELDS = [
    ("post_id", "bigint"), ("user_id", "bigint"), ("instance", "string"), ("date", "bigint"),
    ("text", "string"), ("langs", "array<string>"), ("like_count", "bigint"), ("reply_count", "bigint"),
    ("repost_count", "bigint"), ("reply_to", "bigint"), ("replied_author", "bigint"), ("thread_root", "bigint"),
    ("thread_root_author", "bigint"), ("repost_from", "bigint"), ("reposted_author", "bigint"),
    ("quotes", "bigint"), ("quoted_author", "bigint"), ("labels", "array<string>"), ("sent_label", "int"),
    ("sent_score", "double"),
]
_TYPES = dict(POST_FIELDS)

OK = "ok"
INVALID_JSON = "invalid_json"
NOT_OBJECT = "not_object"


def read_lines(spark: SparkSession, folder: str, suffix: str = ".jsonl") -> DataFrame:
    """(filename, value): every line of every file whose name ends with ``suffix``.
    Many small files are packed into few tasks by the file-source planner
    (``spark.sql.files.openCostInBytes``)."""
    return (spark.read.option("pathGlobFilter", f"*{suffix}").text(folder)
            .select(F.col("_metadata.file_name").alias("filename"), F.col("value")))


def classify_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``json`` (variant) and ``line_status``: ok / invalid_json / not_object."""
    v = F.try_parse_json(F.col(value))
    status = (F.when(F.col("json").isNull(), F.lit(INVALID_JSON))
              .when(F.schema_of_variant(F.col("json")).startswith("OBJECT"), F.lit(OK))
              .otherwise(F.lit(NOT_OBJECT)))
    return lines.withColumn("json", v).withColumn("line_status", status)


def post_field(name: str, type_name: str | None = None):
    """Field get with a null default (P1); wrong JSON types give null."""
    return F.try_variant_get(F.col("json"), f"$.{name}", type_name or _TYPES.get(name, "string"))


def parse_posts(lines: DataFrame, fields=("post_id", "text", "langs"), keep_filename: bool = True) -> DataFrame:
    """Valid post rows with the requested fields. ``langs`` defaults to an empty
    list when missing (P1)."""
    parsed = classify_lines(lines).where(F.col("line_status") == OK)
    cols = [F.col("filename")] if keep_filename else []
    for name in fields:
        c = post_field(name)
        if name == "langs":
            c = F.when(F.variant_get(F.col("json"), "$.langs", "variant").isNull(),
                       F.array().cast("array<string>")).otherwise(c)
        cols.append(c.alias(name))
    return parsed.select(*cols)


def drop_repeats(parsed: DataFrame, key: str = "post_id") -> DataFrame:
    """Of posts with one id the first stays (by file name, then the other
    columns); posts without an id all stay."""
    rest = [c for c in parsed.columns if c != key]
    order = ["filename", *[c for c in rest if c != "filename"]] if "filename" in rest else rest
    first = (parsed.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order)).alias("__first"))
             .select(key, *[F.col(f"__first.{c}").alias(c) for c in rest]))
    return first.unionByName(parsed.where(F.col(key).isNull())).select(*parsed.columns)


def lines_and_posts(lines: DataFrame, fields=("post_id", "text", "langs")) -> DataFrame:
    """(filename, line_status, fields...) of every line, bad ones with null
    fields: one parse for reports and posts alike."""
    classified = classify_lines(lines)
    good = F.col("line_status") == OK
    cols = []
    for name in fields:
        c = post_field(name)
        if name == "langs":
            c = F.when(F.variant_get(F.col("json"), "$.langs", "variant").isNull(), F.array().cast("array<string>")).otherwise(c)
        cols.append(F.when(good, c).alias(name))
    return classified.select("filename", "line_status", *cols)


def bad_line_report(lines: DataFrame) -> DataFrame:
    """(filename, reason, n_lines) for skipped lines (S2). Invalid JSON (blank
    lines included) and valid JSON that is not an object are reported apart."""
    return (classify_lines(lines).where(F.col("line_status") != OK)
            .groupBy("filename", F.col("line_status").alias("reason"))
            .agg(F.count(F.lit(1)).alias("n_lines")))


def read_posts(spark: SparkSession, folder: str, fields=("post_id", "text", "langs")) -> DataFrame:
    """S1 + S3: the folder's posts with file lineage."""
    return parse_posts(read_lines(spark, folder), fields)
