"""Result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import col_of, timestamp_tag


def escape_lines(c) -> "F.Column":
    """One physical line per value: backslash, CR and LF are escaped."""
    c = col_of(c)
    c = F.regexp_replace(c, r"\\", r"\\\\")
    c = F.regexp_replace(c, "\r", r"\\r")
    return F.regexp_replace(c, "\n", r"\\n")


def write_claim_lines(df: DataFrame, path: str, text: str = "text", mode: str = "overwrite") -> None:
    """Claims as a text file, one claim per line."""
    df.select(escape_lines(text).alias("value")).write.mode(mode).text(path)


def write_partitioned(df: DataFrame, path: str, keys=("dataset", "run_id"), fmt: str = "parquet",
                      mode: str = "overwrite") -> None:
    """One directory per dataset and run (prunable on read). No shuffle by
    the keys (a hot dataset would land in one task): each task sorts its rows by
    the keys and writes at most one file per key it holds."""
    keys = list(keys)
    writer = df.sortWithinPartitions(*keys).write.mode(mode).partitionBy(*keys)
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)


def write_named_lines(df: DataFrame, folder: str, name: str = "filename", value: str = "value") -> None:
    """Lines as text files in one folder, ``<stem>-<part><suffix>`` for a file name
    ``<stem><suffix>`` in ``name``: a file per name and task, so a hot name is not one
    task's. The files are renamed in place by the folder's own file system."""
    spark = df.sparkSession
    staging = f"{folder}/_staging"
    df.select(F.col(value).alias("value"), F.col(name).alias("__name")).sortWithinPartitions("__name").write.mode("overwrite").partitionBy("__name").text(staging)
    jvm = spark._jvm
    path_of = jvm.org.apache.hadoop.fs.Path
    files = path_of(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for k, (held,) in enumerate(sorted(tuple(r) for r in spark.read.text(staging).select("_metadata.file_path").distinct().collect())):
        parent = held.rsplit("/", 2)[-2].split("=", 1)[1]
        stem, dot, suffix = parent.partition(".")
        files.rename(path_of(held), path_of(f"{folder}/{stem}-{k:05d}{dot}{suffix}"))
    files.delete(path_of(staging), True)


def stamped(prefix: str, timestamp: str) -> str:
    """Output name with a ``yyyyMMdd_HHmmss`` stamp passed in by the caller."""
    return f"{prefix}_{timestamp}"


def write_run(df: DataFrame, folder: str, name: str, keys=("dataset", "run_id"), tag: str | None = None) -> str:
    """S8 + F19: a run's results under ``<folder>/<name>_<time tag>``, partitioned by
    ``keys``, and, once they are committed, its manifest: (name, tag, file, keys...,
    n_rows) for every data file, appended to ``<folder>/manifest``. A run without a
    manifest did not end. Returns the tag."""
    spark = df.sparkSession
    if tag is None:
        tag = spark.range(1).select(timestamp_tag().alias("t")).first()["t"]
    path = f"{folder}/{stamped(name, tag)}"
    write_partitioned(df, path, keys, mode="error")
    files = spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("file"), *keys).agg(F.count("*").alias("n_rows"))
    files.select(F.lit(name).alias("name"), F.lit(tag).alias("tag"), "file", *keys, "n_rows").write.mode("append").parquet(f"{folder}/manifest")
    return tag


def read_run(spark, folder: str, name: str, tag: str | None = None) -> DataFrame:
    """The results of a run that ended (the latest by default), checked against its
    manifest: a lost or foreign file is an error."""
    listed = spark.read.parquet(f"{folder}/manifest").where(F.col("name") == name)
    tag = tag or listed.agg(F.max("tag").alias("t")).first()["t"]
    rows = spark.read.parquet(f"{folder}/{stamped(name, tag)}")
    found = rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("found"))
    wrong = listed.where(F.col("tag") == tag).groupBy("file").agg(F.sum("n_rows").alias("n_rows")).join(found, "file", "full").where(~F.col("n_rows").eqNullSafe(F.col("found"))).first()
    if wrong is not None:
        raise ValueError(f"{stamped(name, tag)}: file {wrong['file']} has {wrong['found']} rows, the manifest says {wrong['n_rows']}")
    return rows
