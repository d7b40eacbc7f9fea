"""Headered CSV with quoted multi-line text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import CSV_NULL_TOKENS
from ..session import cut_lineage

# Columns of an evaluation master set.
EVAL_SCHEMA = "claim string, label int, domain string"
REQUIRED_EVAL_COLUMNS = ["claim", "label", "domain"]


def normalise_nulls(df: DataFrame, tokens=CSV_NULL_TOKENS) -> DataFrame:
    """String cells holding a missing-value token (``NA``, ``nan``, empty, ...)
    become null, as the pandas reader does."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            cols.append(F.when(F.col(f.name).isin(list(tokens)), F.lit(None).cast("string"))
                        .otherwise(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None,
             null_tokens=CSV_NULL_TOKENS) -> DataFrame:
    """S4. Give ``schema`` on large inputs: inference costs a full extra pass."""
    reader = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
              .option("mode", "PERMISSIVE"))
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    return normalise_nulls(df, null_tokens) if null_tokens else df


CORRUPT = "_corrupt_record"


def read_csv_checked(spark: SparkSession, path: str, schema: str, null_tokens=CSV_NULL_TOKENS, multi_line: bool = True) -> DataFrame:
    """All rows of headered CSV files under ``schema``, with ``file_name`` and
    ``reject_reason``: null for a good row; ``bad_value`` when a cell is not of its
    type, or the row has too few or too many cells. Good cells of a rejected row are kept.
    ``multi_line=False`` lets large files be split (texts without line ends). The
    text is parsed once, with all its columns, and kept in the shared folder: under
    column pruning the reader would not see a bad cell in an unused column."""
    kind = T.StructType.fromDDL(schema)
    full = T.StructType([*kind.fields, T.StructField(CORRUPT, T.StringType())])
    raw = (spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", CORRUPT).schema(full).csv(path))
    rows = raw.select(*[F.col(f.name) for f in kind.fields], F.col("_metadata.file_name").alias("file_name"),
                      F.when(F.col(CORRUPT).isNotNull(), F.lit("bad_value")).alias("reject_reason"))
    return cut_lineage(normalise_nulls(rows, null_tokens) if null_tokens else rows, "csv-rows")


def rejected_rows(checked: DataFrame) -> DataFrame:
    """(file_name, reject_reason, n) of the rows that ``read_csv_checked`` rejects."""
    return checked.where(F.col("reject_reason").isNotNull()).groupBy("file_name", "reject_reason").agg(F.count("*").alias("n"))


def column_report(spark: SparkSession, paths: dict[str, str], required=REQUIRED_EVAL_COLUMNS) -> DataFrame:
    """S5 for many inputs: (input, missing, available, complete). Only headers are read."""
    rows = []
    for name, path in sorted(paths.items()):
        columns = spark.read.option("header", True).csv(path).columns
        missing = [c for c in required if c not in columns]
        rows.append((name, ",".join(missing), ",".join(columns), not missing))
    return spark.createDataFrame(rows, "input string, missing string, available string, complete boolean")


def require_columns(df: DataFrame, required=REQUIRED_EVAL_COLUMNS, name: str = "input") -> DataFrame:
    """Stop with the missing and the available columns named."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{name} missing columns: {missing}; available columns: {list(df.columns)}")
    return df


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Headered CSV, quotes escaped by doubling, no index column."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
