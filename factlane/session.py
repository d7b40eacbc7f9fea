"""Session and lineage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "factlane") -> SparkSession:
    """A local session for tests and the benchmark. On a cluster, build the
    session the usual way; nothing in the library depends on these settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder. The cluster names it in
    ``spark.checkpoint.dir``. Only in a local session (one machine) that sets
    nothing a fresh scratch folder is used; on a cluster each executor would
    write to its own disk, so that is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="factlane-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame, name: str = "stage", large_rows: bool = False) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and
    return a frame that reads it back. One execution (an RDD checkpoint would
    compute the input twice), a columnar copy whose size the planner knows,
    and a lost executor recomputes nothing before this point (used after the
    batch-scoring step, which may call an expensive model, and for tables
    several later steps read). ``large_rows``: rows of megabytes are a row group
    each, else a task would hold up to 100 of them when it writes or reads, and
    they go to Python in ``small_batches``."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    with small_batches(spark, row_a_group=True) if large_rows else nullcontext():
        df.write.mode("error").parquet(path)
    return spark.read.parquet(path)


#: Bytes after which an Arrow batch of large rows is sent.
BATCH_BYTES = 8 << 20


@contextmanager
def small_batches(spark: SparkSession, row_a_group: bool = False):
    """Jobs started inside send rows of megabytes to Python about one at a time.
    A batch is held several times over (vectors, stream, worker), for each core, so
    Spark's 64 MB would cost an executor gigabytes. ``row_a_group``: they also write
    Parquet with a row group a row (it looks at a group's size only after 100 rows)."""
    batch, rows = "spark.sql.execution.arrow.maxBytesPerBatch", "parquet.block.row.count.limit"
    before = {batch: spark.conf.get(batch), rows: spark.conf.get(rows, None)}
    if not 0 < _byte_count(before[batch]) <= BATCH_BYTES:
        spark.conf.set(batch, str(BATCH_BYTES))
    if row_a_group:
        spark.conf.set(rows, "1")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _byte_count(text: str) -> int:
    """Spark's size strings as a number of bytes."""
    number = text.lower().rstrip("bkmgtp")
    return int(number) << 10 * "bkmgtp".find((text.lower()[len(number):] or "b")[0])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table inside the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", name)


#: Tables of at most this many rows are broadcast by ``join_small``.
SMALL_ROWS = 100_000


def join_small(df: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", limit: int = SMALL_ROWS) -> DataFrame:
    """Join a per-group table (one row per key) to many rows. The table is
    written first and its rows are counted: up to ``limit`` it is broadcast, so
    ``df`` is not shuffled by a few hot keys; beyond, the keys are many and the
    join is left to Spark (adaptive skew handling splits hot ones)."""
    small = cut_lineage(small, "small")
    return df.join(F.broadcast(small) if small.count() <= limit else small, keys, how)
