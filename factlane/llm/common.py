"""Shared pieces of the training-data operators.

A word is a maximal run of characters other than space and ``\\t``-``\\r``
(``[^\\x20\\x09-\\x0D]+``). Python's ``bytes.split()`` splits on exactly these
six bytes, so ``text.encode().split()`` in a task and ``words(col)`` in the JVM
give the same words.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\f\r"
GAP_BYTES = re.compile(rb"[\x20\x09-\x0D]")
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text as an array; null text gives an empty array. The gap
    characters become spaces by byte-level replaces, which is cheaper than
    splitting by a pattern."""
    text = F.coalesce(text, F.lit(""))
    for c in GAP_CHARS[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.filter(F.split(text, " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words as a bigint: gaps between words are single spaces after
    the replacement, so counting them needs no array."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WORD_GAP, " "))
    return F.when(flat == "", F.lit(0)).otherwise(
        F.length(flat) - F.length(F.translate(flat, " ", "")) + 1).cast("bigint")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z only (``lower`` would change other letters as well)."""
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


# --- Arrow batches of texts ---------------------------------------------------

BATCH_BYTES = 8 << 20


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column: text i is
    ``bytes[offsets[i]:offsets[i + 1]]``; a null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1 + column.offset)[column.offset:] if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and n else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def sliced(batches, text: str = "text", limit: int = BATCH_BYTES):
    """Arrow batches cut so that each holds about ``limit`` bytes of text (one
    longer text makes a batch of its own)."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths, dtype=np.int64) // limit
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def word_chunks(raw: bytes, size: int = 1 << 20):
    """Words of a text, about ``size`` bytes at a time: a very long text never
    stands as one list of words. An empty text gives one empty list."""
    at = 0
    while True:
        end = len(raw)
        if end - at > size:
            gap = GAP_BYTES.search(raw, at + size)
            end = gap.start() if gap else end
        yield raw[at:end].split()
        if end == len(raw):
            return
        at = end


def map_texts(df: DataFrame, fn, schema: str, limit: int = BATCH_BYTES) -> DataFrame:
    """``mapInArrow`` over size-bounded batches: ``fn(batch) -> RecordBatch``
    or an iterator of them. JVM-side batches are bounded by bytes as well, so
    that long texts do not pile up."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 * BATCH_BYTES))

    def run(batches):
        for batch in sliced(batches, limit=limit):
            out = fn(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return df.mapInArrow(run, schema)
