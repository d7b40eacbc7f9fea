"""Numpy hashing of words and windows of whole batches of texts.

A word's hash is a polynomial over its bytes (through a random table), read off
running sums modulo 2**64 and then mixed; a window's hash is a polynomial over
its word hashes. All constants come from fixed seeds, so every task and every
rerun gives the same values.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

_RNG = np.random.default_rng(20240229)
BYTE_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
R_BYTE, R_WORD, R_WORD2 = (int(x) * 2 + 1 for x in _RNG.integers(2**40, 2**62, 3))
MASK = (1 << 64) - 1
GAP = np.zeros(256, bool)
GAP[[32, 9, 10, 11, 12, 13]] = True
CHUNK = 1 << 19
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(r: int, n: int, inverse: bool = False) -> np.ndarray:
    """r**0 .. r**(n-1) (or of its inverse) modulo 2**64, kept per process."""
    got = _POWERS.get((r, inverse))
    if got is None or len(got) < n:
        size = max(n, CHUNK)
        base = pow(r, -1, 1 << 64) if inverse else r
        got = np.ones(1, np.uint64)
        step = base & MASK
        while len(got) < size:
            got = np.concatenate([got, got * np.uint64(step)])
            step = step * step & MASK
        _POWERS[r, inverse] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def running(values: np.ndarray, r: int) -> np.ndarray:
    """Prefix sums of values[i] * r**i, with a leading zero."""
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * powers(r, len(values)), dtype=np.uint64, out=out[1:])
    return out


def window_hashes(values: np.ndarray, size: int, r: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive values, by its start."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p = running(values, r)
    return mix((p[size:] - p[:-size]) * powers(r, n, inverse=True))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte, words per text) of all words of a batch."""
    n_texts = len(offsets) - 1
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(n_texts, np.int64)
    solid = ~GAP[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    start[edges] = solid[edges]
    end = solid.copy()
    end[:-1] &= ~solid[1:]
    lasts = offsets[1:][np.diff(offsets) > 0] - 1
    end[lasts] = solid[lasts]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    out = np.empty(len(s), np.uint64)
    # byte chunks that end at word ends keep the running sums in cache
    a = 0
    while a < len(s):
        z = max(a + 1, int(np.searchsorted(e, s[a] + CHUNK, side="right")))
        base = s[a]
        p = running(BYTE_TABLE[data[base:e[z - 1]]], R_BYTE)
        out[a:z] = (p[e[a:z] - base] - p[s[a:z] - base]) * powers(R_BYTE, int(s[z - 1] - base) + 1, inverse=True)[s[a:z] - base]
        a = z
    lengths = np.searchsorted(s, offsets[1:]) - np.searchsorted(s, offsets[:-1])
    return mix(out), s, e, lengths


def with_row_key(docs: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, bool]:
    """((key, doc_id, text), rows are unique by key): ``key`` is a non-null bigint that orders documents
    as their ids do and tells rows with different texts apart. Unique non-null
    ids are their own keys. Otherwise the distinct (doc_id, text) pairs are
    numbered in order of id (null last), then text hash; equal rows share a key.
    ``keep`` names further columns to carry."""
    ids = docs.select("doc_id").agg(F.count("*").alias("n"), F.count("doc_id").alias("known"),
                                    F.countDistinct("doc_id").alias("distinct")).first()
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    if ids["n"] == ids["known"] == ids["distinct"] and docs.schema["doc_id"].dataType.simpleString() in ("bigint", "int"):
        return docs.select(F.col("doc_id").cast("bigint").alias("key"), "doc_id", text, *keep), True
    rows = docs.select("doc_id", text, *keep).withColumn("th", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("th")]
    numbered = cut_lineage(rows.select("doc_id", "th").distinct().repartitionByRange(*order).sortWithinPartitions(*order)
                           .select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").alias("kid"), F.col("th").alias("kth")), "row-key")
    return rows.join(numbered, F.col("doc_id").eqNullSafe(F.col("kid")) & (F.col("th") == F.col("kth"))).select("key", "doc_id", "text", *keep), False
