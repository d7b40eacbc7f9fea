"""Small Column helpers: seeded hash, seeds per run, timestamp tag, arg-max, capitalise, shares."""

import hashlib
import re

from pyspark.sql import functions as F

from factlane.functions import hashing as H
from factlane.functions import text as TX
from factlane.operators.claims import value_counts


def test_hash_matches_python_md5(spark):
    df = spark.createDataFrame([(42, 7), (999, 123456789)], "seed int, id long")
    got = [r[0] for r in df.select(H.hash_int("seed", "id", digits=15)).collect()]
    expect = [int(hashlib.md5(f"{s}|{i}".encode()).hexdigest()[:15], 16) for s, i in [(42, 7), (999, 123456789)]]
    assert got == expect


def test_run_seed(spark):
    df = spark.range(7).select(F.col("id").cast("int").alias("run_id"))
    assert [r[0] for r in df.select(H.run_seed("run_id", [42, 123, 456, 789, 999])).collect()] == \
        [42, 123, 456, 789, 999, 42, 123]


def test_timestamp_tag(spark):
    tag = spark.range(1).select(TX.timestamp_tag()).first()[0]
    assert re.fullmatch(r"\d{8}_\d{6}", tag)


def test_argmax_first_wins(spark):
    df = spark.createDataFrame([([0.1, 0.9, 0.9],), ([2.0, 1.0],)], "s array<double>")
    assert [r[0] for r in df.select(TX.array_argmax("s")).collect()] == [1, 0]


def test_capitalize(spark):
    df = spark.createDataFrame([("hEALTH",), ("war",)], "d string")
    assert [r[0] for r in df.select(TX.capitalize("d")).collect()] == ["Health", "War"]


def test_value_counts_shares(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "d string")
    rows = {r["d"]: (r["n"], r["share"]) for r in value_counts(df, "d", normalize=True).collect()}
    assert rows == {"a": (2, 2 / 3), "b": (1, 1 / 3)}
