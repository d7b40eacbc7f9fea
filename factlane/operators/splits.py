"""Run fan-out (J2) and exact stratified train/test splits.

The split is exact, not a Bernoulli sample: per group (dataset x run) the test
part has ceil(share * N) rows, each stratum's train quota is its floor share
plus one for the strata with the largest remainders (ties by stratum name),
and the test part is the rest. Inside a stratum rows are ordered by a seeded
hash of the row key, and the first ``quota`` rows go to train.

Scale: a plain ``row_number`` over each stratum would put a whole stratum (a hot
language may hold a third of all rows) into one task. Instead the 60-bit hash
is cut into 2**bucket_bits buckets; a small aggregate counts rows per
(group, stratum, bucket), a running sum over that count table finds the one
bucket in which each stratum's quota ends, and only the rows of that bucket
are ranked. Every other row is assigned by comparing its bucket number with
the cut bucket, a narrow map-side step after a broadcast of one row per
stratum. The result equals the plain ranking exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import N_RUNS, RUN_SEEDS, TEST_SHARE
from ..functions.hashing import hash_int, run_seed
from ..functions.text import col_of

HASH_DIGITS = 15          # 60-bit order hash
DEFAULT_BUCKET_BITS = 16
SALTS = 64


def fan_out_runs(df: DataFrame, n_runs: int = N_RUNS, seeds=RUN_SEEDS) -> DataFrame:
    """Every row once per run, with ``run_id`` and the run's ``seed``
    (``seeds[run_id % len(seeds)]``). A generator, not a join."""
    return (df.withColumn("run_id", F.explode(F.sequence(F.lit(0), F.lit(n_runs - 1))))
            .withColumn("seed", run_seed("run_id", seeds)))


def strata_key(*cols) -> Column:
    """``domain_label`` as strings (a missing value prints as ``nan``)."""
    return F.concat_ws("_", *[F.coalesce(col_of(c).cast("string"), F.lit("nan")) for c in cols])


def stratified_split(df: DataFrame, by=("domain", "label"), fallback=("label",), test_share: float = TEST_SHARE,
                     seed="seed", key: str = "claim_id", group=("dataset", "run_id"),
                     bucket_bits: int = DEFAULT_BUCKET_BITS, part_col: str = "split",
                     broadcast_max_rows: int = 1_000_000) -> DataFrame:
    """T2 + T3. Adds ``part_col`` ('train' / 'test') and ``stratified_by``
    ('strata' or 'fallback'). ``seed`` is a column name or an int.

    Fallback (T3): when a stratum has fewer than 2 rows, or the test or train
    part has fewer rows than there are strata, the group is split by the
    ``fallback`` key only.

    Plan: one partial aggregate over the rows (counts per group, stratum,
    fallback stratum and hash bucket). Sums per stratum give the quotas; a
    running sum per stratum gives the cut bucket and how many of its rows are
    taken. The cut table (one row per group x stratum
    pair) is kept in the checkpoint folder and broadcast when its measured row
    count is at most ``broadcast_max_rows`` (else joined by key and salt). The rows are
    then read once more: rows outside their cut bucket are assigned by a
    comparison; rows inside it are ranked (a window over a ~1/2**bucket_bits
    slice of the stratum)."""
    from ..session import cut_lineage

    group = list(group)
    added_group = False
    if not group:
        df = df.withColumn("__g", F.lit(0))
        group, added_group = ["__g"], True
    seed_c = F.lit(seed) if isinstance(seed, int) else F.col(seed)
    shift = HASH_DIGITS * 4 - bucket_bits
    keyed = (df.withColumn("__h", hash_int(seed_c, F.col(key), digits=HASH_DIGITS))
             .withColumn("__b", F.shiftright(F.col("__h"), shift))
             .withColumn("__s1", strata_key(*by))
             .withColumn("__s2", strata_key(*fallback)))

    counts = cut_lineage(keyed.groupBy(*group, "__s1", "__s2", "__b").agg(F.count(F.lit(1)).alias("__n")), "buckets")
    cut, n_cut = _cut_table(counts, group, test_share, broadcast_max_rows)
    cut = cut_lineage(cut, "cuts")
    if n_cut <= broadcast_max_rows:  # counted once, on the strata
        assigned = keyed.join(F.broadcast(cut), group + ["__s1", "__s2"])
    else:  # a hot stratum's rows are dealt over SALTS keys
        salted = cut.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        assigned = keyed.withColumn("__salt", F.pmod(F.col("__h"), F.lit(SALTS)).cast("int")).join(
            salted, group + ["__s1", "__s2", "__salt"]).drop("__salt")
    outside = (assigned.where(F.col("__b") != F.col("__cut"))
               .withColumn(part_col, F.when(F.col("__b") < F.col("__cut"), "train").otherwise("test")))
    rank_w = Window.partitionBy(*group, "__s").orderBy("__h", key)
    inside = (assigned.where(F.col("__b") == F.col("__cut"))
              .withColumn(part_col, F.when(F.row_number().over(rank_w) <= F.col("__take"), "train")
                          .otherwise("test")))
    out = outside.unionByName(inside).withColumn(
        "stratified_by", F.when(F.col("__primary"), "strata").otherwise("fallback"))
    drop = ["__h", "__b", "__s1", "__s2", "__s", "__primary", "__cut", "__take"]
    if added_group:
        drop.append("__g")
    return out.drop(*drop)


def _cut_table(counts: DataFrame, group: list, test_share: float, small_rows: int) -> tuple[DataFrame, int]:
    """(group..., __s1, __s2, __s, __primary, __cut, __take) from the bucket
    counts, and its number of rows. Quotas and the fallback are decided on a table of one row per
    stratum; only the running sum that finds the cut bucket is at bucket grain,
    and it is partitioned by stratum."""
    from ..session import cut_lineage

    col = F.col
    w_g = Window.partitionBy(*group)
    # one row per (group, stratum, fallback stratum)
    c = counts.groupBy(*group, "__s1", "__s2").agg(F.sum("__n").alias("__n"))
    c = c.withColumns({"__tot": F.sum("__n").over(w_g), "__ns1": F.sum("__n").over(Window.partitionBy(*group, "__s1")),
                       "__lead": F.row_number().over(Window.partitionBy(*group, "__s1").orderBy("__s2"))})
    c = c.withColumns({"__min": F.min("__ns1").over(w_g), "__k": F.sum((col("__lead") == 1).cast("int")).over(w_g)})
    ntest = F.ceil(F.lit(float(test_share)) * col("__tot")).cast("bigint")
    ntrain = col("__tot") - ntest
    primary = (col("__min") >= 2) & (ntest >= col("__k")) & (ntrain >= col("__k"))
    c = c.withColumns({"__ntrain": ntrain, "__primary": primary})
    c = cut_lineage(c.withColumn("__s", F.when(col("__primary"), col("__s1")).otherwise(col("__s2")))
                    .select(*group, "__s1", "__s2", "__s", "__primary", "__n", "__ntrain", "__tot"), "strata")
    # all tables below have at most one row per stratum pair, so one count
    # decides whether they are broadcast
    n_strata = c.count()
    small = F.broadcast if n_strata <= small_rows else (lambda df: df)

    # largest-remainder quota; n_train * N_s overflows bigint at 1e11 rows: exact decimal(38,0)
    q = c.groupBy(*group, "__s").agg(F.sum("__n").alias("__ns"), F.first("__ntrain").alias("__ntrain"), F.first("__tot").alias("__tot"))
    q = q.withColumn("__num", col("__ntrain").cast("decimal(38,0)") * col("__ns").cast("decimal(38,0)"))
    q = q.withColumn("__floor", F.expr("__num div cast(__tot as decimal(38,0))").cast("bigint"))
    q = q.withColumn("__rem", col("__num") - col("__floor").cast("decimal(38,0)") * col("__tot").cast("decimal(38,0)"))
    q = q.withColumns({"__need": col("__ntrain") - F.sum("__floor").over(w_g),
                       "__rank": F.row_number().over(w_g.orderBy(F.desc("__rem"), F.asc("__s")))})
    q = q.select(*group, "__s", (col("__floor") + F.when(col("__rank") <= col("__need"), 1).otherwise(0)).alias("__quota"))

    strata = c.select(*group, "__s1", "__s2", "__s", "__primary").join(small(q), [*group, "__s"])
    b = counts.join(small(strata), [*group, "__s1", "__s2"])
    b = b.groupBy(*group, "__s", "__b", "__quota").agg(F.sum("__n").alias("__bn"))
    b = b.withColumn("__incl", F.sum("__bn").over(Window.partitionBy(*group, "__s").orderBy("__b")))
    b = b.where((col("__incl") - col("__bn") < col("__quota")) & (col("__quota") <= col("__incl")))
    b = b.select(*group, "__s", col("__b").alias("__cut"), (col("__quota") - col("__incl") + col("__bn")).alias("__take"))
    return strata.join(small(b), [*group, "__s"], "left").select(
        *group, "__s1", "__s2", "__s", "__primary",
        F.coalesce("__cut", F.lit(-1).cast("bigint")).alias("__cut"), F.coalesce("__take", F.lit(0).cast("bigint")).alias("__take")), n_strata


def label_split(df: DataFrame, label: str = "label", test_share: float = TEST_SHARE, seed=42,
                key: str = "claim_id", group=(), part_col: str = "split") -> DataFrame:
    """Split stratified by label only."""
    return stratified_split(df, by=(label,), fallback=(label,), test_share=test_share, seed=seed, key=key,
                            group=group, part_col=part_col)


def crosstab(df: DataFrame, keys=("dataset", "run_id", "split"), row: str = "domain", label: str = "label",
             classes=(0, 1)) -> DataFrame:
    """T5: domain x label counts, zeros filled."""
    return (df.groupBy(*keys, row).pivot(label, list(classes)).agg(F.count(F.lit(1)))
            .na.fill(0, [str(c) for c in classes])
            .select(*keys, row, *[F.col(str(c)).cast("bigint").alias(f"n_label_{c}") for c in classes]))


def part_shares(df: DataFrame, column: str, keys=("dataset", "run_id", "split")) -> DataFrame:
    """Value shares per part (normalised value counts)."""
    keys = list(keys)
    counts = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def part_sizes(df: DataFrame, keys=("dataset", "run_id"), part: str = "split") -> DataFrame:
    """Part sizes and percent of the group."""
    keys = list(keys)
    counts = df.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(*keys)))
