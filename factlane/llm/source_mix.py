"""Mixing sources to target weights by hash-threshold histograms (operator 9).

Each document has a 32-bit hash of its id. Words are summed by (source, leading
hash bits); the source's budget falls into one bucket; only that bucket is
summed again by the next bits, until the threshold is one hash value. A
document is taken when its hash is below its source's threshold, so nothing is
sorted and a rerun takes the same documents. A source whose target exceeds its
size is taken whole once, and the threshold decides the second copy (thresholds
are nested: a document's second copy implies its first).

The document at the threshold is taken when that brings the source nearer to
its target. Defined results: null text has size 0; a null source is a source of
its own, last in order; null ids hash as the empty string; documents with equal
ids are taken together; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEAT = 2
HASH_LEVELS = ((20, 12), (8, 12), (0, 8))  # (shift, bits) from the leading bits down
#: Cut tables (one row per source) up to this many rows are broadcast.
BROADCAST_SOURCES = 100_000


def id_hash(doc_id: Column) -> Column:
    """The leading 32 bits of md5 of the id written as text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size) -> + target. Targets share ``share`` of all sizes
    by weight; a target stops at ``max_repeat`` times its source's size and the
    excess goes to the others: with sources in order of cap / weight, the level
    (words per unit of weight) of the open ones is read off running sums. The
    table has one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("weight", F.element_at(
        F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(max_repeat) * F.col("source_size")).withColumn(
        "ratio", F.col("cap").cast("double") / F.col("weight"))
    run = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", (
        F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(run), F.lit(0)))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(run), F.lit(0))))
    s = s.withColumn("open_level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"])
    return s.select("source", "source_size", F.least(
        F.col("cap").cast("double"), F.col("open_level") * F.col("weight")).alias("target"))


def _on_source(rows: DataFrame, cuts: DataFrame, small: bool) -> DataFrame:
    cuts = cuts.withColumnRenamed("source", "cut_source")
    cuts = F.broadcast(cuts) if small else cuts
    return rows.join(cuts, F.col("source").eqNullSafe(F.col("cut_source"))).drop("cut_source")


def hash_thresholds(sized: DataFrame, budgets: DataFrame, small: bool) -> DataFrame:
    """Per source the largest hash that is taken (-1: none). ``sized`` has
    (source, size, h); ``budgets`` has (source, budget) with 0 <= budget < size
    of the source. Each level adds up one bucket per source."""
    cuts = budgets.select("source", "budget", F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("before"))
    for shift, bits in HASH_LEVELS:
        inside = _on_source(sized.select("source", "size", "h"), cuts, small).where(
            F.shiftright("h", shift + bits) == F.col("prefix"))
        hist = inside.groupBy("source", F.shiftright("h", shift).alias("seg")).agg(
            F.sum("size").alias("words"), F.first("budget").alias("budget"), F.first("before").alias("base"))
        run = Window.partitionBy("source").orderBy("seg")
        hist = hist.withColumn("upto", F.col("base") + F.sum("words").over(run))
        cuts = cut_lineage(hist.where(F.col("upto") > F.col("budget")).groupBy("source").agg(
            F.min(F.struct("seg", "words", "upto", "budget")).alias("c")).select(
            "source", "c.budget", F.col("c.seg").alias("prefix"),
            (F.col("c.upto") - F.col("c.words")).alias("before"), F.col("c.upto").alias("upto")), "mix-cut")
    nearer = (F.col("upto") - F.col("budget")) < (F.col("budget") - F.col("before"))
    return cuts.select("source", F.when(nearer, F.col("prefix")).otherwise(F.col("prefix") - 1).alias("threshold"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every document; ``taken``
    counts its words times the copies the mix takes."""
    sized = cut_lineage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                                    id_hash(F.col("doc_id")).alias("h")), "mix-sized")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut_lineage(source_targets(sizes, weights, share, max_repeat), "mix-targets")
    small = targets.count() <= BROADCAST_SOURCES
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = targets.withColumn("copies", whole.cast("bigint")).withColumn(
        "budget", F.col("target") - F.col("copies") * F.col("source_size"))
    cuts = hash_thresholds(sized, plan.where("source_size > 0").select("source", "budget"), small)
    plan = plan.join(cuts.withColumnRenamed("source", "cut_source"),
                     F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source")
    out = _on_source(sized, plan, small)
    taken = F.col("size") * (F.col("copies") + (F.col("h") <= F.coalesce("threshold", F.lit(-1))).cast("bigint"))
    return out.select("doc_id", "size", "source_size", "target", taken.cast("bigint").alias("taken"))


#: DuckDB twin of ``mix_sources`` over the view named ``docs``.
MIX_SQL = r"""
sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) AS h
  FROM docs),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight FROM by_source),
capped AS (SELECT *, 2 * source_size AS cap, CAST(2 * source_size AS DOUBLE) / weight AS ratio FROM weighed),
levels AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
             - CAST(coalesce(sum(cap) OVER w, 0) AS DOUBLE))
            / CAST((sum(weight) OVER ()) - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS level
  FROM capped
  WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
         least(CAST(cap AS DOUBLE), weight * (SELECT level FROM levels WHERE level <= ratio
                                              ORDER BY ratio, source NULLS LAST LIMIT 1)) AS target
  FROM levels),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM targets),
budgets AS (SELECT *, target - copies * source_size AS budget FROM plan),
run AS (
  SELECT s.*, b.source_size, b.target, b.copies, b.budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h) AS upto,
         sum(s.size) OVER (PARTITION BY s.source, s.h) AS words
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source),
mixed AS (
  SELECT doc_id, size, source_size, target, h,
         CAST(size * (copies + CASE WHEN upto <= budget THEN 1
                                    WHEN upto - words <= budget AND upto - budget < budget - (upto - words) THEN 1
                                    ELSE 0 END) AS BIGINT) AS taken
  FROM run)
"""
