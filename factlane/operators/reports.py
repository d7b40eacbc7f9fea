"""Report operators: error analysis (G14, W2), best runs and domains (W3, W4),
sorted summaries (W1), distinct domains (U3) and unions (U1, U2)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ERROR_EXAMPLES, LENGTH_BIN_NAMES, PREVIEW_CHARS
from ..functions.text import truncate
from ..session import cut_lineage, join_small


#: Values of one histogram bucket of ``exact_quantiles``.
BUCKET_VALUES = 256


def exact_quantiles(counts: DataFrame, keys, value: str, n: str, shares) -> DataFrame:
    """(keys..., q array<double>): linear-interpolated quantiles of an integer
    column, exact, from a (keys..., value, n) count table. A histogram of
    ``BUCKET_VALUES`` values a bucket gives the bucket that holds each wanted rank;
    only those buckets are looked into. No group's values meet in one state."""
    keys = list(keys)
    total = counts.groupBy(*keys).agg(F.sum(n).alias("__total"))
    at = lambda share: (F.col("__total") - 1) * F.lit(float(share))
    ranks = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), f(at(share)).cast("bigint").alias("rank"), (at(share) - F.floor(at(share))).alias("part"))
                      for k, share in enumerate(shares) for side, f in (("low", F.floor), ("high", F.ceil))])
    wanted = total.select(*keys, F.explode(ranks).alias("__w"))
    bucket = F.floor(F.col(value) / BUCKET_VALUES).cast("bigint")
    table = counts.withColumn("__bucket", bucket)
    hist = table.groupBy(*keys, "__bucket").agg(F.sum(n).alias("__in"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("__before", F.coalesce(F.sum("__in").over(before), F.lit(0)))
    holds = join_small(hist, wanted.groupBy(*keys).agg(F.collect_list("__w").alias("__ws")), keys).withColumn("__w", F.explode("__ws")).where(
        (F.col("__w.rank") >= F.col("__before")) & (F.col("__w.rank") < F.col("__before") + F.col("__in")))
    inner = Window.partitionBy(*keys, "__k", "__side").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    found = table.join(holds.select(*keys, "__bucket", "__before", F.col("__w.k").alias("__k"), F.col("__w.side").alias("__side"),
                                    F.col("__w.rank").alias("__rank"), F.col("__w.part").alias("__part")), [*keys, "__bucket"])
    found = found.withColumn("__before", F.col("__before") + F.coalesce(F.sum(n).over(inner), F.lit(0)))
    found = found.where((F.col("__rank") >= F.col("__before")) & (F.col("__rank") < F.col("__before") + F.col(n)))
    side = lambda name: F.max(F.when(F.col("__side") == name, F.col(value).cast("double")))
    each = found.groupBy(*keys, "__k").agg(side("low").alias("lo"), side("high").alias("hi"), F.max("__part").alias("part"))
    q = (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("q")
    return each.select(*keys, "__k", q).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__k", "q"))).alias("__q")).select(
        *keys, F.transform("__q", lambda x: x["q"]).alias("q"))


def length_quartile_accuracy(df: DataFrame, keys=("dataset",), text: str = "claim", label: str = "label",
                             pred: str = "prediction", names=LENGTH_BIN_NAMES, on_duplicates: str = "raise") -> DataFrame:
    """Accuracy by claim-length quartile. Edges are linear-interpolated
    quantiles per group; bins are right-closed with the lowest value included.
    Quartiles need five different edges (least to greatest length): a group without
    them is an error (``raise``), or reported as one row with a null bin
    (``report``)."""
    keys = list(keys)
    # rows are counted per length once; edges and bins use that small table
    correct = (F.col(label) == F.col(pred)).cast("int")
    lens = cut_lineage(df.groupBy(*keys, F.length(text).alias("claim_length")).agg(
        F.count(F.lit(1)).alias("__n"), F.count(correct).alias("__known"), F.sum(correct).alias("__right")), "lengths")
    known = lens.where(F.col("claim_length").isNotNull())
    edges = cut_lineage(exact_quantiles(known, keys, "claim_length", "__n", (0.0, 0.25, 0.5, 0.75, 1.0))
                        .withColumn("__equal", F.size(F.array_distinct("q")) < 5), "length-edges")
    if on_duplicates == "raise":
        equal = edges.where("__equal").select(*keys).first()
        if equal is not None:
            raise ValueError(f"bin edges must be unique: the lengths of group {equal.asDict()} have equal quartiles")
    q = F.col("q")
    bin_ = (F.when(F.col("__equal"), F.lit(None)).when(F.col("claim_length") <= q[1], names[0]).when(F.col("claim_length") <= q[2], names[1])
            .when(F.col("claim_length") <= q[3], names[2]).otherwise(names[3]))
    return (join_small(lens, edges, keys).groupBy(*keys, bin_.alias("length_bin"))
            .agg((F.sum("__right") / F.sum("__known")).alias("accuracy"), F.sum("__n").alias("n")))


def error_examples(df: DataFrame, keys=("dataset",), order: str = "claim_id", text: str = "claim",
                   label: str = "label", pred: str = "prediction", k: int = ERROR_EXAMPLES,
                   preview: int = PREVIEW_CHARS) -> DataFrame:
    """The first ``k`` false positives and false negatives per group in key
    order, with the claim and its ``preview`` (first characters + '...').
    ``row_number() <= k`` is planned as a window group limit: each task keeps
    its own top k before the shuffle, so a hot group never reaches one task
    whole."""
    keys = list(keys)
    y, p = F.col(label), F.col(pred)
    kind = F.when((y == 0) & (p == 1), "FP").when((y == 1) & (p == 0), "FN")
    rows = df.withColumn("kind", kind).where(F.col("kind").isNotNull())
    w = Window.partitionBy(*keys, "kind").orderBy(order)
    return (rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(*keys, "kind", F.col("rank").cast("bigint").alias("rank"), order, text,
                    F.concat(truncate(text, preview), F.lit("...")).alias("preview")))


def distinct_domains(df: DataFrame, domain: str = "domain", keys=()) -> DataFrame:
    """Distinct non-null domains, sorted."""
    return df.select(*keys, domain).where(F.col(domain).isNotNull()).distinct().orderBy(*keys, domain)


def union_datasets(frames: dict[str, DataFrame]) -> DataFrame:
    """Union by column name with a ``dataset`` column naming the source."""
    tagged = [df.withColumn("dataset", F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
