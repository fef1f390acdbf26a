"""Exact ranks and quantiles without putting a whole group into one task.

Equal values are counted first, so a value shared by a third of all rows
becomes one row.  Distinct values are then split into fine magnitude buckets:
the running count over buckets touches one small row per bucket, and the
running count inside a bucket touches only that bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.operators.lineage import materialize

PER_OCTAVE = 1024
EXPONENTS = 1100  # doubles span 2**-1074 .. 2**1023
#: Buckets that hold a wanted rank: up to so many are broadcast.
WANTED = 50_000


def magnitude_bucket(v: Column) -> Column:
    """A bucket number that never decreases as ``v`` grows."""
    size = F.floor(F.log2(F.abs(v)) * PER_OCTAVE) + EXPONENTS * PER_OCTAVE
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("long")


def value_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per (keys, distinct value): how many rows equal it, how many are below."""
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count("*").alias("n_equal"))
        .withColumn("_bucket", magnitude_bucket(F.col(value)))
    )
    before = Window.unboundedPreceding
    over_buckets = Window.partitionBy(*keys, F.lit(0)).orderBy("_bucket").rowsBetween(before, -1)
    base = (
        counts.groupBy(*keys, "_bucket")
        .agg(F.sum("n_equal").alias("_n"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_n").over(over_buckets), F.lit(0)).alias("_base"))
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(before, -1)
    return (
        counts.withColumn("_inside", F.coalesce(F.sum("n_equal").over(inside), F.lit(0)))
        .join(base, [*keys, "_bucket"])
        .select(*keys, value, "n_equal", (F.col("_base") + F.col("_inside")).alias("below"))
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float]
) -> DataFrame:
    """Linearly interpolated quantiles per group, one output column each.

    Rows are counted by magnitude bucket before anything is shuffled; only the
    values of the buckets that hold a wanted rank are then looked at, which
    reads ``df`` twice.
    """
    if not keys:
        whole = exact_quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, quantiles)
        return whole.drop("_all")
    known = df.where(F.col(value).isNotNull()).select(*keys, value, magnitude_bucket(F.col(value)).alias("_bucket"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = known.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    sizes = sizes.select("*", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(group).alias("_total"))
    ends = {o: (F.floor(at), F.ceil(at), at) for o, q in quantiles.items() for at in [(F.col("_total") - 1) * F.lit(q)]}
    within = lambda x: (F.col("_base") <= x) & (x < F.col("_base") + F.col("_n"))
    wanted = reduce(lambda a, b: a | b, [within(x) for lo, hi, _ in ends.values() for x in (lo, hi)])
    wanted = materialize(sizes.where(wanted).drop("_n"))
    few = wanted.count() <= WANTED
    counts = known.join(F.broadcast(wanted) if few else wanted, [*keys, "_bucket"]).groupBy(*keys, "_bucket", value, "_base", "_total").agg(F.count("*").alias("_equal"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn("_first", F.col("_base") + F.coalesce(F.sum("_equal").over(inside), F.lit(0)))
    holds = lambda x: (F.col("_first") <= x) & (x < F.col("_first") + F.col("_equal"))
    picks = []
    for out, (lo, hi, at) in ends.items():
        picks += [F.max(F.when(holds(lo), F.col(value))).alias(f"_lo_{out}"), F.max(F.when(holds(hi), F.col(value))).alias(f"_hi_{out}"), F.max(at - lo).alias(f"_w_{out}")]
    grouped = ranks.groupBy(*keys).agg(*picks)
    return grouped.select(
        *keys,
        *[
            (F.col(f"_lo_{o}") + (F.col(f"_hi_{o}") - F.col(f"_lo_{o}")) * F.col(f"_w_{o}")).alias(o)
            for o in quantiles
        ],
    )


def with_average_rank(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Add the 1-based average rank of ``value`` within ``keys`` (ties share the mean rank)."""
    ranks = value_ranks(df, keys, value).select(
        *keys, value, (F.col("below") + (F.col("n_equal") + 1) / 2.0).alias(out)
    )
    return df.join(ranks, [*keys, value], "left")


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation with the t-approximation of its p-value statistic."""
    if not keys:
        return spearman(df.withColumn("_all", F.lit(0)), ["_all"], x, y).drop("_all")
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    ranked = with_average_rank(with_average_rank(both, keys, x, "_rx"), keys, y, "_ry")
    out = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("_rx", "_ry").alias("rho"))
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / ((1.0 - F.col("rho")) * (1.0 + F.col("rho"))))
    return out.withColumn("t_stat", t)
