"""Swing leg of each symbol and the four tests of its decline.

All legs live inside the last 120 bars of a symbol, so every aggregate here
works on a bounded set of rows per symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

LOOKBACK = 120
MIN_DECLINE_PCT = 3.0
SEVERITY = ("DETERIORATING", "MIXED", "UNKNOWN", "ORDERLY", "NO_PULLBACK", "NO_DATA")


def recent(bars: DataFrame) -> DataFrame:
    """Last bars of each symbol (120 plus the 50 before a peak) with ``n`` and distance from the end."""
    counts = bars.groupBy("symbol").agg(F.max("rn").alias("_last"))
    df = bars.join(counts, "symbol").withColumn("n", F.col("_last") + 1)
    return df.where(F.col("rn") > F.col("_last") - (LOOKBACK + 51)).withColumn("floor", F.greatest(F.lit(0), F.col("_last") - (LOOKBACK - 1)))


def legs(bars: DataFrame) -> DataFrame:
    """Peak (first highest close of the window) and base (latest local low before it) per symbol."""
    df = recent(bars)
    window = df.where(F.col("rn") >= F.col("floor"))
    peak = window.groupBy("symbol").agg(
        F.max_by(F.struct("rn", "close", "date"), F.struct("close", -F.col("rn"))).alias("p"),
        F.max_by("close", "rn").alias("last"),
        F.max("rn").alias("last_rn"),
        F.max("floor").alias("floor"),
        F.max("n").alias("n"),
    )
    before = window.select("symbol", "rn", "close").join(
        peak.select("symbol", F.col("p.rn").alias("peak"), "floor"), "symbol"
    ).where(F.col("rn") <= F.col("peak"))
    w = Window.partitionBy("symbol").orderBy("rn").rowsBetween(-10, 10)
    lows = before.withColumn("_low", F.min("close").over(w))
    local = (F.col("close") == F.col("_low")) & (F.col("rn") < F.col("peak")) & (F.col("rn") >= F.col("floor") + 10)
    base = lows.groupBy("symbol").agg(
        F.max(F.when(local, F.col("rn"))).alias("_swing"),
        F.min_by("rn", F.struct("close", "rn")).alias("_lowest"),
    )
    return peak.join(base, "symbol").select(
        "symbol", "n", "last", "last_rn", "floor",
        F.col("p.rn").alias("peak"), F.col("p.close").alias("top"), F.col("p.date").alias("peak_date"),
        F.coalesce("_swing", "_lowest").alias("base"),
    )


def assess(bars: DataFrame) -> DataFrame:
    """Verdict per symbol with the inputs of its tests."""
    leg = legs(bars)
    df = recent(bars).join(leg.drop("n", "floor"), "symbol")
    w = Window.partitionBy("symbol").orderBy("rn")
    c = F.col
    df = df.withColumns(
        {
            "_chg": (c("close") / F.lag("close").over(w) - 1.0) * 100.0,
            "_ma": F.when(c("n") >= 60, F.avg("close").over(w.rowsBetween(-49, 0))),
        }
    )
    prior = (c("rn") >= c("peak") - 50) & (c("rn") < c("peak"))
    df = df.withColumn("_pv", F.avg(F.when(prior, c("volume"))).over(Window.partitionBy("symbol")))
    heavy = (c("rn") > c("peak")) & (c("_chg") <= -1.5) & (c("volume") > c("_pv"))
    up, down = (c("rn") >= c("base")) & (c("rn") <= c("peak")), c("rn") >= c("peak")
    s = df.groupBy("symbol").agg(
        F.first("n").alias("n"), F.first("last").alias("last"), F.first("top").alias("top"), F.first("peak").alias("peak"),
        F.first("peak_date").alias("peak_date"), F.first("last_rn").alias("last_rn"),
        F.avg(F.when(up, c("volume"))).alias("adv"), F.count(F.when(up, 1)).alias("n_adv"),
        F.avg(F.when(down, c("volume"))).alias("dec"), F.count(F.when(down, 1)).alias("n_dec"),
        F.max(F.when(c("rn") == c("base"), c("close"))).alias("base_close"),
        F.max(F.when(c("rn") == c("last_rn"), c("_ma"))).alias("ma"),
        F.max(F.when(c("rn") == c("last_rn") - 10, c("_ma"))).alias("ma_before"),
        F.first("_pv").alias("pv"), F.count(F.when(heavy, 1)).alias("hits"),
    )
    return s.select("*", *[v.alias(k) for k, v in tests().items()]).withColumns(
        {"passes": _count("PASS"), "fails": _count("FAIL"), "drawdown_pct": (c("last") / c("top") - 1.0) * 100.0}
    ).withColumn("status", verdict())


NAMES = ("t_volume", "t_trend", "t_structure", "t_supply")


def _count(what: str) -> Column:
    return sum((F.when(F.col(t) == what, 1).otherwise(0) for t in NAMES), F.lit(0))


def tests() -> dict[str, Column]:
    c = F.col
    ratio = F.try_divide("dec", "adv")
    slope = F.when(c("n") > 60, c("ma") - c("ma_before")).otherwise(0.0)
    above, rising = c("last") > c("ma"), slope >= 0
    advance = c("top") - c("base_close")
    retrace = F.try_divide(c("top") - c("last"), advance) * 100.0
    return {
        "t_volume": F.when((c("n_adv") < 3) | (c("n_dec") < 2) | (c("adv") <= 0), "N/A").when(ratio <= 0.8, "PASS").when(ratio <= 1.2, "WARN").otherwise("FAIL"),
        "t_trend": F.when(c("n") < 60, "N/A").when(above & rising, "PASS").when(above | rising, "WARN").otherwise("FAIL"),
        "t_structure": F.when(advance <= 0, "N/A").when(c("last") <= c("base_close"), "FAIL").when(retrace <= 38, "PASS").when(retrace <= 62, "WARN").otherwise("FAIL"),
        "t_supply": F.when((c("n_dec") < 3) | c("pv").isNull() | (c("pv") <= 0), "N/A").when(c("hits") == 0, "PASS").when(c("hits") <= 2, "WARN").otherwise("FAIL"),
        "volume_ratio": ratio,
        "retrace_pct": retrace,
    }


def verdict() -> Column:
    c = F.col
    ran = sum((F.when(c(t) != "N/A", 1).otherwise(0) for t in NAMES), F.lit(0))
    return (
        F.when(c("n") < 60, "NO_DATA").when(c("peak") == 0, "NO_PULLBACK").when(c("drawdown_pct") > -MIN_DECLINE_PCT, "NO_PULLBACK")
        .when(ran == 0, "UNKNOWN").when((c("fails") == 0) & (c("passes") >= 3), "ORDERLY").when(c("fails") >= 2, "DETERIORATING").otherwise("MIXED")
    )
