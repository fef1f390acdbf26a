"""Logged scores over time: daily readings, crossings and their record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def daily_readings(log: DataFrame) -> DataFrame:
    """Last reading per symbol and day; repeated runs collapse before the shuffle."""
    known = log.where(F.col("score100").isNotNull())
    g = known.groupBy("symbol", F.to_date("scanned_at").alias("day")).agg(
        F.max_by(F.struct("scanned_at", "score100", "id"), F.struct("scanned_at", "id")).alias("x")
    )
    return g.select("symbol", "day", "x.scanned_at", F.col("x.score100").cast("double").alias("score"), "x.id")


def crossings(readings: DataFrame, bar: float = 60.0, lookback_days: int = 30, now: Column | None = None) -> DataFrame:
    """Newest reading of each symbol against its previous day.

    Groups: crossed, lost, rising (still below, +5 or more), new (no recent
    prior reading).  Only one row per symbol and day reaches the window.
    """
    c = F.col
    w = Window.partitionBy("symbol").orderBy("day")
    df = readings.withColumns(
        {"prev_score": F.lag("score").over(w), "prev_at": F.lag("scanned_at").over(w), "_next": F.lead("day").over(w)}
    ).where(c("_next").isNull())
    known = c("prev_at").isNotNull()
    if now is not None:
        known = known & (c("prev_at") >= now - F.expr(f"INTERVAL {lookback_days} DAYS"))
    delta = F.round(c("score") - c("prev_score"), 1)
    days = F.when(known, F.floor(F.timestamp_diff("HOUR", c("prev_at"), c("scanned_at")) / 24))
    group = (
        F.when(~known, F.when(c("score") >= bar, "new"))
        .when((c("prev_score") < bar) & (c("score") >= bar), "crossed")
        .when((c("prev_score") >= bar) & (c("score") < bar), "lost")
        .when((c("score") < bar) & (delta >= 5), "rising")
    )
    out = df.withColumn("group", group).where(c("group").isNotNull())
    known_out = c("group") != "new"
    return out.select(
        "symbol", "group", "score", F.when(known_out, c("prev_score")).alias("prev_score"), F.when(known_out, delta).alias("delta"),
        F.when(known_out, days).alias("days_between"),
        F.when(known_out & (days != 0), F.round(F.try_divide(delta, F.greatest(days, F.lit(1))), 2)).alias("velocity"),
        F.round(c("score") - bar, 1).alias("margin"), "scanned_at",
    )


def fresh_crossings(crossed: DataFrame, recorded: DataFrame) -> DataFrame:
    """Crossings not yet on record for their symbol, bar and day."""
    return crossed.join(recorded.select("symbol", "bar", "day").distinct(), ["symbol", "bar", "day"], "left_anti")


def last_scores(log: DataFrame) -> DataFrame:
    """Final reading of each cleaned symbol, day and universe; unscored symbols drop out afterwards."""
    from barloom.sources.archive import clean_symbol

    g = log.where("scan_type = 'swing'").groupBy(clean_symbol(F.col("symbol")).alias("symbol"), F.to_date("scanned_at").alias("day")).agg(
        F.max_by(F.struct("score100", "universe"), F.struct("scanned_at", "id")).alias("x")
    )
    return g.select("symbol", "day", F.col("x.score100").alias("score"), "x.universe").where("score IS NOT NULL")
