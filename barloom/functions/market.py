"""Weekly bars, index regime and strength against the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions import indicators as ind
from barloom.functions.windows import Ema, frame_array, lag, running, span, with_ema, with_row_number

REGIMES = ("BULL_TREND", "BULL_WEAK", "RECOVERY", "SIDEWAYS", "BEAR_TREND")


def weekly_bars(bars: DataFrame) -> DataFrame:
    """One bar per symbol and week (weeks end on Sunday), partially aggregated before the shuffle."""
    return (
        bars.groupBy("symbol", F.to_date(F.date_trunc("week", "date")).alias("week"))
        .agg(
            F.min_by("open", "date").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "date").alias("close"),
            F.sum("volume").alias("volume"),
            F.max("date").alias("date"),
        )
        .where(F.col("close").isNotNull())
    )


def _trend_label(close: Column, mean: Column, direction: Column) -> Column:
    return (
        F.when((close > mean) & (direction == 1), "BULLISH")
        .when(~(close > mean) & (direction == -1), "BEARISH")
        .when(close > mean, "WEAK_BULL")
        .otherwise("WEAK_BEAR")
    )


def weekly_states(bars: DataFrame) -> DataFrame:
    """Weekly bars with their 20-week mean and Supertrend state."""
    weeks = with_row_number(weekly_bars(bars), "week")
    weeks = ind.compose(weeks, {"means": [span("w_ema20", "close", 20)]})
    return ind.with_supertrend(weeks, "w_st", state=True)


def with_weekly_trend(df: DataFrame) -> DataFrame:
    """Weekly trend as seen on each bar: finished weeks plus the week so far.

    The state at the end of the week before is joined in and advanced by one
    step with the running week, which equals recomputing the weekly series
    at every bar.
    """
    in_week = Window.partitionBy("symbol", "_week").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_week", F.to_date(F.date_trunc("week", "date")))
    df = df.withColumn("_turn", F.when(F.col("_week") == lag("_week"), 0).otherwise(1))
    df = df.withColumn("_wn", running(F.sum, "_turn") - 1)
    df = df.select("*", F.max("high").over(in_week).alias("_wh"), F.min("low").over(in_week).alias("_wl"))
    prev = weekly_states(df.select("symbol", "date", "open", "high", "low", "close", "volume")).select(
        "symbol",
        (F.col("rn") + 1).alias("_wn"),
        F.col("close").alias("_pc"),
        F.col("w_ema20").alias("_pe"),
        F.col("w_st_atr").alias("_pa"),
        F.col("w_st_upper").alias("_pu"),
        F.col("w_st_lower").alias("_pl"),
        F.col("w_st_line").alias("_ps"),
    )
    df = df.join(prev, ["symbol", "_wn"], "left")
    c, h, l = F.col("close"), F.col("_wh"), F.col("_wl")
    tr = F.greatest(h - l, F.abs(h - F.col("_pc")), F.abs(l - F.col("_pc")))
    df = df.withColumn("_atr", 2.0 / 11 * tr + (1 - 2.0 / 11) * F.col("_pa"))
    ub, lb = (h + l) / 2.0 + 3.0 * F.col("_atr"), (h + l) / 2.0 - 3.0 * F.col("_atr")
    df = df.withColumns(
        {
            "_u": F.when((ub < F.col("_pu")) | (F.col("_pc") > F.col("_pu")), ub).otherwise(F.col("_pu")),
            "_l": F.when((lb > F.col("_pl")) | (F.col("_pc") < F.col("_pl")), lb).otherwise(F.col("_pl")),
            "_mean": 2.0 / 21 * c + (1 - 2.0 / 21) * F.col("_pe"),
        }
    )
    down = F.when(F.col("_ps") == F.col("_pu"), c <= F.col("_u")).otherwise(c < F.col("_l"))
    known = F.col("_wn") >= 14
    df = df.withColumn("weekly_dir", F.when(known, F.when(down, -1).otherwise(1)))
    df = df.withColumn("weekly_trend", F.when(known, _trend_label(c, F.col("_mean"), F.col("weekly_dir"))))
    df = df.withColumn("weekly_ema20", F.when(known, F.col("_mean")))
    return df.drop("_week", "_turn", "_wn", "_wh", "_wl", "_pc", "_pe", "_pa", "_pu", "_pl", "_ps", "_atr", "_u", "_l", "_mean")


def regime_label(above200: Column, above50: Column, strong: Column) -> Column:
    return (
        F.when(above200 & strong & above50, "BULL_TREND")
        .when(above200 & ~strong, "BULL_WEAK")
        .when(~above200 & above50, "RECOVERY")
        .when(~above200 & strong, "BEAR_TREND")
        .otherwise("SIDEWAYS")
    )


def regime_series(index: DataFrame) -> DataFrame:
    """Index regime per bar from the 50/200 means and the ADX."""
    df = ind.compose(index, ind.emas(50, 200), ind.adx())
    df = df.withColumns(
        {
            "above_200": F.col("close") > F.col("e200"),
            "above_50": F.col("close") > F.col("e50"),
            "strong": F.coalesce(F.col("adx") > 25, F.lit(False)),
        }
    )
    return df.withColumn("regime", regime_label(F.col("above_200"), F.col("above_50"), F.col("strong")))


def live_regime(index: DataFrame, vix: Column) -> DataFrame:
    """As :func:`regime_series`, with a volatility override, weekly trend and recent returns."""
    df = regime_series(index)
    df = df.withColumn("above_200", (F.col("rn") >= 199) & F.col("above_200"))
    stressed = F.coalesce(vix > 25, F.lit(False))
    df = df.withColumn(
        "regime",
        F.when(F.col("rn") < 49, "UNKNOWN")
        .when(stressed, "HIGH_VOLATILITY")
        .otherwise(regime_label(F.col("above_200"), F.col("above_50"), F.col("strong"))),
    )
    weeks = with_row_number(weekly_bars(index), "week")
    weeks = ind.compose(weeks, {"means": [span("w_mean", "close", 20)]}).select(
        "symbol", "week", (F.col("rn") + 1).alias("_wn"), F.col("w_mean").alias("_wm")
    )
    turn = F.when(F.date_trunc("week", "date") == lag(F.date_trunc("week", "date")), 0).otherwise(1)
    df = df.withColumn("_turn", turn).withColumn("_wn", running(F.sum, "_turn") - 1)
    df = df.join(weeks.select("symbol", "_wn", "_wm"), ["symbol", "_wn"], "left")
    mean = 2.0 / 21 * F.col("close") + (1 - 2.0 / 21) * F.col("_wm")
    return df.select(
        *[c for c in df.columns if c not in ("_turn", "_wn", "_wm")],
        F.when(F.col("_wn") >= 19, F.when(F.col("close") > mean, "BULLISH").otherwise("BEARISH")).alias("weekly_trend"),
        F.round((F.col("close") / lag("close", 20) - 1.0) * 100.0, 2).alias("return_1m"),
        F.round((F.col("close") / lag("close", 62) - 1.0) * 100.0, 2).alias("return_3m"),
    )


def slope_regime(index: DataFrame) -> DataFrame:
    """Regime from the slope of the normalised 50 mean (finite-history weights)."""
    df = index.withColumn("_one", F.lit(1.0))
    specs = []
    for n in (50, 200):
        # A recursive mean seeded with alpha*x0 instead of x0 equals alpha times
        # the weighted sum; dividing by the same sum of ones normalises it.
        specs += [Ema(f"_v{n}", "close", 2.0 / (n + 1), -1), Ema(f"_w{n}", "_one", 2.0 / (n + 1), -1)]
    df = with_ema(df, specs)
    df = df.withColumns({"m50": F.col("_v50") / F.col("_w50"), "m200": F.col("_v200") / F.col("_w200")})
    df = df.withColumn("slope", (F.col("m50") - lag("m50", 20)) / F.col("m50") * 100.0)
    up50, up200 = F.col("close") > F.col("m50"), F.col("close") > F.col("m200")
    label = (
        F.when(F.col("rn") < 199, "UNKNOWN")
        .when(up200 & up50, F.when(F.col("slope") > 0.5, "BULL_TREND").otherwise("BULL_WEAK"))
        .when(up200, "SIDEWAYS")
        .when(up50, "RECOVERY")
        .otherwise("BEAR_TREND")
    )
    return df.withColumn("regime", label).drop("_one", "_v50", "_w50", "_v200", "_w200")


def stock_regime(df: DataFrame) -> DataFrame:
    """bull / bear / sideways from the 20-bar change of the 200 mean."""
    df = ind.compose(df, ind.emas(200))
    df = df.withColumn("_slope", (F.col("e200") / lag("e200", 20) - 1.0) * 100.0)
    label = F.when(F.col("_slope") > 0.5, "bull").when(F.col("_slope") < -0.5, "bear").otherwise("sideways")
    return df.withColumn("regime", label).drop("_slope")


def trend_label() -> Column:
    up50, up200 = F.col("close") > F.col("e50"), F.col("close") > F.col("e200")
    return (
        F.when(up200 & up50, "UPTREND")
        .when(up200, "PULLBACK IN UPTREND")
        .when(~up50, "DOWNTREND")
        .otherwise("RECOVERY IN DOWNTREND")
    )


STRENGTH_PERIODS = (63, 126, 189, 252)


def index_strength(index: DataFrame) -> DataFrame:
    """Per index date: trailing returns and the last 52 closes (newest last)."""
    cols = [((F.col("close") / lag("close", p - 1) - 1.0) * 100.0).alias(f"_ix{p}") for p in STRENGTH_PERIODS]
    return index.select("date", F.col("rn").alias("_ixn"), *cols, frame_array(F.col("close"), 52).alias("_ix52"))


def with_strength(df: DataFrame, index: DataFrame, bounded: bool = False) -> DataFrame:
    """Relative strength against the index, the 0-100 composite and the 52-bar ratio line.

    Windows count rows on each side, not dates.  The index has one row per
    session; where its caller has counted them (``bounded``) it is broadcast
    and the bars stay where they are, else both sides meet by date.
    """
    df = df.select(
        "*",
        *[((F.col("close") / lag("close", p - 1) - 1.0) * 100.0).alias(f"_r{p}") for p in STRENGTH_PERIODS],
        frame_array(F.col("close"), 52).alias("_c52"),
    )
    sessions = index_strength(index)
    df = df.join(F.broadcast(sessions) if bounded else sessions, "date", "left")
    ex = {p: F.col(f"_r{p}") - F.col(f"_ix{p}") for p in STRENGTH_PERIODS}
    weights = {63: 0.4, 126: 0.2, 189: 0.2, 252: 0.2}
    total = sum(F.when(ex[p].isNotNull(), w).otherwise(0.0) for p, w in weights.items())
    score = sum(F.coalesce(ex[p] * w, F.lit(0.0)) for p, w in weights.items())
    ratio = F.zip_with("_c52", "_ix52", lambda a, b: a / b)
    mean = F.aggregate(ratio, F.lit(0.0), lambda s, x: s + x) / 52.0
    now = F.col("close") / F.element_at("_ix52", -1)
    known = (F.col("rn") >= 59) & (F.col("_ixn") >= 59)
    return df.select(
        *[c for c in df.columns if not c.startswith(("_r", "_ix", "_c52"))],
        F.round(ex[63], 2).alias("rs_vs_index"),
        F.when(
            ex[63].isNotNull(),
            F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50.0 + score / total * 1.25)), 1),
        ).alias("composite_rs"),
        F.when(known, F.round((now - mean) / mean * 100.0, 2)).alias("mansfield_rs"),
    )


def calendar_fill(daily: DataFrame, columns: list[str]) -> DataFrame:
    """Repeat each dated row until the day before the next one.

    One row per calendar day, so a backward as-of lookup becomes an equi-join
    on ``date``.  Meant for one series (an index), bounded by the calendar.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    nxt = F.coalesce(F.date_sub(F.lead("date").over(w), 1), F.date_add("date", 31))
    spans = daily.select(*columns, F.col("date").alias("as_of_date"), nxt.alias("_until"))
    return spans.select(*columns, "as_of_date", F.explode(F.sequence("as_of_date", "_until")).alias("date"))


def as_of_backward(
    left: DataFrame, right: DataFrame, on: str, key: list[str], values: list[str], block: str = "month"
) -> DataFrame:
    """For each left row the newest right row of the same key with ``right.on <= left.on``.

    Rows of both sides are stacked per (key, calendar block), so a key that
    holds a third of all rows is still spread over its blocks.  A row with no
    right row inside its block takes the last one of the blocks before, which
    is looked up in a table of one row per key and block.
    """
    payload = F.struct(*values)
    blk = F.date_trunc(block, on)
    l = left.withColumns({"_side": F.lit(1), "_blk": blk})
    r = right.select(*key, on, F.lit(0).alias("_side"), payload.alias("_payload"), blk.alias("_blk"))
    both = l.unionByName(r, allowMissingColumns=True)
    inside = Window.partitionBy(*key, "_blk").orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_seen", F.last("_payload", ignorenulls=True).over(inside)).where("_side = 1")
    ends = (
        both.groupBy(*key, "_blk")
        .agg(F.max_by("_payload", F.when(F.col("_side") == 0, F.col(on))).alias("_end"))
    )
    earlier = Window.partitionBy(*key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*key, "_blk", F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
    out = seen.join(ends, [*key, "_blk"], "left").withColumn("_seen", F.coalesce("_seen", "_carry"))
    return out.select(*left.columns, *[F.col(f"_seen.{v}").alias(v) for v in values])
