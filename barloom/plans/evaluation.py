"""Evaluation pipelines over re-seeded replays, and the intraday scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from barloom.functions import market, outcomes, scoring
from barloom.functions.reseeded import replay_inputs
from barloom.functions.windows import with_row_number
from barloom.operators import reports
from barloom.operators.segmented import Scan, scan

BUCKETS = ("BASELINE", "50-60", "60-70", "70-80", "80+")


def expectancy_trades(bars: DataFrame, context: DataFrame, bounded: bool = False) -> DataFrame:
    """Sampled bars with the regime of their date, a five-bar trade and a score bucket."""
    c = F.col
    df = replay_inputs(bars, back=150, start=150, step=3, tail=5, path="_fwd", ahead=5)
    sessions = context.select("date", "regime", "above_200", "above_50")
    df = df.join(F.broadcast(sessions) if bounded else sessions, "date")
    df = scoring.with_trade_levels(df)
    df = scoring.with_score(df).where((c("sl_buy") < c("close")) & (c("close") > 0))
    df = outcomes.with_path_trade(df, "_fwd", "sl_buy", "target1", False).where(c("entry").isNotNull())
    return df.select("symbol", "date", "regime", "score100", scoring.score_bucket(c("score100")).alias("bucket"), "outcome", "ret", "mae", "mfe")


def expectancy_table(trades: DataFrame) -> DataFrame:
    """Regime x score cells with their regime's unfiltered baseline; empty cells are listed."""
    c = F.col
    both = trades.withColumn("score_bucket", F.explode(F.array_compact(F.array(F.lit("BASELINE"), "bucket"))))
    cells = reports.trade_cells(both, ["regime", "score_bucket"])
    spark = trades.sparkSession
    grid = spark.createDataFrame([(r, b) for r in market.REGIMES for b in BUCKETS], "regime string, score_bucket string")
    base = cells.where("score_bucket = 'BASELINE'").select("regime", c("avg_return").alias("_br"), c("profit_factor").alias("_bp"))
    df = grid.join(cells, ["regime", "score_bucket"], "left").join(base, "regime", "left")
    other = c("score_bucket") != "BASELINE"
    return df.select(
        *[x for x in cells.columns if x not in ("sample_count", "insufficient_data")],
        F.coalesce("sample_count", F.lit(0)).alias("sample_count"), F.coalesce("insufficient_data", F.lit(True)).alias("insufficient_data"),
        F.when(other, c("avg_return") - c("_br")).alias("edge_vs_baseline"), F.when(other & (c("_bp") != 0), c("profit_factor") - c("_bp")).alias("pf_vs_baseline"),
    )


def captured_signals(bars: DataFrame, min_score: int = 50) -> DataFrame:
    """Every fifth bar scoring at least ``min_score`` on a 201-bar history, with its forward path."""
    c = F.col
    df = replay_inputs(bars, back=200, start=200, step=5, tail=64, path="path", ahead=63)
    df = scoring.with_score(scoring.with_trade_levels(df))
    return df.where((c("score100") >= min_score) & (c("r_atr") > 0)).select(
        "symbol", "date", c("score100").alias("score"), F.element_at("path", 1)["open"].alias("entry"), c("r_atr").alias("atr"),
        c("sl_buy").alias("sl"), c("target1").alias("t1"), "path",
    )


def session_vwap(ticks: DataFrame) -> DataFrame:
    """Volume-weighted price at every tick, restarted each day; the sums are scanned over blocks of ticks."""
    c = F.col
    df = ticks.withColumn("_day", F.to_date("ts"))
    sums = [Scan("_pv", "sum", c("price") * c("volume")), Scan("_v", "sum", c("volume"))]
    df = scan(df, ["symbol", "_day"], [c("ts"), c("event_id")], sums)
    return df.withColumn("vwap", F.when(c("_v") != 0, F.try_divide("_pv", "_v"))).drop("_day", "_pv", "_v")


def intraday_bars(ticks: DataFrame, width: str = "15 minutes") -> DataFrame:
    at = F.struct("ts", "event_id")
    g = ticks.groupBy("symbol", F.window(F.col("ts").cast("timestamp"), width).alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"),
    )
    return g.select("symbol", F.col("w.start").alias("ts"), F.to_date("w.start").alias("date"), "open", "high", "low", "close", "volume")


def intraday_scan(ticks: DataFrame, sessions: int = 5, min_bars: int = 10) -> DataFrame:
    """Newest 15-minute bar of each symbol over its last sessions, with signal points and the session VWAP."""
    c = F.col
    bars = intraday_bars(ticks)
    days = bars.select("symbol", "date").distinct()
    w = Window.partitionBy("symbol").orderBy(c("date").desc())
    recent = days.withColumn("_d", F.row_number().over(w)).where(c("_d") <= sessions).drop("_d")
    df = with_row_number(bars.join(recent, ["symbol", "date"], "left_semi"), "ts")
    day = Window.partitionBy("symbol", "date").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    tp = (c("high") + c("low") + c("close")) / 3.0
    df = df.withColumn("vwap", F.try_divide(F.sum(tp * c("volume")).over(day), F.nullif(F.sum("volume").over(day), F.lit(0.0))))
    df = scoring.with_base_signal(scoring.with_technicals(df))
    df = scoring.with_context_defaults(df)
    df = scoring.with_indicator_points(df)
    points = c("ind_points") + F.when(c("close") > c("vwap"), 1).when(c("vwap").isNotNull(), -1).otherwise(0)
    keep = df.select("symbol", "rn", "ts", "close", "vwap", points.alias("points"), c("base_verdict").alias("verdict"))
    last = keep.groupBy("symbol").agg(F.max_by(F.struct("rn", "ts", "close", "vwap", "points", "verdict"), "rn").alias("x"))
    return last.where(c("x.rn") >= min_bars - 1).select("symbol", "x.ts", "x.close", "x.vwap", "x.points", "x.verdict")
