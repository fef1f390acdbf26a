"""Evaluation reports: grouped statistics over trades and signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.operators.ranking import exact_quantiles


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def trade_cells(trades: DataFrame, keys: Sequence[str], min_n: int = 10) -> DataFrame:
    """Hit rates, win/loss averages, profit factor and expectancy per cell."""
    ret = F.col("ret")
    win, loss = F.when(ret > 0, ret), F.when(ret <= 0, ret)
    out = trades.groupBy(*keys).agg(
        F.count("*").alias("sample_count"),
        F.avg(F.when(F.col("outcome") == "t1", 100.0).otherwise(0.0)).alias("t1_hit_rate"),
        F.avg(F.when(F.col("outcome") == "sl", 100.0).otherwise(0.0)).alias("sl_hit_rate"),
        F.avg(F.when(F.col("outcome") == "timeout", 100.0).otherwise(0.0)).alias("timeout_rate"),
        F.avg(F.when(ret > 0, 100.0).otherwise(0.0)).alias("win_rate"),
        F.coalesce(F.avg(win), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(loss), F.lit(0.0)).alias("avg_loss"),
        F.avg("mae").alias("avg_mae"),
        F.avg("mfe").alias("avg_mfe"),
        safe_div(F.coalesce(F.sum(win), F.lit(0.0)), F.abs(F.sum(loss))).alias("profit_factor"),
        F.avg(ret).alias("avg_return"),
    )
    share = F.col("win_rate") / 100.0
    out = out.withColumn("expectancy", share * F.col("avg_win") + (1.0 - share) * F.col("avg_loss"))
    enough = F.col("sample_count") >= min_n
    figures = [c for c in out.columns if c not in (*keys, "sample_count")]
    return out.select(
        *keys, "sample_count", *[F.when(enough, F.col(c)).alias(c) for c in figures], (~enough).alias("insufficient_data")
    )


def losing_streak(trades: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Longest run of non-positive returns in order, per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    runs = trades.withColumn("_run", F.sum(F.when(F.col("ret") > 0, 1).otherwise(0)).over(w))
    lengths = runs.where(F.col("ret") <= 0).groupBy(*keys, "_run").agg(F.count("*").alias("_n"))
    longest = lengths.groupBy(*keys).agg(F.max("_n").alias("max_consec_loss"))
    return (
        trades.select(*keys)
        .distinct()
        .join(longest, list(keys), "left")
        .withColumn("max_consec_loss", F.coalesce("max_consec_loss", F.lit(0)))
    )


def strategy_stats(trades: DataFrame, keys: Sequence[str], order: str, hold: int = 5, min_trades: int = 10) -> DataFrame:
    """Per-key win rate, Sharpe, profit factor, drawdown and the split by regime."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    t = trades.withColumn("_cum", F.sum("ret").over(w))
    t = t.withColumn("_dd", F.max("_cum").over(w) - F.col("_cum"))
    ret = F.col("ret")
    win, loss = F.when(ret > 0, ret), F.when(ret <= 0, ret)
    aggs = [
        F.count("*").alias("trade_count"),
        F.count(win).alias("wins"),
        F.count(loss).alias("losses"),
        F.avg(ret).alias("avg_return"),
        F.stddev_pop(ret).alias("_sd"),
        safe_div(F.coalesce(F.sum(win), F.lit(0.0)), F.abs(F.sum(loss))).alias("profit_factor"),
        F.max("_dd").alias("max_drawdown"),
    ]
    for r in ("bull", "bear", "sideways"):
        mine = F.when(F.col("regime") == r, ret)
        n = F.count(mine)
        aggs += [
            n.alias(f"{r}_n"),
            F.when(n >= 3, F.avg(F.when(mine > 0, 100.0).when(mine <= 0, 0.0))).alias(f"{r}_win_rate"),
            F.when(n >= 3, F.avg(mine)).alias(f"{r}_avg"),
        ]
    out = t.groupBy(*keys).agg(*aggs).where(F.col("trade_count") >= min_trades)
    return out.withColumn("win_rate", F.col("wins") / F.col("trade_count") * 100.0).withColumn(
        "sharpe", F.when(F.col("_sd") > 0, F.col("avg_return") / F.col("_sd") * F.sqrt(F.lit(252.0 / hold)))
    ).drop("_sd")


def across_symbols(stats: DataFrame, by: str = "strategy") -> DataFrame:
    """Second level: mean and median of the per-symbol figures, ranked."""
    aggs = [
        F.count("*").alias("symbol_count"),
        F.sum("trade_count").alias("total_trades"),
        F.avg("win_rate").alias("avg_win_rate"),
        F.avg("avg_return").alias("avg_return"),
        F.avg("sharpe").alias("avg_sharpe"),
        F.avg("profit_factor").alias("avg_profit_factor"),
        F.avg("max_drawdown").alias("avg_max_drawdown"),
    ]
    for r in ("bull", "bear", "sideways"):
        aggs += [F.avg(f"{r}_win_rate").alias(f"{r}_win_rate"), F.avg(f"{r}_avg").alias(f"{r}_avg")]
    mid = exact_quantiles(stats, [by], "win_rate", {"median_win_rate": 0.5})
    out = stats.groupBy(by).agg(*aggs).join(mid, by)
    # One row per strategy: the ordering window is as small as the registry.
    w = Window.partitionBy(F.lit(0)).orderBy(
        F.coalesce("avg_sharpe", F.lit(0.0)).desc(), F.coalesce("avg_return", F.lit(0.0)).desc(), by
    )
    return out.withColumn("position", F.row_number().over(w))


def exit_report(swept: DataFrame, keys: Sequence[str] = ("variant", "direction"), min_n: int = 50) -> DataFrame:
    """Mean, median, win rate, profit factor, Sharpe and capture per exit rule."""
    ret = F.col("ret")
    win, loss = F.when(ret > 0, ret), F.when(ret <= 0, ret)
    out = (
        swept.groupBy(*keys)
        .agg(
            F.count("*").alias("n"),
            F.avg(ret).alias("avg_ret"),
            F.avg(F.when(ret > 0, 100.0).otherwise(0.0)).alias("win_rate"),
            safe_div(F.coalesce(F.sum(win), F.lit(0.0)), F.abs(F.sum(loss))).alias("profit_factor"),
            F.stddev_pop(ret).alias("_sd"),
            F.max("hold").alias("hold"),
        )
        .where(F.col("n") >= min_n)
        .withColumn("sharpe", F.when(F.col("_sd") > 0, F.col("avg_ret") / F.col("_sd") * F.sqrt(252.0 / F.col("hold"))))
        .drop("_sd")
    )
    mid = exact_quantiles(swept, list(keys), "ret", {"median_ret": 0.5})
    capture = swept.where(F.col("mfe") > 0.5).withColumn("capture", ret / F.col("mfe") * 100.0)
    cap = exact_quantiles(capture, list(keys), "capture", {"median_capture": 0.5})
    return out.join(mid, list(keys)).join(cap, list(keys), "left")
