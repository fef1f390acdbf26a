"""Indicators as if each bar's history began a fixed number of bars ago.

Recursive series depend on where they start, so a replay that cuts the
history to a trailing window needs its own values for every bar.  Spark cuts
the bounded frame of each sampled bar (151 or 201 values) out of blocks of
bars and partitions the work; a vectorised kernel then runs the recursions
for all bars of an Arrow batch at once.  Everything that is not recursive
stays in the window layers.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from barloom.functions import indicators as ind, scoring
from barloom.functions.windows import sampled

FIELDS = (
    "e9", "e21", "e50", "e150", "e150_base", "e21_5", "e50_5", "days_above_ema21", "rsi", "macd_hist", "macd_prev",
    "atr", "atr_mean20", "adx", "plus_di", "minus_di", "st_dir", "obv_gap", "obv_turn", "high_max", "low_min",
)


def _mean(x: np.ndarray, alpha: float, seed: int = 0) -> np.ndarray:
    out = np.full_like(x, np.nan)
    out[:, seed] = x[:, seed]
    for j in range(seed + 1, x.shape[1]):
        out[:, j] = alpha * x[:, j] + (1 - alpha) * out[:, j - 1]
    return out


def _masked_mean(x: np.ndarray, alpha: float) -> np.ndarray:
    """Last value of a mean that starts at the first known entry of each row."""
    now = x[:, 0].copy()
    for j in range(1, x.shape[1]):
        v = x[:, j]
        now = np.where(np.isnan(now), v, np.where(np.isnan(v), now, alpha * v + (1 - alpha) * now))
    return now


def _direction(h: np.ndarray, l: np.ndarray, c: np.ndarray, tr: np.ndarray) -> np.ndarray:
    mid, width = (h + l) / 2, 3.0 * _mean(tr, 2 / 11)
    ub, lb = mid + width, mid - width
    up, lo = ub[:, 0], lb[:, 0]
    line, on_upper = up, np.ones(len(h), bool)
    down = on_upper.copy()
    for j in range(1, h.shape[1]):
        pc = c[:, j - 1]
        on_upper = line == up
        up = np.where((ub[:, j] < up) | (pc > up), ub[:, j], up)
        lo = np.where((lb[:, j] > lo) | (pc < lo), lb[:, j], lo)
        down = np.where(on_upper, c[:, j] <= up, c[:, j] < lo)
        line = np.where(down, up, lo)
    return np.where(down, -1.0, 1.0)


def kernel(h: np.ndarray, l: np.ndarray, c: np.ndarray, v: np.ndarray) -> pd.DataFrame:
    """Last-bar values of every recursive indicator; rows are bars, columns the window."""
    n = c.shape[1]
    chg = np.diff(c, axis=1, prepend=np.nan)
    pc = np.concatenate([c[:, :1], c[:, :-1]], axis=1)
    tr = np.maximum(h - l, np.maximum(np.abs(h - pc), np.abs(l - pc)))
    e21, e50, e150 = _mean(c, 2 / 22), _mean(c, 2 / 51), _mean(c, 2 / 151)
    macd = _mean(c, 2 / 13) - _mean(c, 2 / 27)
    hist = macd - _mean(macd, 2 / 10)
    gain, loss = (_mean(np.maximum(s * chg, 0), 1 / 14, 1)[:, -1] for s in (1, -1))
    with np.errstate(divide="ignore", invalid="ignore"):
        rsi = np.where(loss == 0, np.where(gain > 0, 100.0, 50.0), 100 - 100 / (1 + gain / loss))
    atr = _mean(tr, 1 / 14)
    up = np.diff(h, axis=1, prepend=h[:, :1])
    dn = -np.diff(l, axis=1, prepend=l[:, :1])
    pdm, mdm = np.where((up > dn) & (up > 0), up, 0.0), np.where((dn > up) & (dn > 0), dn, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        pdi, mdi = 100 * _mean(pdm, 1 / 14) / atr, 100 * _mean(mdm, 1 / 14) / atr
        dx = np.where(pdi + mdi != 0, 100 * np.abs(pdi - mdi) / (pdi + mdi), np.nan)
    obv = np.cumsum(np.sign(np.nan_to_num(chg)) * v, axis=1)
    obv_mean = _mean(obv, 2 / 21)
    above = c > e21
    back = min(31, n)
    streak = np.cumprod(above[:, ::-1][:, :back], axis=1).sum(axis=1)
    return pd.DataFrame(
        {
            "e9": _mean(c, 2 / 10)[:, -1], "e21": e21[:, -1], "e50": e50[:, -1], "e150": e150[:, -1], "e150_base": e150[:, -21],
            "e21_5": e21[:, -6], "e50_5": e50[:, -6], "days_above_ema21": streak.astype(float), "rsi": rsi, "macd_hist": hist[:, -1],
            "macd_prev": hist[:, -2], "atr": atr[:, -1], "atr_mean20": atr[:, -20:].mean(axis=1), "adx": _masked_mean(dx, 1 / 14),
            "plus_di": pdi[:, -1], "minus_di": mdi[:, -1], "st_dir": _direction(h, l, c, tr), "obv_gap": obv[:, -1] - obv_mean[:, -1],
            "obv_turn": obv_mean[:, -1] - obv_mean[:, -2], "high_max": h.max(axis=1), "low_min": l.min(axis=1),
        }
    )[list(FIELDS)]


#: Bars that a live signal is seeded with, and its verdicts from the least points down.
LIVE_BARS = 50
VERDICTS = ((4, "STRONG BUY"), (2, "BUY"), (-1, "NEUTRAL / WAIT"), (-3, "SELL / AVOID"))


def live_points(h: np.ndarray, l: np.ndarray, c: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Base points of the last bar of each row of ``LIVE_BARS`` bars, as if the series had begun with the row's first."""
    k = kernel(h, l, c, v)
    e9, e21, e50, rsi, hist, before = (k[x].to_numpy() for x in ("e9", "e21", "e50", "rsi", "macd_hist", "macd_prev"))
    m9, m21 = _mean(c, 2 / 10)[:, -2], _mean(c, 2 / 22)[:, -2]
    macd = (_mean(c, 2 / 13) - _mean(c, 2 / 27))
    signal = _mean(macd, 2 / 10)[:, -1]
    macd = macd[:, -1]
    last = c[:, -20:]
    mid, sd = last.mean(axis=1), last.std(axis=1, ddof=1)
    v20 = v[:, -20:].mean(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        heavy = np.where(v20 != 0, v[:, -1] / v20, np.nan) > 1.5
    points = (
        2 * ((e9 > e21) & (e21 > e50)) - 2 * ((e9 < e21) & (e21 < e50)) + 3 * ((m9 < m21) & (e9 > e21)) - 3 * ((m9 > m21) & (e9 < e21))
        + 2 * ((before < 0) & (hist > 0)) - 2 * ((before > 0) & (hist < 0)) + ((macd > signal) & (macd > 0))
        + 2 * (rsi < 35) - 2 * (rsi > 65) + ((rsi > 45) & (rsi < 60))
    )
    return points + (heavy & (points > 0)) - (heavy & (points < 0)) + (c[:, -1] < mid - 2 * sd)


def live_verdict(points: int) -> str:
    return next((name for least, name in VERDICTS if points >= least), "STRONG SELL / SHORT")


# Ship the kernel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: Windows that go through the kernel at once: it holds some dozens of tables of their size.
WINDOWS = 1 << 9


def in_slices(parts: tuple[pd.Series, ...]) -> pd.DataFrame:
    """The kernel's values of a batch of windows, a slice at a time; a window's values do not depend on the others."""
    slices = ((p.to_numpy()[i : i + WINDOWS] for p in parts) for i in range(0, len(parts[0]), WINDOWS))
    return pd.concat([kernel(*(np.stack(x).astype(float) for x in own)) for own in slices], ignore_index=True)


@F.pandas_udf(T.StructType([T.StructField(f, T.DoubleType()) for f in FIELDS]))
def _window_values(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    for parts in batches:
        yield in_slices(parts)


def replay_inputs(bars: DataFrame, back: int, start: int, step: int, tail: int, path: str | None = None, ahead: int = 0) -> DataFrame:
    """Score inputs on every ``step``-th bar from ``start``, seeded ``back`` bars earlier, and the next ``ahead`` bars as ``path``.

    Only sampled bars with a full window get frames and reach Python.
    ``tail`` bars at the end of a series are left out (their outcome is not
    known yet).
    """
    c = F.col
    df = ind.compose(bars, ind.ichimoku(), ind.volume_average(), ind.pivots(), {"a": {"v5": ind.roll(F.avg, "volume", 5)}})
    df = df.withColumn("_ahead", F.lead("close", tail).over(ind.by_symbol()))
    first = max(start, back)
    df = df.withColumn("_pick", (c("rn") >= first) & ((c("rn") - first) % step == 0) & c("_ahead").isNotNull()).drop("_ahead")
    values = ("high", "low", "close", "volume")
    df = sampled(df, "_pick", values, back, ahead, path or "path")
    df = df.withColumn("_x", _window_values("_w_high", "_w_low", "_w_close", "_w_volume")).drop(*[f"_w_{v}" for v in values])
    x = lambda name: c(f"_x.{name}")
    rnd = scoring.rnd
    df = df.select(
        *[n for n in df.columns if n != "_x"],
        rnd("close", 2).alias("r_close"), rnd(x("e9"), 2).alias("r_ema9"), rnd(x("e21"), 2).alias("r_ema21"), rnd(x("e50"), 2).alias("r_ema50"),
        rnd(x("rsi"), 1).alias("r_rsi"), rnd(x("macd_hist"), 4).alias("r_macd_hist"), rnd(x("macd_prev"), 4).alias("r_macd_prev"),
        rnd("vol_ratio", 2).alias("r_vol_ratio"), rnd(x("atr"), 2).alias("r_atr"),
        F.when(~F.isnan(x("adx")), x("adx")).alias("adx"), x("plus_di").alias("plus_di"), x("minus_di").alias("minus_di"),
        F.round((x("e21") - x("e21_5")) / x("e21_5") * 100.0, 3).alias("ema21_slope"),
        F.round((x("e50") - x("e50_5")) / x("e50_5") * 100.0, 3).alias("ema50_slope"),
        F.round((c("close") - x("e50")) / x("e50") * 100.0, 2).alias("ema50_dist_pct"),
        x("days_above_ema21").cast("long").alias("days_above_ema21"), x("st_dir").cast("int").alias("st_dir"),
        F.when((x("obv_gap") > 0) & (x("obv_turn") > 0), "RISING").when((x("obv_gap") < 0) & (x("obv_turn") < 0), "FALLING").otherwise("NEUTRAL").alias("obv_trend"),
        F.round(F.try_divide(x("atr"), x("atr_mean20")), 2).alias("atr_ratio"),
        ((c("v20") > 0) & (c("v5") < c("v20") * 0.8)).alias("vol_dryup"),
        ((c("close") - x("high_max")) / x("high_max") * 100.0).alias("near_high_pct"),
        x("e50").alias("e50"),
        scoring.rnd(c("close") - 1.5 * x("atr"), 2).alias("sl_base"), scoring.rnd(c("close") + 2.0 * x("atr"), 2).alias("t1_base"),
        scoring.rnd(c("close") + 3.5 * x("atr"), 2).alias("t2_base"),
        *_stage_inputs(x),
    )
    return df.withColumns({"stage": _stage(), "breakout_watch": ind.breakout_watch()})


def _stage_inputs(x) -> list:
    return [x("e150").alias("e150"), ((x("e150") - x("e150_base")) / x("e150_base") * 100.0).alias("e150_slope")]


def _stage():
    c = F.col
    above150, stacked = c("close") > c("e150"), c("e50") > c("e150")
    rising = c("e150_slope") > 0.3
    return (
        F.when(above150 & (c("close") > c("e50")) & stacked & rising, 2).when(~above150 & (c("e150_slope") < -0.3), 4)
        .when(above150 & (~rising | ~stacked), 3).otherwise(1)
    )
