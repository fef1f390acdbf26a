"""Technical indicators as layers of window columns.

An indicator is a dict from a stage to the columns (or recursive means) that
stage adds.  Stages exist because a window function cannot read another
window function of the same ``select``; :func:`compose` merges the stages of
all requested indicators so that they share one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions.windows import (
    STRIDE, Long, by_symbol, first_seen, frame_array, lag, nonzero, roll, running, span, strided, wilder, with_ema, with_long,
)

STAGES = ("first", "long", "a", "b", "means", "c", "d", "means2", "e", "f", "g")
Layer = dict[str, "dict[str, Column] | list[Ema] | list[Long]"]


def compose(df: DataFrame, *layers: Layer) -> DataFrame:
    have = set(df.columns)
    for stage in STAGES:
        if stage.startswith("means") or stage == "long":
            items = {m.out: m for layer in layers for m in layer.get(stage, []) if m.out not in have}
            if items:
                df = (with_long if stage == "long" else with_ema)(df, list(items.values()))
                have.update(items)
            continue
        cols: dict[str, Column] = {}
        for layer in layers:
            cols.update(layer.get(stage, {}))
        cols = {k: v for k, v in cols.items() if k not in have}
        if cols:
            df = df.select("*", *[v.alias(k) for k, v in cols.items()])
            have.update(cols)
    return df


def _c(name: str) -> Column:
    return F.col(name)


def emas(*spans: int) -> Layer:
    return {"means": [span(f"e{n}", "close", n) for n in spans]}


def smas(*sizes: int) -> Layer:
    return {"long": [Long(f"s{n}", "close", n, "avg") for n in sizes]}


def before(*names: str) -> dict[str, Column]:
    """Readings of the bar before, as columns that every layer shares: each lag in an expression is a window of its own otherwise."""
    return {f"_l_{x}": lag(x) for x in names}


def _tr() -> Column:
    return F.greatest(
        _c("high") - _c("low"), F.abs(_c("high") - _c("_l_close")), F.abs(_c("low") - _c("_l_close"))
    )


def atr(*sizes: int) -> Layer:
    return {"first": before("close"), "a": {"tr": _tr()}, "means": [wilder(f"atr{n}", "tr", n) for n in sizes]}


def rsi() -> Layer:
    """Both forms: ``rsi`` (100 without losses, 50 when flat) and ``rsi_raw`` (null then)."""
    chg = _c("close") - _c("_l_close")
    g, l = _c("rsi_gain"), _c("rsi_loss")
    raw = 100.0 - 100.0 / (1.0 + g / nonzero(l))
    return {
        "first": before("close"),
        "a": {
            "gain": F.when(chg.isNotNull(), F.greatest(chg, F.lit(0.0))),
            "loss": F.when(chg.isNotNull(), F.greatest(-chg, F.lit(0.0))),
        },
        "means": [wilder("rsi_gain", "gain", 14, 1), wilder("rsi_loss", "loss", 14, 1)],
        "c": {
            "rsi_raw": raw,
            "rsi": F.when((l == 0) & (g > 0), 100.0).when((l == 0) & (g == 0), 50.0).otherwise(raw),
        },
    }


def rsi_simple() -> Layer:
    chg = _c("close") - _c("_l_close")
    up, down = roll(F.avg, "gain", 14), roll(F.avg, "loss", 14)
    return {
        "first": before("close"),
        "a": {
            "gain": F.when(chg.isNotNull(), F.greatest(chg, F.lit(0.0))),
            "loss": F.when(chg.isNotNull(), F.greatest(-chg, F.lit(0.0))),
        },
        "b": {"gain14": up, "loss14": down},
        "c": {
            "rsi_simple": F.when(_c("loss14") == 0, 100.0).otherwise(
                100.0 - 100.0 / (1.0 + _c("gain14") / _c("loss14"))
            )
        },
    }


def macd() -> Layer:
    return {
        "means": [span("e12", "close", 12), span("e26", "close", 26)],
        "c": {"macd": _c("e12") - _c("e26")},
        "means2": [span("macd_signal", "macd", 9)],
        "e": {"macd_hist": _c("macd") - _c("macd_signal")},
    }


def bollinger() -> Layer:
    return {
        "a": {"bb_mid": roll(F.avg, "close", 20), "bb_sd": roll(F.stddev_samp, "close", 20)},
        "b": {
            "bb_upper": _c("bb_mid") + 2.0 * _c("bb_sd"),
            "bb_lower": _c("bb_mid") - 2.0 * _c("bb_sd"),
            "bb_width": 4.0 * _c("bb_sd") / nonzero(_c("bb_mid")),
        },
    }


def typical() -> Column:
    return (_c("high") + _c("low") + _c("close")) / 3.0


def cci() -> Layer:
    mad = F.aggregate("tp20", F.lit(0.0), lambda s, x: s + F.abs(x - _c("tp_mean"))) / 20.0
    return {
        # Done before the means, so that their windows do not carry the array.
        "first": {"tp": typical()},
        "a": {"tp_mean": roll(F.avg, "tp", 20), "tp20": frame_array(_c("tp"), 20)},
        "b": {"cci": (_c("tp") - _c("tp_mean")) / (0.015 * nonzero(mad))},
    }


def vwap_proxy() -> Layer:
    return {"a": {"vwap20": roll(F.sum, _c("close") * _c("volume"), 20) / roll(F.sum, "volume", 20)}}


def stochastic() -> Layer:
    k = 100.0 * (_c("close") - _c("lo14")) / nonzero(_c("hi14") - _c("lo14"))
    return {
        "a": {"hi14": roll(F.max, "high", 14), "lo14": roll(F.min, "low", 14)},
        "b": {"stoch_k": k},
        "c": {"stoch_d": roll(F.avg, "stoch_k", 3)},
    }


def williams() -> Layer:
    return {
        "a": {"hi14": roll(F.max, "high", 14), "lo14": roll(F.min, "low", 14)},
        "b": {"williams_r": -100.0 * (_c("hi14") - _c("close")) / nonzero(_c("hi14") - _c("lo14"))},
    }


def adx() -> Layer:
    """``adx`` leaves bars without any movement unknown, ``adx_zero`` counts them as 0."""
    up, down = _c("high") - _c("_l_high"), _c("_l_low") - _c("low")
    p, m = 100.0 * _c("pdm_mean") / nonzero(_c("atr14")), 100.0 * _c("mdm_mean") / nonzero(_c("atr14"))
    dx = 100.0 * F.abs(_c("plus_di") - _c("minus_di")) / nonzero(_c("plus_di") + _c("minus_di"))
    return {
        "first": before("high", "low", "close"),
        "a": {
            "tr": _tr(),
            "pdm": F.when((up > down) & (up > 0), up).otherwise(0.0),
            "mdm": F.when((down > up) & (down > 0), down).otherwise(0.0),
        },
        "means": [wilder("atr14", "tr", 14), wilder("pdm_mean", "pdm", 14), wilder("mdm_mean", "mdm", 14)],
        "c": {"plus_di": p, "minus_di": m},
        "d": {"dx": dx, "dx0": F.coalesce(dx, F.lit(0.0)), "dx_seed": first_seen(dx)},
        "means2": [wilder("adx", "dx", 14, "dx_seed"), wilder("adx_zero", "dx0", 14)],
    }


def ichimoku() -> Layer:
    def mid(n: int) -> Column:
        if n < STRIDE:
            return (roll(F.max, "high", n) + roll(F.min, "low", n)) / 2.0
        return (strided("greatest", "_hi16", n) + strided("least", "_lo16", n)) / 2.0

    a, b, t, k = _c("senkou_a"), _c("senkou_b"), _c("tenkan"), _c("kijun")
    known = (a != 0) & (b != 0)
    top, bottom = F.when(known, F.greatest(a, b)), F.when(known, F.least(a, b))
    above, below = _c("close") > nonzero(_c("cloud_top")), _c("close") < nonzero(_c("cloud_bottom"))
    tk = (t != 0) & (k != 0)
    return {
        "first": {"_hi16": roll(F.max, "high", STRIDE), "_lo16": roll(F.min, "low", STRIDE)},
        "a": {"tenkan": mid(9), "kijun": mid(26), "span52": mid(52)},
        "b": {"senkou_a": lag((t + k) / 2.0, 26), "senkou_b": lag("span52", 26)},
        "c": {"cloud_top": top, "cloud_bottom": bottom, "cloud_green": F.when(known, a > b)},
        "d": {
            "ichimoku_signal": F.when(_c("rn") < 51, F.lit(None).cast("string"))
            .when(above & tk & (t > k) & _c("cloud_green"), "BULLISH")
            .when(below & tk & (t < k) & ~_c("cloud_green"), "BEARISH")
            .when(above, "WEAK_BULL")
            .when(below, "WEAK_BEAR")
            .otherwise("NEUTRAL")
        },
    }


def stoch_rsi() -> Layer:
    base = dict(rsi())
    base["d"] = {"rsi_hi": roll(F.max, "rsi", 14), "rsi_lo": roll(F.min, "rsi", 14)}
    base["e"] = {"srsi": 100.0 * (_c("rsi") - _c("rsi_lo")) / nonzero(_c("rsi_hi") - _c("rsi_lo"))}
    base["f"] = {"srsi_k": roll(F.avg, "srsi", 3)}
    base["g"] = {"srsi_d": roll(F.avg, "srsi_k", 3)}
    return base


def obv() -> Layer:
    return {
        "first": before("close"),
        "a": {"obv_step": F.coalesce(F.signum(_c("close") - _c("_l_close")), F.lit(0.0)) * _c("volume")},
        "b": {"obv": running(F.sum, "obv_step")},
        "means": [span("obv_ema", "obv", 20)],
        "c": {
            "obv_trend": F.when((_c("obv") > _c("obv_ema")) & (_c("obv_ema") > lag("obv_ema")), "RISING")
            .when((_c("obv") < _c("obv_ema")) & (_c("obv_ema") < lag("obv_ema")), "FALLING")
            .otherwise("NEUTRAL")
        },
    }


def mfi() -> Layer:
    return {
        "a": {"tp": typical()},
        "b": {
            "flow_up": F.when(_c("tp") > lag("tp"), _c("tp") * _c("volume")).otherwise(0.0),
            "flow_down": F.when(_c("tp") < lag("tp"), _c("tp") * _c("volume")).otherwise(0.0),
        },
        "c": {
            "mfi": 100.0
            - 100.0 / (1.0 + roll(F.sum, "flow_up", 14) / nonzero(roll(F.sum, "flow_down", 14)))
        },
    }


def keltner() -> Layer:
    return {
        "first": before("close"),
        "a": {"tr": _tr()},
        "means": [span("e20", "close", 20), wilder("atr20", "tr", 20)],
        "c": {
            "kc_upper": _c("e20") + 2.0 * _c("atr20"),
            "kc_lower": _c("e20") - 2.0 * _c("atr20"),
            "kc15_upper": _c("e20") + 1.5 * _c("atr20"),
            "kc15_lower": _c("e20") - 1.5 * _c("atr20"),
        },
    }


def highs(*sizes: int) -> Layer:
    return {"long": [Long(f"hh{n}", "high", n, "max") for n in sizes]}


def lows(*sizes: int) -> Layer:
    return {"long": [Long(f"ll{n}", "low", n, "min") for n in sizes]}


def cmf() -> Layer:
    rng = nonzero(_c("high") - _c("low"))
    mfv = ((_c("close") - _c("low")) - (_c("high") - _c("close"))) / rng * _c("volume")
    return {
        "a": {"mfv": mfv},
        "b": {"cmf": roll(F.sum, "mfv", 20) / nonzero(roll(F.sum, "volume", 20))},
    }


def roc(n: int = 20) -> Layer:
    return {"a": {f"roc{n}": (_c("close") / lag("close", n) - 1.0) * 100.0}}


def volume_average() -> Layer:
    return {"a": {"v20": roll(F.avg, "volume", 20)}, "b": {"vol_ratio": _c("volume") / nonzero(_c("v20"))}}


def pivots() -> Layer:
    """Classic pivot levels and the central range from the previous bar."""
    h, l, c = _c("_l_high"), _c("_l_low"), _c("_l_close")
    pp = (h + l + c) / 3.0
    return {
        "first": before("high", "low", "close"),
        "a": {"pivot": pp, "prev_high": h, "prev_low": l, "cpr_top": (h + l) / 2.0},
        "b": {
            "resistance": 2.0 * _c("pivot") - _c("prev_low"),
            "resistance2": _c("pivot") + (_c("prev_high") - _c("prev_low")),
            "support": 2.0 * _c("pivot") - _c("prev_high"),
            "support2": _c("pivot") - (_c("prev_high") - _c("prev_low")),
            "cpr_bottom": 2.0 * _c("pivot") - _c("cpr_top"),
        },
        "c": {"cpr_width_pct": F.abs(_c("cpr_top") - _c("cpr_bottom")) / _c("pivot") * 100.0},
        "d": {"cpr_narrow": _c("cpr_width_pct") < 0.5},
    }


def year_range() -> Layer:
    return {
        "long": [Long("high_52w", "high", 252, "max", False), Long("low_52w", "low", 252, "min", False)],
        "b": {
            "near_high_pct": (_c("close") - _c("high_52w")) / _c("high_52w") * 100.0,
            "near_low_pct": (_c("close") - _c("low_52w")) / _c("low_52w") * 100.0,
        },
    }


def stage() -> Layer:
    """Stage 1-4 from the 50/150 means and the slope of the slower one."""
    slope = (_c("e150") - _c("e150_base")) / _c("e150_base") * 100.0
    above150, above50 = _c("close") > _c("e150"), _c("close") > _c("e50")
    rising, falling, s = _c("e150_slope") > 0.3, _c("e150_slope") < -0.3, _c("e150_slope")
    stacked = _c("e50") > _c("e150")
    n = F.when(above150 & above50 & stacked & rising, 2).when(~above150 & falling, 4)
    n = n.when(above150 & (~rising | ~stacked), 3).otherwise(1)
    late = (F.round("near_low_pct", 1) > 25) & (F.abs(s) < 0.5)
    base = dict(year_range())
    base["means"] = [span("e50", "close", 50), span("e150", "close", 150)]
    base["c"] = {"e150_base": F.coalesce(lag("e150", 20), F.first("e150").over(by_symbol()))}
    base["d"] = {"e150_slope": slope}
    base["e"] = {"stage": F.when(_c("rn") < 29, 0).otherwise(n)}
    base["f"] = {"late_base": (_c("stage") == 1) & late}
    return base


def slopes() -> Layer:
    """Five-bar slopes, distance to the 50 mean and the streak above the 21 mean."""
    pct = lambda e: (_c(e) - lag(e, 5)) / lag(e, 5) * 100.0
    broken = running(F.max, F.when(~(_c("close") > _c("e21")), _c("rn")))
    return {
        "means": [span("e21", "close", 21), span("e50", "close", 50)],
        "c": {
            "ema21_slope": F.round(pct("e21"), 3),
            "ema50_slope": F.round(pct("e50"), 3),
            "ema50_dist_pct": F.when(
                _c("rn") >= 5, F.round((_c("close") - _c("e50")) / _c("e50") * 100.0, 2)
            ),
            "last_below": F.coalesce(broken, F.lit(-1)),
        },
        "d": {"days_above_ema21": F.least(_c("rn") - _c("last_below"), F.lit(31)).cast("long")},
    }


def squeeze() -> Layer:
    """Contracting range with drying or rising volume; needs obv, stage inputs and direction."""
    return {
        "first": before("close"),
        "a": {
            "tr": _tr(),
            "v5": roll(F.avg, "volume", 5),
            "v20": roll(F.avg, "volume", 20),
        },
        "means": [wilder("atr14", "tr", 14)],
        "c": {"atr_ratio": F.round(_c("atr14") / nonzero(roll(F.avg, "atr14", 20)), 2)},
        "d": {"vol_dryup": (_c("v20") > 0) & (_c("v5") < _c("v20") * 0.8)},
    }


def breakout_watch() -> Column:
    """Over columns of year_range, emas, obv, supertrend and squeeze."""
    not_freefall = (F.round("near_high_pct", 1) > -20) | (
        (F.round("e50", 2) > 0) & (F.round("close", 2) >= F.round("e50", 2) * 0.97)
    )
    calm = _c("atr_ratio") < 0.85
    return F.when(_c("rn") < 24, False).otherwise(
        F.coalesce(not_freefall & calm & (_c("vol_dryup") | (_c("obv_trend") == "RISING")), F.lit(False))
    )


def short_momentum() -> Column:
    chg = (_c("close") - lag("close", 4)) / lag("close", 4) * 100.0
    return (
        F.when((chg > 0.5) & (_c("vol_ratio") > 1.3), "BULLISH MOMENTUM")
        .when((chg < -0.5) & (_c("vol_ratio") > 1.3), "BEARISH MOMENTUM")
        .otherwise("NEUTRAL")
    )


def swing_levels() -> Layer:
    """Nearest confirmed swing high above and swing low below the close (last 60 bars)."""
    # A bar is a swing high when no bar within three on either side is higher.
    # Seen from the current bar, the candidate sits three bars back.
    w7 = by_symbol().rowsBetween(-6, 0)
    full = F.count("high").over(w7) == 7
    sh = F.when(full & (lag("high", 3) == F.max("high").over(w7)), F.round(lag("high", 3), 2))
    sl = F.when(full & (lag("low", 3) == F.min("low").over(w7)), F.round(lag("low", 3), 2))
    w57 = by_symbol().rowsBetween(-56, 0)
    hs, ls = F.collect_list("swing_high").over(w57), F.collect_list("swing_low").over(w57)
    return {
        # Done before the means, so that their windows do not carry the arrays.
        "first": {"swing_high": sh, "swing_low": sl},
        "a": {"swing_highs": hs, "swing_lows": ls},
        "b": {
            "breakout_level": F.array_min(F.filter("swing_highs", lambda p: p > _c("close") * 1.005)),
            "key_support": F.array_max(F.filter("swing_lows", lambda p: p < _c("close") * 0.995)),
        },
        "c": {
            "breakout_dist_pct": F.round((_c("breakout_level") - _c("close")) / _c("close") * 100.0, 1)
        },
    }


def patterns() -> Layer:
    """Candlestick labels of each bar, in a fixed order."""
    o, h, l, c = (_c(x) for x in ("open", "high", "low", "close"))
    body, rng = F.abs(c - o), h - l
    up, down = h - F.greatest(o, c), F.least(o, c) - l
    ma = _c("bb_mid")
    pb, p2 = _c("prev_body"), _c("prev2_body")
    po, pc, po2, pc2 = _c("po"), _c("pc"), _c("po2"), _c("pc2")
    real = (body > 0) & (rng > 0)
    long_up = real & (up >= 2.5 * body) & (down <= body * 0.4)
    rules: list[tuple[str, Column]] = [
        ("doji", (rng > 0) & (body / rng < 0.08)),
        ("hammer", real & (down >= 2.5 * body) & (up <= body * 0.4) & (c < ma)),
        ("inverted_hammer", long_up & (c < ma)),
        ("shooting_star", long_up & (c > ma)),
        ("bullish_engulfing", (pb < 0) & (c > o) & (o <= pc) & (c >= po)),
        ("bearish_engulfing", (pb > 0) & (c < o) & (o >= pc) & (c <= po)),
        ("morning_star", (p2 < 0) & (F.abs(pb) < F.abs(p2) * 0.35) & (c > o) & (c > (po2 + pc2) / 2.0)),
        ("evening_star", (p2 > 0) & (F.abs(pb) < F.abs(p2) * 0.35) & (c < o) & (c < (po2 + pc2) / 2.0)),
        ("bullish_marubozu", (rng > 0) & (body / rng > 0.92) & (c > o)),
        ("bearish_marubozu", (rng > 0) & (body / rng > 0.92) & (c <= o)),
    ]
    pin = (rng > 0) & (down / rng > 0.55) & ((body == 0) | (down > 1.5 * body))
    pins = F.filter("pin5", lambda p: p.isNotNull())
    pairs = F.zip_with(
        F.slice("pins", 1, F.greatest(F.size("pins") - 1, F.lit(0))),
        F.slice("pins", 2, F.greatest(F.size("pins") - 1, F.lit(0))),
        lambda a, b: (a > 0) & (F.abs(a - b) / a < 0.015),
    )
    labels = F.array_compact(
        F.array(*[F.when(r, name) for name, r in rules], F.when(_c("double_rejection"), "double_rejection"))
    )
    return {
        "first": {"po": lag("open"), "pc": lag("close"), "po2": lag("open", 2), "pc2": lag("close", 2)},
        "a": {
            "bb_mid": roll(F.avg, "close", 20),
            "prev_body": pc - po,
            "prev2_body": pc2 - po2,
            "pin_low": F.when(pin, l),
        },
        "b": {"pin5": frame_array(F.col("pin_low"), 5)},
        "c": {"pins": pins},
        "d": {"double_rejection": (_c("rn") >= 4) & F.exists(pairs, lambda x: x)},
        "e": {"patterns": F.when(_c("rn") < 2, F.array().cast("array<string>")).otherwise(labels)},
    }


def rolling_apply(window: str, n: int, function: Callable[[Column], Column]) -> Column:
    """Any function of the last ``n`` values, given as an array column; null until all are there."""
    return F.when(F.size(window) == n, function(F.col(window)))


# --- recursions with a state that is not linear -----------------------------

#: State of a series after a bar, from the state before (None on the first bar) and the bar's readings.
Step = Callable[[tuple | None, tuple], tuple]


def scan_by_symbol(df: DataFrame, reads: Sequence[str], schema: str, step: Step, outputs: dict[str, str]) -> DataFrame:
    """Run ``step`` along each symbol and add fields of its state.

    ``reads`` are the columns a bar hands to ``step``; ``schema`` describes
    the state.  Rows pass in Arrow batches and only the last state is carried
    from one to the next, so time grows with the number of bars and memory
    does not.  The row number over the symbol's window just below makes Spark
    deliver each symbol whole and in order; it is checked on every row.
    """
    fields = [f.split(":")[0] for f in schema.split(",")]

    @F.pandas_udf("struct<" + schema + ">")
    def scan(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        symbol, at, state = None, 0, None
        for series in columns:
            lists = [[None if v != v else v for v in x.tolist()] if x.hasnans else x.tolist() for x in series]
            out = []
            for name, place, *bar in zip(*lists):
                if place == 1:
                    symbol, at, state = name, 0, None
                if name != symbol or place != at + 1:
                    raise ValueError(f"bars of {name} arrive out of order")
                at, state = place, step(state, bar)
                out.append(state)
            yield pd.DataFrame(out, columns=fields)

    df = df.withColumn("_place", F.row_number().over(by_symbol()))
    df = df.withColumn("_state", scan.asNondeterministic()("symbol", "_place", *reads))
    return df.select("*", *[F.col(f"_state.{s}").alias(o) for o, s in outputs.items()]).drop("_place", "_state")


def _under(a: float | None, b: float | None) -> bool:
    return a is not None and b is not None and a < b


def _lowest(*x: float | None) -> float | None:
    return min((v for v in x if v is not None), default=None)


def _highest(*x: float | None) -> float | None:
    return max((v for v in x if v is not None), default=None)


def with_supertrend(df: DataFrame, out: str = "st", mult: float = 3.0, state: bool = False) -> DataFrame:
    """Ratcheted bands; starts bearish. Adds ``{out}_line`` and ``{out}_dir`` (1 / -1).

    ``state`` also keeps the bands and their mean range, to continue the series later.
    """
    tr0 = F.greatest(
        _c("high") - _c("low"),
        F.abs(_c("high") - F.coalesce(_c("_pc"), _c("close"))),
        F.abs(_c("low") - F.coalesce(_c("_pc"), _c("close"))),
    )
    mid = (_c("high") + _c("low")) / 2.0
    df = compose(
        df,
        {
            "first": {"_pc": lag("close")},
            "a": {"_tr0": tr0},
            "means": [span("_st_atr", "_tr0", 10)],
            "c": {"_ub": mid + mult * _c("_st_atr"), "_lb": mid - mult * _c("_st_atr")},
        },
    )

    def step(p, bar):
        close, before, up, low = bar
        if p is None:
            upper, lower, down = up, low, True
        elif None in bar or None in p:
            upper = up if _under(up, p[0]) or _under(p[0], before) else p[0]
            lower = low if _under(p[1], low) or _under(before, p[1]) else p[1]
            down = not _under(upper, close) if p[2] == p[0] else _under(close, lower)
        else:  # the same without a look for gaps at every comparison
            upper, lower, line, _ = p
            down = line == upper
            if up < upper or upper < before:
                upper = up
            if lower < low or before < lower:
                lower = low
            down = upper >= close if down else close < lower
        return upper, lower, upper if down else lower, -1 if down else 1

    df = scan_by_symbol(
        df,
        ["close", "_pc", "_ub", "_lb"],
        "upper:double,lower:double,line:double,dir:int",
        step,
        {f"{out}_line": "line", f"{out}_dir": "dir"}
        | ({f"{out}_upper": "upper", f"{out}_lower": "lower"} if state else {}),
    )
    if state:
        df = df.withColumn(f"{out}_atr", F.col("_st_atr"))
    return df.drop("_tr0", "_pc", "_st_atr", "_ub", "_lb")


def with_simple_supertrend(df: DataFrame, mult: float = 3.0) -> DataFrame:
    """Flip rule without ratchet; adds ``sst_line`` and ``sst_up``."""
    mid = (_c("high") + _c("low")) / 2.0
    df = compose(
        df,
        {
            "first": before("close"),
            "a": {"tr": _tr()},
            "means": [wilder("atr10", "tr", 10)],
            "c": {"_ub": mid + mult * _c("atr10"), "_lb": mid - mult * _c("atr10")},
        },
    )

    def step(p, bar):
        close, up_band, low_band = bar
        up = True if p is None or p[0] is None else _under(p[0], close)
        return None if p is None else low_band if up else up_band, up

    df = scan_by_symbol(df, ["close", "_ub", "_lb"], "line:double,up:boolean", step, {"sst_line": "line", "sst_up": "up"})
    return df.drop("_ub", "_lb")


def with_parabolic_sar(df: DataFrame, start: float = 0.02, step_by: float = 0.02, top: float = 0.2) -> DataFrame:
    """Adds ``psar`` and ``psar_dir`` (1 / -1, first bar 1)."""
    df = compose(
        df,
        {
            "first": {"_l1": lag("low"), "_h1": lag("high"), "_low2": lag("low", 2), "_high2": lag("high", 2)},
            "a": {"_l2": F.coalesce("_low2", "_l1"), "_h2": F.coalesce("_high2", "_h1")},
        },
    )

    def step(p, bar):
        high, low, l1, l2, h1, h2 = bar
        if p is None:
            return low, high, start, True
        sar, ep, af, bull = p
        moved = sar + af * (ep - sar)
        sar = _lowest(moved, l1, l2) if bull else _highest(moved, h1, h2)
        flip = _under(low, sar) if bull else _under(sar, high)
        bull = bull != flip
        extreme = high if bull else low
        further = _under(ep, high) if bull else _under(low, ep)
        if flip:
            return ep, extreme, start, bull
        return sar, extreme if further else ep, min(af + step_by, top) if further else af, bull

    df = scan_by_symbol(
        df, ["high", "low", "_l1", "_l2", "_h1", "_h2"], "sar:double,ep:double,af:double,bull:boolean", step, {"psar": "sar", "_bull": "bull"}
    )
    return df.withColumn("psar_dir", F.when(_c("_bull"), 1).otherwise(-1)).drop("_l1", "_l2", "_h1", "_h2", "_low2", "_high2", "_bull")
