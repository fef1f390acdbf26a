"""Entry rules: one boolean condition per bar over indicator columns.

A rule names the indicator layers it reads, the non-linear scans it needs and
a condition.  Rules are plain functions returning a ``Column``; callers may
add their own to the registry (see :func:`add_rule`).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions import indicators as ind
from barloom.functions.windows import cross_up, dealt_again, lag, roll, shared_lags


@dataclass(frozen=True)
class Rule:
    condition: Callable[[], Column]
    layers: Callable[[], Sequence[ind.Layer]] = field(default=lambda: ())
    scans: tuple[Callable[[DataFrame], DataFrame], ...] = ()


# Two flat bars leave the RSI unchanged; rounding noise must not read as a rise.
TIE = 1e-9

RULES: dict[str, Rule] = {}
LAB_RULES: dict[str, Rule] = {}
CONTROLS: dict[str, Rule] = {}


def add_rule(name: str, rule: Rule, book: dict[str, Rule] = RULES) -> None:
    if name in book:
        raise ValueError(f"rule {name} exists")
    book[name] = rule


def with_rules(df: DataFrame, rules: dict[str, Rule], prefix: str = "", also: Sequence[ind.Layer] = ()) -> DataFrame:
    """Add one 0/1 column per rule; an undefined condition counts as 0.

    Layers in ``also`` share the windows of the rules' own; their columns are there afterwards.
    """
    scans = list(dict.fromkeys(s for r in rules.values() for s in r.scans))
    for s in scans:
        df = dealt_again(s(df))
    layers = [layer for r in rules.values() for layer in r.layers()]
    df = ind.compose(df, *layers, *also)
    kept = df.columns
    with shared_lags() as lags:
        hits = [F.coalesce(r.condition(), F.lit(False)).cast("int").alias(prefix + n) for n, r in rules.items()]
    return df.select("*", *lags.values()).select(*kept, *hits)


c = F.col


def _up(name: str, level: float) -> Column:
    return cross_up(c(name), F.lit(level), lag(name), F.lit(level))


def _green() -> Column:
    return c("close") > c("open")


def _breakout_layers():
    return [ind.highs(20), ind.volume_average()]


def _mins(stage: str, out: str, source: str, n: int) -> ind.Layer:
    return {stage: {out: roll(F.min, source, n)}}


def _width_low() -> ind.Layer:
    """Lowest band width of 126 bars, from 16-bar minima 16 bars apart."""
    steps = [*range(0, 126 - 16, 16), 126 - 16]
    return {
        "c": {"width_low16": roll(F.min, "bb_width", 16)},
        "d": {"width_min126": F.when(lag("width_low16", 110).isNotNull(), F.least(*[lag("width_low16", k) for k in steps]))},
    }


def _near_high() -> ind.Layer:
    return {**ind.highs(252), "b": {"from_high": (c("close") / c("hh252") - 1.0) * 100.0}}


def _body() -> Column:
    return F.abs(c("close") - c("open"))


def _range() -> Column:
    return c("high") - c("low")


def _lower_wick() -> Column:
    return F.least("open", "close") - c("low")


def _trend_rules() -> None:
    stack = lambda: (c("e9") > c("e21")) & (c("e21") > c("e50")) & (c("close") > c("e50"))
    add_rule("ema_stack_9_21_50", Rule(stack, lambda: [ind.emas(9, 21, 50)]))
    add_rule(
        "ema_stack_20_50_200",
        Rule(
            lambda: (c("e20") > c("e50")) & (c("e50") > c("e200")) & (c("close") > c("e200")),
            lambda: [ind.emas(20, 50, 200)],
        ),
    )
    add_rule(
        "golden_cross",
        Rule(lambda: cross_up(c("s50"), c("s200"), lag("s50"), lag("s200")), lambda: [ind.smas(50, 200)]),
    )
    add_rule("price_above_200ema", Rule(lambda: c("close") > c("e200"), lambda: [ind.emas(200)]))
    was_up = lambda k=1: F.coalesce(lag("sst_up", k), F.lit(False))
    add_rule("supertrend_bull_flip", Rule(lambda: c("sst_up") & ~was_up(), scans=(ind.with_simple_supertrend,)))
    add_rule(
        "supertrend_sustained",
        Rule(lambda: c("sst_up") & was_up(1) & was_up(2), scans=(ind.with_simple_supertrend,)),
    )
    add_rule(
        "adx_bull_trend",
        Rule(lambda: (c("adx_zero") > 25) & (c("plus_di") > c("minus_di")), lambda: [ind.adx()]),
    )
    # The first bar is not yet a bullish reading for this rule.
    before = lambda: (lag("psar_dir") == 1) & (c("rn") > 1)
    add_rule(
        "psar_bull_flip",
        Rule(
            lambda: (c("rn") > 0) & (c("psar_dir") == 1) & ~F.coalesce(before(), F.lit(False)),
            scans=(ind.with_parabolic_sar,),
        ),
    )
    add_rule("keltner_trend", Rule(lambda: c("close") > c("kc_upper"), lambda: [ind.keltner()]))
    add_rule(
        "three_ema_reclaim",
        Rule(
            lambda: (c("close") > c("e9"))
            & (c("close") > c("e21"))
            & (c("close") > c("e50"))
            & ((lag("close") < lag("e9")) | (lag("close") < lag("e50"))),
            lambda: [ind.emas(9, 21, 50)],
        ),
    )


def _momentum_rules() -> None:
    rsi = lambda: [ind.rsi()]
    add_rule(
        "rsi_momentum_zone",
        Rule(lambda: c("rsi_raw").between(50, 70) & (c("rsi_raw") - lag("rsi_raw", 2) > TIE), rsi),
    )
    add_rule("rsi_cross_50", Rule(lambda: _up("rsi_raw", 50), rsi))
    macd = lambda: [ind.macd()]
    add_rule(
        "macd_crossover",
        Rule(lambda: cross_up(c("macd"), c("macd_signal"), lag("macd"), lag("macd_signal")), macd),
    )
    add_rule("macd_hist_positive", Rule(lambda: _up("macd_hist", 0), macd))
    add_rule(
        "macd_above_zero",
        Rule(lambda: (c("macd") > 0) & (c("macd_signal") > 0) & (c("macd") > c("macd_signal")), macd),
    )
    add_rule("cci_breakout", Rule(lambda: _up("cci", 100), lambda: [ind.cci()]))
    add_rule("roc_positive", Rule(lambda: _up("roc20", 0), lambda: [ind.roc()]))
    kd = lambda: cross_up(c("stoch_k"), c("stoch_d"), lag("stoch_k"), lag("stoch_d"))
    stoch = lambda: [ind.stochastic()]
    add_rule("stoch_golden_cross", Rule(lambda: kd() & (lag("stoch_k") < 30), stoch))
    add_rule("mfi_bullish", Rule(lambda: _up("mfi", 50), lambda: [ind.mfi()]))
    add_rule(
        "williams_r_recovery",
        Rule(lambda: _up("williams_r", -60) & (lag("williams_r", 2) < -80), lambda: [ind.williams()]),
    )


def _breakout_rules() -> None:
    heavy = lambda: c("volume") > 1.5 * c("v20")
    top20 = lambda: c("close") > lag("hh20")
    add_rule("turtle_20d", Rule(top20, lambda: [ind.highs(20)]))
    add_rule("turtle_volume", Rule(lambda: top20() & heavy(), _breakout_layers))
    add_rule("52w_high_breakout", Rule(lambda: c("close") >= lag("hh252"), lambda: [ind.highs(252)]))
    add_rule("donchian_breakout", Rule(top20, lambda: [ind.highs(20)]))
    add_rule(
        "bb_upper_breakout",
        Rule(lambda: (c("close") > c("bb_upper")) & heavy(), lambda: [ind.bollinger(), ind.volume_average()]),
    )
    add_rule(
        "inside_bar_breakout",
        Rule(
            lambda: (lag("high") < lag("high", 2)) & (lag("low") > lag("low", 2)) & (c("high") > lag("high"))
        ),
    )
    add_rule(
        "consolidation_breakout",
        Rule(
            lambda: (lag("atr14") == lag("atr_min20")) & (_range() > lag("atr14") * 1.5) & _green(),
            lambda: [ind.atr(14), _mins("c", "atr_min20", "atr14", 20)],
        ),
    )
    add_rule(
        "cup_handle_proxy",
        Rule(
            lambda: (c("from_high") > -5)
            & (lag("from_high", 20) < -15)
            & (c("atr14") / c("close") < 0.015)
            & (c("close") > lag("close")),
            lambda: [_near_high(), ind.atr(14)],
        ),
    )
    add_rule(
        "vcp_proxy",
        Rule(
            lambda: (c("close") > c("e50")) & (c("e50") > c("e150")) & (c("atr14") < c("atr_avg10") * 0.8),
            lambda: [ind.emas(50, 150), ind.atr(14), {"c": {"atr_avg10": roll(F.avg, "atr14", 10)}}],
        ),
    )


def _reversion_rules() -> None:
    add_rule(
        "rsi_oversold_bounce",
        Rule(
            lambda: (lag("rsi_min5") < 30) & _up("rsi_raw", 35),
            lambda: [ind.rsi(), _mins("d", "rsi_min5", "rsi_raw", 5)],
        ),
    )
    add_rule(
        "bb_lower_bounce",
        Rule(lambda: (lag("low") <= lag("bb_lower")) & (c("close") > c("bb_lower")), lambda: [ind.bollinger()]),
    )
    add_rule(
        "cci_oversold_recovery",
        Rule(
            lambda: (lag("cci_min5") < -200) & _up("cci", -100),
            lambda: [ind.cci(), _mins("d", "cci_min5", "cci", 5)],
        ),
    )
    add_rule(
        "stoch_oversold_recovery",
        Rule(
            lambda: cross_up(c("stoch_k"), c("stoch_d"), lag("stoch_k"), lag("stoch_d"))
            & (c("stoch_k") < 30)
            & (c("stoch_d") < 30),
            lambda: [ind.stochastic()],
        ),
    )
    red = lambda k: lag("close", k) < lag("open", k)
    add_rule(
        "3bar_pullback",
        Rule(
            lambda: (c("close") > c("e50")) & red(1) & red(2) & red(3) & _green() & (c("close") > c("e21")),
            lambda: [ind.emas(21, 50)],
        ),
    )
    add_rule(
        "ema21_bounce",
        Rule(
            lambda: (c("close") > c("e50"))
            & (c("low") <= c("e21") * 1.01)
            & (lag("close") < lag("e21"))
            & (c("close") > c("e21")),
            lambda: [ind.emas(21, 50)],
        ),
    )
    add_rule(
        "vwap_reclaim",
        Rule(
            lambda: cross_up(c("close"), c("vwap20"), lag("close"), lag("vwap20")), lambda: [ind.vwap_proxy()]
        ),
    )


def _volatility_rules() -> None:
    add_rule(
        "bb_squeeze_breakout",
        Rule(
            lambda: (lag("bb_width") == lag("width_min126"))
            & (c("close") > c("bb_upper"))
            & (c("bb_width") > lag("bb_width")),
            lambda: [ind.bollinger(), _width_low()],
        ),
    )
    add_rule(
        "keltner_bb_squeeze",
        Rule(
            lambda: (lag("bb_upper", 3) < lag("kc15_upper", 3))
            & (lag("bb_lower", 3) > lag("kc15_lower", 3))
            & (c("bb_upper") > c("kc15_upper"))
            & _green(),
            lambda: [ind.bollinger(), ind.keltner()],
        ),
    )
    add_rule(
        "atr_expansion",
        Rule(
            lambda: (lag("atr14") == lag("atr_min10")) & (c("atr14") > lag("atr14") * 1.2) & _green(),
            lambda: [ind.atr(14), _mins("c", "atr_min10", "atr14", 10)],
        ),
    )
    add_rule(
        "narrow_range_7",
        Rule(lambda: (_range() == c("range_min7")) & _green(), lambda: [{"a": {"range_min7": roll(F.min, _range(), 7)}}]),
    )
    add_rule(
        "high_tight_flag",
        Rule(
            lambda: (c("close") / lag("close", 42) - 1.0 > 1.0) & (c("close") / c("close_max5") - 1.0 > -0.15),
            lambda: [{"a": {"close_max5": roll(F.max, "close", 5)}}],
        ),
    )


def _candle_rules() -> None:
    add_rule(
        "bullish_engulfing",
        Rule(
            lambda: (lag("close") < lag("open"))
            & _green()
            & (c("open") < lag("close"))
            & (c("close") > lag("open"))
        ),
    )
    falling = lambda: lag("close", 3) > lag("close", 1)
    add_rule(
        "hammer",
        Rule(
            lambda: (_lower_wick() > 2.0 * F.nullif(_body(), F.lit(0.0)))
            & (c("high") - F.greatest("open", "close") < _body())
            & falling()
        ),
    )
    add_rule(
        "morning_star",
        Rule(
            lambda: (lag("close", 2) < lag("open", 2))
            & (lag("open", 2) - lag("close", 2) > lag("bb_sd", 2) * 0.5)
            & (F.abs(lag("close") - lag("open")) < lag("bb_sd") * 0.3)
            & _green()
            & (c("close") - c("open") > c("bb_sd") * 0.5),
            lambda: [ind.bollinger()],
        ),
    )
    add_rule(
        "bullish_harami",
        Rule(
            lambda: (lag("open") - lag("close") > lag("atr14") * 0.5)
            & _green()
            & (c("close") - c("open") < (lag("open") - lag("close")) * 0.5)
            & (c("open") > lag("close"))
            & (c("close") < lag("open")),
            lambda: [ind.atr(14)],
        ),
    )
    solid = lambda k: lag("close", k) - lag("open", k) > (lag("high", k) - lag("low", k)) * 0.6
    add_rule(
        "three_white_soldiers",
        Rule(
            lambda: (lag("close", 2) > lag("open", 2))
            & (lag("close") > lag("open"))
            & _green()
            & (lag("close") > lag("close", 2))
            & (c("close") > lag("close"))
            & solid(2)
            & solid(1)
        ),
    )
    add_rule(
        "pin_bar_reversal",
        Rule(
            lambda: (_lower_wick() > _range() * 0.6)
            & (_body() < _range() * 0.3)
            & (c("close") < c("e50") * 1.03),
            lambda: [ind.emas(50)],
        ),
    )
    add_rule("marubozu_bull", Rule(lambda: (c("close") - c("open") > _range() * 0.85) & _green()))
    add_rule("doji_reversal", Rule(lambda: (_body() < _range() * 0.1) & falling()))


def _volume_rules() -> None:
    add_rule(
        "obv_breakout",
        Rule(lambda: c("obv") > lag("obv_max20"), lambda: [ind.obv(), {"c": {"obv_max20": roll(F.max, "obv", 20)}}]),
    )
    vol = lambda: [ind.volume_average()]
    add_rule("volume_surge_up", Rule(lambda: (c("volume") > 2.5 * c("v20")) & _green(), vol))
    add_rule("cmf_positive", Rule(lambda: _up("cmf", 0), lambda: [ind.cmf()]))
    add_rule("mfi_cross_50", Rule(lambda: _up("mfi", 50), lambda: [ind.mfi()]))
    add_rule(
        "volume_dry_up_reversal",
        Rule(lambda: (lag("volume") < lag("v20") * 0.5) & (c("volume") > c("v20")) & _green(), vol),
    )
    add_rule(
        "obv_divergence_bull",
        Rule(
            lambda: (c("close") < lag("close", 10))
            & (lag("close", 5) < lag("close", 10))
            & (c("obv") > lag("obv", 10))
            & (lag("obv", 5) > lag("obv", 10)),
            lambda: [ind.obv()],
        ),
    )


def _named_rules() -> None:
    add_rule(
        "weinstein_stage2",
        Rule(
            lambda: (c("close") > c("s150")) & (c("close") > c("s50")) & (c("s150") > lag("s150", 4)),
            lambda: [ind.smas(50, 150)],
        ),
    )
    add_rule(
        "elder_triple_screen",
        Rule(
            lambda: (c("e65") > lag("e65", 5)) & (lag("rsi_min5") < 35) & (c("rsi_raw") > 35),
            lambda: [ind.emas(65), ind.rsi(), _mins("d", "rsi_min5", "rsi_raw", 5)],
        ),
    )
    add_rule(
        "darvas_box",
        Rule(
            lambda: ((lag("hh10") - lag("ll10")) / lag("ll10") < 0.08)
            & (c("close") > lag("hh10"))
            & (c("volume") > 1.5 * c("v20")),
            lambda: [ind.highs(10), ind.lows(10), ind.volume_average()],
        ),
    )
    add_rule(
        "canslim_proxy",
        Rule(
            lambda: (c("close") >= lag("hh252") * 0.85)
            & (c("close") > c("e50"))
            & (c("e50") > c("e150"))
            & (c("up_vol20") > c("down_vol20") * 1.2),
            lambda: [
                ind.highs(252),
                ind.emas(50, 150),
                {
                    "a": {
                        "up_vol20": roll(F.sum, F.when(_green(), c("volume")).otherwise(0.0), 20),
                        "down_vol20": roll(F.sum, F.when(c("close") < c("open"), c("volume")).otherwise(0.0), 20),
                    }
                },
            ],
        ),
    )
    add_rule(
        "livermore_pivot",
        Rule(
            lambda: (c("close") > lag("hh126"))
            & ((lag("close_max15") - lag("close_min15")) / lag("close_min15") < 0.08),
            lambda: [
                ind.highs(126),
                {"a": {"close_max15": roll(F.max, "close", 15), "close_min15": roll(F.min, "close", 15)}},
            ],
        ),
    )


def _lab_rules() -> None:
    add = lambda name, rule: add_rule(name, rule, LAB_RULES)
    add("ema_momentum", RULES["ema_stack_9_21_50"])
    add("rsi_reversal", Rule(lambda: (lag("rsi_raw") < 35) & (c("rsi_raw") >= 35), lambda: [ind.rsi()]))
    add(
        "supertrend_rsi",
        Rule(
            lambda: c("sst_up") & c("rsi_raw").between(50, 70),
            lambda: [ind.rsi()],
            (ind.with_simple_supertrend,),
        ),
    )
    add("macd_crossover", RULES["macd_hist_positive"])
    add("breakout", RULES["turtle_volume"])
    add(
        "ichimoku",
        Rule(
            lambda: (c("close") > F.greatest("senkou_a", "senkou_b")) & (c("tenkan") > c("kijun")),
            lambda: [ind.ichimoku()],
        ),
    )
    add("adx_trend", RULES["adx_bull_trend"])
    add(
        "swing_pullback",
        Rule(
            lambda: (c("close") > c("e50")) & (lag("close") < lag("e21")) & (c("close") >= c("e21")),
            lambda: [ind.emas(21, 50)],
        ),
    )
    add_rule("breakout_20d", RULES["turtle_20d"], CONTROLS)
    add_rule("rsi_above_60", Rule(lambda: c("rsi") > 60, lambda: [ind.rsi()]), CONTROLS)


for _group in (
    _trend_rules,
    _momentum_rules,
    _breakout_rules,
    _reversion_rules,
    _volatility_rules,
    _candle_rules,
    _volume_rules,
    _named_rules,
    _lab_rules,
):
    _group()
