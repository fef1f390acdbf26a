"""Points, labels, trade levels and the 0-100 score as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions import indicators as ind
from barloom.functions.windows import dealt_again, lag


# Means of equal readings differ by rounding noise only; that is not a crossing.
TIE = 1e-9


def _c(name: str) -> Column:
    return F.col(name)


def rnd(x: Column | str, n: int) -> Column:
    """Round half up on the decimal value, not on its binary neighbour."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x.cast("decimal(24,8)"), n).cast("double")


def points(*cases: tuple[Column, float]) -> Column:
    """The points of the first case that holds, 0 when none does."""
    expr = F.when(cases[0][0], F.lit(cases[0][1]))
    for cond, p in cases[1:]:
        expr = expr.when(cond, F.lit(p))
    return expr.otherwise(F.lit(type(cases[0][1])(0)))


def at_least(x: Column, *bands: tuple[float, float]) -> list[tuple[Column, float]]:
    return [(x >= lo, p) for lo, p in bands]


def tags(*pairs: tuple[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for t, c in pairs]))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


# --- base signal -------------------------------------------------------------


def base_layers() -> list[ind.Layer]:
    return [
        ind.emas(9, 21, 50, 200), ind.macd(), ind.rsi(), ind.bollinger(), ind.atr(14), ind.volume_average(),
    ]


def with_base_signal(df: DataFrame) -> DataFrame:
    """Points, labels and first trade levels of each bar; null before 50 bars.

    Adds rounded inputs (``r_*``), ``base_points``, ``base_signals``,
    ``base_verdict``, ``momentum_label`` and ``sl_base`` / ``t1_base`` / ``t2_base``.
    """
    ready = _c("rn") >= 49
    df = ind.compose(df, *base_layers())
    df = df.withColumns(
        {
            "r_close": rnd("close", 2),
            "r_rsi": rnd("rsi", 1),
            "r_macd_hist": F.coalesce(rnd("macd_hist", 4), F.lit(0.0)),
            "r_macd_prev": rnd(lag("macd_hist"), 4),
            "r_ema9": rnd("e9", 2),
            "r_ema21": rnd("e21", 2),
            "r_ema50": rnd("e50", 2),
            "r_vol_ratio": rnd("vol_ratio", 2),
            "r_atr": F.coalesce(rnd("atr14", 2), F.lit(0.0)),
            "change_pct": rnd((_c("close") - lag("close")) / lag("close") * 100.0, 2),
            "prev_e9": lag("e9"),
            "prev_e21": lag("e21"),
            "prev_hist": lag("macd_hist"),
            "momentum_label": ind.short_momentum(),
            "sl_base": rnd(_c("close") - 1.5 * _c("atr14"), 2),
            "t1_base": rnd(_c("close") + 2.0 * _c("atr14"), 2),
            "t2_base": rnd(_c("close") + 3.5 * _c("atr14"), 2),
        }
    )
    e9, e21, e50, r = _c("e9"), _c("e21"), _c("e50"), _c("rsi")
    hist, heavy = _c("macd_hist"), _c("vol_ratio") > 1.5
    rules = {
        "stack_up": ((e9 > e21) & (e21 > e50), 2),
        "stack_down": ((e9 < e21) & (e21 < e50), -2),
        "cross_up": ((_c("prev_e9") < _c("prev_e21")) & (e9 > e21), 3),
        "cross_down": ((_c("prev_e9") > _c("prev_e21")) & (e9 < e21), -3),
        "macd_turn_up": ((_c("prev_hist") < 0) & (hist > 0), 2),
        "macd_turn_down": ((_c("prev_hist") > 0) & (hist < 0), -2),
        "macd_strong": ((_c("macd") > _c("macd_signal")) & (_c("macd") > 0), 1),
        "rsi_oversold": (r < 35, 2),
        "rsi_overbought": (r > 65, -2),
        "rsi_bull_zone": ((r > 45) & (r < 60), 1),
    }
    total = lambda rs: sum((F.when(c, p).otherwise(0) for c, p in rs.values()), F.lit(0))
    df = df.withColumn("_early", total(rules))
    late = {
        "volume_confirms_up": (heavy & (_c("_early") > 0), 1),
        "volume_confirms_down": (heavy & (_c("_early") < 0), -1),
        "above_upper_band": (_c("close") > _c("bb_upper"), 0),
        "below_lower_band": (_c("close") < _c("bb_lower"), 1),
        "above_200": ((_c("rn") >= 199) & (_c("close") > _c("e200")), 1),
        "below_200": ((_c("rn") >= 199) & (_c("close") < _c("e200")), -1),
    }
    df = df.withColumn("base_points", F.when(ready, _c("_early") + total(late)))
    s = _c("base_points")
    verdict = (
        F.when(s >= 4, "STRONG BUY").when(s >= 2, "BUY").when(s <= -4, "STRONG SELL / SHORT")
        .when(s <= -2, "SELL / AVOID").when(s.isNotNull(), "NEUTRAL / WAIT")
    )
    listed = tags(*[(n, c) for n, (c, _) in {**rules, **late}.items()])
    return df.withColumns(
        {"base_signals": F.when(ready, listed), "base_verdict": verdict}
    ).drop("_early", "prev_e9", "prev_e21", "prev_hist")


# --- indicator points ----------------------------------------------------------


def with_directions(df: DataFrame) -> DataFrame:
    """The two array scans; cheapest while the rows are still narrow."""
    return dealt_again(ind.with_parabolic_sar(dealt_again(ind.with_supertrend(df))))


def with_technicals(df: DataFrame) -> DataFrame:
    """Everything the indicator points and the score read, on every bar."""
    if "st_dir" not in df.columns:
        df = with_directions(df)
    df = ind.compose(
        df,
        *base_layers(),
        ind.cci(), ind.adx(), ind.stochastic(), ind.year_range(), ind.patterns(), ind.ichimoku(), ind.stoch_rsi(),
        ind.williams(), ind.obv(), ind.squeeze(), ind.slopes(), ind.stage(), ind.pivots(), ind.swing_levels(),
    )
    return df.withColumn("breakout_watch", ind.breakout_watch())


def with_indicator_points(df: DataFrame) -> DataFrame:
    """Add ``ind_points`` and ``ind_signals``; wants ``rs_vs_index``, ``composite_rs``, ``weekly_trend``."""
    df = df.withColumns(
        {
            "_st_prev": lag("st_dir"), "_sar_prev": lag("psar_dir"), "_k_prev": lag("stoch_k"), "_sk_prev": lag("srsi_k"),
        }
    )
    st, sp = _c("st_dir"), _c("_st_prev")
    sar, sarp = _c("psar_dir"), _c("_sar_prev")
    k, d, sk, sd = _c("stoch_k"), _c("stoch_d"), _c("srsi_k"), _c("srsi_d")
    adx, p, m = _c("adx"), _c("plus_di"), _c("minus_di")
    high, low = rnd("near_high_pct", 1), rnd("near_low_pct", 1)
    ichi, rs = _c("ichimoku_signal"), _c("rs_vs_index")
    has = lambda name: F.array_contains("patterns", name)
    good = ("hammer", "inverted_hammer", "bullish_engulfing", "morning_star", "bullish_marubozu")
    bad = ("shooting_star", "bearish_engulfing", "evening_star", "bearish_marubozu")
    pattern_points = sum((F.when(has(g), 1).otherwise(0) for g in good), F.lit(0)) - sum(
        (F.when(has(b), 1).otherwise(0) for b in bad), F.lit(0)
    )
    rules: list[tuple[str, Column, int]] = [
        ("supertrend_flip_up", (st == 1) & (sp == -1), 2),
        ("supertrend_flip_down", (st == -1) & (sp == 1), -2),
        ("supertrend_up", (st == 1) & (sp == 1), 1),
        ("supertrend_down", (st == -1) & (sp == -1), -1),
        ("cci_overbought", _c("cci") > 100, -1),
        ("cci_oversold", _c("cci") < -100, 1),
        ("adx_up", (adx > 25) & (p > m), 1),
        ("adx_down", (adx > 25) & (m > p), -1),
        ("stoch_oversold", k < 20, 1),
        ("stoch_overbought", k > 80, -1),
        ("stoch_cross_up", (_c("_k_prev") < d) & (k > d) & (k < 50), 1),
        ("near_high", high > -3, 0),
        ("near_low", low < 5, 0),
        ("sar_flip_up", (sar == 1) & (sarp == -1), 2),
        ("sar_flip_down", (sar == -1) & (sarp == 1), -2),
        ("sar_up", (sar == 1) & (sarp == 1), 0),
        ("sar_down", (sar == -1) & (sarp == -1), 0),
        ("ichimoku_bullish", ichi == "BULLISH", 2),
        ("ichimoku_weak_bull", ichi == "WEAK_BULL", 1),
        ("ichimoku_bearish", ichi == "BEARISH", -2),
        ("ichimoku_weak_bear", ichi == "WEAK_BEAR", -1),
        ("ichimoku_inside", ichi == "NEUTRAL", 0),
        ("stoch_rsi_oversold", sk < 20, 1),
        ("stoch_rsi_overbought", sk > 80, -1),
        ("stoch_rsi_cross_up", (sd - _c("_sk_prev") > TIE) & (sk - sd > TIE) & (sk < 50), 1),
        ("williams_oversold", _c("williams_r") < -80, 1),
        ("williams_overbought", _c("williams_r") > -20, -1),
        ("obv_rising", _c("obv_trend") == "RISING", 1),
        ("obv_falling", _c("obv_trend") == "FALLING", -1),
        ("quiet_squeeze", _c("breakout_watch") & _c("vol_dryup"), 1),
        ("squeeze", _c("breakout_watch") & ~_c("vol_dryup"), 1),
        ("rs_leader", rs > 10, 2),
        ("rs_ahead", (rs > 0) & (rs <= 10), 1),
        ("rs_laggard", rs < -10, -2),
        ("rs_behind", (rs < 0) & (rs >= -10), -1),
        ("composite_rs_top", _c("composite_rs") >= 80, 1),
        ("weekly_bullish", _c("weekly_trend") == "BULLISH", 1),
        ("weekly_bearish", _c("weekly_trend") == "BEARISH", -1),
    ]
    total = sum((F.when(c, pts).otherwise(0) for _, c, pts in rules if pts), F.lit(0)) + pattern_points
    ready = _c("rn") >= 49
    return df.withColumns(
        {
            "ind_points": F.when(ready, _c("base_points") + total),
            "ind_signals": F.when(ready, tags(*[(n, c) for n, c, _ in rules])),
        }
    ).drop("_st_prev", "_sar_prev", "_k_prev", "_sk_prev")


def with_trade_levels(df: DataFrame) -> DataFrame:
    """Stop, two targets and reward-risk; wants ``r_close``, ``r_atr`` and the pivot levels."""
    close, atr = _c("r_close"), _c("r_atr")
    s1, res, r2 = rnd("support", 2), rnd("resistance", 2), rnd("resistance2", 2)
    below = (s1 != 0) & (s1 < close)
    raw = F.when(below, F.least(close - 3.0 * atr, s1 * 0.99)).otherwise(close - 3.0 * atr)
    df = df.withColumn("stop_capped", (atr > 0) & (close - raw - 4.0 * atr > 1e-9))
    df = df.withColumn("_sl", rnd(F.when(_c("stop_capped"), close - 4.0 * atr).otherwise(raw), 2))
    risk = close - _c("_sl")
    ok = (atr > 0) & (risk > 0)
    df = df.withColumn("_t1", rnd(close + 2.0 * risk, 2))
    t2 = F.greatest(F.when((r2 != 0) & (r2 > _c("_t1")), r2).otherwise(rnd(close + 3.0 * risk, 2)), rnd(_c("_t1") + 0.01, 2))
    df = df.withColumns(
        {
            "sl_buy": F.when(ok, _c("_sl")).otherwise(_c("sl_base")),
            "target1": F.when(ok, _c("_t1")).otherwise(_c("t1_base")),
            "target2": F.when(ok, t2).otherwise(_c("t2_base")),
            "rr_ratio": F.when(ok, rnd((_c("_t1") - close) / risk, 2)),
            "resistance_blocks_target": F.coalesce(ok & (res > close) & (res < _c("_t1")), F.lit(False)),
        }
    )
    return df.drop("_sl", "_t1")


# --- score -----------------------------------------------------------------------

# Multipliers and ceilings by index regime.
TREND_WEIGHT = {
    "BULL_TREND": 1.00, "BULL_WEAK": 0.90, "RECOVERY": 0.75, "BEAR_TREND": 0.55, "SIDEWAYS": 0.65,
    "HIGH_VOLATILITY": 0.55, "UNKNOWN": 0.85,
}
MOMENTUM_WEIGHT = {
    "BULL_TREND": 1.00, "BULL_WEAK": 0.92, "RECOVERY": 0.78, "BEAR_TREND": 0.60, "SIDEWAYS": 0.68,
    "HIGH_VOLATILITY": 0.58, "UNKNOWN": 0.85,
}
SCORE_CEILING = {
    "BULL_TREND": 100, "BULL_WEAK": 92, "RECOVERY": 84, "BEAR_TREND": 72, "SIDEWAYS": 82,
    "HIGH_VOLATILITY": 74, "UNKNOWN": 90,
}
LENDER_WORDS = ("financial", "bank", "insurance", "capital markets", "credit")

CONTEXT = {
    "regime": "string", "vix_high": "boolean", "above_200": "boolean", "above_50": "boolean", "fii_signal": "string",
    "retail_signal": "string", "bulk_deal": "boolean", "oi_spurt": "boolean", "delivery_pct": "double",
    "fund_score": "double", "debt_equity": "double", "revenue_growth": "double", "is_lender": "boolean",
    "promoter_pledged": "double", "quality_score": "double", "rs_vs_index": "double", "composite_rs": "double",
    "weekly_trend": "string",
}


def with_context_defaults(df: DataFrame) -> DataFrame:
    """Unknown context is null: it leaves the score's denominator, it is not a zero."""
    missing = {n: F.lit(None).cast(t) for n, t in CONTEXT.items() if n not in df.columns}
    return df.withColumns(missing) if missing else df


def is_lender(sector: Column, industry: Column) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(sector, F.lit("")), F.coalesce(industry, F.lit(""))))
    return text.rlike("|".join(LENDER_WORDS))


def _lookup(table: dict[str, float], key: Column, default: float) -> Column:
    expr = None
    for k, v in table.items():
        expr = F.when(key == k, F.lit(float(v))) if expr is None else expr.when(key == k, F.lit(float(v)))
    return expr.otherwise(F.lit(float(default)))


def with_score(df: DataFrame, momentum_mode: str = "reward", ceilings: dict[str, int] = SCORE_CEILING) -> DataFrame:
    """Adds the buckets (``p_*``), ``score100``, ``score_coverage_pct`` and labels."""
    df = with_context_defaults(df)
    vix = F.coalesce(_c("vix_high"), F.lit(False))
    regime = F.coalesce(_c("regime"), F.lit("UNKNOWN"))
    regime = F.when(vix & ~regime.isin("BEAR_TREND", "HIGH_VOLATILITY"), "HIGH_VOLATILITY").otherwise(regime)
    df = df.withColumns(
        {
            "_regime": regime,
            "_rs": F.coalesce(_c("rs_vs_index"), F.lit(0.0)),
            "_adx": F.coalesce(rnd("adx", 1), F.lit(0.0)),
            "_vol": F.coalesce(F.nullif(_c("r_vol_ratio"), F.lit(0.0)), F.lit(1.0)),
        }
    )
    close, e9, e21, e50 = _c("r_close"), _c("r_ema9"), _c("r_ema21"), _c("r_ema50")
    bear, held = _c("_regime") == "BEAR_TREND", (e50 > 0) & (close >= e50)
    leader = held & (_c("_rs") > 0)
    wt, rs, adx = _c("weekly_trend"), _c("_rs"), _c("_adx")
    weekly_ok = ~F.coalesce(wt.isin("BEARISH", "WEAK_BEAR"), F.lit(False))
    exceptional = bear & held & (rs > 10) & weekly_ok & (F.coalesce(_c("r_vol_ratio"), F.lit(0.0)) >= 1.2)
    df = df.withColumns(
        {
            "trend_mod": F.when(bear & leader, 0.50).when(bear & held, 0.35).when(bear, 0.25)
            .otherwise(_lookup(TREND_WEIGHT, _c("_regime"), 0.80)),
            "mom_mod": F.when(bear & leader, 0.55).when(bear & held, 0.40).when(bear, 0.30)
            .otherwise(_lookup(MOMENTUM_WEIGHT, _c("_regime"), 0.80)),
            "regime_cap": F.when(exceptional, 65.0).otherwise(_lookup(ceilings, _c("_regime"), 86)),
        }
    )
    # Trend structure.
    stacked = (e9 > e21) & (e21 > e50)
    trend = points((stacked & (close > e50), 7), (stacked, 5), (e9 > e21, 2), ((e9 < e21) & (e21 < e50), -3))
    trend += points(((_c("ema21_slope") > 0.05) & (_c("ema50_slope") > 0.02), 2))
    trend += points((_c("days_above_ema21").between(1, 5), 2), (_c("days_above_ema21").between(6, 20), 1))
    far = F.coalesce(_c("ema50_dist_pct"), F.lit(0.0))
    stretch = points((far > 15, 2), (far > 10, 1))
    trend += {"reward": stretch, "penalise": -stretch}.get(momentum_mode, F.lit(0))
    trend += points((_c("st_dir") == 1, 5), (_c("st_dir") == -1, -4))
    trend += points((wt == "BULLISH", 3), (wt == "WEAK_BULL", 1), (wt == "WEAK_BEAR", -1), (wt == "BEARISH", -3))
    # Momentum quality.
    r = F.coalesce(F.nullif(_c("r_rsi"), F.lit(0.0)), F.lit(50.0))
    if momentum_mode == "penalise":
        zone = points((r.between(55, 65), 6), ((r >= 45) & (r < 55), 5), ((r > 65) & (r <= 72), 3), ((r >= 35) & (r < 45), 3), (F.lit(True), 1))
    else:
        top = 7 if momentum_mode == "reward" else 6
        zone = points((r > 72, top), (r >= 55, 6), (r >= 45, 4), (r >= 35, 2), (F.lit(True), 1))
    hist, prev = _c("r_macd_hist"), F.coalesce(_c("r_macd_prev"), F.lit(0.0))
    mom = zone + points(((hist > 0) & (hist > prev), 3), (hist > 0, 1))
    ichi = _c("ichimoku_signal")
    mom += points((ichi == "BULLISH", 4), (ichi == "WEAK_BULL", 2), (ichi == "BEARISH", -2), (ichi == "WEAK_BEAR", -1))
    p, m = rnd("plus_di", 1), rnd("minus_di", 1)
    mom += points(((adx > 25) & (p > m), 2), ((adx > 25) & (m > p), -2))
    weekly_known = F.coalesce(wt.isin("BULLISH", "WEAK_BULL", "WEAK_BEAR", "BEARISH"), F.lit(False))
    ichi_known = F.coalesce(ichi.isin("BULLISH", "WEAK_BULL", "WEAK_BEAR", "BEARISH"), F.lit(False))
    df = df.withColumns(
        {
            "trend_max": F.when(weekly_known, 15).otherwise(12),
            "mom_max": F.when(ichi_known, 15).otherwise(11),
            "_trend": trend,
            "_mom": mom,
        }
    )
    halved = F.when((adx > 0) & (adx < 18), (_c("_trend") * 0.5).cast("int")).otherwise(_c("_trend"))
    fund = _c("fund_score")
    valid_fund = fund.isNotNull() & ~F.isnan(fund)
    delivery = F.coalesce(_c("delivery_pct") > 55, F.lit(False))
    a200, a50 = _c("above_200"), F.coalesce(_c("above_50"), F.lit(False))
    market = F.when(a200.isNull(), 5).when(a200 & a50, 8).when(a200, 5).when(a50, 3).otherwise(1)
    market = F.when(vix, F.greatest(F.lit(0), market - 2)).otherwise(market)
    pledged = F.coalesce(_c("promoter_pledged"), F.lit(0.0))
    q = _c("quality_score")
    raw_rs = _c("rs_vs_index")
    df = df.withColumns(
        {
            "p_trend": F.greatest(F.lit(0), F.least(_c("trend_max"), (halved * _c("trend_mod")).cast("int"))),
            "p_momentum": F.greatest(F.lit(0), F.least(_c("mom_max"), (_c("_mom") * _c("mom_mod")).cast("int"))),
            "p_strength": points((raw_rs > 10, 10), (raw_rs > 5, 8), (raw_rs > 0, 5), (raw_rs > -5, 3), (raw_rs > -10, 1)),
            "p_participation": clip(
                points(*at_least(_c("_vol"), (2.0, 6), (1.5, 5), (1.2, 4), (0.8, 2)), (_c("breakout_watch"), 3), (F.lit(True), 1))
                + points((_c("obv_trend") == "RISING", 3), (_c("obv_trend") == "NEUTRAL", 1))
                + points((delivery, 1)),
                0, 10,
            ),
            "p_market": clip(market, 0, 6),
            "p_fundamental": F.when(valid_fund, clip(F.bround(fund / 100.0 * 6.0, 0).cast("int"), 0, 6)).otherwise(3),
            "p_squeeze": points((_c("breakout_watch") & (rs > 0) & _c("vol_dryup"), 2), (_c("breakout_watch") & (rs > 0), 1)),
            "b_stage": points((_c("stage") == 2, 2), (_c("stage") == 3, -1), (_c("stage") == 4, -3)),
            "b_composite_rs": points((F.coalesce(_c("composite_rs"), F.lit(0.0)) >= 80, 1)),
            "b_quality": points((q >= 8, 2), (q >= 6, 1), (q <= 2, -1)),
            "b_interest": points((F.coalesce(_c("oi_spurt"), F.lit(False)), 1)),
            "b_participants": clip(
                points((_c("fii_signal") == "BULLISH", 1), (_c("fii_signal") == "BEARISH", -1))
                + points((_c("retail_signal") == "BUY", 1), (_c("retail_signal") == "SELL", -1)),
                -1, 1,
            ),
            "b_deals": points((F.coalesce(_c("bulk_deal"), F.lit(False)), 1)),
            "base_max": _c("trend_max") + _c("mom_max") + F.when(raw_rs.isNotNull(), 10).otherwise(0) + 10 + 6 + 6 + 2,
            "cap_pledge": F.when(pledged > 50, 48.0).when(pledged > 30, 58.0).when(pledged > 20, 68.0).otherwise(100.0),
            "cap_stage": F.when(_c("stage") == 3, 65.0).when(_c("stage") == 4, 50.0).otherwise(100.0),
        }
    )
    indebted = ~F.coalesce(_c("is_lender"), F.lit(False)) & F.coalesce(_c("debt_equity") > 3.0, F.lit(False))
    shrinking = F.coalesce(_c("revenue_growth") < -10, F.lit(False))
    loss = valid_fund & (fund < 20)
    base = sum((_c(x) for x in ("p_momentum", "p_strength", "p_participation", "p_market", "p_fundamental", "p_squeeze")), _c("p_trend"))
    bonus = sum((_c(x) for x in ("b_composite_rs", "b_quality", "b_interest", "b_participants", "b_deals")), _c("b_stage"))
    coverage = _c("base_max") / 64.0
    df = df.withColumns(
        {
            "cap_fundamental": F.when(loss & indebted, 52.0).when(loss & shrinking, 57.0).when(loss, 63.0).otherwise(100.0),
            "cap_coverage": F.when(coverage < 0.70, 58.0).when(coverage < 0.85, 72.0).otherwise(100.0),
            "score_coverage_pct": F.bround(coverage * 100.0, 0).cast("int"),
            "scaled_base": F.bround(F.greatest(F.lit(0), base) / _c("base_max") * 100.0, 0).cast("int"),
            "bonus": bonus,
        }
    )
    cap = F.least("regime_cap", "cap_pledge", "cap_stage", "cap_fundamental", "cap_coverage")
    df = df.withColumn("score_cap", cap)
    score = F.greatest(F.lit(0.0), F.least(_c("score_cap"), F.lit(100.0), (_c("scaled_base") + _c("bonus")).cast("double")))
    df = df.withColumn("score100", F.when(_c("rn") >= 49, score.cast("int")))
    return df.withColumn("score_verdict", verdict(_c("score100"))).drop("_regime", "_rs", "_adx", "_vol", "_trend", "_mom")


def verdict(score: Column) -> Column:
    return (
        F.when(score >= 75, "HIGH-QUALITY SETUP").when(score >= 60, "GOOD SETUP").when(score <= 30, "NOT SUITABLE")
        .when(score <= 45, "WEAK / AVOID").when(score.isNotNull(), "WATCHLIST")
    )


def reward_risk_points() -> Column:
    """Diagnostic only: does not enter the score."""
    rr, close = F.coalesce(_c("rr_ratio"), F.lit(0.0)), _c("r_close")
    p = points(*at_least(rr, (3.0, 10), (2.5, 8), (2.0, 6), (1.5, 3)))
    ratio = (close - _c("sl_buy")) / _c("r_atr")
    known = (_c("sl_buy") > 0) & (close > 0) & (_c("r_atr") > 0)
    p += F.when(known, points((ratio >= 1.2, 5), (ratio >= 0.8, 3), (ratio >= 0.5, 1))).otherwise(0)
    p = F.when(_c("resistance_blocks_target"), F.greatest(F.lit(0), p - 3)).otherwise(p)
    p = F.when(_c("stop_capped"), F.greatest(F.lit(0), p - 2)).otherwise(p)
    return clip(p, 0, 15)


def data_confidence() -> Column:
    """How complete the inputs are; zero counts as missing."""
    blank = lambda x: F.coalesce(x, F.lit(0.0)) == 0
    empty = lambda x: F.coalesce(x, F.lit("")) == ""
    lost = (
        points((blank(_c("rs_vs_index")), 3)) + points((empty(_c("ichimoku_signal")), 2))
        + points((empty(_c("weekly_trend")), 2)) + points((blank(rnd("adx", 1)), 1))
        + points((_c("fund_score").isNull(), 3)) + points((blank(_c("rr_ratio")), 2))
        + points((empty(_c("obv_trend")), 1)) + points((blank(_c("st_dir").cast("double")), 1))
    )
    return F.when(lost == 0, "HIGH").when(lost <= 3, "MEDIUM").when(lost <= 7, "LOW").otherwise("INCOMPLETE")


def setup_status() -> Column:
    s, stage, rs = _c("score100"), _c("stage"), F.coalesce(_c("rs_vs_index"), F.lit(0.0))
    return (
        F.when((_c("r_close") > _c("breakout_level") * 1.005) & (s >= 55), "ENTRY")
        .when((stage == 2) & (s >= 60), "ENTRY")
        .when(_c("breakout_watch"), "WATCH")
        .when((stage == 1) & (rs > 0) & (s >= 40), "WATCH")
        .when((stage == 2) & (s >= 45), "WATCH")
        .when((stage == 4) | ((_c("st_dir") == -1) & (rs < -5)), "AVOID")
        .when(s < 35, "AVOID")
        .otherwise("WATCH")
    )


# --- fundamentals ------------------------------------------------------------------


def fund_score_a(roe: Column, growth: Column | None, de: Column, margin: Column) -> Column:
    s = F.lit(50) + points(*at_least(roe, (20, 15), (15, 10), (10, 5)), (roe < 0, -20), (roe < 5, -10))
    if growth is not None:
        s += points(*at_least(growth, (20, 10), (10, 5), (0, 2)), (growth < -10, -15), (growth < 0, -7))
    s += points((de <= 0.5, 10), (de <= 1.0, 5), (de <= 2.0, 0), (de <= 4.0, -5), (de > 4.0, -15))
    s += points((margin >= 20, 5), (margin >= 10, 3), (margin < 0, -10))
    return clip(s, 0, 100)


def fund_score_b(roe: Column, de: Column, margin: Column) -> Column:
    return fund_score_a(roe, None, de, margin)


def fund_score_c(roe: Column, growth: Column, earnings: Column, de: Column, margin: Column, lender: Column) -> Column:
    """Lender-aware form: leverage is ignored and margins are judged harder for lenders."""
    s = F.lit(50) + points((roe > 20, 15), (roe > 12, 8), (roe < 5, -10))
    s += points((growth > 20, 15), (growth > 10, 8), (growth < 0, -12))
    s += points((earnings > 25, 10), (earnings > 10, 5), (earnings < -10, -8))
    s += points((~lender & (de < 0.3), 8), (~lender & (de > 2.0), -10))
    s += points((lender & (margin > 25), 7), (lender & (margin < 10), -8), (~lender & (margin > 15), 7), (~lender & (margin < 3), -8))
    return clip(s, 0, 100)


def quality_points(roce: Column, roe: Column, de: Column, fii: Column, dii: Column, pledged: Column) -> Column:
    p = points((roce > 15, 2), (roce > 10, 1)) + points((roe > 15, 2), (roe > 10, 1))
    p += points((de < 0.5, 2), (de < 1, 1)) + points((fii > 0, 1)) + points((dii > 0, 1))
    return p + points((F.coalesce(pledged, F.lit(0.0)) < 10, 1))


def red_flags(pledged: Column, promoter: Column, fii: Column, de: Column) -> Column:
    pl = F.coalesce(pledged, F.lit(0.0))
    return F.slice(
        tags(("high_pledge", pl > 50), ("pledge", pl > 20), ("promoter_sold", promoter < -2), ("fii_sold", fii < -3), ("high_debt", de > 3)), 1, 5
    )


def green_flags(pledged: Column, promoter: Column, fii: Column, dii: Column, roce: Column) -> Column:
    pl = F.coalesce(pledged, F.lit(0.0))
    return F.slice(
        tags(("fii_buying", fii > 1), ("dii_buying", dii > 1), ("promoter_bought", promoter > 0.5), ("high_roce", roce > 20), ("zero_pledge", pl == 0)), 1, 5
    )


def v2_quality(roe: Column, de: Column, margin: Column, lender: Column) -> Column:
    weight = F.when(roe.isNotNull(), 50.0).otherwise(0.0) + F.when(lender | de.isNotNull(), 30.0).otherwise(0.0)
    weight += F.when(margin.isNotNull(), 20.0).otherwise(0.0)
    p = points(*at_least(roe, (20, 50), (15, 40), (10, 25), (5, 10)))
    p += points((lender, 18), (de < 0.3, 30), (de < 1.0, 22), (de < 2.0, 12), (de < 3.0, 5))
    p += points((lender & (margin >= 25), 20), (lender & (margin >= 10), 12), (~lender & (margin >= 15), 20), (~lender & (margin >= 3), 12))
    return F.when(weight >= 40, rnd(p / weight * 100.0, 1))


def v2_growth(rev: Column, earn: Column) -> Column:
    weight = F.when(rev.isNotNull(), 50.0).otherwise(0.0) + F.when(earn.isNotNull(), 50.0).otherwise(0.0)
    p = points(*at_least(rev, (25, 50), (15, 38), (8, 22), (0, 8)))
    p += points(*at_least(earn, (30, 50), (15, 38), (5, 22), (0, 8)))
    raw = p / weight * 100.0
    return F.when(weight >= 40, rnd(F.when(weight < 100, F.least(raw, F.lit(70.0))).otherwise(raw), 1))


def v2_momentum(skip: Column, quarter: Column, index_year: Column, bars: Column) -> Column:
    """Skip-month year return, quarter return and the lead over the index; null before 260 bars."""
    p = points(*at_least(skip, (60, 55), (30, 45), (15, 32), (0, 18), (-20, 6)))
    p += points(*at_least(quarter, (15, 25), (5, 18), (-5, 10)))
    p += points(*at_least(skip - index_year, (25, 20), (10, 14), (0, 8)))
    return F.when(bars >= 260, F.least(p, F.lit(100)).cast("double"))


def v2_participation(expansion: Column, delivery: Column, bars: Column) -> Column:
    p = points(*at_least(expansion, (2.5, 60), (1.6, 48), (1.2, 34), (0.9, 20)))
    p += F.when(delivery.isNull(), 22).otherwise(points(*at_least(delivery, (55, 40), (40, 28), (25, 15))))
    return F.when((bars >= 100) & expansion.isNotNull(), F.least(p, F.lit(100)).cast("double"))


# What each category asks of each factor.
V2_BARS = {
    "COMPOUNDER": {"quality": 60, "growth": 55, "momentum": 25},
    "MOMENTUM": {"momentum": 60, "participation": 50, "quality": 35},
    "TURNAROUND": {"growth": 70, "participation": 55, "momentum": 40},
}


def v2_qualifies() -> Column:
    cleared = []
    for name, bar in V2_BARS.items():
        cond = F.lit(True)
        for factor, lo in bar.items():
            cond = cond & F.coalesce(_c(f"v2_{factor}") >= lo, F.lit(False))
        cleared.append((name, cond))
    return tags(*cleared)


# --- sizing -------------------------------------------------------------------------


def risk_size(close: Column, stop: Column, liquidity_cap: Column, account: float = 500_000.0, risk_pct: float = 2.0) -> Column:
    """Whole shares for a fixed account risk, at most 15% of the account and the liquidity cap."""
    shares = F.least(
        F.floor(F.lit(account * risk_pct / 100.0) / (close - stop)),
        F.floor(F.lit(account * 0.15) / close),
        F.when(liquidity_cap > 0, F.floor(liquidity_cap / close)),
    )
    ok = (close > 0) & (stop > 0) & (stop < close)
    return F.when(ok & (shares > 0), shares)


def kelly_size(
    win_rate: Column, rr: Column, value: float, fraction: float = 0.25, smallest: float = 2000.0, flat: float = 0.02
) -> dict[str, Column]:
    usable = F.coalesce((win_rate > 0) & (rr > 0), F.lit(False))
    p = clip(F.when(win_rate > 1, win_rate / 100.0).otherwise(win_rate), 0.01, 0.99)
    f = F.greatest(F.lit(0.0), (p * rr - (1.0 - p)) / rr)
    bounded = lambda x: F.greatest(F.lit(smallest), F.least(x, F.lit(value * 0.15)))
    return {
        "invest": F.when(usable, rnd(bounded(f * fraction * value), 2)).otherwise(bounded(F.lit(value * flat))),
        "kelly_fraction": F.when(usable, rnd(f, 4)).otherwise(0.0),
    }


def failure_tag(reason: Column, pnl_pct: Column) -> Column:
    return (
        F.when(pnl_pct >= 0, "")
        .when(reason.contains("SL_HIT"), F.when(F.abs(pnl_pct) < 0.8, "SL_TOO_TIGHT").otherwise("SL_HIT"))
        .when(reason.contains("MAX_HOLD"), "MAX_HOLD_LOSS")
        .when(reason.startswith("AI:"), "AI_DIRECTED")
        .when(F.abs(pnl_pct) < 1.0, "SMALL_LOSS_TRIM")
        .otherwise("FALSE_BREAKOUT")
    )


EXPECTANCY_BUCKETS = ((50, 60, "50-60"), (60, 70, "60-70"), (70, 80, "70-80"), (80, 101, "80+"))


def score_bucket(score: Column, buckets=EXPECTANCY_BUCKETS) -> Column:
    expr = F.lit(None).cast("string")
    for lo, hi, label in reversed(buckets):
        expr = F.when((score >= lo) & (score < hi), label).otherwise(expr)
    return expr
