"""One query per entry rule, plus the whole matrix."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from barloom.catalog.base import register, tidy
from barloom.catalog.indicators import PSAR, SIMPLE_SUPERTREND, TECH
from barloom.catalog.oracle import W, query, roll
from barloom.functions import rules
from barloom.plans.tables import bars


def lags(text: str) -> str:
    """Expand ``x[k]`` to the value of x k bars earlier."""
    return re.sub(r"(\w+)\[(\d+)\]", rf"lag(\1, \2) OVER ({W})", text)


EXTRA = f"""t8 AS (SELECT *, {roll('min', 'atr14', 20)} AS atr_min20, {roll('min', 'atr14', 10)} AS atr_min10, {roll('avg', 'atr14', 10)} AS atr_avg10,
  (close/hh252-1)*100 AS from_high, {roll('min', 'bb_width', 126)} AS width_min126, {roll('min', '(high-low)', 7)} AS range_min7,
  {roll('max', 'close', 5)} AS close_max5, {roll('max', 'close', 15)} AS close_max15, {roll('min', 'close', 15)} AS close_min15, {roll('max', 'obv', 20)} AS obv_max20,
  {roll('sum', '(CASE WHEN close>open THEN volume ELSE 0 END)', 20)} AS up_vol20, {roll('sum', '(CASE WHEN close<open THEN volume ELSE 0 END)', 20)} AS down_vol20,
  abs(close-open) AS body, high-low AS rng, least(open,close)-low AS lower_wick, high-greatest(open,close) AS upper_wick FROM t7)"""
RULE_TABLE = [*TECH, EXTRA]
KD = "stoch_k>stoch_d AND stoch_k[1]<=stoch_d[1]"

SQL = {
    "ema_stack_9_21_50": "e9>e21 AND e21>e50 AND close>e50",
    "ema_stack_20_50_200": "e20>e50 AND e50>e200 AND close>e200",
    "golden_cross": "s50>s200 AND s50[1]<=s200[1]",
    "price_above_200ema": "close>e200",
    "supertrend_bull_flip": "up AND NOT coalesce(up[1], false)",
    "supertrend_sustained": "up AND coalesce(up[1], false) AND coalesce(up[2], false)",
    "adx_bull_trend": "adx_zero>25 AND plus_di>minus_di",
    "psar_bull_flip": "rn>0 AND bull AND NOT (rn>1 AND coalesce(bull[1], false))",
    "keltner_trend": "close>kc_upper",
    "three_ema_reclaim": "close>e9 AND close>e21 AND close>e50 AND (close[1]<e9[1] OR close[1]<e50[1])",
    "rsi_momentum_zone": "rsi_raw>=50 AND rsi_raw<=70 AND rsi_raw-rsi_raw[2]>1e-9",
    "rsi_cross_50": "rsi_raw>50 AND rsi_raw[1]<=50",
    "macd_crossover": "macd>macd_signal AND macd[1]<=macd_signal[1]",
    "macd_hist_positive": "macd_hist>0 AND macd_hist[1]<=0",
    "macd_above_zero": "macd>0 AND macd_signal>0 AND macd>macd_signal",
    "cci_breakout": "cci>100 AND cci[1]<=100",
    "roc_positive": "roc20>0 AND roc20[1]<=0",
    "stoch_golden_cross": f"{KD} AND stoch_k[1]<30",
    "mfi_bullish": "mfi>50 AND mfi[1]<=50",
    "williams_r_recovery": "williams_r>-60 AND williams_r[1]<=-60 AND williams_r[2]<-80",
    "turtle_20d": "close>hh20[1]",
    "turtle_volume": "close>hh20[1] AND volume>1.5*v20",
    "52w_high_breakout": "close>=hh252[1]",
    "donchian_breakout": "close>hh20[1]",
    "bb_upper_breakout": "close>bb_upper AND volume>1.5*v20",
    "inside_bar_breakout": "high[1]<high[2] AND low[1]>low[2] AND high>high[1]",
    "consolidation_breakout": "atr14[1]=atr_min20[1] AND high-low>atr14[1]*1.5 AND close>open",
    "cup_handle_proxy": "from_high>-5 AND from_high[20]<-15 AND atr14/close<0.015 AND close>close[1]",
    "vcp_proxy": "close>e50 AND e50>e150 AND atr14<atr_avg10*0.8",
    "rsi_oversold_bounce": "rsi_min5[1]<30 AND rsi_raw>35 AND rsi_raw[1]<=35",
    "bb_lower_bounce": "low[1]<=bb_lower[1] AND close>bb_lower",
    "cci_oversold_recovery": "cci_min5[1]<-200 AND cci>-100 AND cci[1]<=-100",
    "stoch_oversold_recovery": f"{KD} AND stoch_k<30 AND stoch_d<30",
    "3bar_pullback": "close>e50 AND close[1]<open[1] AND close[2]<open[2] AND close[3]<open[3] AND close>open AND close>e21",
    "ema21_bounce": "close>e50 AND low<=e21*1.01 AND close[1]<e21[1] AND close>e21",
    "vwap_reclaim": "close>vwap20 AND close[1]<=vwap20[1]",
    "bb_squeeze_breakout": "bb_width[1]=width_min126[1] AND close>bb_upper AND bb_width>bb_width[1]",
    "keltner_bb_squeeze": "bb_upper[3]<kc15_upper[3] AND bb_lower[3]>kc15_lower[3] AND bb_upper>kc15_upper AND close>open",
    "atr_expansion": "atr14[1]=atr_min10[1] AND atr14>atr14[1]*1.2 AND close>open",
    "narrow_range_7": "high-low=range_min7 AND close>open",
    "high_tight_flag": "close/close[42]-1>1 AND close/close_max5-1>-0.15",
    "bullish_engulfing": "close[1]<open[1] AND close>open AND open<close[1] AND close>open[1]",
    "hammer": "lower_wick>2*nullif(body,0) AND upper_wick<body AND close[3]>close[1]",
    "morning_star": "close[2]<open[2] AND open[2]-close[2]>bb_sd[2]*0.5 AND abs(close[1]-open[1])<bb_sd[1]*0.3 AND close>open AND close-open>bb_sd*0.5",
    "bullish_harami": "open[1]-close[1]>atr14[1]*0.5 AND close>open AND close-open<(open[1]-close[1])*0.5 AND open>close[1] AND close<open[1]",
    "three_white_soldiers": "close[2]>open[2] AND close[1]>open[1] AND close>open AND close[1]>close[2] AND close>close[1] AND close[2]-open[2]>(high[2]-low[2])*0.6 AND close[1]-open[1]>(high[1]-low[1])*0.6",
    "pin_bar_reversal": "lower_wick>rng*0.6 AND body<rng*0.3 AND close<e50*1.03",
    "marubozu_bull": "close-open>rng*0.85 AND close>open",
    "doji_reversal": "body<rng*0.1 AND close[3]>close[1]",
    "obv_breakout": "obv>obv_max20[1]",
    "volume_surge_up": "volume>2.5*v20 AND close>open",
    "cmf_positive": "cmf>0 AND cmf[1]<=0",
    "mfi_cross_50": "mfi>50 AND mfi[1]<=50",
    "volume_dry_up_reversal": "volume[1]<v20[1]*0.5 AND volume>v20 AND close>open",
    "obv_divergence_bull": "close<close[10] AND close[5]<close[10] AND obv>obv[10] AND obv[5]>obv[10]",
    "weinstein_stage2": "close>s150 AND close>s50 AND s150>s150[4]",
    "elder_triple_screen": "e65>e65[5] AND rsi_min5[1]<35 AND rsi_raw>35",
    "darvas_box": "(hh10[1]-ll10[1])/ll10[1]<0.08 AND close>hh10[1] AND volume>1.5*v20",
    "canslim_proxy": "close>=hh252[1]*0.85 AND close>e50 AND e50>e150 AND up_vol20>down_vol20*1.2",
    "livermore_pivot": "close>hh126[1] AND (close_max15[1]-close_min15[1])/close_min15[1]<0.08",
}
LAB_SQL = {
    "ema_momentum": SQL["ema_stack_9_21_50"],
    "rsi_reversal": "rsi_raw[1]<35 AND rsi_raw>=35",
    "supertrend_rsi": "up AND rsi_raw>=50 AND rsi_raw<=70",
    "macd_crossover": SQL["macd_hist_positive"],
    "breakout": SQL["turtle_volume"],
    "ichimoku": "close>greatest(senkou_a,senkou_b) AND tenkan>kijun",
    "adx_trend": SQL["adx_bull_trend"],
    "swing_pullback": "close>e50 AND close[1]<e21[1] AND close>=e21",
}
CONTROL_SQL = {"breakout_20d": SQL["turtle_20d"], "rsi_above_60": "rsi>60"}


def rule_source(names) -> tuple[list[str], str, bool]:
    """CTEs, row source and recursion flag for the given rules."""
    ctes, frm, rec = list(RULE_TABLE), "t8", False
    if any("supertrend" in n for n in names):
        ctes.append(SIMPLE_SUPERTREND)
        frm += " JOIN (SELECT symbol, rn, up FROM sst) USING (symbol, rn)"
        rec = True
    if any(n.startswith("psar") for n in names):
        ctes.append(PSAR)
        frm += " JOIN (SELECT symbol, rn, bull FROM ps) USING (symbol, rn)"
        rec = True
    return ctes, frm, rec


def hit(text: str) -> str:
    return f"cast(coalesce({lags(text)}, false) AS bigint)"


def _register(key: str, name: str, rule: rules.Rule, text: str) -> None:
    def run(spark, sf):
        df = rules.with_rules(bars(spark, sf), {name: rule})
        return tidy(df.select("symbol", "date", F.col(name).alias("hit")))

    ctes, frm, rec = rule_source([name])
    body = f"SELECT symbol, strftime(date,'%Y-%m-%d') AS date, {hit(text)} AS hit FROM {frm}"
    register(key, run, query(ctes, body, rec))


for _i, _name in enumerate(rules.RULES, 1):
    _register(f"s{_i:02d}_{_name}", _name, rules.RULES[_name], SQL[_name])
for _i, _name in enumerate(rules.LAB_RULES, 62):
    _register(f"s{_i}_lab_{_name}", _name, rules.LAB_RULES[_name], LAB_SQL[_name])
for _i, _name in enumerate(rules.CONTROLS, 70):
    _register(f"s{_i}_control_{_name}", _name, rules.CONTROLS[_name], CONTROL_SQL[_name])


def signal_matrix(spark, sf):
    df = rules.with_rules(bars(spark, sf), rules.RULES, "strat_")
    return tidy(df.select("symbol", "date", *[f"strat_{n}" for n in rules.RULES]))


_ctes, _frm, _rec = rule_source(SQL)
MATRIX = f"m AS (SELECT symbol, rn, date, {', '.join(f'{hit(t)} AS strat_{n}' for n, t in SQL.items())} FROM {_frm})"
register(
    "s61_signal_matrix",
    signal_matrix,
    query(
        [*_ctes, MATRIX],
        f"SELECT symbol, strftime(date,'%Y-%m-%d') AS date, {', '.join('strat_' + n for n in SQL)} FROM m",
        True,
    ),
)
