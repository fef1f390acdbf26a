"""Score, label, level and sizing queries and their SQL."""

from __future__ import annotations


from pyspark.sql import functions as F

from barloom.catalog.base import register, tidy
from barloom.catalog.indicators import BREAKOUT, PATTERNS, PSAR, SUPERTREND, SWINGS, TECH
from barloom.catalog.market import REGIME, STRENGTH, WEEKS, tech
from barloom.catalog.oracle import INDEX, lag, query, roll, select
from barloom.functions import indicators as ind, scoring
from barloom.plans import scan, tables
from barloom.plans.tables import bars

c = F.col

FUNDAMENTALS = """fd0 AS (SELECT s_suppkey AS k, 'S'||cast(s_suppkey AS varchar) AS symbol, cast(abs(round(s_acctbal*100)) AS bigint) AS ct, s_nationkey FROM supplier),
fd AS (SELECT symbol, CASE WHEN k%11<>0 THEN (ct%3500)/100.0::double-5 END AS roe, CASE WHEN k%11<>0 THEN (k*37%500)/100.0::double END AS debt_equity,
  CASE WHEN k%11<>0 THEN (ct%410)/10.0::double-8 END AS net_margin, CASE WHEN k%11<>0 THEN (ct%593)/10.0::double-20 END AS revenue_growth,
  CASE WHEN k%11<>0 AND k%4<>0 THEN (ct%701)/10.0::double-25 END AS earnings_growth,
  CASE s_nationkey%5 WHEN 0 THEN 'Financial Services' WHEN 1 THEN 'Technology' WHEN 2 THEN 'Energy' WHEN 3 THEN 'Healthcare' ELSE 'Industrials' END AS sector,
  CASE WHEN k%7=0 THEN 'Banks - Regional' ELSE 'General' END AS industry, (k*17%70)::double AS promoter_pledged, (k*13%80)/10.0::double-4 AS promoter_change,
  (k*19%90)/10.0::double-4.5::double AS fii_change, (k*23%60)/10.0::double-3 AS dii_change, CASE WHEN k%11<>0 THEN (k*41%400)/10.0::double END AS roce,
  CASE WHEN k%9<>0 THEN (k*29%1000)/10.0::double END AS delivery_pct, k%6=0 AS oi_spurt, k%10=0 AS banned, k%8=0 AS bulk_deal,
  CASE k%3 WHEN 0 THEN 'BULLISH' WHEN 1 THEN 'BEARISH' ELSE 'NEUTRAL' END AS fii_signal, CASE k%5 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' ELSE 'NEUTRAL' END AS retail_signal FROM fd0),
fe AS (SELECT *, sector='Financial Services' OR industry='Banks - Regional' AS lender FROM fd),
ffa AS (SELECT *,
  greatest(0,least(100, 50+CASE WHEN roe>=20 THEN 15 WHEN roe>=15 THEN 10 WHEN roe>=10 THEN 5 WHEN roe<0 THEN -20 WHEN roe<5 THEN -10 ELSE 0 END
    +CASE WHEN revenue_growth>=20 THEN 10 WHEN revenue_growth>=10 THEN 5 WHEN revenue_growth>=0 THEN 2 WHEN revenue_growth< -10 THEN -15 WHEN revenue_growth<0 THEN -7 ELSE 0 END
    +CASE WHEN debt_equity<=0.5 THEN 10 WHEN debt_equity<=1 THEN 5 WHEN debt_equity<=2 THEN 0 WHEN debt_equity<=4 THEN -5 WHEN debt_equity>4 THEN -15 ELSE 0 END
    +CASE WHEN net_margin>=20 THEN 5 WHEN net_margin>=10 THEN 3 WHEN net_margin<0 THEN -10 ELSE 0 END)) AS score_a,
  greatest(0,least(100, 50+CASE WHEN roe>=20 THEN 15 WHEN roe>=15 THEN 10 WHEN roe>=10 THEN 5 WHEN roe<0 THEN -20 WHEN roe<5 THEN -10 ELSE 0 END
    +CASE WHEN debt_equity<=0.5 THEN 10 WHEN debt_equity<=1 THEN 5 WHEN debt_equity<=2 THEN 0 WHEN debt_equity<=4 THEN -5 WHEN debt_equity>4 THEN -15 ELSE 0 END
    +CASE WHEN net_margin>=20 THEN 5 WHEN net_margin>=10 THEN 3 WHEN net_margin<0 THEN -10 ELSE 0 END)) AS score_b,
  greatest(0,least(100, 50+CASE WHEN roe>20 THEN 15 WHEN roe>12 THEN 8 WHEN roe<5 THEN -10 ELSE 0 END
    +CASE WHEN revenue_growth>20 THEN 15 WHEN revenue_growth>10 THEN 8 WHEN revenue_growth<0 THEN -12 ELSE 0 END
    +CASE WHEN earnings_growth>25 THEN 10 WHEN earnings_growth>10 THEN 5 WHEN earnings_growth< -10 THEN -8 ELSE 0 END
    +CASE WHEN lender THEN 0 WHEN debt_equity<0.3 THEN 8 WHEN debt_equity>2 THEN -10 ELSE 0 END
    +CASE WHEN lender THEN CASE WHEN net_margin>25 THEN 7 WHEN net_margin<10 THEN -8 ELSE 0 END ELSE CASE WHEN net_margin>15 THEN 7 WHEN net_margin<3 THEN -8 ELSE 0 END END)) AS score_c,
  CASE WHEN roce>15 THEN 2 WHEN roce>10 THEN 1 ELSE 0 END+CASE WHEN roe>15 THEN 2 WHEN roe>10 THEN 1 ELSE 0 END+CASE WHEN debt_equity<0.5 THEN 2 WHEN debt_equity<1 THEN 1 ELSE 0 END
    +CASE WHEN fii_change>0 THEN 1 ELSE 0 END+CASE WHEN dii_change>0 THEN 1 ELSE 0 END+CASE WHEN promoter_pledged<10 THEN 1 ELSE 0 END AS quality_score
  FROM fe)"""


def r(x: str, n: int) -> str:
    return f"cast(round(cast({x} AS decimal(24,8)),{n}) AS double)"


SCAN0 = f"""q0 AS (SELECT t7.*, st.line AS st_line, st.dir AS st_dir, CASE WHEN bull THEN 1 ELSE -1 END AS psar_dir, CASE WHEN t7.rn<2 THEN '' ELSE pt.labels END AS patterns,
   sw.breakout_level, wt.weekly_trend, rs.rs_vs_index, rs.composite_rs, {BREAKOUT} AS breakout_watch
  FROM t7 JOIN st USING (symbol, rn) JOIN ps USING (symbol, rn) JOIN (SELECT symbol, rn, labels FROM pt) pt USING (symbol, rn)
  JOIN (SELECT symbol, rn, breakout_level FROM sw) sw USING (symbol, rn) JOIN wt USING (symbol, rn) JOIN rs USING (symbol, rn)),
q1 AS (SELECT *, {r('close', 2)} AS r_close, {r('rsi', 1)} AS r_rsi, coalesce({r('macd_hist', 4)},0) AS r_macd_hist, {r(lag('macd_hist'), 4)} AS r_macd_prev,
   {r('e9', 2)} AS r_ema9, {r('e21', 2)} AS r_ema21, {r('e50', 2)} AS r_ema50, {r('vol_ratio', 2)} AS r_vol_ratio, coalesce({r('atr14', 2)},0) AS r_atr,
   {r(f"(close-{lag('close')})/{lag('close')}*100", 2)} AS change_pct, {lag('e9')} AS pe9, {lag('e21')} AS pe21, {lag('macd_hist')} AS ph,
   {r('close-1.5*atr14', 2)} AS sl_base, {r('close+2*atr14', 2)} AS t1_base, {r('close+3.5*atr14', 2)} AS t2_base,
   {lag('st_dir')} AS st_prev, {lag('psar_dir')} AS sar_prev, {lag('stoch_k')} AS k_prev, {lag('srsi_k')} AS sk_prev, {r('near_high_pct', 1)} AS nh, {r('near_low_pct', 1)} AS nl,
   {lag('high')} AS ph1, {lag('low')} AS pl1, {lag('close')} AS pc1 FROM q0),
q1b AS (SELECT *, {roll('avg', 'srsi_k', 3)} AS srsi_d FROM q1),
q2 AS (SELECT *, CASE WHEN e9>e21 AND e21>e50 THEN 2 ELSE 0 END + CASE WHEN e9<e21 AND e21<e50 THEN -2 ELSE 0 END + CASE WHEN pe9<pe21 AND e9>e21 THEN 3 ELSE 0 END + CASE WHEN pe9>pe21 AND e9<e21 THEN -3 ELSE 0 END
   + CASE WHEN ph<0 AND macd_hist>0 THEN 2 ELSE 0 END + CASE WHEN ph>0 AND macd_hist<0 THEN -2 ELSE 0 END + CASE WHEN macd>macd_signal AND macd>0 THEN 1 ELSE 0 END
   + CASE WHEN rsi<35 THEN 2 WHEN rsi>65 THEN -2 WHEN rsi>45 AND rsi<60 THEN 1 ELSE 0 END AS early,
   concat_ws('|', CASE WHEN e9>e21 AND e21>e50 THEN 'stack_up' END, CASE WHEN e9<e21 AND e21<e50 THEN 'stack_down' END, CASE WHEN pe9<pe21 AND e9>e21 THEN 'cross_up' END, CASE WHEN pe9>pe21 AND e9<e21 THEN 'cross_down' END,
     CASE WHEN ph<0 AND macd_hist>0 THEN 'macd_turn_up' END, CASE WHEN ph>0 AND macd_hist<0 THEN 'macd_turn_down' END, CASE WHEN macd>macd_signal AND macd>0 THEN 'macd_strong' END,
     CASE WHEN rsi<35 THEN 'rsi_oversold' WHEN rsi>65 THEN 'rsi_overbought' WHEN rsi>45 AND rsi<60 THEN 'rsi_bull_zone' END) AS early_tags,
   (ph1+pl1+pc1)/3 AS pp FROM q1b),
q3 AS (SELECT *, early + CASE WHEN vol_ratio>1.5 THEN sign(early) ELSE 0 END + CASE WHEN close<bb_lower THEN 1 ELSE 0 END + CASE WHEN rn>=199 AND close>e200 THEN 1 WHEN rn>=199 AND close<e200 THEN -1 ELSE 0 END AS bp,
   concat_ws('|', nullif(early_tags,''), CASE WHEN vol_ratio>1.5 AND early>0 THEN 'volume_confirms_up' WHEN vol_ratio>1.5 AND early<0 THEN 'volume_confirms_down' END,
     CASE WHEN close>bb_upper THEN 'above_upper_band' END, CASE WHEN close<bb_lower THEN 'below_lower_band' END, CASE WHEN rn>=199 AND close>e200 THEN 'above_200' WHEN rn>=199 AND close<e200 THEN 'below_200' END) AS btags,
   CASE WHEN st_dir=1 AND st_prev=-1 THEN 2 WHEN st_dir=-1 AND st_prev=1 THEN -2 WHEN st_dir=1 AND st_prev=1 THEN 1 WHEN st_dir=-1 AND st_prev=-1 THEN -1 ELSE 0 END
   + CASE WHEN cci>100 THEN -1 WHEN cci< -100 THEN 1 ELSE 0 END + CASE WHEN adx>25 AND plus_di>minus_di THEN 1 WHEN adx>25 AND minus_di>plus_di THEN -1 ELSE 0 END
   + CASE WHEN stoch_k<20 THEN 1 WHEN stoch_k>80 THEN -1 ELSE 0 END + CASE WHEN k_prev<stoch_d AND stoch_k>stoch_d AND stoch_k<50 THEN 1 ELSE 0 END
   + CASE WHEN psar_dir=1 AND sar_prev=-1 THEN 2 WHEN psar_dir=-1 AND sar_prev=1 THEN -2 ELSE 0 END
   + CASE ichimoku_signal WHEN 'BULLISH' THEN 2 WHEN 'WEAK_BULL' THEN 1 WHEN 'BEARISH' THEN -2 WHEN 'WEAK_BEAR' THEN -1 ELSE 0 END
   + CASE WHEN srsi_k<20 THEN 1 WHEN srsi_k>80 THEN -1 ELSE 0 END + CASE WHEN srsi_d-sk_prev>1e-9 AND srsi_k-srsi_d>1e-9 AND srsi_k<50 THEN 1 ELSE 0 END
   + CASE WHEN williams_r< -80 THEN 1 WHEN williams_r> -20 THEN -1 ELSE 0 END + CASE obv_trend WHEN 'RISING' THEN 1 WHEN 'FALLING' THEN -1 ELSE 0 END
   + CASE WHEN breakout_watch THEN 1 ELSE 0 END + CASE WHEN rs_vs_index>10 THEN 2 WHEN rs_vs_index>0 THEN 1 WHEN rs_vs_index< -10 THEN -2 WHEN rs_vs_index<0 THEN -1 ELSE 0 END
   + CASE WHEN composite_rs>=80 THEN 1 ELSE 0 END + CASE weekly_trend WHEN 'BULLISH' THEN 1 WHEN 'BEARISH' THEN -1 ELSE 0 END
   + len(list_filter(string_split(patterns,'|'), lambda x: x IN ('hammer','inverted_hammer','bullish_engulfing','morning_star','bullish_marubozu')))
   - len(list_filter(string_split(patterns,'|'), lambda x: x IN ('shooting_star','bearish_engulfing','evening_star','bearish_marubozu'))) AS ip,
   concat_ws('|', CASE WHEN st_dir=1 AND st_prev=-1 THEN 'supertrend_flip_up' WHEN st_dir=-1 AND st_prev=1 THEN 'supertrend_flip_down' WHEN st_dir=1 AND st_prev=1 THEN 'supertrend_up' WHEN st_dir=-1 AND st_prev=-1 THEN 'supertrend_down' END,
     CASE WHEN cci>100 THEN 'cci_overbought' WHEN cci< -100 THEN 'cci_oversold' END, CASE WHEN adx>25 AND plus_di>minus_di THEN 'adx_up' WHEN adx>25 AND minus_di>plus_di THEN 'adx_down' END,
     CASE WHEN stoch_k<20 THEN 'stoch_oversold' WHEN stoch_k>80 THEN 'stoch_overbought' END, CASE WHEN k_prev<stoch_d AND stoch_k>stoch_d AND stoch_k<50 THEN 'stoch_cross_up' END,
     CASE WHEN nh> -3 THEN 'near_high' END, CASE WHEN nl<5 THEN 'near_low' END,
     CASE WHEN psar_dir=1 AND sar_prev=-1 THEN 'sar_flip_up' WHEN psar_dir=-1 AND sar_prev=1 THEN 'sar_flip_down' WHEN psar_dir=1 AND sar_prev=1 THEN 'sar_up' WHEN psar_dir=-1 AND sar_prev=-1 THEN 'sar_down' END,
     CASE ichimoku_signal WHEN 'BULLISH' THEN 'ichimoku_bullish' WHEN 'WEAK_BULL' THEN 'ichimoku_weak_bull' WHEN 'BEARISH' THEN 'ichimoku_bearish' WHEN 'WEAK_BEAR' THEN 'ichimoku_weak_bear' WHEN 'NEUTRAL' THEN 'ichimoku_inside' END,
     CASE WHEN srsi_k<20 THEN 'stoch_rsi_oversold' WHEN srsi_k>80 THEN 'stoch_rsi_overbought' END, CASE WHEN srsi_d-sk_prev>1e-9 AND srsi_k-srsi_d>1e-9 AND srsi_k<50 THEN 'stoch_rsi_cross_up' END,
     CASE WHEN williams_r< -80 THEN 'williams_oversold' WHEN williams_r> -20 THEN 'williams_overbought' END, CASE obv_trend WHEN 'RISING' THEN 'obv_rising' WHEN 'FALLING' THEN 'obv_falling' END,
     CASE WHEN breakout_watch AND vol_dryup THEN 'quiet_squeeze' WHEN breakout_watch THEN 'squeeze' END,
     CASE WHEN rs_vs_index>10 THEN 'rs_leader' WHEN rs_vs_index>0 THEN 'rs_ahead' WHEN rs_vs_index< -10 THEN 'rs_laggard' WHEN rs_vs_index<0 THEN 'rs_behind' END,
     CASE WHEN composite_rs>=80 THEN 'composite_rs_top' END, CASE weekly_trend WHEN 'BULLISH' THEN 'weekly_bullish' WHEN 'BEARISH' THEN 'weekly_bearish' END) AS itags,
   {r('2*pp-ph1', 2)} AS s1, {r('2*pp-pl1', 2)} AS res, {r('pp+(ph1-pl1)', 2)} AS r2 FROM q2),
q4 AS (SELECT *, CASE WHEN s1<>0 AND s1<r_close THEN least(r_close-3*r_atr, s1*0.99::double) ELSE r_close-3*r_atr END AS sraw FROM q3),
q5 AS (SELECT *, r_atr>0 AND r_close-sraw-4*r_atr>1e-9 AS stop_capped FROM q4),
q6 AS (SELECT *, {r('CASE WHEN stop_capped THEN r_close-4*r_atr ELSE sraw END', 2)} AS sl0 FROM q5),
q7 AS (SELECT *, r_atr>0 AND r_close-sl0>0 AS lok, {r('r_close+2*(r_close-sl0)', 2)} AS t10 FROM q6),
q8 AS (SELECT *, CASE WHEN lok THEN sl0 ELSE sl_base END AS sl_buy, CASE WHEN lok THEN t10 ELSE t1_base END AS target1,
   CASE WHEN lok THEN greatest(CASE WHEN r2<>0 AND r2>t10 THEN r2 ELSE {r('r_close+3*(r_close-sl0)', 2)} END, {r('t10+0.01::double', 2)}) ELSE t2_base END AS target2,
   CASE WHEN lok THEN {r('(t10-r_close)/(r_close-sl0)', 2)} END AS rr_ratio, coalesce(lok AND res>r_close AND res<t10,false) AS resistance_blocks_target,
   CASE WHEN rn>=49 THEN cast(bp AS bigint) END AS base_points, CASE WHEN rn>=49 THEN cast(bp+ip AS bigint) END AS ind_points FROM q7)"""

MARKETCTX = ", ".join(f"('{k}',{a}::double,{b}::double,{cap}::double)" for k, a, b, cap in (
    ("BULL_TREND", 1.00, 1.00, 100), ("BULL_WEAK", 0.90, 0.92, 92), ("RECOVERY", 0.75, 0.78, 84), ("BEAR_TREND", 0.55, 0.60, 72),
    ("SIDEWAYS", 0.65, 0.68, 82), ("HIGH_VOLATILITY", 0.55, 0.58, 74), ("UNKNOWN", 0.85, 0.85, 90)))
SCORE = f"""ctx(rname,tm,mm,cap) AS (VALUES {MARKETCTX}),
z0 AS (SELECT q8.*, g.regime AS regime0, g.vix>25 AS vix_high, g.above_200, g.above_50, f.debt_equity, f.revenue_growth, f.lender, f.promoter_pledged, f.quality_score, f.delivery_pct, f.oi_spurt, f.bulk_deal, f.fii_signal, f.retail_signal,
    CASE WHEN f.roe IS NOT NULL THEN f.score_a END AS fund_score, f.sector, f.roe, f.net_margin, f.earnings_growth, f.banned,
    CASE WHEN g.vix>25 AND g.regime NOT IN ('BEAR_TREND','HIGH_VOLATILITY') THEN 'HIGH_VOLATILITY' ELSE g.regime END AS regime,
    coalesce(rs_vs_index,0) AS rs, coalesce({r('adx', 1)},0) AS radx, coalesce(nullif(r_vol_ratio,0),1) AS vol
  FROM q8 LEFT JOIN (SELECT date, regime, vix, above_200, above_50 FROM rgm) g USING (date) LEFT JOIN ffa f USING (symbol)),
z1 AS (SELECT *, r_ema50>0 AND r_close>=r_ema50 AS held, regime='BEAR_TREND' AS bear FROM z0),
z2 AS (SELECT z1.*, CASE WHEN bear THEN CASE WHEN held AND rs>0 THEN 0.50::double WHEN held THEN 0.35::double ELSE 0.25::double END ELSE tm END AS trend_mod,
    CASE WHEN bear THEN CASE WHEN held AND rs>0 THEN 0.55::double WHEN held THEN 0.40::double ELSE 0.30::double END ELSE mm END AS mom_mod,
    CASE WHEN bear AND held AND rs>10 AND coalesce(weekly_trend,'') NOT IN ('BEARISH','WEAK_BEAR') AND coalesce(r_vol_ratio,0)>=1.2 THEN 65::double ELSE cap END AS regime_cap,
    CASE WHEN r_ema9>r_ema21 AND r_ema21>r_ema50 AND r_close>r_ema50 THEN 7 WHEN r_ema9>r_ema21 AND r_ema21>r_ema50 THEN 5 WHEN r_ema9>r_ema21 THEN 2 WHEN r_ema9<r_ema21 AND r_ema21<r_ema50 THEN -3 ELSE 0 END
     + CASE WHEN ema21_slope>0.05 AND ema50_slope>0.02 THEN 2 ELSE 0 END + CASE WHEN days_above_ema21 BETWEEN 1 AND 5 THEN 2 WHEN days_above_ema21 BETWEEN 6 AND 20 THEN 1 ELSE 0 END
     + CASE WHEN ema50_dist_pct>15 THEN 2 WHEN ema50_dist_pct>10 THEN 1 ELSE 0 END + CASE st_dir WHEN 1 THEN 5 ELSE -4 END
     + CASE weekly_trend WHEN 'BULLISH' THEN 3 WHEN 'WEAK_BULL' THEN 1 WHEN 'WEAK_BEAR' THEN -1 WHEN 'BEARISH' THEN -3 ELSE 0 END AS tr0,
    CASE WHEN coalesce(nullif(r_rsi,0),50)>72 THEN 7 WHEN coalesce(nullif(r_rsi,0),50)>=55 THEN 6 WHEN coalesce(nullif(r_rsi,0),50)>=45 THEN 4 WHEN coalesce(nullif(r_rsi,0),50)>=35 THEN 2 ELSE 1 END
     + CASE WHEN r_macd_hist>0 AND r_macd_hist>coalesce(r_macd_prev,0) THEN 3 WHEN r_macd_hist>0 THEN 1 ELSE 0 END
     + CASE ichimoku_signal WHEN 'BULLISH' THEN 4 WHEN 'WEAK_BULL' THEN 2 WHEN 'BEARISH' THEN -2 WHEN 'WEAK_BEAR' THEN -1 ELSE 0 END
     + CASE WHEN radx>25 AND {r('plus_di', 1)}>{r('minus_di', 1)} THEN 2 WHEN radx>25 AND {r('plus_di', 1)}<{r('minus_di', 1)} THEN -2 ELSE 0 END AS mo0,
    CASE WHEN weekly_trend IS NOT NULL THEN 15 ELSE 12 END AS trend_max, CASE WHEN ichimoku_signal IS NOT NULL AND ichimoku_signal<>'NEUTRAL' THEN 15 ELSE 11 END AS mom_max
  FROM z1 JOIN ctx ON rname=regime),
z3 AS (SELECT *, greatest(0,least(trend_max, trunc((CASE WHEN radx>0 AND radx<18 THEN trunc(tr0*0.5::double) ELSE tr0 END)*trend_mod)))::bigint AS p_trend,
    greatest(0,least(mom_max, trunc(mo0*mom_mod)))::bigint AS p_momentum,
    CASE WHEN rs_vs_index>10 THEN 10 WHEN rs_vs_index>5 THEN 8 WHEN rs_vs_index>0 THEN 5 WHEN rs_vs_index> -5 THEN 3 WHEN rs_vs_index> -10 THEN 1 ELSE 0 END AS p_strength,
    greatest(0,least(10, CASE WHEN vol>=2 THEN 6 WHEN vol>=1.5 THEN 5 WHEN vol>=1.2 THEN 4 WHEN vol>=0.8 THEN 2 WHEN breakout_watch THEN 3 ELSE 1 END
      + CASE obv_trend WHEN 'RISING' THEN 3 WHEN 'NEUTRAL' THEN 1 ELSE 0 END + CASE WHEN delivery_pct>55 THEN 1 ELSE 0 END)) AS p_participation,
    greatest(0,least(6, greatest(0, CASE WHEN above_200 AND above_50 THEN 8 WHEN above_200 THEN 5 WHEN above_50 THEN 3 ELSE 1 END - CASE WHEN vix_high THEN 2 ELSE 0 END))) AS p_market,
    CASE WHEN fund_score IS NULL THEN 3 ELSE greatest(0,least(6,round_even(fund_score/100.0::double*6,0)))::bigint END AS p_fundamental,
    CASE WHEN breakout_watch AND rs>0 THEN CASE WHEN vol_dryup THEN 2 ELSE 1 END ELSE 0 END AS p_squeeze,
    CASE stage WHEN 2 THEN 2 WHEN 3 THEN -1 WHEN 4 THEN -3 ELSE 0 END AS b_stage, CASE WHEN composite_rs>=80 THEN 1 ELSE 0 END AS b_composite_rs,
    CASE WHEN quality_score>=8 THEN 2 WHEN quality_score>=6 THEN 1 WHEN quality_score<=2 THEN -1 ELSE 0 END AS b_quality, CASE WHEN oi_spurt THEN 1 ELSE 0 END AS b_interest,
    greatest(-1,least(1, CASE fii_signal WHEN 'BULLISH' THEN 1 WHEN 'BEARISH' THEN -1 ELSE 0 END + CASE retail_signal WHEN 'BUY' THEN 1 WHEN 'SELL' THEN -1 ELSE 0 END)) AS b_participants,
    CASE WHEN bulk_deal THEN 1 ELSE 0 END AS b_deals, trend_max+mom_max+CASE WHEN rs_vs_index IS NOT NULL THEN 10 ELSE 0 END+24 AS base_max,
    CASE WHEN promoter_pledged>50 THEN 48 WHEN promoter_pledged>30 THEN 58 WHEN promoter_pledged>20 THEN 68 ELSE 100 END::double AS cap_pledge,
    CASE stage WHEN 3 THEN 65 WHEN 4 THEN 50 ELSE 100 END::double AS cap_stage,
    CASE WHEN fund_score<20 AND NOT lender AND debt_equity>3 THEN 52 WHEN fund_score<20 AND revenue_growth< -10 THEN 57 WHEN fund_score<20 THEN 63 ELSE 100 END::double AS cap_fundamental
  FROM z2),
z4 AS (SELECT *, CASE WHEN base_max/64.0::double<0.7 THEN 58 WHEN base_max/64.0::double<0.85 THEN 72 ELSE 100 END::double AS cap_coverage, round_even(base_max/64.0::double*100,0)::bigint AS score_coverage_pct,
    round_even(greatest(0,p_trend+p_momentum+p_strength+p_participation+p_market+p_fundamental+p_squeeze)/base_max::double*100,0)::bigint AS scaled_base,
    b_stage+b_composite_rs+b_quality+b_interest+b_participants+b_deals AS bonus FROM z3),
z5 AS (SELECT *, least(regime_cap,cap_pledge,cap_stage,cap_fundamental,cap_coverage) AS score_cap FROM z4),
z6 AS (SELECT *, CASE WHEN rn>=49 THEN cast(greatest(0,least(score_cap,100,scaled_base+bonus)) AS bigint) END AS score100 FROM z5),
z AS (SELECT *, CASE WHEN score100>=75 THEN 'HIGH-QUALITY SETUP' WHEN score100>=60 THEN 'GOOD SETUP' WHEN score100<=30 THEN 'NOT SUITABLE' WHEN score100<=45 THEN 'WEAK / AVOID' WHEN score100 IS NOT NULL THEN 'WATCHLIST' END AS score_verdict,
    CASE lost WHEN 0 THEN 'HIGH' ELSE CASE WHEN lost<=3 THEN 'MEDIUM' WHEN lost<=7 THEN 'LOW' ELSE 'INCOMPLETE' END END AS data_confidence,
    CASE WHEN r_close>breakout_level*1.005 AND score100>=55 THEN 'ENTRY' WHEN stage=2 AND score100>=60 THEN 'ENTRY' WHEN breakout_watch THEN 'WATCH' WHEN stage=1 AND rs>0 AND score100>=40 THEN 'WATCH'
      WHEN stage=2 AND score100>=45 THEN 'WATCH' WHEN stage=4 OR (st_dir=-1 AND rs< -5) THEN 'AVOID' WHEN score100<35 THEN 'AVOID' ELSE 'WATCH' END AS setup_status,
    greatest(0,least(15, CASE WHEN stop_capped THEN greatest(0,rr2-2) ELSE rr2 END)) AS rr_points
  FROM (SELECT *, CASE WHEN rs=0 THEN 3 ELSE 0 END+CASE WHEN ichimoku_signal IS NULL THEN 2 ELSE 0 END+CASE WHEN weekly_trend IS NULL THEN 2 ELSE 0 END+CASE WHEN radx=0 THEN 1 ELSE 0 END
      +CASE WHEN fund_score IS NULL THEN 3 ELSE 0 END+CASE WHEN coalesce(rr_ratio,0)=0 THEN 2 ELSE 0 END AS lost,
      CASE WHEN resistance_blocks_target THEN greatest(0,rr1-3) ELSE rr1 END AS rr2
    FROM (SELECT *, CASE WHEN rr_ratio>=3 THEN 10 WHEN rr_ratio>=2.5 THEN 8 WHEN rr_ratio>=2 THEN 6 WHEN rr_ratio>=1.5 THEN 3 ELSE 0 END
      + CASE WHEN sl_buy>0 AND r_close>0 AND r_atr>0 THEN CASE WHEN (r_close-sl_buy)/r_atr>=1.2 THEN 5 WHEN (r_close-sl_buy)/r_atr>=0.8 THEN 3 WHEN (r_close-sl_buy)/r_atr>=0.5 THEN 1 ELSE 0 END ELSE 0 END AS rr1 FROM z6)))"""

IDX = [INDEX, *tech("x", "ix"), REGIME]
SCAN = [*TECH, SUPERTREND, PSAR, PATTERNS, SWINGS, WEEKS, *IDX, STRENGTH, FUNDAMENTALS, SCAN0, SCORE]
TECHNICAL = [*TECH, SUPERTREND, PSAR, PATTERNS, SWINGS, WEEKS, INDEX, STRENGTH, SCAN0]


def _from_technical(*names: str):
    return lambda spark, sf: tidy(
        scan.technical(spark, sf).select("symbol", "date", *names)
    )


def _from_scan(*names):
    return lambda spark, sf: tidy(scan.scan(spark, sf).select("symbol", "date", *names))


def _base(spark, sf):
    df = scoring.with_base_signal(bars(spark, sf))
    return tidy(df.select("symbol", "date", "base_points", F.coalesce(F.concat_ws("|", "base_signals"), F.lit("")).alias("base_signals"), "base_verdict", "sl_base", "t1_base", "t2_base", "change_pct"))


register(
    "p01_base_signal",
    _base,
    query(
        TECHNICAL,
        """SELECT symbol, strftime(date,'%Y-%m-%d') AS date, base_points, CASE WHEN rn>=49 THEN btags ELSE '' END AS base_signals,
  CASE WHEN base_points>=4 THEN 'STRONG BUY' WHEN base_points>=2 THEN 'BUY' WHEN base_points<=-4 THEN 'STRONG SELL / SHORT' WHEN base_points<=-2 THEN 'SELL / AVOID' WHEN base_points IS NOT NULL THEN 'NEUTRAL / WAIT' END AS base_verdict,
  round(sl_base,4)+0.0::double AS sl_base, round(t1_base,4)+0.0::double AS t1_base, round(t2_base,4)+0.0::double AS t2_base, round(change_pct,4)+0.0::double AS change_pct FROM q8""",
        True,
    ),
)


def _indicator_points(spark, sf):
    df = scan.technical(spark, sf)
    return tidy(df.select("symbol", "date", "ind_points", F.concat_ws("|", "ind_signals").alias("ind_signals")))


register(
    "p02_indicator_points",
    _indicator_points,
    query(TECHNICAL, "SELECT symbol, strftime(date,'%Y-%m-%d') AS date, ind_points, CASE WHEN rn>=49 THEN itags ELSE '' END AS ind_signals FROM q8", True),
)


def _levels(spark, sf):
    df = ind.compose(bars(spark, sf), ind.pivots())
    df = scoring.with_trade_levels(scoring.with_base_signal(df))
    return tidy(df.select("symbol", "date", "sl_buy", "target1", "target2", "rr_ratio", "stop_capped", "resistance_blocks_target"))


register(
    "p03_trade_levels",
    _levels,
    query(TECHNICAL, f"SELECT {select('symbol date@d sl_buy@4 target1@4 target2@4 rr_ratio@4 stop_capped@i resistance_blocks_target@i')} FROM q8", True),
)

for _key, _spec in {
    "p04_regime_modifiers": "trend_mod@4 mom_mod@4 regime_cap@4",
    "p05_trend_bucket": "p_trend@i trend_max@i",
    "p06_momentum_bucket": "p_momentum@i mom_max@i",
    "p07_strength_bucket": "p_strength@i",
    "p08_participation_bucket": "p_participation@i",
    "p10_market_fundamental_squeeze": "p_market@i p_fundamental@i p_squeeze@i",
    "p11_bonuses": "b_stage@i b_composite_rs@i b_quality@i b_interest@i b_participants@i b_deals@i",
    "p12_score_caps": "cap_pledge@4 cap_stage@4 cap_fundamental@4 cap_coverage@4 score_cap@4",
    "p13_score": "score100@i score_coverage_pct@i base_max@i scaled_base@i bonus@i",
    "p14_verdict": "score100@i score_verdict",
}.items():
    register(
        _key,
        _from_scan(*[s.partition("@")[0] for s in _spec.split()]),
        query(SCAN, f"SELECT {select('symbol date@d ' + _spec)} FROM z", True),
    )


def _diagnostics(name, expr):
    return lambda spark, sf: tidy(scan.scan(spark, sf).select("symbol", "date", expr().alias(name)))


register("p09_reward_risk", _diagnostics("rr_points", scoring.reward_risk_points), query(SCAN, f"SELECT {select('symbol date@d rr_points@i')} FROM z", True))
register("p15_data_confidence", _diagnostics("data_confidence", scoring.data_confidence), query(SCAN, f"SELECT {select('symbol date@d data_confidence')} FROM z", True))
register("p16_setup_status", _diagnostics("setup_status", scoring.setup_status), query(SCAN, f"SELECT {select('symbol date@d setup_status')} FROM z", True))
