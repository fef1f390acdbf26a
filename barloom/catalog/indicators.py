"""Indicator queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from barloom.catalog.base import register, tidy
from barloom.catalog.oracle import BARS, W, lag, query, roll, select, span, tail, wilder
from barloom.functions import indicators as ind
from barloom.functions.scoring import rnd
from barloom.plans.tables import bars

# SQL form of the same indicators: each CTE may read the columns of the one before.
T1 = f"""t1 AS (SELECT *, {lag('close')} AS pc, close-{lag('close')} AS chg, (high+low+close)/3 AS tp,
  greatest(high-low, abs(high-{lag('close')}), abs(low-{lag('close')})) AS tr,
  high-{lag('high')} AS up_move, {lag('low')}-low AS dn_move,
  coalesce(sign(close-{lag('close')}),0)*volume AS obv_step,
  ((close-low)-(high-close))/nullif(high-low,0)*volume AS mfv
  FROM b)"""

T2 = f"""t2 AS (SELECT *, CASE WHEN chg IS NOT NULL THEN greatest(chg,0) END AS gain, CASE WHEN chg IS NOT NULL THEN greatest(-chg,0) END AS loss,
  CASE WHEN up_move>dn_move AND up_move>0 THEN up_move ELSE 0 END AS pdm,
  CASE WHEN dn_move>up_move AND dn_move>0 THEN dn_move ELSE 0 END AS mdm,
  CASE WHEN tp>{lag('tp')} THEN tp*volume ELSE 0 END AS flow_up, CASE WHEN tp<{lag('tp')} THEN tp*volume ELSE 0 END AS flow_down,
  sum(obv_step) OVER ({W}) AS obv,
  {", ".join(f"{roll('avg', 'close', n)} AS s{n}" for n in (20, 50, 150, 200))},
  {roll('stddev_samp', 'close', 20)} AS bb_sd, {roll('avg', 'tp', 20)} AS tp_mean,
  list(tp) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS tp20,
  {roll('sum', 'close*volume', 20)} AS cv20, {roll('sum', 'volume', 20)} AS vsum20, {roll('avg', 'volume', 20)} AS v20, {roll('avg', 'volume', 5)} AS v5,
  {", ".join(f"{roll('max', 'high', n)} AS hh{n}" for n in (9, 10, 14, 20, 26, 52, 126, 252))},
  {", ".join(f"{roll('min', 'low', n)} AS ll{n}" for n in (9, 10, 14, 20, 26, 52))},
  {tail('max', 'high', 252)} AS high_52w, {tail('min', 'low', 252)} AS low_52w,
  {roll('sum', 'mfv', 20)} AS mfv20
  FROM t1)"""

T3 = f"""t3 AS (SELECT *, {", ".join(f"{span('close', n)} AS e{n}" for n in (9, 12, 20, 21, 26, 50, 65, 150, 200))},
  {wilder('gain', 14, '1')} AS rsi_gain, {wilder('loss', 14, '1')} AS rsi_loss,
  {", ".join(f"{wilder('tr', n)} AS atr{n}" for n in (10, 14, 20))},
  {wilder('pdm', 14)} AS pdm_mean, {wilder('mdm', 14)} AS mdm_mean, {span('obv', 20)} AS obv_ema,
  {span('tr', 10)} AS st_atr,
  s20 AS bb_mid, s20+2*bb_sd AS bb_upper, s20-2*bb_sd AS bb_lower, 4*bb_sd/nullif(s20,0) AS bb_width,
  (tp-tp_mean)/(0.015::double*nullif(list_sum(list_transform(tp20, lambda x: abs(x-tp_mean)))/20.0::double,0)) AS cci,
  cv20/vsum20 AS vwap20, 100*(close-ll14)/nullif(hh14-ll14,0) AS stoch_k, -100*(hh14-close)/nullif(hh14-ll14,0) AS williams_r,
  mfv20/nullif(vsum20,0) AS cmf, (close/{lag('close', 20)}-1)*100 AS roc20,
  100-100/(1+({roll('sum', 'flow_up', 14)})/nullif({roll('sum', 'flow_down', 14)},0)) AS mfi,
  volume/nullif(v20,0) AS vol_ratio,
  (hh9+ll9)/2 AS tenkan, (hh26+ll26)/2 AS kijun, (hh52+ll52)/2 AS span52,
  (close-high_52w)/high_52w*100 AS near_high_pct, (close-low_52w)/low_52w*100 AS near_low_pct
  FROM t2)"""

T4 = f"""t4 AS (SELECT *, e12-e26 AS macd, 100-100/(1+rsi_gain/nullif(rsi_loss,0)) AS rsi_raw,
  CASE WHEN rsi_loss=0 AND rsi_gain>0 THEN 100 WHEN rsi_loss=0 AND rsi_gain=0 THEN 50 ELSE 100-100/(1+rsi_gain/nullif(rsi_loss,0)) END AS rsi,
  100*pdm_mean/nullif(atr14,0) AS plus_di, 100*mdm_mean/nullif(atr14,0) AS minus_di,
  {roll('avg', 'stoch_k', 3)} AS stoch_d, e20+2*atr20 AS kc_upper, e20-2*atr20 AS kc_lower, e20+1.5*atr20 AS kc15_upper, e20-1.5*atr20 AS kc15_lower,
  CASE WHEN obv>obv_ema AND obv_ema>{lag('obv_ema')} THEN 'RISING' WHEN obv<obv_ema AND obv_ema<{lag('obv_ema')} THEN 'FALLING' ELSE 'NEUTRAL' END AS obv_trend,
  {lag('(tenkan+kijun)/2', 26)} AS senkou_a, {lag('span52', 26)} AS senkou_b,
  round(atr14/nullif({roll('avg', 'atr14', 20)},0),2) AS atr_ratio, v20>0 AND v5<v20*0.8 AS vol_dryup,
  round((e21-{lag('e21', 5)})/{lag('e21', 5)}*100,3) AS ema21_slope, round((e50-{lag('e50', 5)})/{lag('e50', 5)}*100,3) AS ema50_slope,
  CASE WHEN rn>=5 THEN round((close-e50)/e50*100,2) END AS ema50_dist_pct,
  least(rn-coalesce(max(CASE WHEN NOT close>e21 THEN rn END) OVER ({W}),-1),31) AS days_above_ema21,
  coalesce({lag('e150', 20)}, first_value(e150) OVER ({W})) AS e150_base
  FROM t3)"""

T5 = f"""t5 AS (SELECT *, {span('macd', 9)} AS macd_signal,
  100*abs(plus_di-minus_di)/nullif(plus_di+minus_di,0) AS dx, coalesce(100*abs(plus_di-minus_di)/nullif(plus_di+minus_di,0),0) AS dx0,
  min(CASE WHEN plus_di+minus_di<>0 THEN rn END) OVER ({W}) AS dx_seed,
  {roll('max', 'rsi', 14)} AS rsi_hi, {roll('min', 'rsi', 14)} AS rsi_lo, {roll('min', 'rsi_raw', 5)} AS rsi_min5, {roll('min', 'cci', 5)} AS cci_min5,
  CASE WHEN senkou_a<>0 AND senkou_b<>0 THEN greatest(senkou_a,senkou_b) END AS cloud_top,
  CASE WHEN senkou_a<>0 AND senkou_b<>0 THEN least(senkou_a,senkou_b) END AS cloud_bottom,
  CASE WHEN senkou_a<>0 AND senkou_b<>0 THEN senkou_a>senkou_b END AS cloud_green,
  (e150-e150_base)/e150_base*100 AS e150_slope
  FROM t4)"""

T6 = f"""t6 AS (SELECT *, macd-macd_signal AS macd_hist, {wilder('dx', 14, 'dx_seed')} AS adx, {wilder('dx0', 14)} AS adx_zero,
  100*(rsi-rsi_lo)/nullif(rsi_hi-rsi_lo,0) AS srsi,
  CASE WHEN rn<51 THEN NULL WHEN close>cloud_top AND tenkan>kijun AND cloud_green THEN 'BULLISH'
       WHEN close<cloud_bottom AND tenkan<kijun AND NOT cloud_green THEN 'BEARISH'
       WHEN close>cloud_top THEN 'WEAK_BULL' WHEN close<cloud_bottom THEN 'WEAK_BEAR' ELSE 'NEUTRAL' END AS ichimoku_signal,
  CASE WHEN rn<29 THEN 0 WHEN close>e150 AND close>e50 AND e50>e150 AND e150_slope>0.3 THEN 2
       WHEN close<=e150 AND e150_slope < -0.3 THEN 4
       WHEN close>e150 AND (e150_slope<=0.3 OR e50<=e150) THEN 3 ELSE 1 END AS stage
  FROM t5)"""

T7 = f"""t7 AS (SELECT *, {roll('avg', 'srsi', 3)} AS srsi_k FROM t6)"""
TECH = [BARS, T1, T2, T3, T4, T5, T6, T7]

FOLD_BANDS = f"""st0 AS (SELECT symbol, rn, close, high, low, pc, (high+low)/2+3*st_atr AS ub, (high+low)/2-3*st_atr AS lb,
  (high+low)/2+3*atr10 AS ub2, (high+low)/2-3*atr10 AS lb2 FROM t3)"""

SUPERTREND = f"""{FOLD_BANDS},
stu AS (SELECT symbol, rn, ub AS upper, lb AS lower FROM st0 WHERE rn=0
  UNION ALL
  SELECT x.symbol, x.rn, CASE WHEN x.ub<p.upper OR x.pc>p.upper THEN x.ub ELSE p.upper END,
         CASE WHEN x.lb>p.lower OR x.pc<p.lower THEN x.lb ELSE p.lower END
  FROM stu p JOIN st0 x ON x.symbol=p.symbol AND x.rn=p.rn+1),
st AS (SELECT u.symbol, u.rn, u.upper, u.lower, u.upper AS line, -1 AS dir FROM stu u WHERE u.rn=0
  UNION ALL
  SELECT u.symbol, u.rn, u.upper, u.lower,
    CASE WHEN p.line=p.upper THEN CASE WHEN x.close<=u.upper THEN u.upper ELSE u.lower END
         ELSE CASE WHEN x.close>=u.lower THEN u.lower ELSE u.upper END END,
    CASE WHEN p.line=p.upper THEN CASE WHEN x.close<=u.upper THEN -1 ELSE 1 END
         ELSE CASE WHEN x.close>=u.lower THEN 1 ELSE -1 END END
  FROM st p JOIN stu u ON u.symbol=p.symbol AND u.rn=p.rn+1 JOIN st0 x ON x.symbol=u.symbol AND x.rn=u.rn)"""

SIMPLE_SUPERTREND = f"""{FOLD_BANDS},
sst AS (SELECT symbol, rn, cast(NULL AS double) AS line, true AS up FROM st0 WHERE rn=0
  UNION ALL
  SELECT x.symbol, x.rn, CASE WHEN p.line IS NULL OR x.close>p.line THEN x.lb2 ELSE x.ub2 END, p.line IS NULL OR x.close>p.line
  FROM sst p JOIN st0 x ON x.symbol=p.symbol AND x.rn=p.rn+1)"""

PSAR = f"""ps0 AS (SELECT symbol, rn, high, low, {lag('low')} AS l1, coalesce({lag('low', 2)},{lag('low')}) AS l2,
   {lag('high')} AS h1, coalesce({lag('high', 2)},{lag('high')}) AS h2 FROM b),
ps AS (SELECT symbol, rn, low AS sar, high AS ep, 0.02::double AS af, true AS bull FROM ps0 WHERE rn=0
  UNION ALL
  SELECT symbol, rn, CASE WHEN flip THEN ep0 ELSE s END,
    CASE WHEN flip THEN CASE WHEN bull0 THEN low ELSE high END
         WHEN bull0 AND high>ep0 THEN high WHEN NOT bull0 AND low<ep0 THEN low ELSE ep0 END,
    CASE WHEN flip THEN 0.02::double WHEN (bull0 AND high>ep0) OR (NOT bull0 AND low<ep0) THEN least(af0+0.02::double,0.2::double) ELSE af0 END,
    bull0<>flip
  FROM (SELECT *, CASE WHEN bull0 THEN low<s ELSE high>s END AS flip FROM (
    SELECT x.*, p.ep AS ep0, p.af AS af0, p.bull AS bull0,
      CASE WHEN p.bull THEN least(p.sar+p.af*(p.ep-p.sar), x.l1, x.l2) ELSE greatest(p.sar+p.af*(p.ep-p.sar), x.h1, x.h2) END AS s
    FROM ps p JOIN ps0 x ON x.symbol=p.symbol AND x.rn=p.rn+1)))"""


def _over(layers, spec: str, extra=None):
    """Spark query: compose the layers over the bars and keep the named columns."""
    parts = [s.partition("@") for s in spec.split()]
    names = [n for n, _, _ in parts]
    digits = {n: int(k) for n, _, k in parts if k.isdigit()}

    def run(spark, sf_dir) -> DataFrame:
        df = ind.compose(bars(spark, sf_dir), *layers())
        if extra is not None:
            df = extra(df)
        return tidy(df.select(*names), **digits)

    return run


def _column(name: str, layers, spec: str, table: str = "t7") -> None:
    full = "symbol date@d " + spec
    register(name, _over(layers, full), query(TECH, f"SELECT {select(full)} FROM {table}"))


register(
    "d01_daily_bars",
    lambda spark, sf: tidy(bars(spark, sf).select("symbol", "date", "open", "high", "low", "close", "volume", "rn")),
    query(BARS, f"SELECT {select('symbol date@d open@4 high@4 low@4 close@4 volume@4 rn@i')} FROM b"),
)
_column("w01_ema", lambda: [ind.emas(9, 21, 50, 200)], "e9@4 e21@4 e50@4 e200@4")
_column("w02_sma", lambda: [ind.smas(20, 50, 200)], "s20@6 s50@6 s200@6")
_column("w03_rsi_masked", lambda: [ind.rsi()], "rsi@4")
_column("w04_rsi_raw", lambda: [ind.rsi()], "rsi_raw@4")
register(
    "w05_rsi_simple",
    _over(lambda: [ind.rsi_simple()], "symbol date rsi_simple"),
    query(
        [BARS, T1, T2, f"r AS (SELECT *, {roll('avg', 'gain', 14)} AS g, {roll('avg', 'loss', 14)} AS l FROM t2)"],
        f"SELECT symbol, strftime(date,'%Y-%m-%d') AS date, round(CASE WHEN l=0 THEN 100 ELSE 100-100/(1+g/l) END,4)+0.0::double AS rsi_simple FROM r",
    ),
)
_column("w06_macd", lambda: [ind.macd()], "macd@4 macd_signal@4 macd_hist@4")
_column("w07_bollinger", lambda: [ind.bollinger()], "bb_upper@4 bb_mid@4 bb_lower@4")
_column("w08_band_width", lambda: [ind.bollinger()], "bb_width@6")
_column("w09_atr", lambda: [ind.atr(10, 14, 20)], "tr@4 atr10@4 atr14@4 atr20@4")
register(
    "w10_supertrend",
    lambda spark, sf: tidy(ind.with_supertrend(bars(spark, sf)).select("symbol", "date", "st_line", "st_dir")),
    query(
        [*TECH[:4], SUPERTREND],
        "SELECT b.symbol, strftime(b.date,'%Y-%m-%d') AS date, round(line,4)+0.0::double AS st_line, cast(dir AS bigint) AS st_dir FROM st JOIN b USING (symbol, rn)",
        recursive=True,
    ),
)
register(
    "w11_supertrend_simple",
    lambda spark, sf: tidy(ind.with_simple_supertrend(bars(spark, sf)).select("symbol", "date", "sst_line", "sst_up")),
    query(
        [*TECH[:4], SIMPLE_SUPERTREND],
        "SELECT b.symbol, strftime(b.date,'%Y-%m-%d') AS date, round(line,4)+0.0::double AS sst_line, cast(up AS bigint) AS sst_up FROM sst JOIN b USING (symbol, rn)",
        recursive=True,
    ),
)
_column("w12_cci", lambda: [ind.cci()], "cci@4")
register(
    "w14_vwap_proxy",
    _over(lambda: [ind.vwap_proxy()], "symbol date vwap20", lambda df: df.withColumn("vwap20", rnd("vwap20", 4))),
    query(TECH[:4], "SELECT symbol, strftime(date,'%Y-%m-%d') AS date, cast(round(cast(vwap20 AS decimal(24,8)),4) AS double)+0.0::double AS vwap20 FROM t3"),
)
_column("w15_stochastic", lambda: [ind.stochastic()], "stoch_k@4 stoch_d@4")
_column("w16_adx", lambda: [ind.adx()], "adx@4 plus_di@4 minus_di@4")
_column("w17_adx_zero", lambda: [ind.adx()], "adx_zero@4")
register(
    "w18_parabolic_sar",
    lambda spark, sf: tidy(ind.with_parabolic_sar(bars(spark, sf)).select("symbol", "date", "psar", "psar_dir")),
    query(
        [BARS, PSAR],
        "SELECT b.symbol, strftime(b.date,'%Y-%m-%d') AS date, round(sar,4)+0.0::double AS psar, cast(CASE WHEN bull THEN 1 ELSE -1 END AS bigint) AS psar_dir FROM ps JOIN b USING (symbol, rn)",
        recursive=True,
    ),
)
_column("w19_ichimoku", lambda: [ind.ichimoku()], "tenkan@4 kijun@4 cloud_top@4 cloud_bottom@4 cloud_green@i ichimoku_signal")
register(
    "w20_stoch_rsi",
    _over(lambda: [ind.stoch_rsi()], "symbol date srsi_k srsi_d"),
    query(
        [*TECH, f"t8 AS (SELECT *, {roll('avg', 'srsi_k', 3)} AS srsi_d FROM t7)"],
        f"SELECT {select('symbol date@d srsi_k@4 srsi_d@4')} FROM t8",
    ),
)
_column("w21_williams_r", lambda: [ind.williams()], "williams_r@4")
_column("w22_obv", lambda: [ind.obv()], "obv@4 obv_ema@4 obv_trend")
_column("w23_mfi", lambda: [ind.mfi()], "mfi@4")
_column("w24_keltner", lambda: [ind.keltner()], "kc_upper@4 kc_lower@4 kc15_upper@4 kc15_lower@4")
_column("w25_donchian", lambda: [ind.highs(20), ind.lows(20)], "hh20@4 ll20@4")
_column("w26_chaikin_money_flow", lambda: [ind.cmf()], "cmf@6")
_column("w27_rate_of_change", lambda: [ind.roc()], "roc20@4")

PATTERNS = f"""pt1 AS (SELECT *, {roll('avg', 'close', 20)} AS ma, {lag('open')} AS po, {lag('close')} AS pcl, {lag('open', 2)} AS po2, {lag('close', 2)} AS pc2,
   abs(close-open) AS body, high-low AS rng, high-greatest(open,close) AS up, least(open,close)-low AS dn FROM b),
pt2 AS (SELECT *, CASE WHEN rng>0 AND dn/rng>0.55 AND (body=0 OR dn>1.5*body) THEN low END AS pin FROM pt1),
pt3 AS (SELECT *, last_value(CASE WHEN pin IS NOT NULL THEN rn END IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_pin_rn,
   last_value(pin IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_pin FROM pt2),
pt4 AS (SELECT *, CASE WHEN pin IS NOT NULL AND prev_pin>0 AND abs(prev_pin-pin)/prev_pin<0.015 THEN prev_pin_rn END AS pair_start FROM pt3),
pt AS (SELECT *, concat_ws('|',
   CASE WHEN rng>0 AND body/rng<0.08 THEN 'doji' END,
   CASE WHEN body>0 AND rng>0 AND dn>=2.5*body AND up<=body*0.4 AND close<ma THEN 'hammer' END,
   CASE WHEN body>0 AND rng>0 AND up>=2.5*body AND dn<=body*0.4 AND close<ma THEN 'inverted_hammer' END,
   CASE WHEN body>0 AND rng>0 AND up>=2.5*body AND dn<=body*0.4 AND close>ma THEN 'shooting_star' END,
   CASE WHEN pcl<po AND close>open AND open<=pcl AND close>=po THEN 'bullish_engulfing' END,
   CASE WHEN pcl>po AND close<open AND open>=pcl AND close<=po THEN 'bearish_engulfing' END,
   CASE WHEN pc2<po2 AND abs(pcl-po)<abs(pc2-po2)*0.35 AND close>open AND close>(po2+pc2)/2 THEN 'morning_star' END,
   CASE WHEN pc2>po2 AND abs(pcl-po)<abs(pc2-po2)*0.35 AND close<open AND close<(po2+pc2)/2 THEN 'evening_star' END,
   CASE WHEN rng>0 AND body/rng>0.92 AND close>open THEN 'bullish_marubozu' END,
   CASE WHEN rng>0 AND body/rng>0.92 AND close<=open THEN 'bearish_marubozu' END,
   CASE WHEN rn>=4 AND max(pair_start) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)>=rn-4 THEN 'double_rejection' END) AS labels FROM pt4)"""
register(
    "w28_candlestick_labels",
    _over(lambda: [ind.patterns()], "symbol date patterns"),
    query([BARS, PATTERNS], "SELECT symbol, strftime(date,'%Y-%m-%d') AS date, CASE WHEN rn<2 THEN '' ELSE labels END AS patterns FROM pt"),
)
PIVOTS = f"""pv AS (SELECT symbol, date, rn, {lag('high')} AS h, {lag('low')} AS l, {lag('close')} AS c FROM b)"""
register(
    "w29_pivot_levels",
    _over(
        lambda: [ind.pivots()],
        "symbol date pivot resistance resistance2 support support2 cpr_top cpr_bottom cpr_width_pct cpr_narrow",
    ),
    query(
        [
            BARS,
            PIVOTS,
            "pw AS (SELECT *, (h+l+c)/3 AS pp, (h+l)/2 AS cpr_top FROM pv)",
            "px AS (SELECT *, 2*pp-l AS resistance, pp+(h-l) AS resistance2, 2*pp-h AS support, pp-(h-l) AS support2, 2*pp-cpr_top AS cpr_bottom, abs(cpr_top-(2*pp-cpr_top))/pp*100 AS cpr_width_pct FROM pw)",
        ],
        f"SELECT {select('symbol date@d resistance@4 resistance2@4 support@4 support2@4 cpr_top@4 cpr_bottom@4 cpr_width_pct@4')}, round(pp,4)+0.0::double AS \"pivot\", cast(cpr_width_pct<0.5 AS bigint) AS cpr_narrow FROM px",
    ),
)
register(
    "w30_stage",
    _over(lambda: [ind.stage()], "symbol date stage late_base e150 e150_slope near_high_pct near_low_pct"),
    query(
        TECH,
        f"SELECT {select('symbol date@d stage@i e150@4 e150_slope@4 near_high_pct@4 near_low_pct@4')}, cast(stage=1 AND round(near_low_pct,1)>25 AND abs(e150_slope)<0.5 AS bigint) AS late_base FROM t7",
    ),
)
SWINGS = """sh AS (SELECT a.symbol, a.rn, round(a.high,2) AS p, true AS is_high FROM b a WHERE a.rn>=3 AND
    (SELECT count(*)=7 AND max(x.high)=a.high FROM b x WHERE x.symbol=a.symbol AND x.rn BETWEEN a.rn-3 AND a.rn+3)
  UNION ALL SELECT a.symbol, a.rn, round(a.low,2), false FROM b a WHERE a.rn>=3 AND
    (SELECT count(*)=7 AND min(x.low)=a.low FROM b x WHERE x.symbol=a.symbol AND x.rn BETWEEN a.rn-3 AND a.rn+3)),
sw AS (SELECT b.symbol, b.date, b.rn, b.close, min(CASE WHEN is_high AND p>close*1.005 THEN p END) AS breakout_level,
    max(CASE WHEN NOT is_high AND p<close*0.995 THEN p END) AS key_support
  FROM b LEFT JOIN sh ON sh.symbol=b.symbol AND sh.rn BETWEEN b.rn-59 AND b.rn-3 GROUP BY ALL)"""
register(
    "w31_swing_levels",
    _over(lambda: [ind.swing_levels()], "symbol date breakout_level key_support breakout_dist_pct"),
    query(
        [BARS, SWINGS],
        "SELECT symbol, strftime(date,'%Y-%m-%d') AS date, round(breakout_level,4)+0.0::double AS breakout_level, round(key_support,4)+0.0::double AS key_support, round((breakout_level-close)/close*100,1)+0.0::double AS breakout_dist_pct FROM sw",
    ),
)
_column(
    "w36_slopes_and_streak",
    lambda: [ind.slopes()],
    "ema21_slope@3 ema50_slope@3 ema50_dist_pct@2 days_above_ema21@i",
)
_column("w37_year_range", lambda: [ind.year_range()], "high_52w@4 low_52w@4 near_high_pct@4 near_low_pct@4")
BREAKOUT = """coalesce(rn>=24 AND (round(near_high_pct,1)>-20 OR (round(e50,2)>0 AND round(close,2)>=round(e50,2)*0.97)) AND atr_ratio<0.85 AND (vol_dryup OR obv_trend='RISING'), false)"""
register(
    "w38_squeeze",
    _over(
        lambda: [ind.squeeze(), ind.obv(), ind.year_range(), ind.emas(50)],
        "symbol date atr_ratio vol_dryup breakout_watch",
        lambda df: df.withColumn("breakout_watch", ind.breakout_watch()),
    ),
    query(TECH, f"SELECT {select('symbol date@d atr_ratio@2 vol_dryup@i')}, cast({BREAKOUT} AS bigint) AS breakout_watch FROM t7"),
)
register(
    "w39_short_momentum",
    _over(
        lambda: [ind.volume_average()],
        "symbol date short_momentum",
        lambda df: df.withColumn("short_momentum", ind.short_momentum()),
    ),
    query(
        [*TECH[:4], f"m AS (SELECT *, (close-{lag('close', 4)})/{lag('close', 4)}*100 AS ch FROM t3)"],
        "SELECT symbol, strftime(date,'%Y-%m-%d') AS date, CASE WHEN ch>0.5 AND vol_ratio>1.3 THEN 'BULLISH MOMENTUM' WHEN ch< -0.5 AND vol_ratio>1.3 THEN 'BEARISH MOMENTUM' ELSE 'NEUTRAL' END AS short_momentum FROM m",
    ),
)
