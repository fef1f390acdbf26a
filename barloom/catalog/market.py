"""Weekly, index and strength queries and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from barloom.catalog.base import register, tidy
from barloom.catalog.indicators import TECH, T1, T2, T3, T4, T5, T6, T7
from barloom.catalog.oracle import BARS, INDEX, W, lag, query, roll, select, span
from barloom.functions import indicators as ind, market
from barloom.functions.outcomes import valid_bar_tolerant
from barloom.functions.windows import Long, frame_array, lag as wlag, roll as wroll
from barloom.plans.tables import bars, daily_bars, index_series


def tech(prefix: str, base: str) -> list[str]:
    """The indicator CTEs over another bar table, renamed."""
    out = []
    for t in (T1, T2, T3, T4, T5, T6, T7):
        t = re.sub(r"\bt([1-7])\b", rf"{prefix}\1", t)
        out.append(t.replace("FROM b)", f"FROM {base})"))
    return out


def supertrend_sql(prefix: str, source: str) -> str:
    """Recursive bands over ``source(symbol, rn, high, low, close, pc, st_atr)``."""
    p = prefix
    return f"""{p}0 AS (SELECT symbol, rn, close, pc, st_atr, (high+low)/2+3*st_atr AS ub, (high+low)/2-3*st_atr AS lb FROM {source}),
{p} AS (SELECT symbol, rn, ub AS upper, lb AS lower, ub AS line, -1 AS dir FROM {p}0 WHERE rn=0
  UNION ALL
  SELECT symbol, rn, u, l, CASE WHEN dn THEN u ELSE l END, CASE WHEN dn THEN -1 ELSE 1 END FROM (
    SELECT *, CASE WHEN pline=pu THEN close<=u ELSE close<l END AS dn FROM (
      SELECT x.symbol, x.rn, x.close, p.line AS pline, p.upper AS pu,
        CASE WHEN x.ub<p.upper OR x.pc>p.upper THEN x.ub ELSE p.upper END AS u,
        CASE WHEN x.lb>p.lower OR x.pc<p.lower THEN x.lb ELSE p.lower END AS l
      FROM {p} p JOIN {p}0 x ON x.symbol=p.symbol AND x.rn=p.rn+1)))"""


WEEKS = f"""wk AS (SELECT symbol, date_trunc('week', date) AS week, arg_min(open, date) AS open, max(high) AS high, min(low) AS low,
   arg_max(close, date) AS close, sum(volume) AS volume, cast(row_number() OVER (PARTITION BY symbol ORDER BY date_trunc('week', date)) AS bigint)-1 AS rn FROM b GROUP BY symbol, date_trunc('week', date)),
wk1 AS (SELECT *, {lag('close')} AS pc, greatest(high-low, abs(high-{lag('close')}), abs(low-{lag('close')})) AS tr FROM wk),
wk2 AS (SELECT *, {span('tr', 10)} AS st_atr, {span('close', 20)} AS e20 FROM wk1),
{supertrend_sql('wst', 'wk2')},
wb0 AS (SELECT symbol, date, rn, close, date_trunc('week', date) AS week, max(high) OVER (PARTITION BY symbol, date_trunc('week', date) ORDER BY rn) AS h,
   min(low) OVER (PARTITION BY symbol, date_trunc('week', date) ORDER BY rn) AS l FROM b),
wb1 AS (SELECT b.*, k.rn AS wn, q.close AS pc, q.e20 AS pe, q.st_atr AS pa, s.upper AS pu, s.lower AS pl, s.line AS ps
   FROM wb0 b JOIN wk2 k USING (symbol, week) LEFT JOIN wk2 q ON q.symbol=k.symbol AND q.rn=k.rn-1 LEFT JOIN wst s ON s.symbol=k.symbol AND s.rn=k.rn-1),
wb2 AS (SELECT *, (2.0::double/11)*greatest(h-l, abs(h-pc), abs(l-pc))+(1-2.0::double/11)*pa AS a, (2.0::double/21)*close+(1-2.0::double/21)*pe AS wmean FROM wb1),
wb3 AS (SELECT *, CASE WHEN (h+l)/2+3*a<pu OR pc>pu THEN (h+l)/2+3*a ELSE pu END AS u, CASE WHEN (h+l)/2-3*a>pl OR pc<pl THEN (h+l)/2-3*a ELSE pl END AS lo FROM wb2),
wb AS (SELECT symbol, rn, CASE WHEN wn>=14 THEN wmean END AS weekly_ema20,
   CASE WHEN wn>=14 THEN CASE WHEN CASE WHEN ps=pu THEN close<=u ELSE close<lo END THEN -1 ELSE 1 END END AS weekly_dir, close>wmean AS wup FROM wb3),
wt AS (SELECT *, CASE WHEN weekly_dir IS NULL THEN NULL WHEN wup AND weekly_dir=1 THEN 'BULLISH' WHEN NOT wup AND weekly_dir=-1 THEN 'BEARISH' WHEN wup THEN 'WEAK_BULL' ELSE 'WEAK_BEAR' END AS weekly_trend FROM wb)"""

register(
    "c03_weekly_resample",
    lambda spark, sf: tidy(market.weekly_bars(daily_bars(spark, sf)).select("symbol", "week", "open", "high", "low", "close", "volume")),
    query(
        [BARS],
        "SELECT symbol, strftime(date_trunc('week', date),'%Y-%m-%d') AS week, round(arg_min(open,date),4)+0.0::double AS open, round(max(high),4)+0.0::double AS high, round(min(low),4)+0.0::double AS low, round(arg_max(close,date),4)+0.0::double AS close, round(sum(volume),4)+0.0::double AS volume FROM b GROUP BY 1,2",
    ),
)
register(
    "w35_weekly_trend",
    lambda spark, sf: tidy(market.with_weekly_trend(bars(spark, sf)).select("symbol", "date", "weekly_trend", "weekly_dir", "weekly_ema20")),
    query(
        [BARS, WEEKS],
        f"SELECT b.symbol, strftime(b.date,'%Y-%m-%d') AS date, weekly_trend, cast(weekly_dir AS bigint) AS weekly_dir, round(weekly_ema20,4)+0.0::double AS weekly_ema20 FROM wt JOIN b USING (symbol, rn)",
        True,
    ),
)

STRENGTH = f"""ixs AS (SELECT date, rn AS ixn, close AS ixclose, {', '.join(f"(close/{lag('close', p - 1)}-1)*100 AS ix{p}" for p in (63, 126, 189, 252))},
   list(close) OVER ({W} ROWS BETWEEN 51 PRECEDING AND CURRENT ROW) AS ix52 FROM ix),
rs0 AS (SELECT symbol, rn, date, close, {', '.join(f"(close/{lag('close', p - 1)}-1)*100 AS r{p}" for p in (63, 126, 189, 252))},
   list(close) OVER ({W} ROWS BETWEEN 51 PRECEDING AND CURRENT ROW) AS c52 FROM b),
rs1 AS (SELECT *, r63-ix63 AS x3, r126-ix126 AS x6, r189-ix189 AS x9, r252-ix252 AS x12,
   list_avg(list_transform(c52, lambda x, i: x/ix52[i])) AS rm FROM rs0 LEFT JOIN ixs USING (date)),
rs AS (SELECT symbol, rn, date, round(x3,2) AS rs_vs_index,
   CASE WHEN x3 IS NOT NULL THEN round(greatest(0,least(100,50+1.25*(coalesce(x3*0.4,0)+coalesce(x6*0.2,0)+coalesce(x9*0.2,0)+coalesce(x12*0.2,0))/
     (0.4::double+CASE WHEN x6 IS NOT NULL THEN 0.2::double ELSE 0 END+CASE WHEN x9 IS NOT NULL THEN 0.2::double ELSE 0 END+CASE WHEN x12 IS NOT NULL THEN 0.2::double ELSE 0 END))),1) END AS composite_rs,
   CASE WHEN rn>=59 AND ixn>=59 THEN round((close/ixclose-rm)/rm*100,2) END AS mansfield_rs FROM rs1)"""


def _strength(*names):
    return lambda spark, sf: tidy(
        market.with_strength(bars(spark, sf), index_series(spark, sf)).select("symbol", "date", *names)
    )


for _key, _name, _digits in (
    ("w32_relative_strength", "rs_vs_index", 2),
    ("w33_composite_strength", "composite_rs", 1),
    ("w34_mansfield_strength", "mansfield_rs", 2),
):
    register(
        _key,
        _strength(_name),
        query([BARS, INDEX, STRENGTH], f"SELECT {select(f'symbol date@d {_name}@{_digits}')} FROM rs"),
    )

IX = [INDEX, *tech("x", "ix")]
REGIME = """rg AS (SELECT *, close>e200 AS above_200, close>e50 AS above_50, coalesce(adx>25,false) AS strong FROM x7),
rgm AS (SELECT *, CASE WHEN above_200 AND strong AND above_50 THEN 'BULL_TREND' WHEN above_200 AND NOT strong THEN 'BULL_WEAK'
  WHEN NOT above_200 AND above_50 THEN 'RECOVERY' WHEN NOT above_200 AND strong THEN 'BEAR_TREND' ELSE 'SIDEWAYS' END AS regime,
  10.0::double+(cast(volume/100 AS bigint)%2000)/100.0::double AS vix FROM rg)"""
register(
    "w40_index_regime",
    lambda spark, sf: tidy(market.regime_series(index_series(spark, sf)).select("date", "regime", "above_200", "above_50")),
    query([*IX, REGIME], f"SELECT {select('date@d regime above_200@i above_50@i')} FROM rgm"),
)


def _live(spark, sf):
    vix = 10.0 + F.pmod((F.col("volume") / 100).cast("long"), F.lit(2000)) / 100.0
    df = market.live_regime(index_series(spark, sf), vix)
    return tidy(df.select("date", "regime", "weekly_trend", "return_1m", "return_3m"))


register(
    "w41_index_regime_live",
    _live,
    query(
        [
            *IX,
            REGIME,
            f"iw AS (SELECT date_trunc('week', date) AS week, arg_max(close,date) AS close, cast(row_number() OVER (ORDER BY date_trunc('week', date)) AS bigint)-1 AS rn, '^INDEX' AS symbol FROM ix GROUP BY date_trunc('week', date))",
            f"iw2 AS (SELECT *, {span('close', 20)} AS wm FROM iw)",
            "il AS (SELECT r.*, k.rn AS wn, 2.0::double/21*r.close+(1-2.0::double/21)*q.wm AS m FROM rgm r JOIN iw2 k ON k.week=date_trunc('week', r.date) LEFT JOIN iw2 q ON q.rn=k.rn-1)",
            f"il2 AS (SELECT *, rn>=199 AND above_200 AS a2, (close/lag(close,20) OVER (ORDER BY rn)-1)*100 AS q1, (close/lag(close,62) OVER (ORDER BY rn)-1)*100 AS q3 FROM il)",
        ],
        """SELECT strftime(date,'%Y-%m-%d') AS date, CASE WHEN rn<49 THEN 'UNKNOWN' WHEN vix>25 THEN 'HIGH_VOLATILITY' WHEN a2 AND strong AND above_50 THEN 'BULL_TREND' WHEN a2 AND NOT strong THEN 'BULL_WEAK'
  WHEN NOT a2 AND above_50 THEN 'RECOVERY' WHEN NOT a2 AND strong THEN 'BEAR_TREND' ELSE 'SIDEWAYS' END AS regime,
  CASE WHEN wn>=19 THEN CASE WHEN close>m THEN 'BULLISH' ELSE 'BEARISH' END END AS weekly_trend, round(q1,2)+0.0::double AS return_1m, round(q3,2)+0.0::double AS return_3m FROM il2""",
    ),
)


def _norm_mean(n: int) -> str:
    keep = f"(1-2.0::double/{n + 1})"
    return f"(sum(close*pow({keep},-rn)) OVER ({W}))/(sum(pow({keep},-rn)) OVER ({W}))"


register(
    "w42_index_regime_slope",
    lambda spark, sf: tidy(market.slope_regime(index_series(spark, sf)).select("date", "m50", "m200", "slope", "regime")),
    query(
        [
            INDEX,
            f"n1 AS (SELECT *, {_norm_mean(50)} AS m50, {_norm_mean(200)} AS m200 FROM ix)",
            f"n2 AS (SELECT *, (m50-{lag('m50', 20)})/m50*100 AS slope FROM n1)",
        ],
        f"SELECT {select('date@d m50@4 m200@4 slope@4')}, CASE WHEN rn<199 THEN 'UNKNOWN' WHEN close>m200 AND close>m50 THEN CASE WHEN slope>0.5 THEN 'BULL_TREND' ELSE 'BULL_WEAK' END WHEN close>m200 THEN 'SIDEWAYS' WHEN close>m50 THEN 'RECOVERY' ELSE 'BEAR_TREND' END AS regime FROM n2",
    ),
)
STOCK_REGIME = f"""sr AS (SELECT symbol, rn, CASE WHEN (e200/{lag('e200', 20)}-1)*100>0.5 THEN 'bull' WHEN (e200/{lag('e200', 20)}-1)*100< -0.5 THEN 'bear' ELSE 'sideways' END AS regime FROM t3)"""
register(
    "w43_stock_regime",
    lambda spark, sf: tidy(market.stock_regime(bars(spark, sf)).select("symbol", "date", "regime")),
    query([*TECH[:4], STOCK_REGIME], "SELECT symbol, strftime(date,'%Y-%m-%d') AS date, regime FROM sr JOIN b USING (symbol, rn)"),
)
register(
    "w44_index_trend_label",
    lambda spark, sf: tidy(
        ind.compose(index_series(spark, sf), ind.emas(50, 200)).select("date", market.trend_label().alias("trend"))
    ),
    query(
        IX,
        "SELECT strftime(date,'%Y-%m-%d') AS date, CASE WHEN close>e200 AND close>e50 THEN 'UPTREND' WHEN close>e200 THEN 'PULLBACK IN UPTREND' WHEN NOT close>e50 THEN 'DOWNTREND' ELSE 'RECOVERY IN DOWNTREND' END AS trend FROM x7",
    ),
)


def _flips(spark, sf):
    df = ind.with_parabolic_sar(ind.with_supertrend(bars(spark, sf)))
    return tidy(
        df.select(
            "symbol", "date", "st_dir", "psar_dir",
            F.coalesce((F.col("st_dir") != wlag("st_dir")), F.lit(False)).alias("st_flip"),
            F.coalesce((F.col("psar_dir") != wlag("psar_dir")), F.lit(False)).alias("psar_flip"),
        )
    )


from barloom.catalog.indicators import PSAR, SUPERTREND  # noqa: E402

register(
    "w48_direction_flips",
    _flips,
    query(
        [*TECH[:4], SUPERTREND, PSAR, "d AS (SELECT symbol, rn, dir AS st_dir, CASE WHEN bull THEN 1 ELSE -1 END AS psar_dir FROM st JOIN ps USING (symbol, rn))"],
        f"SELECT d.symbol, strftime(b.date,'%Y-%m-%d') AS date, cast(st_dir AS bigint) AS st_dir, cast(psar_dir AS bigint) AS psar_dir, cast(coalesce(st_dir<>lag(st_dir) OVER w,false) AS bigint) AS st_flip, cast(coalesce(psar_dir<>lag(psar_dir) OVER w,false) AS bigint) AS psar_flip FROM d JOIN b USING (symbol, rn) WINDOW w AS (PARTITION BY d.symbol ORDER BY rn)",
        True,
    ),
)


def fund_features(df):
    """Eligibility, vol-scaled skip-month strength and nearness to the prior year high."""
    c = F.col
    df = df.withColumns(
        {
            "valid": valid_bar_tolerant(),
            "_ret": c("close") / wlag("close") - 1.0,
            "_turn": c("close") * c("volume"),
        }
    )
    df = df.withColumns({"_okn": F.when(c("valid"), 1).otherwise(0), "_ph": wlag("high")})
    df = ind.compose(df, {"long": [Long("_vol", "_ret", 252, "sd"), Long("_yh", "_ph", 252, "max"), Long("_ok", "_okn", 253, "avg", False)]})
    mid = F.sort_array("_t20")
    strength = (wlag("close", 21) / wlag("close", 126) - 1.0 + wlag("close", 21) / wlag("close", 252) - 1.0) / 2.0
    df = df.select(
        "*",
        F.when(F.count("close").over(ind.by_symbol().rowsBetween(-19, 0)) == 20, frame_array(c("_turn"), 20)).alias("_t20"),
    )
    df = df.withColumn("turnover", (F.element_at(mid, 10) + F.element_at(mid, 11)) / 2.0)
    return df.select(
        "symbol", "date", "rn", "close", "high", "low", "open", "volume", "valid",
        ((c("_ok") == 1.0) & (c("rn") >= 252) & (c("close") >= 10) & (c("turnover") >= 1e5)).alias("eligible"),
        (c("valid") & (c("high") > c("low"))).alias("tradable"),
        (strength / F.nullif(c("_vol") * F.sqrt(F.lit(252.0)), F.lit(0.0))).alias("momentum"),
        (c("close") / c("_yh")).alias("year_high"),
        "turnover",
    )


# Traded values of the derived bars are about a hundredth of real ones, so the
# liquidity floor of 1e7 is used here as 1e5.
FUND = f"""ff0 AS (SELECT *, close/{lag('close')}-1 AS ret, close*volume AS turn, {lag('high')} AS ph,
   least(open,high,low,close)>0 AND high+(greatest(open,high,low,close)*1e-10+1e-8)>=greatest(open,low,close) AND low-(greatest(open,high,low,close)*1e-10+1e-8)<=least(open,high,close) AND volume>0 AS valid FROM b),
ff1 AS (SELECT *, sum(CASE WHEN valid THEN 1 ELSE 0 END) OVER ({W} ROWS BETWEEN 252 PRECEDING AND CURRENT ROW) AS ok,
   CASE WHEN rn>=19 THEN median(turn) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS turnover,
   ({roll('stddev_samp', 'ret', 252)})*sqrt(252.0::double) AS vol, {roll('max', 'ph', 252)} AS yh,
   ({lag('close', 21)}/{lag('close', 126)}-1+{lag('close', 21)}/{lag('close', 252)}-1)/2 AS strength FROM ff0),
ff AS (SELECT *, ok=253 AND close>=10 AND turnover>=1e5 AS eligible, valid AND high>low AS tradable, strength/nullif(vol,0) AS momentum, close/yh AS year_high FROM ff1)"""
register(
    "w45_fund_features",
    lambda spark, sf: tidy(
        fund_features(bars(spark, sf)).select("symbol", "date", F.coalesce("eligible", F.lit(False)).alias("eligible"), "valid", "tradable", "momentum", "year_high", "turnover"),
        turnover=2, momentum=6, year_high=6,
    ),
    query([BARS, FUND], f"SELECT {select('symbol date@d valid@i tradable@i momentum@6 year_high@6 turnover@2')}, cast(coalesce(eligible,false) AS bigint) AS eligible FROM ff"),
)

ML_FEATURES = {
    "rsi14": "rsi", "rsi_delta": "rsi-rsi[3]", "macd_hist": "macd_hist", "macd_hist_delta": "macd_hist-macd_hist[3]",
    "ema9_dist": "(close/e9-1)*100", "ema21_dist": "(close/e21-1)*100", "ema50_dist": "(close/e50-1)*100", "ema200_dist": "(close/e200-1)*100",
    "ema_stack": "CASE WHEN e9>e21 AND e21>e50 AND e50>e200 THEN 1 ELSE 0 END", "price_vs_ema200": "(close/e200-1)*100",
    "atr_pct": "atr14/nullif(close,0)*100", "vol_ratio": "volume/nullif(v20,0)", "cci": "CASE WHEN cci IS NOT NULL THEN greatest(-300,least(300,cci)) END",
    "adx": "adx_zero", "adx_pdi_mdi": "(plus_di-minus_di)/nullif(adx_zero,0)", "obv_slope": "CASE WHEN obv_norm-obv_norm[5] IS NOT NULL THEN greatest(-10,least(10,obv_norm-obv_norm[5])) END",
    "bb_pct": "(close-bb_lower)/nullif(bb_upper-bb_lower,0)", "close_pct_5d": "(close/close[5]-1)*100", "close_pct_20d": "(close/close[20]-1)*100",
    "close_pct_60d": "(close/close[60]-1)*100", "high52w_pct": "(close/chi252-1)*100", "low52w_pct": "(close/clo252-1)*100",
    "day_range_pct": "(high-low)/nullif(close,0)*100", "vol_regime": "least(5,greatest(0,coalesce(vsd20/nullif(vsd252,0),1)))",
}


def ml_layers():
    """The layers that the model's technical features read."""
    return [
        ind.emas(9, 21, 50, 200), ind.rsi(), ind.macd(), ind.atr(14), ind.obv(), ind.cci(), ind.adx(), ind.bollinger(), ind.volume_average(),
        {
            "long": [
                Long("chi252", "close", 252, "max"), Long("clo252", "close", 252, "min"),
                Long("vsd20", "volume", 20, "sd"), Long("vsd252", "volume", 252, "sd"),
            ],
            "c": {"obv_norm": F.col("obv") / F.nullif(wroll(F.stddev_samp, "obv", 20), F.lit(0.0))},
        },
    ]


def ml_features(df):
    """The 24 technical features, one column each, over rows with the base layout."""
    c = F.col
    df = ind.compose(df, *ml_layers())
    bound = lambda x, lo, hi: F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))
    pct = lambda n: (c("close") / wlag("close", n) - 1.0) * 100.0
    dist = lambda e: (c("close") / c(e) - 1.0) * 100.0
    cols = {
        "rsi14": c("rsi"),
        "rsi_delta": c("rsi") - wlag("rsi", 3),
        "f_macd_hist": c("macd_hist"),
        "macd_hist_delta": c("macd_hist") - wlag("macd_hist", 3),
        "ema9_dist": dist("e9"), "ema21_dist": dist("e21"), "ema50_dist": dist("e50"), "ema200_dist": dist("e200"),
        "ema_stack": F.when((c("e9") > c("e21")) & (c("e21") > c("e50")) & (c("e50") > c("e200")), 1.0).otherwise(0.0),
        "price_vs_ema200": dist("e200"),
        "atr_pct": c("atr14") / F.nullif("close", F.lit(0.0)) * 100.0,
        "f_vol_ratio": c("vol_ratio"),
        "f_cci": bound(c("cci"), -300.0, 300.0),
        "f_adx": c("adx_zero"),
        "adx_pdi_mdi": (c("plus_di") - c("minus_di")) / F.nullif("adx_zero", F.lit(0.0)),
        "obv_slope": bound(c("obv_norm") - wlag("obv_norm", 5), -10.0, 10.0),
        "bb_pct": (c("close") - c("bb_lower")) / F.nullif(c("bb_upper") - c("bb_lower"), F.lit(0.0)),
        "close_pct_5d": pct(5), "close_pct_20d": pct(20), "close_pct_60d": pct(60),
        "high52w_pct": dist("chi252"), "low52w_pct": dist("clo252"),
        "day_range_pct": (c("high") - c("low")) / F.nullif("close", F.lit(0.0)) * 100.0,
        "vol_regime": F.least(F.lit(5.0), F.greatest(F.lit(0.0), F.coalesce(c("vsd20") / F.nullif("vsd252", F.lit(0.0)), F.lit(1.0)))),
    }
    return df.select("*", *[v.alias(k if k.startswith("f_") else f"f_{k}") for k, v in cols.items()])


def _features(spark, sf):
    df = ml_features(bars(spark, sf))
    return tidy(df.select("symbol", "date", *[F.col(f"f_{n}").alias(n) for n in ML_FEATURES]), 3)


def lags(text: str) -> str:
    return re.sub(r"(\w+)\[(\d+)\]", rf"lag(\1, \2) OVER ({W})", text)


FEATURE_BASE = f"""fb0 AS (SELECT *, {roll('max', 'close', 252)} AS chi252, {roll('min', 'close', 252)} AS clo252, {roll('stddev_samp', 'volume', 20)} AS vsd20,
  {roll('stddev_samp', 'volume', 252)} AS vsd252, obv/nullif({roll('stddev_samp', 'obv', 20)},0) AS obv_norm FROM t7),
fb AS (SELECT symbol, date, rn, {', '.join(f'cast({lags(t)} AS double) AS {n}' for n, t in ML_FEATURES.items())} FROM fb0)"""
register(
    "w46_ml_features",
    _features,
    query([*TECH, FEATURE_BASE], f"SELECT {select('symbol date@d ' + ' '.join(n + '@3' for n in ML_FEATURES))} FROM fb"),
)


def _pullback_trend(spark, sf):
    c = F.col
    df = ind.compose(bars(spark, sf), ind.smas(50, 200))
    df = df.withColumns({"_valid": valid_bar_tolerant(), "_turn": c("close") * c("volume")})
    w20 = ind.by_symbol().rowsBetween(-19, 0)
    mid = F.sort_array("_t20")
    df = df.withColumn("_okn", F.when(c("_valid"), 1).otherwise(0))
    df = ind.compose(df, {"long": [Long("_ok", "_okn", 220, "avg", False)]})
    df = df.select("*", F.when(F.count("close").over(w20) == 20, frame_array(c("_turn"), 20)).alias("_t20"))
    hit = (
        (c("close") > c("s50")) & (c("s50") > c("s200")) & (c("s200") > wlag("s200", 20)) & (c("close") / wlag("close", 3) - 1.0 < 0)
        & (c("_ok") == 1.0) & (c("rn") >= 219) & (c("close") >= 10) & ((F.element_at(mid, 10) + F.element_at(mid, 11)) / 2.0 >= 1e5)
    )
    return tidy(df.select("symbol", "date", F.coalesce(hit, F.lit(False)).alias("hit")))


register(
    "w47_pullback_trend",
    _pullback_trend,
    query(
        [
            *TECH[:3],
            f"pb AS (SELECT *, least(open,high,low,close)>0 AND high>=greatest(open,low,close) AND low<=least(open,high,close) AND volume>0 AS valid FROM t2)",
            f"pc AS (SELECT *, sum(CASE WHEN valid THEN 1 ELSE 0 END) OVER ({W} ROWS BETWEEN 219 PRECEDING AND CURRENT ROW) AS ok, median(close*volume) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS mt FROM pb)",
        ],
        f"SELECT symbol, strftime(date,'%Y-%m-%d') AS date, cast(coalesce(close>s50 AND s50>s200 AND s200>{lag('s200', 20)} AND close/{lag('close', 3)}-1<0 AND ok=220 AND close>=10 AND mt>=1e5, false) AS bigint) AS hit FROM pc",
    ),
)
