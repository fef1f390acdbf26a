"""Fundamental scores, factor scores, liquidity, sizing and pullback queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from barloom.catalog.base import register, tidy
from barloom.catalog.indicators import TECH
from barloom.catalog.oracle import BARS, INDEX, W, lag, query, roll, select
from barloom.catalog.scores import FUNDAMENTALS, SCAN, r
from barloom.functions import indicators as ind, outcomes as out, scoring
from barloom.functions.scoring import rnd
from barloom.functions.windows import lag as wlag, tail as wtail
from barloom.operators import pullback, quality
from barloom.operators.lineage import materialize
from barloom.plans import scan, tables
from barloom.plans.tables import bars, index_series

c = F.col


def _ref(spark, sf):
    return scan.with_fund_score(tables.fundamentals(spark, sf))


def _v2_reference(df):
    return df.withColumns(
        {
            "v2_quality": scoring.v2_quality(c("roe"), c("debt_equity"), c("net_margin"), c("is_lender")),
            "v2_growth": scoring.v2_growth(c("revenue_growth"), c("earnings_growth")),
        }
    )


V2REF = """v2f AS (SELECT *, CASE WHEN CASE WHEN roe IS NOT NULL THEN 50 ELSE 0 END+CASE WHEN lender OR debt_equity IS NOT NULL THEN 30 ELSE 0 END+CASE WHEN net_margin IS NOT NULL THEN 20 ELSE 0 END>=40 THEN
   round(cast((CASE WHEN roe>=20 THEN 50 WHEN roe>=15 THEN 40 WHEN roe>=10 THEN 25 WHEN roe>=5 THEN 10 ELSE 0 END+CASE WHEN lender THEN 18 WHEN debt_equity<0.3 THEN 30 WHEN debt_equity<1 THEN 22 WHEN debt_equity<2 THEN 12 WHEN debt_equity<3 THEN 5 ELSE 0 END
     +CASE WHEN lender THEN CASE WHEN net_margin>=25 THEN 20 WHEN net_margin>=10 THEN 12 ELSE 0 END ELSE CASE WHEN net_margin>=15 THEN 20 WHEN net_margin>=3 THEN 12 ELSE 0 END END)
     /(CASE WHEN roe IS NOT NULL THEN 50 ELSE 0 END+CASE WHEN lender OR debt_equity IS NOT NULL THEN 30 ELSE 0 END+CASE WHEN net_margin IS NOT NULL THEN 20 ELSE 0 END)::double*100 AS decimal(24,8)),1)::double END AS v2_quality,
   CASE WHEN revenue_growth IS NOT NULL OR earnings_growth IS NOT NULL THEN
   round(cast(least((CASE WHEN revenue_growth>=25 THEN 50 WHEN revenue_growth>=15 THEN 38 WHEN revenue_growth>=8 THEN 22 WHEN revenue_growth>=0 THEN 8 ELSE 0 END+CASE WHEN earnings_growth>=30 THEN 50 WHEN earnings_growth>=15 THEN 38 WHEN earnings_growth>=5 THEN 22 WHEN earnings_growth>=0 THEN 8 ELSE 0 END)
     /(CASE WHEN revenue_growth IS NOT NULL THEN 50 ELSE 0 END+CASE WHEN earnings_growth IS NOT NULL THEN 50 ELSE 0 END)::double*100, CASE WHEN revenue_growth IS NULL OR earnings_growth IS NULL THEN 70 ELSE 1000 END) AS decimal(24,8)),1)::double END AS v2_growth FROM ffa)"""

register("p17_v2_quality", lambda spark, sf: tidy(_v2_reference(_ref(spark, sf)).select("symbol", "v2_quality")), query([FUNDAMENTALS, V2REF], "SELECT symbol, round(v2_quality,4)+0.0::double AS v2_quality FROM v2f"))
register("p18_v2_growth", lambda spark, sf: tidy(_v2_reference(_ref(spark, sf)).select("symbol", "v2_growth")), query([FUNDAMENTALS, V2REF], "SELECT symbol, round(v2_growth,4)+0.0::double AS v2_growth FROM v2f"))


def v2_price(bars_df, index):
    """Skip-month momentum and volume expansion on every bar."""
    ix = index.select("date", ((c("close") / wlag("close", 251) - 1.0) * 100.0).alias("ix_year"))
    df = bars_df.withColumns(
        {
            "skip": (wlag("close", 20) / wlag("close", 251) - 1.0) * 100.0,
            "quarter": (c("close") / wlag("close", 62) - 1.0) * 100.0,
            "_v20": wtail(F.avg, "volume", 20),
            "_v80": wtail(F.sum, "volume", 80),
            "_v20s": wtail(F.sum, "volume", 20),
        }
    )
    prior = (c("_v80") - c("_v20s")) / 60.0
    df = df.withColumn("expansion", F.when((c("rn") >= 79) & (prior > 0), c("_v20") / prior))
    return df.drop("_v20", "_v80", "_v20s").join(ix, "date", "left")


V2PRICE = f"""vp0 AS (SELECT symbol, rn, date, close, volume, ({lag('close', 20)}/{lag('close', 251)}-1)*100 AS skip, (close/{lag('close', 62)}-1)*100 AS quarter,
   avg(volume) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS a20, avg(volume) OVER ({W} ROWS BETWEEN 79 PRECEDING AND 20 PRECEDING) AS p60 FROM b),
ixy AS (SELECT date, (close/{lag('close', 251)}-1)*100 AS ix_year FROM ix),
vp AS (SELECT vp0.*, ix_year, CASE WHEN rn>=79 AND p60>0 THEN a20/p60 END AS expansion FROM vp0 LEFT JOIN ixy USING (date)),
vm AS (SELECT *, CASE WHEN rn+1>=260 THEN least(100, CASE WHEN skip>=60 THEN 55 WHEN skip>=30 THEN 45 WHEN skip>=15 THEN 32 WHEN skip>=0 THEN 18 WHEN skip>=-20 THEN 6 ELSE 0 END
   +CASE WHEN quarter>=15 THEN 25 WHEN quarter>=5 THEN 18 WHEN quarter>=-5 THEN 10 ELSE 0 END+CASE WHEN skip-ix_year>=25 THEN 20 WHEN skip-ix_year>=10 THEN 14 WHEN skip-ix_year>=0 THEN 8 ELSE 0 END)::double END AS v2_momentum,
   CASE WHEN expansion>=2.5 THEN 60 WHEN expansion>=1.6 THEN 48 WHEN expansion>=1.2 THEN 34 WHEN expansion>=0.9 THEN 20 ELSE 0 END AS exp_pts FROM vp),
vv AS (SELECT vm.*, CASE WHEN rn+1>=100 AND expansion IS NOT NULL THEN least(100, exp_pts+CASE WHEN delivery_pct IS NULL THEN 22 WHEN delivery_pct>=55 THEN 40 WHEN delivery_pct>=40 THEN 28 WHEN delivery_pct>=25 THEN 15 ELSE 0 END)::double END AS v2_participation,
   v2_quality, v2_growth FROM vm JOIN v2f USING (symbol))"""


def _v2(spark, sf):
    df = v2_price(bars(spark, sf), index_series(spark, sf))
    df = df.withColumn("v2_momentum", scoring.v2_momentum(c("skip"), c("quarter"), c("ix_year"), c("rn") + 1))
    df = df.join(_v2_reference(_ref(spark, sf)), "symbol")
    df = df.withColumn("v2_participation", scoring.v2_participation(c("expansion"), c("delivery_pct"), c("rn") + 1))
    known = F.array_compact(F.array("v2_quality", "v2_growth", "v2_momentum", "v2_participation"))
    df = df.withColumn("_known", known)
    total = F.aggregate("_known", F.lit(0.0), lambda a, x: a + x)
    return df.withColumns(
        {
            "v2_composite": F.when(F.size("_known") > 0, rnd(total / F.size("_known"), 1)),
            "v2_coverage": F.size("_known") * 25,
            "v2_qualifies": F.concat_ws("|", scoring.v2_qualifies()),
        }
    )


V2 = [BARS, INDEX, FUNDAMENTALS, V2REF, V2PRICE]
register("p19_v2_momentum", lambda spark, sf: tidy(_v2(spark, sf).select("symbol", "date", "v2_momentum")), query(V2, f"SELECT {select('symbol date@d v2_momentum@4')} FROM vv"))
register("p20_v2_participation", lambda spark, sf: tidy(_v2(spark, sf).select("symbol", "date", "v2_participation")), query(V2, f"SELECT {select('symbol date@d v2_participation@4')} FROM vv"))
register(
    "p21_v2_qualification",
    lambda spark, sf: tidy(_v2(spark, sf).select("symbol", "date", "v2_composite", "v2_coverage", "v2_qualifies")),
    query(
        V2,
        """SELECT symbol, strftime(date,'%Y-%m-%d') AS date, CASE WHEN n>0 THEN round(cast((coalesce(v2_quality,0)+coalesce(v2_growth,0)+coalesce(v2_momentum,0)+coalesce(v2_participation,0))/n::double AS decimal(24,8)),1)::double+0.0::double END AS v2_composite, cast(n*25 AS bigint) AS v2_coverage,
  concat_ws('|', CASE WHEN v2_quality>=60 AND v2_growth>=55 AND v2_momentum>=25 THEN 'COMPOUNDER' END, CASE WHEN v2_momentum>=60 AND v2_participation>=50 AND v2_quality>=35 THEN 'MOMENTUM' END, CASE WHEN v2_growth>=70 AND v2_participation>=55 AND v2_momentum>=40 THEN 'TURNAROUND' END) AS v2_qualifies
  FROM (SELECT *, (v2_quality IS NOT NULL)::int+(v2_growth IS NOT NULL)::int+(v2_momentum IS NOT NULL)::int+(v2_participation IS NOT NULL)::int AS n FROM vv)""",
    ),
)
register("p22_lender_test", lambda spark, sf: tidy(_ref(spark, sf).select("symbol", "sector", "industry", "is_lender")), query(FUNDAMENTALS, "SELECT symbol, sector, industry, cast(lender AS bigint) AS is_lender FROM fe"))
register(
    "p23_fund_score_a",
    lambda spark, sf: tidy(_ref(spark, sf).select("symbol", scoring.fund_score_a(c("roe"), c("revenue_growth"), c("debt_equity"), c("net_margin")).alias("fund_score"))),
    query(FUNDAMENTALS, "SELECT symbol, cast(score_a AS bigint) AS fund_score FROM ffa"),
)
register(
    "p24_fund_score_b",
    lambda spark, sf: tidy(_ref(spark, sf).select("symbol", scoring.fund_score_b(c("roe"), c("debt_equity"), c("net_margin")).alias("fund_score"))),
    query(FUNDAMENTALS, "SELECT symbol, cast(score_b AS bigint) AS fund_score FROM ffa"),
)


def _score_c():
    return scoring.fund_score_c(c("roe"), c("revenue_growth"), c("earnings_growth"), c("debt_equity"), c("net_margin"), c("is_lender"))


register("p25_fund_score_c", lambda spark, sf: tidy(_ref(spark, sf).select("symbol", _score_c().alias("fund_score"))), query(FUNDAMENTALS, "SELECT symbol, cast(score_c AS bigint) AS fund_score FROM ffa"))


def _flags(spark, sf):
    return tidy(
        _ref(spark, sf).select(
            "symbol", c("quality_score").cast("int").alias("quality_score"),
            scoring.red_flags(c("promoter_pledged"), c("promoter_change"), c("fii_change"), c("debt_equity")).alias("red_flags"),
            scoring.green_flags(c("promoter_pledged"), c("promoter_change"), c("fii_change"), c("dii_change"), c("roce")).alias("green_flags"),
        )
    )


register(
    "p26_quality_and_flags",
    _flags,
    query(
        FUNDAMENTALS,
        """SELECT symbol, cast(quality_score AS bigint) AS quality_score, concat_ws('|', CASE WHEN promoter_pledged>50 THEN 'high_pledge' END, CASE WHEN promoter_pledged>20 THEN 'pledge' END, CASE WHEN promoter_change< -2 THEN 'promoter_sold' END, CASE WHEN fii_change< -3 THEN 'fii_sold' END, CASE WHEN debt_equity>3 THEN 'high_debt' END) AS red_flags,
  concat_ws('|', CASE WHEN fii_change>1 THEN 'fii_buying' END, CASE WHEN dii_change>1 THEN 'dii_buying' END, CASE WHEN promoter_change>0.5 THEN 'promoter_bought' END, CASE WHEN roce>20 THEN 'high_roce' END, CASE WHEN promoter_pledged=0 THEN 'zero_pledge' END) AS green_flags FROM ffa""",
    ),
)


def sector_tech(df):
    """Tech score of the sector view: plain RSI zone, side of the 50 mean, one-month return."""
    df = ind.compose(df, ind.rsi_simple(), ind.emas(50))
    month = F.when(c("rn") >= 21, (c("close") / wlag("close", 21) - 1.0) * 100.0).otherwise(0.0)
    x = c("rsi_simple")
    s = F.lit(50) + scoring.points(((x > 40) & (x < 70), 20), (x >= 70, 10), (x < 30, -10))
    s += F.when(c("close") > c("e50"), 20).otherwise(-20) + scoring.points((month > 5, 10), (month < -5, -10))
    return df.withColumn("tech_score", F.when(c("rn") >= 19, scoring.clip(s, 0, 100)))


SECTOR_TECH = f"""sx0 AS (SELECT t3.*, {roll('avg', 'gain', 14)} AS g14, {roll('avg', 'loss', 14)} AS l14, CASE WHEN rn>=21 THEN (close/{lag('close', 21)}-1)*100 ELSE 0 END AS m1 FROM t3),
sx1 AS (SELECT *, CASE WHEN l14=0 THEN 100 ELSE 100-100/(1+g14/l14) END AS rs FROM sx0),
sx AS (SELECT symbol, rn, date, CASE WHEN rn>=19 THEN cast(greatest(0,least(100, 50+CASE WHEN rs>40 AND rs<70 THEN 20 WHEN rs>=70 THEN 10 WHEN rs<30 THEN -10 ELSE 0 END+CASE WHEN close>e50 THEN 20 ELSE -20 END+CASE WHEN m1>5 THEN 10 WHEN m1< -5 THEN -10 ELSE 0 END)) AS bigint) END AS tech_score FROM sx1)"""
register("p27_sector_tech_score", lambda spark, sf: tidy(sector_tech(bars(spark, sf)).select("symbol", "date", "tech_score")), query([*TECH[:4], SECTOR_TECH], f"SELECT {select('symbol date@d tech_score')} FROM sx"))


def last_rows(df):
    """The newest bar of each symbol, by aggregation instead of a sort."""
    rest = [x for x in df.columns if x != "symbol"]
    return df.groupBy("symbol").agg(F.max_by(F.struct(*rest), "rn").alias("_l")).select("symbol", *[c(f"_l.{x}").alias(x) for x in rest])


def sector_scores(spark, sf):
    df = last_rows(sector_tech(bars(spark, sf)).select("symbol", "rn", "tech_score"))
    df = df.join(_ref(spark, sf), "symbol").withColumn("fund_c", _score_c())
    growth = F.coalesce("revenue_growth", F.lit(0.0)) * 0.5 + F.coalesce("earnings_growth", F.lit(0.0)) * 0.5
    df = df.withColumn("growth_bonus", scoring.clip(growth, 0.0, 30.0))
    tech = F.coalesce(F.nullif("tech_score", F.lit(0)), F.lit(50))
    raw = rnd(tech * 0.40 + c("fund_c") * 0.35 + c("growth_bonus") * 0.25, 6)
    return df.withColumn("composite", scoring.clip(raw.cast("int"), 0, 100))


SECTOR = f"""sl AS (SELECT symbol, arg_max(tech_score, rn) AS tech_score FROM sx GROUP BY 1),
sc AS (SELECT f.symbol, f.sector, s.tech_score, f.score_c AS fund_c, greatest(0,least(30, coalesce(revenue_growth,0)*0.5+coalesce(earnings_growth,0)*0.5)) AS gb FROM sl s JOIN ffa f USING (symbol)),
sd AS (SELECT *, cast(greatest(0,least(100, trunc(cast(round(cast(coalesce(nullif(tech_score,0),50)*0.40::double+fund_c*0.35::double+gb*0.25::double AS decimal(24,8)),6) AS double)))) AS bigint) AS composite FROM sc)"""
register(
    "p28_sector_composite",
    lambda spark, sf: tidy(sector_scores(spark, sf).select("symbol", "sector", "tech_score", "growth_bonus", "composite")),
    query([*TECH[:4], SECTOR_TECH, FUNDAMENTALS, SECTOR], "SELECT symbol, sector, tech_score, round(gb,4)+0.0::double AS growth_bonus, composite FROM sd"),
)


def _sector_rank(spark, sf):
    s = sector_scores(spark, sf)
    w = Window.partitionBy("sector").orderBy(c("composite").desc(), "symbol")
    lead_row = s.groupBy("sector").agg(F.max_by(F.struct("symbol", "composite"), F.struct("composite", F.hash("symbol") * 0)).alias("_x"), F.count("*").alias("stocks"), F.max("composite").alias("leader_score"))
    leaders = s.join(lead_row.select("sector", "leader_score", "stocks"), "sector").where(c("composite") == c("leader_score"))
    leaders = leaders.groupBy("sector").agg(F.min("symbol").alias("leader"), F.max("leader_score").alias("leader_score"), F.max("stocks").alias("stocks"))
    # The number of sectors is fixed, so ordering them is a tiny window.
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(c("leader_score").desc(), "sector"))
    return tidy(leaders.select("sector", "leader", "leader_score", "stocks", rank.alias("position")))


register(
    "c21_sector_ranking",
    _sector_rank,
    query(
        [*TECH[:4], SECTOR_TECH, FUNDAMENTALS, SECTOR],
        "SELECT sector, min(symbol) FILTER (WHERE composite=m) AS leader, max(composite) AS leader_score, count(*) AS stocks, row_number() OVER (ORDER BY max(composite) DESC, sector) AS position FROM (SELECT *, max(composite) OVER (PARTITION BY sector) AS m FROM sd) GROUP BY sector",
    ),
)


def scout_profile(df):
    """Volume expansion, sides of the means, returns and distance from the year's highest close."""
    df = ind.compose(df, ind.emas(50, 200), {"long": [ind.Long("_ch", "close", 252, "max", False)], "a": {"_s20": wtail(F.sum, "volume", 20), "_s80": wtail(F.sum, "volume", 80)}})
    slow = F.when(c("rn") >= 199, c("e200")).otherwise(c("e50"))
    ret = lambda n: F.when(c("rn") >= n, (c("close") / wlag("close", n - 1) - 1.0) * 100.0).otherwise(0.0)
    return df.select(
        "symbol", "date", "rn", "close", "volume",
        F.try_divide(c("_s20") / 20.0, (c("_s80") - c("_s20")) / 60.0).alias("vol_expansion"),
        (c("close") > c("e50")).alias("above_ema50"), (c("close") > slow).alias("above_ema200"),
        ret(63).alias("ret_3m"), ret(21).alias("ret_1m"), ((c("close") / c("_ch") - 1.0) * 100.0).alias("from_high"),
    ).where("rn >= 119")


PROFILE = f"""pf AS (SELECT symbol, date, rn, close, volume, avg(volume) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)/avg(volume) OVER ({W} ROWS BETWEEN 79 PRECEDING AND 20 PRECEDING) AS vol_expansion,
   close>e50 AS above_ema50, close>CASE WHEN rn>=199 THEN e200 ELSE e50 END AS above_ema200, CASE WHEN rn>=63 THEN (close/{lag('close', 62)}-1)*100 ELSE 0 END AS ret_3m, CASE WHEN rn>=21 THEN (close/{lag('close', 20)}-1)*100 ELSE 0 END AS ret_1m,
   (close/max(close) OVER ({W} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)-1)*100 AS from_high FROM t3)"""
register(
    "p29_smallcap_profile",
    lambda spark, sf: tidy(scout_profile(bars(spark, sf)).select("symbol", "date", "above_ema50", "above_ema200", *[rnd(x, 4).alias(x) for x in ("vol_expansion", "ret_3m", "ret_1m", "from_high")])),
    query([*TECH[:4], PROFILE], f"SELECT {select('symbol date@d above_ema50@i above_ema200@i')}, {', '.join(f'{r(x, 4)}+0.0::double AS {x}' for x in ('vol_expansion', 'ret_3m', 'ret_1m', 'from_high'))} FROM pf WHERE rn>=119"),
)


def liquidity(bars_df, floor: float = 2_000_000.0):
    """Median turnover and volume and share of traded sessions over the last 60 bars of each symbol."""
    ends = bars_df.groupBy("symbol").agg(F.max("rn").alias("_last"))
    d = bars_df.join(ends, "symbol").where(c("rn") > c("_last") - 60)
    # At most 60 rows per symbol: the exact median needs no large buffer.
    m = d.groupBy("symbol").agg(
        F.median(c("volume") * c("close")).alias("median_turnover"), F.median("volume").alias("median_volume"),
        F.avg(F.when(c("volume") > 0, 100.0).otherwise(0.0)).alias("trading_days_pct"), F.count("*").alias("bars"),
    ).where("bars >= 20")
    t = c("median_turnover")
    reasons = scoring.tags(("no_turnover", t.isNull()), ("thin_turnover", t < floor), ("rarely_trades", c("trading_days_pct") < 80))
    return m.withColumns({"max_position_value": F.when(t > 0, F.round(t * 0.025, 0)), "reasons": reasons}).withColumn("tradeable", F.size("reasons") == 0)


LIQUIDITY = """lq0 AS (SELECT symbol, volume, close, rn, max(rn) OVER (PARTITION BY symbol) AS lr FROM b),
lq AS (SELECT symbol, median(volume*close) AS median_turnover, median(volume) AS median_volume, avg(CASE WHEN volume>0 THEN 100.0::double ELSE 0 END) AS trading_days_pct, count(*) AS bars FROM lq0 WHERE rn>lr-60 GROUP BY 1 HAVING count(*)>=20)"""
register(
    "p31_liquidity_measure",
    lambda spark, sf: tidy(liquidity(bars(spark, sf)).select("symbol", "median_turnover", "median_volume", "trading_days_pct", "bars")),
    query([BARS, LIQUIDITY], f"SELECT {select('symbol median_turnover@4 median_volume@4 trading_days_pct@4 bars')} FROM lq"),
)
FLOOR = 230_000.0


def _liq_verdict(spark, sf):
    df = liquidity(bars(spark, sf), FLOOR)
    share = 12_000.0 / c("median_turnover") * 100.0
    risk = F.when(share > 10, "severe").when(share > 5, "high").when(share > 2.5, "moderate").otherwise("low")
    return df.withColumns({"intended_share_pct": share, "impact_risk": risk, "suggested_value": F.round(F.least(F.lit(12_000.0), c("median_turnover") * 0.025), 0)})


register(
    "p32_liquidity_verdict",
    lambda spark, sf: tidy(_liq_verdict(spark, sf).select("symbol", "max_position_value", "tradeable", "reasons", "intended_share_pct", "impact_risk", "suggested_value")),
    query(
        [BARS, LIQUIDITY],
        """SELECT symbol, round(median_turnover*0.025::double,0)+0.0::double AS max_position_value, cast(median_turnover>=230000 AND trading_days_pct>=80 AS bigint) AS tradeable, concat_ws('|', CASE WHEN median_turnover<230000 THEN 'thin_turnover' END, CASE WHEN trading_days_pct<80 THEN 'rarely_trades' END) AS reasons,
  round(12000/median_turnover*100,4)+0.0::double AS intended_share_pct, CASE WHEN 12000/median_turnover*100>10 THEN 'severe' WHEN 12000/median_turnover*100>5 THEN 'high' WHEN 12000/median_turnover*100>2.5 THEN 'moderate' ELSE 'low' END AS impact_risk, round(least(12000, median_turnover*0.025::double),0)+0.0::double AS suggested_value FROM lq""",
    ),
)


def _liq_size(spark, sf):
    df = _liq_verdict(spark, sf).join(last_rows(bars(spark, sf).select("symbol", "rn", "close")), "symbol")
    capped = (c("suggested_value") < 12_000.0) & (c("close") > 0)
    return tidy(
        df.select(
            "symbol", F.when(capped, c("suggested_value")).otherwise(12_000.0).alias("position_value"),
            F.when(capped, F.floor(c("suggested_value") / c("close"))).otherwise(F.floor(12_000.0 / c("close"))).alias("position_size"),
            capped.alias("capped_by_liquidity"),
        )
    )


LAST = "lc AS (SELECT symbol, arg_max(close, rn) AS close FROM b GROUP BY 1)"
register(
    "p33_liquidity_capped_size",
    _liq_size,
    query(
        [BARS, LIQUIDITY, LAST],
        "SELECT symbol, round(CASE WHEN sv<12000 THEN sv ELSE 12000 END,4)+0.0::double AS position_value, cast(floor(CASE WHEN sv<12000 THEN sv ELSE 12000 END/close) AS bigint) AS position_size, cast(sv<12000 AS bigint) AS capped_by_liquidity FROM (SELECT symbol, round(least(12000, median_turnover*0.025::double),0) AS sv FROM lq) JOIN lc USING (symbol)",
    ),
)


#: Least recent volume against the sessions before of a pick; the derived volumes move less than a market's, where 1.4 is usual.
EXPANSION = 1.15


def screened(df):
    """Score of the rows that pass the broad bounds; ``picked`` marks those whose volume expands and that are no weaker than the index."""
    keep = c("tradeable") & c("median_turnover").between(FLOOR, 500_000_000.0) & (c("vol_expansion") >= 1.0) & c("above_ema50") & (c("rs_vs_index") >= -100.0)
    picked = (c("vol_expansion") >= EXPANSION) & (c("rs_vs_index") >= 0.0)
    pts = (
        F.least(c("vol_expansion"), F.lit(4.0)) * 12 + F.when(c("above_ema50"), 20).otherwise(0) + F.when(c("above_ema200"), 15).otherwise(0)
        + scoring.clip(c("rs_vs_index"), -20.0, 40.0) * 0.5 + scoring.clip(c("ret_3m"), -30.0, 60.0) * 0.3 + F.when(c("from_high") > -15, 10).otherwise(0)
    )
    return df.where(keep).select("symbol", "rs_vs_index", rnd(pts, 1).alias("score"), picked.alias("picked"))


def _scout(spark, sf):
    p = last_rows(scout_profile(bars(spark, sf)))
    ix = index_series(spark, sf).select("rn", ((c("close") / wlag("close", 62) - 1.0) * 100.0).alias("ix3"), F.lit("i").alias("symbol"))
    base = ix.agg(F.max_by("ix3", "rn").alias("ix3"))
    df = p.join(liquidity(bars(spark, sf), FLOOR), "symbol")
    # The index return is one number: a scalar subquery, not a join.
    df = df.withColumn("rs_vs_index", c("ret_3m") - base.select("ix3").scalar())
    return tidy(screened(df).orderBy(c("score").desc(), "symbol"))


register(
    "p30_smallcap_screen",
    _scout,
    query(
        [*TECH[:4], PROFILE, LIQUIDITY, INDEX, f"i3 AS (SELECT arg_max(r, rn) AS ix3 FROM (SELECT rn, (close/{lag('close', 62)}-1)*100 AS r FROM ix))", "pl AS (SELECT symbol, max(rn) AS rn FROM pf GROUP BY 1)"],
        f"""SELECT symbol, round(rs,4)+0.0::double AS rs_vs_index, {r("least(vol_expansion,4)*12+20+CASE WHEN above_ema200 THEN 15 ELSE 0 END+greatest(-20,least(40,rs))*0.5+greatest(-30,least(60,ret_3m))*0.3+CASE WHEN from_high> -15 THEN 10 ELSE 0 END", 1)}+0.0::double AS score, cast(vol_expansion>={EXPANSION} AND rs>=0 AS bigint) AS picked
  FROM (SELECT pf.*, ret_3m-ix3 AS rs, median_turnover, trading_days_pct FROM pf JOIN pl USING (symbol, rn) JOIN lq USING (symbol), i3) WHERE rn>=119 AND median_turnover BETWEEN 230000 AND 500000000 AND trading_days_pct>=80 AND vol_expansion>=1 AND above_ema50 AND rs>=-100""",
    ),
)


def _risk(spark, sf):
    df = ind.compose(bars(spark, sf), ind.pivots())
    df = scoring.with_trade_levels(scoring.with_base_signal(df))
    size = scoring.risk_size(c("r_close"), c("sl_buy"), F.lit(None).cast("double"))
    return tidy(df.select("symbol", "date", size.alias("position_size"), rnd(size * (c("r_close") - c("sl_buy")), 2).alias("risk_amount")))


register(
    "p34_risk_based_size",
    _risk,
    query(
        SCAN[:-1],
        f"""SELECT symbol, strftime(date,'%Y-%m-%d') AS date, CASE WHEN n>0 THEN cast(n AS bigint) END AS position_size, CASE WHEN n>0 THEN {r('n*(r_close-sl_buy)', 2)}+0.0::double END AS risk_amount
  FROM (SELECT *, CASE WHEN r_close>0 AND sl_buy>0 AND sl_buy<r_close THEN least(floor(10000.0::double/(r_close-sl_buy)), floor(75000.0::double/r_close)) END AS n FROM q8)""",
        True,
    ),
)


def _kelly(spark, sf):
    df = tables.fundamentals(spark, sf)
    k = scoring.kelly_size(c("delivery_pct"), c("debt_equity"), 500_000.0)
    return tidy(df.select("symbol", k["invest"].alias("invest"), k["kelly_fraction"].alias("kelly_fraction")))


register(
    "p35_kelly_size",
    _kelly,
    query(
        FUNDAMENTALS,
        f"""SELECT symbol, CASE WHEN ok THEN {r("greatest(2000,least(f*0.25*500000,75000))", 2)} ELSE 10000.0::double END+0.0::double AS invest, CASE WHEN ok THEN {r('f', 4)} ELSE 0 END+0.0::double AS kelly_fraction FROM (
  SELECT symbol, ok, greatest(0,(p*debt_equity-(1-p))/debt_equity) AS f FROM (SELECT *, coalesce(delivery_pct>0 AND debt_equity>0,false) AS ok, greatest(0.01::double,least(0.99::double,CASE WHEN delivery_pct>1 THEN delivery_pct/100 ELSE delivery_pct END)) AS p FROM fd))""",
    ),
)


def sells(spark, sf):
    """Orders as closing trades: account as symbol, a percent result and a reason."""
    o = tables.read(spark, sf, "orders")
    pnl = (F.round(c("o_totalprice") * 100).cast("long") % 1200) / 100.0 - 7.0
    reason = F.element_at(F.array(*[F.lit(x) for x in ("SL_HIT", "MAX_HOLD_10D", "AI: exit", "manual")]), (c("o_orderkey") % 4 + 1).cast("int"))
    return o.select(F.concat(F.lit("C"), c("o_custkey").cast("string")).alias("symbol"), c("o_orderdate").alias("ts"), pnl.alias("pnl_pct"), reason.alias("reason"), c("o_orderkey").alias("id"))


SELLS = """se AS (SELECT 'C'||cast(o_custkey AS varchar) AS symbol, o_orderdate AS ts, (cast(round(o_totalprice*100) AS bigint)%1200)/100.0::double-7 AS pnl_pct, CASE o_orderkey%4 WHEN 0 THEN 'SL_HIT' WHEN 1 THEN 'MAX_HOLD_10D' WHEN 2 THEN 'AI: exit' ELSE 'manual' END AS reason, o_orderkey AS id FROM orders),
sf AS (SELECT *, CASE WHEN pnl_pct>=0 THEN '' WHEN reason='SL_HIT' THEN CASE WHEN abs(pnl_pct)<0.8 THEN 'SL_TOO_TIGHT' ELSE 'SL_HIT' END WHEN reason='MAX_HOLD_10D' THEN 'MAX_HOLD_LOSS' WHEN reason='AI: exit' THEN 'AI_DIRECTED' WHEN abs(pnl_pct)<1 THEN 'SMALL_LOSS_TRIM' ELSE 'FALSE_BREAKOUT' END AS tag FROM se)"""
register("p36_loss_classification", lambda spark, sf: tidy(sells(spark, sf).select("id", "symbol", "pnl_pct", scoring.failure_tag(c("reason"), c("pnl_pct")).alias("tag"))), query(SELLS, f"SELECT {select('id symbol pnl_pct@4 tag')} FROM sf"))


def _cooldown(spark, sf):
    """Symbols with a tagged loss in the three days before the newest trade."""
    t = sells(spark, sf).withColumn("tag", scoring.failure_tag(c("reason"), c("pnl_pct")))
    now = t.agg(F.max("ts").alias("now"))
    recent = t.where((c("pnl_pct") < 0) & ~c("tag").isin("SMALL_LOSS_TRIM", "") & (c("ts") >= now.select(F.col("now") - F.expr("INTERVAL 3 DAYS")).scalar()))
    blocked = recent.select("symbol").distinct().withColumn("blocked", F.lit(True))
    return tidy(t.select("symbol").distinct().join(blocked, "symbol", "left").select("symbol", F.coalesce("blocked", F.lit(False)).alias("blocked")))


register(
    "p37_reentry_cooldown",
    _cooldown,
    query(SELLS, "SELECT symbol, cast(max(CASE WHEN pnl_pct<0 AND tag NOT IN ('SMALL_LOSS_TRIM','') AND ts>=(SELECT max(ts) FROM sf)-INTERVAL 3 DAY THEN 1 ELSE 0 END) AS bigint) AS blocked FROM sf GROUP BY 1"),
)
register(
    "p38_round_trip_cost",
    lambda spark, sf: tidy(sells(spark, sf).select("id", F.lit(out.ROUND_TRIP * 100).alias("cost_pct"), (c("pnl_pct") - out.ROUND_TRIP * 100).alias("net_pct"))),
    query(SELLS, "SELECT id, round((2*(0.001::double+0.001::double+0.0000297::double+0.000001::double)+0.00015::double+2*0.18::double*(0.001::double+0.0000297::double+0.000001::double)+2*0.0005::double)*100,4)+0.0::double AS cost_pct, round(pnl_pct-(2*(0.001::double+0.001::double+0.0000297::double+0.000001::double)+0.00015::double+2*0.18::double*(0.001::double+0.0000297::double+0.000001::double)+2*0.0005::double)*100,4)+0.0::double AS net_pct FROM se"),
)
register(
    "p39_score_bucket",
    lambda spark, sf: tidy(sells(spark, sf).select("id", scoring.score_bucket(c("pnl_pct") * 8 + 50).alias("bucket"))),
    query(SELLS, "SELECT id, CASE WHEN s>=50 AND s<60 THEN '50-60' WHEN s>=60 AND s<70 THEN '60-70' WHEN s>=70 AND s<80 THEN '70-80' WHEN s>=80 AND s<101 THEN '80+' END AS bucket FROM (SELECT id, pnl_pct*8+50 AS s FROM se)"),
)

PULLBACK = """pk0 AS (SELECT symbol, rn, date, close, volume, max(rn) OVER (PARTITION BY symbol) AS lr FROM b),
pk1 AS (SELECT *, greatest(0, lr-119) AS fl FROM pk0), pk2 AS (SELECT *, max(close) FILTER (WHERE rn>=fl) OVER (PARTITION BY symbol) AS top FROM pk1),
pk3 AS (SELECT *, min(CASE WHEN rn>=fl AND close=top THEN rn END) OVER (PARTITION BY symbol) AS peak FROM pk2),
pk4 AS (SELECT *, min(close) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS lw FROM pk3 WHERE rn>=fl AND rn<=peak),
pk5 AS (SELECT symbol, coalesce(max(CASE WHEN close=lw AND rn<peak AND rn>=fl+10 THEN rn END), arg_min(rn, close*1000000+rn)) AS base FROM pk4 GROUP BY 1),
pk6 AS (SELECT p.*, q.base, (p.close/lag(p.close) OVER (PARTITION BY p.symbol ORDER BY p.rn)-1)*100 AS chg, avg(p.close) OVER (PARTITION BY p.symbol ORDER BY p.rn ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS ma FROM pk3 p JOIN pk5 q USING (symbol)),
pk7 AS (SELECT *, avg(CASE WHEN rn>=peak-50 AND rn<peak THEN volume END) OVER (PARTITION BY symbol) AS pv FROM pk6),
pk8 AS (SELECT symbol, any_value(lr)+1 AS n, arg_max(close, rn) AS last, any_value(top) AS top, any_value(peak) AS peak, avg(volume) FILTER (WHERE rn BETWEEN base AND peak) AS adv, count(*) FILTER (WHERE rn BETWEEN base AND peak) AS na, avg(volume) FILTER (WHERE rn>=peak) AS dc, count(*) FILTER (WHERE rn>=peak) AS nd,
   max(CASE WHEN rn=base THEN close END) AS bc, max(CASE WHEN rn=lr THEN ma END) AS ma, max(CASE WHEN rn=lr-10 THEN ma END) AS mb, any_value(pv) AS pv, count(*) FILTER (WHERE rn>peak AND chg<=-1.5 AND volume>pv) AS hits, any_value(base) AS base FROM pk7 GROUP BY 1),
pk AS (SELECT *, CASE WHEN na<3 OR nd<2 OR adv<=0 THEN 'N/A' WHEN dc/adv<=0.8 THEN 'PASS' WHEN dc/adv<=1.2 THEN 'WARN' ELSE 'FAIL' END AS t_volume,
   CASE WHEN n<60 THEN 'N/A' WHEN last>ma AND ma-mb>=0 THEN 'PASS' WHEN last>ma OR ma-mb>=0 THEN 'WARN' ELSE 'FAIL' END AS t_trend,
   CASE WHEN top-bc<=0 THEN 'N/A' WHEN last<=bc THEN 'FAIL' WHEN (top-last)/(top-bc)*100<=38 THEN 'PASS' WHEN (top-last)/(top-bc)*100<=62 THEN 'WARN' ELSE 'FAIL' END AS t_structure,
   CASE WHEN nd<3 OR pv IS NULL OR pv<=0 THEN 'N/A' WHEN hits=0 THEN 'PASS' WHEN hits<=2 THEN 'WARN' ELSE 'FAIL' END AS t_supply, dc/adv AS volume_ratio, (top-last)/nullif(top-bc,0)*100 AS retrace_pct, (last/top-1)*100 AS drawdown_pct FROM pk8),
pz AS (SELECT *, (t_volume='PASS')::int+(t_trend='PASS')::int+(t_structure='PASS')::int+(t_supply='PASS')::int AS passes, (t_volume='FAIL')::int+(t_trend='FAIL')::int+(t_structure='FAIL')::int+(t_supply='FAIL')::int AS fails FROM pk)"""


def _pullback(*names):
    return lambda spark, sf: tidy(pullback.assess(bars(spark, sf)).select("symbol", *names))


for _key, _names in {
    "p40_pullback_volume": "t_volume volume_ratio@4", "p41_pullback_trend": "t_trend", "p42_pullback_structure": "t_structure retrace_pct@4",
    "p43_pullback_supply": "t_supply hits@i",
}.items():
    register(_key, _pullback(*[x.partition("@")[0] for x in _names.split()]), query([BARS, PULLBACK], f"SELECT {select('symbol ' + _names)} FROM pz"))
register(
    "p44_swing_leg",
    lambda spark, sf: tidy(pullback.legs(bars(spark, sf)).select("symbol", "peak", "top", "base")),
    query([BARS, PULLBACK], f"SELECT {select('symbol peak@i top@4 base@i')} FROM pz"),
)
register(
    "p45_pullback_verdict",
    _pullback("status", "passes", "fails", "drawdown_pct"),
    query(
        [BARS, PULLBACK],
        f"SELECT {select('symbol passes@i fails@i drawdown_pct@4')}, CASE WHEN n<60 THEN 'NO_DATA' WHEN peak=0 THEN 'NO_PULLBACK' WHEN drawdown_pct> -3 THEN 'NO_PULLBACK' WHEN t_volume='N/A' AND t_trend='N/A' AND t_structure='N/A' AND t_supply='N/A' THEN 'UNKNOWN' WHEN fails=0 AND passes>=3 THEN 'ORDERLY' WHEN fails>=2 THEN 'DETERIORATING' ELSE 'MIXED' END AS status FROM pz",
    ),
)
register(
    "p46_ml_verdict_label",
    lambda spark, sf: tidy(
        tables.read(spark, sf, "lineitem").groupBy("l_suppkey").agg((F.sum(F.round(c("l_discount") * 100).cast("long")) / F.count("*") / 10.0).alias("prob")).select(
            "l_suppkey", F.when(c("prob") >= 0.65, "HIGH CONFIDENCE").when(c("prob") >= 0.55, "MODERATE").when(c("prob") >= 0.45, "NEUTRAL").otherwise("LOW CONFIDENCE").alias("label")
        )
    ),
    query("p AS (SELECT l_suppkey, sum(cast(round(l_discount*100) AS bigint))/count(*)/10.0::double AS prob FROM lineitem GROUP BY 1)", "SELECT l_suppkey, CASE WHEN prob>=0.65 THEN 'HIGH CONFIDENCE' WHEN prob>=0.55 THEN 'MODERATE' WHEN prob>=0.45 THEN 'NEUTRAL' ELSE 'LOW CONFIDENCE' END AS label FROM p"),
)


#: The moment the registered scan is made: the session of that day is not over.
SCAN_TIME, LAST_SESSION = "2001-11-04 14:00:00", "2001-11-03"
FUNDAMENTAL_COLUMNS = ("fund_score", "roe", "debt_equity", "revenue_growth", "earnings_growth", "net_margin", "sector", "industry")


def swing_scan(spark, sf):
    """The screening result: newest completed bar of each symbol, scored, labelled, with fundamentals, gated and ordered.

    The gate wants a tradeable row of the reference session that the written
    risk registry does not block.
    """
    t = tables.stored(spark, sf)
    df = scan.scan_newest(spark, sf, SCAN_TIME).withColumn("data_confidence", scoring.data_confidence())
    df = df.select("symbol", c("date").alias("bar_date"), "score100", "score_verdict", "data_confidence", "sl_buy", "target1", "target2")
    df = df.join(liquidity(quality.completed_sessions(t.bars, SCAN_TIME), FLOOR).select("symbol", "tradeable"), "symbol", "left")
    reference = scan.with_fund_score(tables.fundamentals(spark, sf)).select("symbol", *FUNDAMENTAL_COLUMNS)
    df = df.join(reference, "symbol", "left")
    session = quality.completed_sessions(t.index, SCAN_TIME).agg(F.max("date").alias("d")).select("d").scalar()
    df = quality.eligibility(df, session, written_registry(spark, sf))
    df = materialize(df)  # a row a symbol: the sort reads its input twice
    status = F.when(c("screen_eligible"), "WATCH").otherwise("AVOID")
    return tidy(
        df.select(
            "symbol", c("bar_date").alias("date"), "score100", "score_verdict", "data_confidence", "sl_buy", "target1", "target2", *FUNDAMENTAL_COLUMNS,
            c("fund_score").isNotNull().alias("fundamentals_available"), "screen_eligible", F.concat_ws("|", "eligibility_reasons").alias("reasons"),
            "financial_review_status", status.alias("setup_status"),
        ).orderBy(c("screen_eligible").desc(), c("score100").desc(), "symbol")
    )


def written_registry(spark, sf):
    """The risk registry, written as JSON lines and read back strictly."""
    from barloom.streaming.ticks import work_folder

    path = work_folder(spark)
    risks(spark, sf).write.json(path)
    return quality.load_risks(spark, path, multi_line=False)


def risks(spark, sf):
    f = tables.fundamentals(spark, sf)
    return f.where(c("banned") | c("oi_spurt")).select("symbol", F.when(c("banned"), "blocked").otherwise("watch").alias("status"))


register(
    "p47_swing_scan",
    swing_scan,
    query(
        [*SCAN, LIQUIDITY.replace("FROM b)", f"FROM b WHERE date<='{LAST_SESSION}')"), f"zl AS (SELECT symbol, max(rn) AS rn FROM z WHERE date<='{LAST_SESSION}' GROUP BY 1)"],
        f"""SELECT symbol, strftime(date,'%Y-%m-%d') AS date, score100, score_verdict, data_confidence, round(sl_buy,4)+0.0::double AS sl_buy, round(target1,4)+0.0::double AS target1, round(target2,4)+0.0::double AS target2,
    CASE WHEN roe IS NOT NULL THEN round(score_a,4)+0.0::double END AS fund_score, round(roe,4)+0.0::double AS roe, round(debt_equity,4)+0.0::double AS debt_equity, round(revenue_growth,4)+0.0::double AS revenue_growth,
    round(earnings_growth,4)+0.0::double AS earnings_growth, round(net_margin,4)+0.0::double AS net_margin, sector, industry, cast(roe IS NOT NULL AS bigint) AS fundamentals_available,
    cast(rs0='' AS bigint) AS screen_eligible, rs0 AS reasons, CASE WHEN banned THEN 'blocked' WHEN oi_spurt THEN 'watch' ELSE 'unreviewed' END AS financial_review_status, CASE WHEN rs0='' THEN 'WATCH' ELSE 'AVOID' END AS setup_status
  FROM (SELECT symbol, z.date, score100, score_verdict, data_confidence, sl_buy, target1, target2, f.roe, f.debt_equity, f.revenue_growth, f.earnings_growth, f.net_margin, f.sector, f.industry, f.score_a, f.banned, f.oi_spurt,
    concat_ws('|', CASE WHEN NOT coalesce(median_turnover>=230000 AND trading_days_pct>=80,false) THEN 'liquidity_failed_or_unknown' END, CASE WHEN z.date<>(SELECT max(date) FROM ix WHERE date<='{LAST_SESSION}') THEN 'stale_or_incomplete_session' END,
      CASE WHEN f.banned THEN 'material_financial_risk' END) AS rs0 FROM z JOIN zl USING (symbol, rn) LEFT JOIN lq USING (symbol) LEFT JOIN ffa f USING (symbol))""",
        True,
    ),
)
