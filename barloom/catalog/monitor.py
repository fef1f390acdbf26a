"""Score-log, crossing, portfolio and point-in-time queries and their SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from barloom.catalog.archive import LOG, scan_log, stamp, when
from barloom.catalog.base import register, tidy
from barloom.catalog.factors import LAST, last_rows
from barloom.catalog.market import FUND, fund_features
from barloom.catalog.oracle import BARS, INDEX, W, lag, query, select
from barloom.catalog.scores import FUNDAMENTALS, r
from barloom.functions.scoring import rnd
from barloom.functions.windows import roll
from barloom.operators import monitor, portfolio
from barloom.plans import tables
from barloom.plans.tables import bars, daily_bars, index_bars, index_series, read

c = F.col
READ = """rd0 AS (SELECT symbol, cast(scanned_at AS date) AS day, scanned_at, score100 AS score, id, row_number() OVER (PARTITION BY symbol, cast(scanned_at AS date) ORDER BY scanned_at DESC, id DESC) AS k FROM slog WHERE score100 IS NOT NULL),
rd AS (SELECT symbol, day, scanned_at, score, id FROM rd0 WHERE k=1)"""
register("x18_daily_readings", lambda spark, sf: tidy(monitor.daily_readings(scan_log(spark, sf)).select("symbol", "day", "score", "id")), query([LOG, READ], "SELECT symbol, strftime(day,'%Y-%m-%d') AS day, round(score,4)+0.0::double AS score, id FROM rd"))
CROSS = """cr0 AS (SELECT *, lag(score) OVER w AS ps, lag(scanned_at) OVER w AS pa, lead(day) OVER w AS nd FROM rd WINDOW w AS (PARTITION BY symbol ORDER BY day)),
cr1 AS (SELECT *, pa IS NOT NULL AND pa>=TIMESTAMP '2000-01-01'-INTERVAL 400 DAY AS known FROM cr0 WHERE nd IS NULL),
cr AS (SELECT *, CASE WHEN NOT known THEN CASE WHEN score>=60 THEN 'new' END WHEN ps<60 AND score>=60 THEN 'crossed' WHEN ps>=60 AND score<60 THEN 'lost' WHEN score<60 AND score-ps>=5 THEN 'rising' END AS grp, CASE WHEN known THEN floor(date_diff('hour', pa, scanned_at)/24) END AS db FROM cr1)"""


def _cross(spark, sf):
    return monitor.crossings(monitor.daily_readings(scan_log(spark, sf)), 60.0, 400, F.lit("2000-01-01").cast("timestamp_ntz"))


register(
    "x19_crossings",
    lambda spark, sf: tidy(_cross(spark, sf).drop("scanned_at")),
    query([LOG, READ, CROSS], "SELECT symbol, grp AS \"group\", round(score,4)+0.0::double AS score, CASE WHEN grp<>'new' THEN round(ps,4)+0.0::double END AS prev_score, CASE WHEN grp<>'new' THEN round(score-ps,1)+0.0::double END AS delta, CASE WHEN grp<>'new' THEN cast(db AS bigint) END AS days_between, CASE WHEN grp<>'new' AND db<>0 THEN " + r("(score-ps)/greatest(db,1)", 2) + "+0.0::double END AS velocity, round(score-60,1)+0.0::double AS margin FROM cr WHERE grp IS NOT NULL"),
)


def _fresh(spark, sf):
    x = _cross(spark, sf).where("`group` = 'crossed'").select("symbol", F.lit(60).alias("bar"), F.to_date("scanned_at").alias("day"), "score")
    seen = scan_log(spark, sf).where("universe = 'narrow'").select("symbol", F.lit(60).alias("bar"), F.to_date("scanned_at").alias("day"))
    return tidy(monitor.fresh_crossings(x, seen).select("symbol", "day", "score"))


register("x20_crossing_record", _fresh, query([LOG, READ, CROSS], "SELECT symbol, strftime(day,'%Y-%m-%d') AS day, round(score,4)+0.0::double AS score FROM cr WHERE grp='crossed' AND NOT EXISTS (SELECT 1 FROM slog s WHERE s.universe='narrow' AND s.symbol=cr.symbol AND cast(s.scanned_at AS date)=cr.day)"))
register("x21_crossing_history", lambda spark, sf: tidy(_cross(spark, sf).where("`group` = 'crossed'").where(c("scanned_at") >= F.lit("2000-01-01").cast("timestamp_ntz")).orderBy(c("scanned_at").desc(), "symbol").select("symbol", when(c("scanned_at")).alias("scanned_at"), "score")), query([LOG, READ, CROSS], f"SELECT symbol, {stamp('scanned_at')} AS scanned_at, round(score,4)+0.0::double AS score FROM cr WHERE grp='crossed' AND scanned_at>='2000-01-01'"))
LASTS = "ls0 AS (SELECT clean AS symbol, cast(scanned_at AS date) AS day, score100 AS score, universe, row_number() OVER (PARTITION BY clean, cast(scanned_at AS date) ORDER BY scanned_at DESC, id DESC) AS k FROM slog WHERE scan_type='swing'), lst AS (SELECT * FROM ls0 WHERE k=1 AND score IS NOT NULL)"
register("x22_last_score_per_day", lambda spark, sf: tidy(monitor.last_scores(scan_log(spark, sf))), query([LOG, LASTS], "SELECT symbol, strftime(day,'%Y-%m-%d') AS day, score, universe FROM lst"))
MEND = "me AS (SELECT date FROM (SELECT date, lead(date) OVER (ORDER BY date) AS nx FROM ix) WHERE month(nx)<>month(date))"
register("x23_month_ends", lambda spark, sf: tidy(portfolio.month_ends(index_bars(spark, sf))), query([INDEX, MEND], "SELECT strftime(date,'%Y-%m-%d') AS date FROM me"))


def _picks(spark, sf):
    ix = index_series(spark, sf)
    risk = ix.select("date", (c("close") > roll(F.avg, "close", 200)).alias("risk_on"))
    feats = fund_features(bars(spark, sf)).withColumn("momentum", rnd("momentum", 6)).withColumn("year_high", rnd("year_high", 6))
    return portfolio.monthly_picks(feats, portfolio.month_ends(ix), risk)


PICKS = f"""rk0 AS (SELECT date, close>CASE WHEN rn>=199 THEN avg(close) OVER ({W} ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) END AS risk_on FROM ix),
pe AS (SELECT ff.symbol, ff.date, {r('momentum', 6)} AS m, {r('year_high', 6)} AS y, risk_on, turnover, close FROM ff JOIN me USING (date) JOIN rk0 USING (date) WHERE eligible),
pl AS (SELECT date, symbol, 'stable_control' AS arm, 0.0::double AS value, sha256(symbol) AS key, turnover, close FROM pe UNION ALL SELECT date, symbol, 'momentum', m, '', turnover, close FROM pe WHERE m IS NOT NULL
  UNION ALL SELECT date, symbol, 'momentum_trend', m, '', turnover, close FROM pe WHERE risk_on AND m IS NOT NULL UNION ALL SELECT date, symbol, 'year_high', y, '', turnover, close FROM pe WHERE y>=0.95),
pp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date, arm ORDER BY key, value DESC, symbol) AS position FROM pl) WHERE position<=20)"""
register("x24_monthly_picks", lambda spark, sf: tidy(_picks(spark, sf)), query([BARS, INDEX, FUND, MEND, PICKS], f"SELECT {select('date@d symbol arm value@4 position')} FROM pp"))
register("x25_price_jumps", lambda spark, sf: tidy(portfolio.price_jumps(daily_bars(spark, sf), 0.02).select("symbol", "date", "move")), query(BARS, f"SELECT symbol, strftime(date,'%Y-%m-%d') AS date, round(m,4)+0.0::double AS move FROM (SELECT symbol, date, close/{lag('close')}-1 AS m FROM b) WHERE abs(m)>0.02"))


def _allocate(spark, sf):
    picks = _picks(spark, sf).where("arm = 'momentum'").join(daily_bars(spark, sf).select("symbol", "date", c("close").alias("price"), (c("close") * c("volume")).alias("turnover")), ["symbol", "date"])
    t = picks.join(tables.fundamentals(spark, sf).select("symbol", "sector"), "symbol").withColumn("budget", F.lit(50_000.0))
    return tidy(portfolio.allocate(t.select("date", "symbol", "position", "price", "turnover", "sector", "budget"), 500_000.0, 200_000.0, 0.08, 0.2, 0.25, 0.0028).select("date", "symbol", "position", "quantity"))


register(
    "x26_budget_caps",
    _allocate,
    query(
        [BARS, INDEX, FUND, MEND, PICKS, FUNDAMENTALS,
         "al0 AS (SELECT p.date, p.symbol, position, b.close AS price, b.close*b.volume AS tv, sector FROM pp p JOIN b ON b.symbol=p.symbol AND b.date=p.date JOIN fd ON fd.symbol=p.symbol WHERE arm='momentum')",
         "al1 AS (SELECT *, floor(least(least(50000.0::double, 0.08::double*500000)/price, 0.2::double*tv/price)) AS w FROM al0), al2 AS (SELECT *, coalesce(sum(w*price) OVER (PARTITION BY date, sector ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS used FROM al1 WHERE w>0)",
         "al3 AS (SELECT *, least(w, greatest(0, floor((125000.0::double-used)/price))) AS w2 FROM al2), al4 AS (SELECT *, coalesce(sum(w2*price*(1+0.0028::double)) OVER (PARTITION BY date ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS spent FROM al3 WHERE w2>0)",
         "al AS (SELECT *, least(w2, greatest(0, floor((200000.0::double-spent)/(price*(1+0.0028::double))))) AS q FROM al4)"],
        "SELECT strftime(date,'%Y-%m-%d') AS date, symbol, position, cast(q AS bigint) AS quantity FROM al WHERE q>0",
    ),
)


def fills(spark, sf):
    li = read(spark, sf, "lineitem")
    w = Window.partitionBy("l_suppkey", "l_shipdate").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_tax", "l_discount")
    return li.select(
        F.concat(F.lit("S"), c("l_suppkey").cast("string")).alias("symbol"), F.to_date("l_shipdate").alias("day"), F.row_number().over(w).alias("seq"),
        F.when(c("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"), F.when(c("l_returnflag") == "R", c("l_quantity") * 2).otherwise(c("l_quantity")).cast("long").alias("qty"),
        (c("l_extendedprice") / c("l_quantity")).alias("price"),
    )


POSITIONS = """fl AS (SELECT 'S'||cast(l_suppkey AS varchar) AS symbol, cast(l_shipdate AS date) AS day, row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_tax, l_discount) AS seq,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_tax, l_discount) AS k, CASE WHEN l_returnflag='R' THEN 'SELL' ELSE 'BUY' END AS side, cast(CASE WHEN l_returnflag='R' THEN l_quantity*2 ELSE l_quantity END AS bigint) AS qty, l_extendedprice/l_quantity AS price FROM lineitem),
po AS (SELECT symbol, day, seq, k, side, CASE WHEN side='BUY' THEN qty ELSE 0 END AS filled, CASE WHEN side='BUY' THEN qty ELSE 0 END AS held, CASE WHEN side='BUY' THEN price*qty ELSE 0.0::double END AS cost, 0.0::double AS realised FROM fl WHERE k=1
  UNION ALL
  SELECT x.symbol, x.day, x.seq, x.k, x.side, CASE WHEN x.side='BUY' THEN x.qty ELSE least(x.qty,p.held) END, CASE WHEN x.side='BUY' THEN p.held+x.qty ELSE p.held-least(x.qty,p.held) END,
    CASE WHEN x.side='BUY' THEN p.cost+x.price*x.qty WHEN p.held-least(x.qty,p.held)=0 THEN 0 ELSE p.cost*(1-least(x.qty,p.held)/p.held) END,
    CASE WHEN x.side='SELL' AND p.held>0 THEN least(x.qty,p.held)*(x.price-p.cost/p.held) ELSE 0 END FROM po p JOIN fl x ON x.symbol=p.symbol AND x.k=p.k+1)"""
register(
    "x27_position_rebuild",
    lambda spark, sf: tidy(portfolio.positions(fills(spark, sf)).withColumns({"avg_price": rnd("avg_price", 3), "realised": rnd("realised", 3)})),
    query(POSITIONS, "SELECT symbol, strftime(day,'%Y-%m-%d') AS day, seq, side, filled, held, CASE WHEN held>0 THEN " + r('cost/held', 3) + "+0.0::double END AS avg_price, " + r('realised', 3) + "+0.0::double AS realised FROM po", True),
)


def _value(spark, sf):
    o = read(spark, sf, "orders").select(c("o_custkey").alias("account"), F.concat(F.lit("S"), F.pmod("o_orderkey", F.lit(110)).cast("string")).alias("symbol"), F.floor(c("o_totalprice") / 10000).alias("qty"))
    marks = last_rows(bars(spark, sf).select("symbol", "rn", "close")).select("symbol", c("close").alias("mark"))
    return tidy(portfolio.valuation(o, marks, F.lit(1000.0)))


register("x28_valuation_snapshot", _value, query([BARS, LAST], "SELECT account, count(*) FILTER (WHERE close IS NULL) AS missing, CASE WHEN count(*) FILTER (WHERE close IS NULL)=0 THEN round(1000+sum(qty*close),4)+0.0::double END AS nav FROM (SELECT o_custkey AS account, 'S'||cast(o_orderkey%110 AS varchar) AS symbol, floor(o_totalprice/10000) AS qty FROM orders) o LEFT JOIN lc USING (symbol) GROUP BY 1"))


_d = lambda x: f"round({x},4)+0.0::double"


def corporate_actions(spark, sf):
    """Actions of every order that names one, some repeated and some repeated with other values."""
    k = c("o_orderkey")
    kind = F.when(c("o_orderpriority") == "1-URGENT", "split").when(c("o_orderpriority").isin("2-HIGH", "4-NOT SPECIFIED"), "dividend_payment").when(c("o_orderpriority") == "3-MEDIUM", "demerger")
    a = read(spark, sf, "orders").select(
        k.alias("id"), F.concat(F.lit("S"), F.pmod("o_custkey", F.lit(120)).cast("string")).alias("symbol"), kind.alias("type"),
        F.when(kind == "split", F.when(k % 11 == 0, -1.0).when(k % 2 == 0, 2.0).otherwise(0.5)).alias("ratio"),
        F.when(kind == "dividend_payment", F.when(k % 13 == 0, -1.0).otherwise(k % 9 / 10.0)).alias("cash_per_share"), F.to_date("o_orderdate").alias("day"),
    ).where(c("type").isNotNull())
    other = a.where("id % 19 = 0").withColumns({"ratio": c("ratio") + 1, "cash_per_share": c("cash_per_share") + 1})
    return a.unionByName(a.where("id % 17 = 0")).unionByName(other)


def share_changes(spark, sf):
    o = read(spark, sf, "orders")
    return o.select(F.pmod("o_custkey", F.lit(40)).alias("account"), F.concat(F.lit("S"), F.pmod("o_orderkey", F.lit(120)).cast("string")).alias("symbol"), F.to_date("o_orderdate").alias("day"), (1 + c("o_orderkey") % 5).alias("qty"))


SNAPSHOT = "1997-06-01"
ACTIONS = [
    """aa AS (SELECT o_orderkey AS id, 'S'||cast(o_custkey%120 AS varchar) AS symbol, CASE WHEN o_orderpriority='1-URGENT' THEN 'split' WHEN o_orderpriority IN ('2-HIGH','4-NOT SPECIFIED') THEN 'dividend_payment' WHEN o_orderpriority='3-MEDIUM' THEN 'demerger' END AS type, cast(o_orderdate AS date) AS day FROM orders)""",
    """an AS (SELECT *, CASE WHEN id%19=0 AND type<>'demerger' THEN 'conflicting_action' WHEN type='split' AND id%11=0 THEN 'invalid_ratio' WHEN type='dividend_payment' AND id%13=0 THEN 'invalid_dividend' WHEN type='demerger' THEN 'needs_review' WHEN id%17=0 OR id%19=0 THEN 'duplicate_action' END AS reason FROM aa WHERE type IS NOT NULL)""",
    "ch AS (SELECT o_custkey%40 AS account, 'S'||cast(o_orderkey%120 AS varchar) AS symbol, cast(o_orderdate AS date) AS day, sum(1+o_orderkey%5) AS d FROM orders GROUP BY 1,2,3)",
    "iv AS (SELECT account, symbol, cast(sum(d) OVER (PARTITION BY account, symbol ORDER BY day) AS bigint) AS qty, day AS f, lead(day) OVER (PARTITION BY account, symbol ORDER BY day) AS t FROM ch)",
]


def _holdings(spark, sf):
    iv = portfolio.entitlements(share_changes(spark, sf))
    at = F.lit(SNAPSHOT).cast("date")
    return iv.where((c("valid_from") <= at) & (c("valid_to").isNull() | (at < c("valid_to")))).select("account", "symbol", "qty", F.lit(100.0).alias("mark"), at.alias("held_since"))


def _splits(spark, sf):
    sound, _ = portfolio.reviewed_actions(corporate_actions(spark, sf))
    return tidy(portfolio.apply_splits(_holdings(spark, sf), sound).select("account", "symbol", "factor", "qty", "mark", "unresolved"))


def _dividends(spark, sf):
    sound, _ = portfolio.reviewed_actions(corporate_actions(spark, sf))
    return tidy(portfolio.dividend_cash(portfolio.entitlements(share_changes(spark, sf)), sound))


def _quarantine(spark, sf):
    _, refused = portfolio.reviewed_actions(corporate_actions(spark, sf))
    return tidy(portfolio.quarantine(portfolio.entitlements(share_changes(spark, sf)), refused))


register(
    "x29_split_application",
    _splits,
    query(
        [*ACTIONS, f"hd AS (SELECT account, symbol, qty FROM iv WHERE f<='{SNAPSHOT}' AND (t IS NULL OR t>'{SNAPSHOT}'))",
         f"sx AS (SELECT h.account, h.symbol, h.qty, CASE WHEN a.id%2=0 THEN 1 ELSE -1 END AS e, a.day, a.id FROM hd h JOIN an a ON a.symbol=h.symbol AND a.type='split' AND coalesce(a.reason,'duplicate_action')='duplicate_action' AND a.day>'{SNAPSHOT}')",
         "sy AS (SELECT *, sum(e) OVER (PARTITION BY account, symbol ORDER BY day, id ROWS UNBOUNDED PRECEDING) AS p FROM sx)",
         "sz AS (SELECT account, symbol, sum(e) AS e, min(p) AS low FROM sy GROUP BY 1,2)"],
        f"""SELECT account, symbol, {_d('pow(2,coalesce(e,0))')} AS factor, {_d('qty*pow(2,coalesce(e,0))')} AS qty, {_d('100/pow(2,coalesce(e,0))')} AS mark,
  cast(coalesce(CASE WHEN low<0 THEN qty % cast(greatest(1,pow(2,-low)) AS bigint)<>0 END, false) AS bigint) AS unresolved FROM hd LEFT JOIN sz USING (account, symbol)""",
    ),
)
register(
    "x29_dividends",
    _dividends,
    query(
        ACTIONS,
        f"SELECT account, {_d('sum(qty*(id%9))/10.0::double')} AS dividend_cash, count(*) AS payments FROM iv JOIN an ON an.symbol=iv.symbol AND f<=day AND (t IS NULL OR day<t) WHERE type='dividend_payment' AND coalesce(reason,'duplicate_action')='duplicate_action' GROUP BY 1",
    ),
)
register(
    "x29_quarantine",
    _quarantine,
    query(
        ACTIONS,
        "SELECT id, an.symbol, type, reason, account FROM an JOIN iv ON an.symbol=iv.symbol AND f<=day AND (t IS NULL OR day<t) WHERE reason='needs_review' UNION ALL SELECT id, symbol, type, reason, NULL FROM an WHERE reason IS NOT NULL AND reason<>'needs_review'",
    ),
)


def _exits(spark, sf):
    last = last_rows(bars(spark, sf).select("symbol", "rn", "close", "date"))
    cut = bars(spark, sf).where(c("date") <= F.lit("2001-10-20").cast("date"))
    entry = last_rows(cut.select("symbol", "rn", "close", "date")).select("symbol", c("close").alias("cost"), c("date").alias("since"))
    df = last.join(entry, "symbol")
    x = portfolio.exit_action(c("close"), c("cost") * 0.97, c("cost") * 1.03, F.lit(7), F.datediff("date", "since"), c("cost"))
    return tidy(df.select("symbol", x["action"].alias("action"), x["sell_qty"].alias("sell_qty"), rnd(x["stop"], 3).alias("stop")))


register("x30_exit_check", _exits, query([BARS, "l AS (SELECT symbol, arg_max(close, rn) AS px, max(date) AS d FROM b GROUP BY 1), e AS (SELECT symbol, arg_max(close, rn) AS cost, max(date) AS s FROM b WHERE date<='2001-10-20' GROUP BY 1), xa AS (SELECT symbol, CASE WHEN px<=cost*0.97::double THEN 'SL_HIT' WHEN px>=cost*1.03::double THEN 'T1_HIT' WHEN date_diff('day', s, d)>=10 THEN 'MAX_HOLD' END AS action, cost FROM l JOIN e USING (symbol))"], "SELECT symbol, action, cast(CASE WHEN action='T1_HIT' THEN 3 WHEN action IS NOT NULL THEN 7 END AS bigint) AS sell_qty, round(CASE WHEN action='T1_HIT' THEN cost WHEN action IS NULL THEN cost*0.97::double END, 3)+0.0::double AS stop FROM xa"))


def _nav(spark, sf):
    """Equal-weight and value series over all symbols as two NAV arms."""
    d = daily_bars(spark, sf).groupBy("date").agg(F.sum(F.round(c("close") * 100).cast("long")).alias("s"), F.count("*").alias("n"))
    base = c("s") / c("n") / 100.0 * 5000.0
    arms = F.array(F.struct(F.lit("equal").alias("arm"), base.alias("nav"), F.lit(1000.0).alias("cash"), (1.0 / c("n")).alias("max_weight")), F.struct(F.lit("double").alias("arm"), (base * 2 - 500000.0).alias("nav"), F.lit(0.0).alias("cash"), F.lit(0.5).alias("max_weight")))
    return d.select("date", F.inline(arms))


NAV = "nv0 AS (SELECT date, sum(cast(round(close*100) AS bigint))/count(*)/100.0::double*5000 AS base, count(*) AS n FROM b GROUP BY 1), nv AS (SELECT date, 'equal' AS arm, base AS nav, 1000.0::double AS cash, 1.0::double/n AS mw FROM nv0 UNION ALL SELECT date, 'double', base*2-500000, 0, 0.5 FROM nv0), np AS (SELECT *, greatest(500000, max(nav) OVER (PARTITION BY arm ORDER BY date)) AS pk FROM nv)"
register(
    "c25_nav_metrics",
    lambda spark, sf: tidy(portfolio.nav_metrics(_nav(spark, sf), 500_000.0)),
    query([BARS, NAV], "SELECT arm, count(*) AS sessions, round(max(mw),4)+0.0::double AS max_weight, round((arg_max(nav,date)/500000-1)*100,4)+0.0::double AS total_return_pct, round((pow(arg_max(nav,date)/500000, 1/(date_diff('day', min(date), max(date))/365.25::double))-1)*100,4)+0.0::double AS cagr_pct, round(least(min(nav/pk-1),0)*100,4)+0.0::double AS max_drawdown_pct, round(((arg_max(nav,date)-(arg_max(nav,date)-arg_max(cash,date))*0.0028::double)/500000-1)*100,4)+0.0::double AS liquidation_return_pct FROM np GROUP BY arm"),
)
register("c25_yearly_returns", lambda spark, sf: tidy(portfolio.yearly_returns(_nav(spark, sf), 500_000.0)), query([BARS, NAV, "ye AS (SELECT arm, year(date) AS year, arg_max(nav,date) AS e FROM nv GROUP BY 1,2)"], "SELECT arm, year, round((e/coalesce(lag(e) OVER (PARTITION BY arm ORDER BY year),500000)-1)*100,4)+0.0::double AS return_pct FROM ye"))
