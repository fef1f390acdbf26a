"""Filters, joins, aggregates, sorts, scalar functions and set operations, with SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from barloom.catalog.archive import INSTRUMENTS, LOG, instruments, scan_log, stamp, when
from barloom.catalog.base import register, tidy
from barloom.catalog.factors import FLOOR, LAST, LIQUIDITY, SELLS, last_rows, liquidity, sells
from barloom.catalog.market import IX, REGIME
from barloom.catalog.monitor import READ
from barloom.catalog.oracle import BARS, INDEX, W, lag, query, select
from barloom.catalog.outcomes import FORWARD, HORIZONS
from barloom.catalog.scores import FUNDAMENTALS, SCAN, r
from barloom.functions import indicators as ind, market, outcomes as out, rules, scoring
from barloom.functions.scoring import rnd
from barloom.functions.windows import LEVELS, lag as wlag, lead
from barloom.operators import evaluation, monitor, ranking
from barloom.plans import scan, tables
from barloom.plans.tables import bars, daily_bars, index_bars, index_series, read
from barloom.sources import archive, parsing

c = F.col
d = lambda x, n=4: f"round({x},{n})+0.0::double"


def part(spark, sf):
    return read(spark, sf, "part")


# --- B: filters and routing -------------------------------------------------------
def _candidates(spark, sf):
    """What each session's scan offers to buy: score, stage, reward against risk, not banned, few pledged shares; strongest first."""
    rows = scan.score_log(spark, sf).join(tables.fundamentals(spark, sf).select("symbol", "banned"), "symbol", "left")
    good = (c("score100") >= 65) & (c("stage") == 2) & (F.coalesce("rr_ratio", F.lit(0.0)) >= 1.8) & ~F.coalesce("banned", F.lit(False)) & (F.coalesce("promoter_pledged", F.lit(0.0)) < 30)
    order = [c("date"), F.coalesce("composite_rs", F.lit(0.0)).desc(), c("score100").desc(), c("symbol")]
    return tidy(rows.where(good).orderBy(*order).select("date", "symbol", "score100", "rr_ratio", "composite_rs"))


register(
    "b01_candidate_filter",
    _candidates,
    query(SCAN, f"SELECT {select('date@d symbol score100@i rr_ratio@4 composite_rs@4')} FROM z WHERE score100>=65 AND stage=2 AND coalesce(rr_ratio,0)>=1.8 AND NOT coalesce(banned,false) AND coalesce(promoter_pledged,0)<30", True),
)


def route(symbol):
    """Exchange of a symbol: all digits trade on BSE."""
    bare = F.regexp_replace(symbol, r"\.(NS|BO)$", "")
    return F.when(bare.rlike("^[0-9]+$"), "BSE").otherwise("NSE")


def ticker_for(symbol):
    """Validated ticker with exchange suffix; null when malformed."""
    up = F.upper(F.trim(symbol))
    ok = up.rlike(r"^[A-Z0-9][A-Z0-9&-]{0,29}(\.NS|\.BO)?$")
    return F.when(ok, F.when(up.rlike(r"\.(NS|BO)$"), up).otherwise(F.concat(up, F.lit(".NS"))))




def _codes(spark, sf):
    return part(spark, sf).select("p_partkey", F.when(c("p_partkey") % 3 == 0, c("p_partkey").cast("string")).when(c("p_partkey") % 3 == 1, F.concat(c("p_name"), F.lit(".NS"))).otherwise(F.regexp_replace("p_brand", "#", "&")).alias("s"))


CODES = "cd AS (SELECT p_partkey, CASE p_partkey%3 WHEN 0 THEN cast(p_partkey AS varchar) WHEN 1 THEN p_name||'.NS' ELSE replace(p_brand,'#','&') END AS s FROM part)"
register("b02_exchange_routing", lambda spark, sf: tidy(_codes(spark, sf).select("p_partkey", route(c("s")).alias("exchange"))), query(CODES, "SELECT p_partkey, CASE WHEN regexp_matches(regexp_replace(s,'\\.(NS|BO)$',''),'^[0-9]+$') THEN 'BSE' ELSE 'NSE' END AS exchange FROM cd"))
register("b03_ticker_validation", lambda spark, sf: tidy(_codes(spark, sf).select("p_partkey", ticker_for(c("s")).alias("ticker"))), query(CODES, "SELECT p_partkey, CASE WHEN regexp_matches(upper(trim(s)),'^[A-Z0-9][A-Z0-9&-]{0,29}(\\.NS|\\.BO)?$') THEN CASE WHEN regexp_matches(upper(s),'\\.(NS|BO)$') THEN upper(trim(s)) ELSE upper(trim(s))||'.NS' END END AS ticker FROM cd"))
DEBT_WORDS = r"\b(BOND|NCD|WIDGET)\b"


def _equities(spark, sf):
    m = parsing.instrument_master(instruments(spark, sf))
    return m.where(c("ticker").isNull() & c("bse_code").isNotNull() & c("isin").startswith("INE") & ~c("name").rlike(DEBT_WORDS))


register("b04_structural_filter", lambda spark, sf: tidy(_equities(spark, sf).select("isin", "bse_code", "name")), query(INSTRUMENTS, "SELECT isin, bse_code, name FROM im WHERE ticker IS NULL AND bse_code IS NOT NULL AND isin LIKE 'INE%' AND NOT regexp_matches(name,'\\b(BOND|NCD|WIDGET)\\b')"))


def _universe(spark, sf):
    n = daily_bars(spark, sf).groupBy("symbol").agg(F.count("*").alias("bars_n")).where("bars_n >= 100")
    return liquidity(bars(spark, sf), FLOOR).where("tradeable").join(n, "symbol").orderBy(c("median_turnover").desc(), "symbol")


register("b05_tradeable_universe", lambda spark, sf: tidy(_universe(spark, sf).select("symbol", "median_turnover", "bars_n")), query([BARS, LIQUIDITY], f"SELECT symbol, {d('median_turnover')} AS median_turnover, n AS bars_n FROM lq JOIN (SELECT symbol, count(*) AS n FROM b GROUP BY 1) USING (symbol) WHERE n>=100 AND median_turnover>=230000 AND trading_days_pct>=80"))
register("b06_universe_by_turnover", lambda spark, sf: tidy(liquidity(bars(spark, sf), FLOOR).where("median_turnover >= 250000").select("symbol", "median_turnover")), query([BARS, LIQUIDITY], f"SELECT symbol, {d('median_turnover')} AS median_turnover FROM lq WHERE median_turnover>=250000"))


def resolve(queries, master):
    """Ticker, else ISIN, else numeric code, else the only name that contains the query.

    Names are met over the query's first three letters, so no query meets
    all names.
    """
    q = queries.select("q", F.upper(F.trim("q")).alias("_q"))
    hits = None
    for rank, col in ((1, "ticker"), (2, "isin"), (3, "bse_code")):
        h = q.join(master.select("isin", c(col).alias("_q")), "_q").select("q", "isin", F.lit(rank).alias("rank"))
        hits = h if hits is None else hits.unionByName(h)
    name = F.upper("name")
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.array(*[F.substring(name, i, F.lit(n)) for n in (1, 2, 3)])))
    names = master.where("name <> ''").select("isin", name.alias("_name"), F.explode(F.array_distinct(grams)).alias("_g"))
    found = q.where("_q <> ''").withColumn("_g", F.substring("_q", 1, 3)).join(names, "_g").where(F.contains("_name", "_q"))
    once = found.groupBy("q").agg(F.count("*").alias("_n"), F.min("isin").alias("isin")).where("_n = 1")
    hits = hits.unionByName(once.select("q", "isin", F.lit(4).alias("rank")))
    best = hits.groupBy("q").agg(F.min_by("isin", F.struct("rank", "isin")).alias("isin"))
    return queries.join(best, "q", "left")


def _resolve(spark, sf):
    m = parsing.instrument_master(instruments(spark, sf))
    k = c("p_partkey")
    q = part(spark, sf).select(F.when(k % 3 == 0, F.concat(F.lit("t"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("ine"), F.lpad(F.floor(k / 2).cast("string"), 9, "0"))).otherwise((k + 500000).cast("string")).alias("q"))
    return tidy(resolve(q, m))


register(
    "b07_instrument_resolve",
    _resolve,
    query([INSTRUMENTS, "qs AS (SELECT CASE p_partkey%3 WHEN 0 THEN 't'||p_partkey WHEN 1 THEN 'ine'||lpad(cast(p_partkey//2 AS varchar),9,'0') ELSE cast(p_partkey+500000 AS varchar) END AS q FROM part)"], "SELECT q, coalesce(a.isin, b.isin, e.isin) AS isin FROM qs LEFT JOIN im a ON a.ticker=upper(q) LEFT JOIN im b ON b.isin=upper(q) LEFT JOIN im e ON e.bse_code=q"),
)
register(
    "b08_instrument_search",
    lambda spark, sf: tidy(parsing.instrument_master(instruments(spark, sf)).where(F.concat_ws(" ", "ticker", "isin", "bse_code", "name").contains("GEAR")).orderBy("isin").limit(10).select("isin", "name")),
    query(INSTRUMENTS, "SELECT isin, name FROM im WHERE contains(concat_ws(' ', ticker, isin, bse_code, name),'GEAR') ORDER BY isin LIMIT 10"),
)


def _alerts(spark, sf):
    log = scan_log(spark, sf).where("score100 >= 60").withColumn("tier", F.when(c("score100") >= 80, "strong").otherwise("watch"))
    w = Window.partitionBy("tier", "universe").orderBy(c("score100").desc(), "id")
    return tidy(log.withColumn("position", F.row_number().over(w)).where("position <= 5").select("tier", "universe", "id", "score100", "position"))


register("b09_alert_filter", _alerts, query([LOG, "al AS (SELECT *, CASE WHEN score100>=80 THEN 'strong' ELSE 'watch' END AS tier FROM slog WHERE score100>=60), ar AS (SELECT *, row_number() OVER (PARTITION BY tier, universe ORDER BY score100 DESC, id) AS position FROM al)"], "SELECT tier, universe, id, score100, position FROM ar WHERE position<=5"))


def _day_moves(spark, sf):
    b = ind.compose(bars(spark, sf), ind.volume_average()).withColumn("change_pct", (c("close") / wlag("close") - 1.0) * 100.0)
    return last_rows(b.select("symbol", "rn", "close", "volume", "vol_ratio", "change_pct"))


MOVES = f"""mv0 AS (SELECT symbol, rn, close, volume, CASE WHEN rn>=19 THEN volume/avg(volume) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS vr, (close/{lag('close')}-1)*100 AS ch FROM b), mvx AS (SELECT symbol, max(rn) AS rn FROM b GROUP BY 1), mv AS (SELECT mv0.* FROM mv0 JOIN mvx USING (symbol, rn))"""
register("b10_activity_spurts", lambda spark, sf: tidy(_day_moves(spark, sf).where("vol_ratio >= 1.5").orderBy(c("vol_ratio").desc(), "symbol").select("symbol", rnd("vol_ratio", 4).alias("vol_ratio"), rnd("change_pct", 4).alias("change_pct"))), query([BARS, MOVES], f"SELECT symbol, {r('vr', 4)}+0.0::double AS vol_ratio, {r('ch', 4)}+0.0::double AS change_pct FROM mv WHERE vr>=1.5"))
register("b11_most_active", lambda spark, sf: tidy(_day_moves(spark, sf).orderBy((c("close") * c("volume")).desc(), "symbol").limit(30).select("symbol", (c("close") * c("volume") / 1e7).alias("value_crore")), 6), query([BARS, MOVES], f"SELECT symbol, {d('close*volume/1e7', 6)} AS value_crore FROM mv ORDER BY close*volume DESC, symbol LIMIT 30"))


def _movers(spark, sf):
    m = _day_moves(spark, sf).where("change_pct IS NOT NULL").select("symbol", rnd("change_pct", 4).alias("change_pct"))
    up = m.orderBy(c("change_pct").desc(), "symbol").limit(20).withColumn("side", F.lit("gainer"))
    return tidy(up.unionByName(m.orderBy("change_pct", "symbol").limit(20).withColumn("side", F.lit("loser"))))


register("b12_movers", _movers, query([BARS, MOVES], f"SELECT symbol, {r('ch', 4)}+0.0::double AS change_pct, 'gainer' AS side FROM (SELECT * FROM mv ORDER BY {r('ch', 4)} DESC, symbol LIMIT 20) UNION ALL SELECT symbol, {r('ch', 4)}+0.0::double, 'loser' FROM (SELECT * FROM mv ORDER BY {r('ch', 4)}, symbol LIMIT 20)"))
register("b13_banned_set", lambda spark, sf: tidy(tables.fundamentals(spark, sf).where("banned").select(F.upper(F.trim("symbol")).alias("symbol")).distinct()), query(FUNDAMENTALS, "SELECT DISTINCT symbol FROM fd WHERE banned"))


def _snapshot(spark, sf):
    m = _day_moves(spark, sf).join(tables.fundamentals(spark, sf).select("symbol", "sector"), "symbol")
    return tidy(m.groupBy(F.lower(F.regexp_replace("sector", " ", "_")).alias("sector_key")).agg(F.count("*").alias("n"), F.sum(F.round(c("change_pct") * 1e6).cast("long")).alias("micro_change")))


register("b14_sector_snapshot", _snapshot, query([BARS, MOVES, FUNDAMENTALS], "SELECT lower(replace(sector,' ','_')) AS sector_key, count(*) AS n, cast(sum(cast(round(ch*1e6) AS bigint)) AS bigint) AS micro_change FROM mv JOIN fd USING (symbol) GROUP BY 1"))
register("b15_status_override", lambda spark, sf: tidy(tables.fundamentals(spark, sf).select("symbol", F.when(~c("banned") & (c("promoter_pledged") < 30), "WATCH").otherwise("AVOID").alias("setup_status"))), query(FUNDAMENTALS, "SELECT symbol, CASE WHEN NOT banned AND promoter_pledged<30 THEN 'WATCH' ELSE 'AVOID' END AS setup_status FROM fd"))


def rule_variant(regime, rs, floor):
    """Regime under which a stock that beats the index by ``floor`` is scored."""
    weak = regime.isin("BEAR_TREND", "SIDEWAYS", "RECOVERY", "HIGH_VOLATILITY")
    return F.when(F.coalesce(rs >= floor, F.lit(False)) & weak, "BULL_WEAK").otherwise(regime)


def _variant(spark, sf):
    df = market.with_strength(bars(spark, sf), index_series(spark, sf)).join(tables.index_context(spark, sf).select("date", "regime"), "date")
    return tidy(df.select("symbol", "date", rule_variant(c("regime"), c("rs_vs_index"), 5.0).alias("regime")))


from barloom.catalog.market import STRENGTH  # noqa: E402

register("b16_rule_variant", _variant, query([BARS, *IX, REGIME, STRENGTH], "SELECT rs.symbol, strftime(rs.date,'%Y-%m-%d') AS date, CASE WHEN coalesce(rs_vs_index>=5,false) AND regime IN ('BEAR_TREND','SIDEWAYS','RECOVERY','HIGH_VOLATILITY') THEN 'BULL_WEAK' ELSE regime END AS regime FROM rs JOIN rgm USING (date)"))
register(
    "b17_open_positions",
    lambda spark, sf: tidy(read(spark, sf, "lineitem").where((c("l_quantity") != 1) & (c("l_linestatus") != "F")).select("l_orderkey", "l_linenumber", F.coalesce(F.when(c("l_tax") > 0.04, c("l_extendedprice")), c("l_quantity")).alias("avg_price"))),
    f"SELECT l_orderkey, cast(l_linenumber AS bigint) AS l_linenumber, {d('CASE WHEN l_tax>0.04 THEN l_extendedprice ELSE l_quantity END')} AS avg_price FROM lineitem WHERE l_quantity<>1 AND l_linestatus<>'F'",
)


def _alert_rows(spark, sf):
    x = monitor.crossings(monitor.daily_readings(scan_log(spark, sf)), 60.0).where("`group` = 'crossed'")
    w = Window.partitionBy("group").orderBy(c("delta").desc(), c("score").desc(), "symbol")
    x = x.withColumn("position", F.row_number().over(w)).where("position <= 15")
    line = F.format_string("%s %d -> %d", "symbol", c("prev_score").cast("long"), c("score").cast("long"))
    return tidy(x.select("position", line.alias("line")))


register("b18_alert_rows", _alert_rows, query([LOG, READ, "z0 AS (SELECT *, lag(score) OVER w AS ps, lead(day) OVER w AS nd FROM rd WINDOW w AS (PARTITION BY symbol ORDER BY day)), z1 AS (SELECT *, row_number() OVER (ORDER BY score-ps DESC, score DESC, symbol) AS position FROM z0 WHERE nd IS NULL AND ps<60 AND score>=60)"], "SELECT position, symbol||' '||ps||' -> '||score AS line FROM z1 WHERE position<=15"))

# --- J: joins --------------------------------------------------------------------


def _scalar_context(spark, sf):
    ctx = tables.index_context(spark, sf).agg(F.max_by("regime", "date").alias("regime"), F.max_by("vix", "date").alias("vix"))
    return tidy(tables.fundamentals(spark, sf).select("symbol", ctx.select("regime").scalar().alias("regime"), ctx.select("vix").scalar().alias("vix")))


register("j01_scalar_context", _scalar_context, query([*IX, REGIME, FUNDAMENTALS], f"SELECT symbol, regime, {d('vix')} AS vix FROM fd, (SELECT arg_max(regime,date) AS regime, arg_max(vix,date) AS vix FROM rgm)"))


def _lookups(spark, sf):
    f = tables.fundamentals(spark, sf)
    base = last_rows(bars(spark, sf).select("symbol", "rn", "close")).select("symbol", "close")
    flag = lambda cond, name: f.where(cond).select("symbol", F.lit(True).alias(name))
    df = base.join(f.select("symbol", "delivery_pct"), "symbol", "left").join(flag(c("oi_spurt"), "spurt"), "symbol", "left").join(flag(c("banned"), "ban"), "symbol", "left")
    return tidy(df.select("symbol", "delivery_pct", c("spurt").isNotNull().alias("spurt"), c("ban").isNotNull().alias("ban")))


register("j02_symbol_lookups", _lookups, query([BARS, LAST, FUNDAMENTALS], f"SELECT symbol, {d('delivery_pct')} AS delivery_pct, cast(oi_spurt AS bigint) AS spurt, cast(banned AS bigint) AS ban FROM lc LEFT JOIN fd USING (symbol)"))
register("j03_fundamentals_join", lambda spark, sf: tidy(daily_bars(spark, sf).select("symbol", "date").join(tables.fundamentals(spark, sf).select("symbol", "roe", "sector"), "symbol", "left")), query([BARS, FUNDAMENTALS], f"SELECT symbol, strftime(date,'%Y-%m-%d') AS date, {d('roe')} AS roe, sector FROM b LEFT JOIN fd USING (symbol)"))


def enrich(primary, second):
    """Second source fills gaps, sets the return on capital and moves the score."""
    df = primary.join(second, "symbol", "left")
    s = F.coalesce("fund_score", F.lit(50.0))
    step = F.when(c("roce") > 20, F.least(F.lit(100.0), s + 8)).when(c("roce") > 15, F.least(F.lit(100.0), s + 5)).when(c("roce") > 10, F.least(F.lit(100.0), s + 2)).when(c("roce") < 5, F.greatest(F.lit(0.0), s - 5)).otherwise(c("fund_score"))
    df = df.withColumn("fund_score", step)
    s = F.coalesce("fund_score", F.lit(50.0))
    pl = F.coalesce("promoter_pledged", F.lit(0.0))
    return df.withColumns({"roe": F.coalesce("roe", "roe_second"), "fund_score": F.when(pl > 50, F.greatest(F.lit(0.0), s - 20)).when(pl > 20, F.greatest(F.lit(0.0), s - 10)).otherwise(c("fund_score"))})


def _enrich(spark, sf):
    from barloom.plans.scan import with_fund_score

    f = with_fund_score(tables.fundamentals(spark, sf))
    k = F.substring("symbol", 2, 10).cast("long")
    return tidy(enrich(f.select("symbol", "roe", "fund_score"), f.where(k % 2 == 0).select("symbol", "roce", "promoter_pledged", (c("roce") / 2).alias("roe_second"))).select("symbol", "roe", "fund_score"))


register(
    "j04_enrichment_merge",
    _enrich,
    query([FUNDAMENTALS, "en AS (SELECT symbol, roe, CASE WHEN roe IS NOT NULL THEN score_a::double END AS fs, CASE WHEN cast(substr(symbol,2) AS bigint)%2=0 THEN roce END AS rc, CASE WHEN cast(substr(symbol,2) AS bigint)%2=0 THEN promoter_pledged END AS pl FROM ffa), eo AS (SELECT *, CASE WHEN rc>20 THEN least(100,coalesce(fs,50)+8) WHEN rc>15 THEN least(100,coalesce(fs,50)+5) WHEN rc>10 THEN least(100,coalesce(fs,50)+2) WHEN rc<5 THEN greatest(0,coalesce(fs,50)-5) ELSE fs END AS f1 FROM en)"],
          f"SELECT symbol, {d('coalesce(roe, rc/2)')} AS roe, {d('CASE WHEN pl>50 THEN greatest(0,coalesce(f1,50)-20) WHEN pl>20 THEN greatest(0,coalesce(f1,50)-10) ELSE f1 END')} AS fund_score FROM eo"),
)


def _asof(spark, sf):
    """Regime known on each bar's date, from an index that reports weekly."""
    reg = tables.index_context(spark, sf).where(F.dayofweek("date") == 2)
    filled = market.calendar_fill(reg.select("date", "regime"), ["regime"])
    return tidy(daily_bars(spark, sf).select("symbol", "date").join(filled.select("date", "regime"), "date", "inner"))


register("j05_as_of_regime", _asof, query([BARS, *IX, REGIME, "wk1 AS (SELECT date, regime FROM rgm WHERE dayofweek(date)=1)"], "SELECT b.symbol, strftime(b.date,'%Y-%m-%d') AS date, w.regime FROM b ASOF JOIN wk1 w ON b.date>=w.date"))


def _asof_generic(spark, sf):
    ev = read(spark, sf, "events")
    left = ev.where("event_type = 'purchase'").select(c("user_id"), c("ts"), c("event_id"))
    right = ev.where("event_type = 'view'").select("user_id", "ts", c("event_id").alias("view_id"))
    return tidy(market.as_of_backward(left, right, "ts", ["user_id"], ["view_id"], "day").select("event_id", "view_id"))


register("j05_as_of_events", _asof_generic, "SELECT p.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type='purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type='view') v ON p.user_id=v.user_id AND p.ts>=v.ts")


def _window_return(spark, sf):
    """Index return from each symbol's own peak date to the end: two dated lookups."""
    peak = daily_bars(spark, sf).groupBy("symbol").agg(F.max_by("date", F.struct("close", -F.unix_date("date"))).alias("date"))
    ix = index_bars(spark, sf).select("date", "close")
    end = ix.agg(F.max_by("close", "date").alias("e"))
    return tidy(peak.join(ix, "date").select("symbol", "date", ((end.select("e").scalar() / c("close") - 1.0) * 100.0).alias("index_pct")))


register("j07_benchmark_window", _window_return, query([BARS, INDEX, "pk AS (SELECT symbol, min(date) AS date FROM (SELECT *, max(close) OVER (PARTITION BY symbol) AS m FROM b) WHERE close=m GROUP BY 1)"], f"SELECT pk.symbol, strftime(pk.date,'%Y-%m-%d') AS date, {d('((SELECT arg_max(close,date) FROM ix)/ix.close-1)*100')} AS index_pct FROM pk JOIN ix USING (date)"))


def _next_bar(spark, sf):
    """First bar strictly after each logged day: the bars of a symbol-month carry the event forward."""
    b = bars(spark, sf).select("symbol", "date", "open", lead("close", 5).alias("c5"))
    ev = read(spark, sf, "orders").select(c("o_orderkey").alias("id"), F.concat(F.lit("S"), F.pmod("o_orderkey", F.lit(100)).cast("string")).alias("symbol"), F.date_sub(F.lit("2002-01-01").cast("date"), F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01"))).alias("date"))
    # Mirror the time axis so the forward match is a backward one.
    flip = lambda x: F.date_add(F.lit("1990-01-01").cast("date"), F.datediff(F.lit("2030-01-01"), x))
    left = ev.withColumn("_k", F.date_sub(flip(c("date")), 1))
    right = b.select("symbol", flip(c("date")).alias("_k"), c("date").alias("bar_date"), "open")
    return tidy(market.as_of_backward(left, right, "_k", ["symbol"], ["bar_date", "open"], "month").where("bar_date IS NOT NULL").select("id", "bar_date", "open"))


register("j08_first_bar_after", _next_bar, query([BARS, "ev AS (SELECT o_orderkey AS id, 'S'||cast(o_orderkey%100 AS varchar) AS symbol, DATE '2002-01-01'-cast(date_diff('day', DATE '1995-01-01', cast(o_orderdate AS date)) AS int) AS date FROM orders)"], f"SELECT id, strftime(b.date,'%Y-%m-%d') AS bar_date, {d('open')} AS open FROM ev ASOF JOIN b ON ev.symbol=b.symbol AND ev.date<b.date"))
register(
    "j09_live_price",
    lambda spark, sf: tidy(last_rows(bars(spark, sf).select("symbol", "rn", "close")).join(tables.fundamentals(spark, sf).select("symbol", c("delivery_pct").alias("ltp")), "symbol", "left").select("symbol", F.coalesce(F.when(c("ltp") > 0, c("ltp")), c("close")).alias("live_price"))),
    query([BARS, LAST, FUNDAMENTALS], f"SELECT symbol, {d('CASE WHEN delivery_pct>0 THEN delivery_pct ELSE close END')} AS live_price FROM lc LEFT JOIN fd USING (symbol)"),
)


def _holdings(spark, sf):
    o = read(spark, sf, "orders").select(c("o_custkey").alias("account"), F.concat(F.lit("S"), F.pmod("o_orderkey", F.lit(100)).cast("string")).alias("symbol"), F.floor(c("o_totalprice") / 10000).alias("qty"))
    px = last_rows(bars(spark, sf).select("symbol", "rn", "close")).select("symbol", "close")
    return o.join(px, "symbol")


HOLD = "ho AS (SELECT o_custkey AS account, 'S'||cast(o_orderkey%100 AS varchar) AS symbol, cast(floor(o_totalprice/10000) AS bigint) AS qty FROM orders), hp AS (SELECT * FROM ho JOIN lc USING (symbol))"
register("j10_holdings_join", lambda spark, sf: tidy(_holdings(spark, sf).groupBy("account").agg(F.sum("qty").alias("qty"), F.sum(c("qty") * (F.round(c("close") * 100).cast("long"))).alias("value_cents"))), query([BARS, LAST, HOLD], "SELECT account, cast(sum(qty) AS bigint) AS qty, cast(sum(qty*cast(round(close*100) AS bigint)) AS bigint) AS value_cents FROM hp GROUP BY 1"))
register(
    "j11_prior_observation",
    lambda spark, sf: tidy(monitor.daily_readings(scan_log(spark, sf)).withColumn("prev_score", F.lag("score").over(Window.partitionBy("symbol").orderBy("day"))).select("symbol", "day", "score", "prev_score")),
    query([LOG, READ], f"SELECT symbol, strftime(day,'%Y-%m-%d') AS day, {d('score')} AS score, {d('lag(score) OVER (PARTITION BY symbol ORDER BY day)')} AS prev_score FROM rd"),
)


def _vanished(spark, sf):
    b = daily_bars(spark, sf)
    at = lambda y: b.where(F.year("date") == y).select("symbol", F.month("date").alias("m")).distinct()
    return tidy(at(1996).join(at(2001), ["symbol", "m"], "left_anti"))


register("j12_set_difference", _vanished, query(BARS, "SELECT DISTINCT symbol, month(date) AS m FROM b WHERE year(date)=1996 AND (symbol, month(date)) NOT IN (SELECT symbol, month(date) FROM b WHERE year(date)=2001)"))


def _deals(spark, sf):
    """Two deal tables stacked; the list of deals of each symbol by month, so that a busy symbol is no single group."""
    o = read(spark, sf, "orders").where("o_totalprice > 200000")
    deal = o.select(F.concat(F.lit("S"), F.pmod("o_custkey", F.lit(100)).cast("string")).alias("symbol"), "o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.when(c("o_orderstatus") == "F", "bulk").otherwise("block").alias("kind"))
    both = deal.where("kind = 'bulk'").unionByName(deal.where("kind = 'block'"))
    return tidy(both.groupBy("symbol", "month").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.concat(F.lpad(c("o_orderkey").cast("string"), 12, "0"), F.lit(":"), "kind"))).alias("deals")))


register("j13_deal_grouping", _deals, "SELECT 'S'||cast(o_custkey%100 AS varchar) AS symbol, strftime(o_orderdate,'%Y-%m') AS month, count(*) AS n, string_agg(lpad(o_orderkey::varchar,12,'0')||':'||CASE WHEN o_orderstatus='F' THEN 'bulk' ELSE 'block' END, '|' ORDER BY lpad(o_orderkey::varchar,12,'0')||':'||CASE WHEN o_orderstatus='F' THEN 'bulk' ELSE 'block' END) AS deals FROM orders WHERE o_totalprice>200000 GROUP BY 1,2")

# --- C: aggregates -----------------------------------------------------------------


def _summary(spark, sf):
    log = scan_log(spark, sf).where(c("scanned_at") >= F.lit("2000-01-01").cast("timestamp_ntz"))
    top = log.where("score100 >= 60").groupBy("symbol").agg(F.count("*").alias("appearances"), F.avg("score100").alias("avg_score"), F.max("scanned_at").alias("last_seen"))
    return tidy(top.orderBy(c("appearances").desc(), c("avg_score").desc(), "symbol").limit(10).select("symbol", "appearances", "avg_score", when(c("last_seen")).alias("last_seen")))


register("c01_run_summary_top", _summary, query(LOG, f"SELECT symbol, count(*) AS appearances, {d('avg(score100)')} AS avg_score, {stamp('max(scanned_at)')} AS last_seen FROM slog WHERE scanned_at>='2000-01-01' AND score100>=60 GROUP BY 1 ORDER BY appearances DESC, avg(score100) DESC, symbol LIMIT 10"))
register("c01_run_summary_totals", lambda spark, sf: tidy(scan_log(spark, sf).groupBy("verdict").agg(F.count("*").alias("n"), F.countDistinct("scanned_at").alias("scans"), F.countDistinct("symbol").alias("symbols"))), query(LOG, "SELECT verdict, count(*) AS n, count(DISTINCT scanned_at) AS scans, count(DISTINCT symbol) AS symbols FROM slog GROUP BY 1"))
register("c02_scan_dates_having", lambda spark, sf: tidy(scan_log(spark, sf).where("scan_type = 'swing'").groupBy(F.to_date("scanned_at").alias("day"), "universe").agg(F.countDistinct("symbol").alias("n")).where("n >= 4")), query(LOG, "SELECT strftime(scanned_at,'%Y-%m-%d') AS day, universe, count(DISTINCT symbol) AS n FROM slog WHERE scan_type='swing' GROUP BY 1,2 HAVING count(DISTINCT symbol)>=4"))


def _flows(spark, sf):
    cents = F.round(c("o_totalprice") * 100).cast("long")
    kind = F.when(c("o_orderpriority").rlike("^(1|2)"), "FII").when(c("o_orderpriority").rlike("^(3|4)"), "DII")
    o = read(spark, sf, "orders").withColumns({"kind": kind, "v": cents}).where("kind IS NOT NULL")
    buy, sell = F.when(c("o_orderstatus") != "F", c("v")).otherwise(0), F.when(c("o_orderstatus") == "F", c("v")).otherwise(0)
    return tidy(o.groupBy("kind", F.year("o_orderdate").alias("year")).agg(F.sum(buy).alias("buy"), F.sum(sell).alias("sell"), F.sum(buy - sell).alias("net")))


register("c04_flow_totals", _flows, "SELECT kind, year, cast(sum(CASE WHEN st<>'F' THEN v ELSE 0 END) AS bigint) AS buy, cast(sum(CASE WHEN st='F' THEN v ELSE 0 END) AS bigint) AS sell, cast(sum(CASE WHEN st<>'F' THEN v ELSE -v END) AS bigint) AS net FROM (SELECT CASE WHEN o_orderpriority[1] IN ('1','2') THEN 'FII' WHEN o_orderpriority[1] IN ('3','4') THEN 'DII' END AS kind, year(o_orderdate) AS year, o_orderstatus AS st, cast(round(o_totalprice*100) AS bigint) AS v FROM orders) WHERE kind IS NOT NULL GROUP BY 1,2")


def _interest(spark, sf):
    o = read(spark, sf, "orders")
    long = F.count_if(c("o_orderstatus") == "O") - F.count_if(c("o_orderstatus") == "F")
    g = o.groupBy("o_orderpriority").agg(long.alias("net"))
    sig = F.when(c("net") > 20, "BULLISH").when(c("net") < -20, "BEARISH").otherwise("NEUTRAL")
    contra = F.when(c("net") > 40, "SELL").when(c("net") < -40, "BUY").otherwise("NEUTRAL")
    return tidy(g.select("o_orderpriority", "net", sig.alias("signal"), contra.alias("contrarian")))


register("c05_participant_interest", _interest, "SELECT o_orderpriority, net, CASE WHEN net>20 THEN 'BULLISH' WHEN net< -20 THEN 'BEARISH' ELSE 'NEUTRAL' END AS signal, CASE WHEN net>40 THEN 'SELL' WHEN net< -40 THEN 'BUY' ELSE 'NEUTRAL' END AS contrarian FROM (SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus='O')-count(*) FILTER (WHERE o_orderstatus='F') AS net FROM orders GROUP BY 1)")


def scored_forward(spark, sf):
    """Every bar of at least 120 with its 0-100 score and its forward returns."""
    df = scan.score_log(spark, sf).select("symbol", "date", "rn", *LEVELS, "open", "close", c("score100").cast("double").alias("score"))
    df = df.select("symbol", "date", "rn", "score", *[rnd(v, 6).alias(k) for k, v in out.forward_returns(HORIZONS).items()])
    return df.where((c("rn") >= 119) & c("score").isNotNull())


SCORED = [*SCAN, FORWARD + " FROM z)", f"sfw AS (SELECT symbol, date, cast(score100 AS double) AS score, {r('d5', 6)} AS d5, {r('d21', 6)} AS d21, {r('d63', 6)} AS d63 FROM fw WHERE rn>=119 AND score100 IS NOT NULL)"]
BUCKETS = ((70, 101, "70+"), (60, 70, "60-70"), (50, 60, "50-60"), (40, 50, "40-50"), (-1, 40, "<40"))
LONGF = "lf AS (SELECT symbol, score, 'd5' AS horizon, d5 AS v FROM sfw UNION ALL SELECT symbol, score, 'd21', d21 FROM sfw UNION ALL SELECT symbol, score, 'd63', d63 FROM sfw)"
register(
    "c13_forward_bucket_table",
    lambda spark, sf: tidy(evaluation.bucket_table(scored_forward(spark, sf).withColumn("bucket", scoring.score_bucket(c("score"), BUCKETS)), list(HORIZONS), "bucket")),
    query([*SCORED, LONGF, "lb AS (SELECT *, CASE WHEN score>=70 THEN '70+' WHEN score>=60 THEN '60-70' WHEN score>=50 THEN '50-60' WHEN score>=40 THEN '40-50' ELSE '<40' END AS bucket FROM lf WHERE v IS NOT NULL), bs AS (SELECT horizon, count(*) AS bn, avg(v) AS bm, var_samp(v) AS bv FROM lb GROUP BY 1)"],
          f"SELECT bucket, horizon, count(*) AS n, {d('avg(v)')} AS mean_ret, {d('avg(v)-any_value(bm)')} AS edge, {d('(avg(v)-any_value(bm))/sqrt(var_samp(v)/count(*)+any_value(bv)/any_value(bn))')} AS t_stat FROM lb JOIN bs USING (horizon) GROUP BY 1,2 HAVING count(*)>=5", True),
)
register(
    "c14_score_validation",
    lambda spark, sf: tidy(evaluation.validation_table(scored_forward(spark, sf), "score", list(HORIZONS))),
    query([*SCORED, LONGF, "rk AS (SELECT horizon, rank() OVER (PARTITION BY horizon ORDER BY score)+(count(*) OVER (PARTITION BY horizon, score)-1)/2.0::double AS rx, rank() OVER (PARTITION BY horizon ORDER BY v)+(count(*) OVER (PARTITION BY horizon, v)-1)/2.0::double AS ry FROM lf WHERE v IS NOT NULL)", "ro AS (SELECT horizon, count(*) AS n, corr(rx,ry) AS rho FROM rk GROUP BY 1)"],
          f"SELECT horizon, n, {d('rho')} AS rho, {d('rho*sqrt((n-2)/((1-rho)*(1+rho)))')} AS t_stat FROM ro", True),
)
register(
    "k06_decile_picks",
    lambda spark, sf: tidy(evaluation.decile_edges(scored_forward(spark, sf), "score", "d21")),
    query([*SCORED, "dk AS (SELECT *, count(*) OVER () AS n FROM sfw WHERE d21 IS NOT NULL), dr AS (SELECT *, greatest(floor(n*0.10::double),5) AS k, row_number() OVER (ORDER BY score DESC, symbol, date) AS rt, row_number() OVER (ORDER BY score, symbol, date) AS rl FROM dk)"],
          f"SELECT count(*) AS n, {d('avg(d21)')} AS base, {d('avg(d21) FILTER (WHERE rt<=k)')} AS top_mean, {d('avg(d21) FILTER (WHERE rt<=k)-avg(d21)')} AS top_edge, {d('avg(d21) FILTER (WHERE rl<=k)')} AS bottom_mean, {d('avg(d21) FILTER (WHERE rl<=k)-avg(d21)')} AS bottom_edge FROM dr", True),
)


def observations(spark, sf):
    """Every fifth bar after 260: next open to close 21 bars on, the score and the control masks; rows without a score leave all arms."""
    df = scan.score_log(spark, sf).select("symbol", "date", "rn", *LEVELS, "open", "high", "low", "close", "volume", c("score100").cast("double").alias("score"))
    df = rules.with_rules(df, rules.CONTROLS, "m_")
    df = df.withColumns({"fwd": (lead("close", 21) / lead("open", 1) - 1.0) * 100.0 - out.ROUND_TRIP_PCT, "prev_score": F.when(c("rn") >= 265, wlag("score", 5))})
    picked = (c("rn") >= 260) & ((c("rn") - 260) % 5 == 0) & c("fwd").isNotNull() & c("score").isNotNull()
    return df.where(picked).select("symbol", "date", "fwd", "score", "prev_score", "m_breakout_20d", "m_rsi_above_60")


OBS = [*SCAN, f"o0 AS (SELECT symbol, date, rn, (lead(close,21) OVER ({W})/lead(open,1) OVER ({W})-1)*100-0.5582::double AS fwd, cast(score100 AS double) AS score, rsi>60 AS m2, coalesce(close>{lag('hh20')},false) AS m1 FROM z)", f"o1 AS (SELECT *, CASE WHEN rn>=265 THEN {lag('score', 5)} END AS ps FROM o0)", "ob AS (SELECT * FROM o1 WHERE rn>=260 AND (rn-260)%5=0 AND fwd IS NOT NULL AND score IS NOT NULL)"]
register("x07_head_to_head", lambda spark, sf: tidy(observations(spark, sf).withColumn("fwd", rnd("fwd", 4))), query(OBS, f"SELECT symbol, strftime(date,'%Y-%m-%d') AS date, {r('fwd', 4)}+0.0::double AS fwd, {d('score')} AS score, {d('ps')} AS prev_score, cast(m1 AS bigint) AS m_breakout_20d, cast(m2 AS bigint) AS m_rsi_above_60 FROM ob", True))


def _arms():
    s, p = c("score"), c("prev_score")
    return {"baseline": F.lit(True), "score_60": s >= 60, "score_70": s >= 70, "crosses_60": (p < 60) & (s >= 60), "breakout": c("m_breakout_20d") == 1, "rsi_60": c("m_rsi_above_60") == 1, "breakout_and_score": (c("m_breakout_20d") == 1) & (s >= 60)}


register(
    "c15_arm_comparison",
    lambda spark, sf: tidy(evaluation.arm_comparison(observations(spark, sf), _arms())),
    query([*OBS, "ar AS (" + " UNION ALL ".join(f"SELECT '{n}' AS arm, count(fwd) FILTER (WHERE {e}) AS n, avg(fwd) FILTER (WHERE {e}) AS m, avg(CASE WHEN fwd>0 THEN 100.0::double ELSE 0 END) FILTER (WHERE {e}) AS w, avg(fwd) AS b FROM ob" for n, e in {"baseline": "true", "score_60": "score>=60", "score_70": "score>=70", "crosses_60": "ps<60 AND score>=60", "breakout": "m1", "rsi_60": "m2", "breakout_and_score": "m1 AND score>=60"}.items()) + ")"], f"SELECT arm, n, {d('m')} AS mean_ret, {d('m-b')} AS edge, {d('w')} AS win_rate FROM ar WHERE n>=20", True),
)
HEX = "list_reduce(list_prepend(0::bigint, list_transform(string_split(substr({h},1,8),''), lambda x: cast(instr('0123456789abcdef', x)-1 AS bigint))), lambda a, b: a*16+b)"
register(
    "c16_block_bootstrap",
    lambda spark, sf: tidy(evaluation.block_bootstrap(observations(spark, sf), c("score") >= 60)),
    query(
        [*OBS, "dd AS (SELECT date, sum(fwd) AS t, count(fwd) AS n, coalesce(sum(fwd) FILTER (WHERE score>=60),0) AS s, count(fwd) FILTER (WHERE score>=60) AS k, row_number() OVER (ORDER BY date)-1 AS ix FROM ob GROUP BY date)",
         "nn AS (SELECT count(*) AS d, sum(k) AS picks, cast(ceil(count(*)/21.0::double) AS bigint) AS m FROM dd)",
         "pk AS (SELECT draw, i, sha256(draw||'|'||i||'|42') AS h, d, CASE WHEN i=m THEN d-(m-1)*21 ELSE 21 END AS len FROM (SELECT unnest(range(1000)) AS draw), (SELECT d, m, unnest(range(1, m+1)) AS i FROM nn))",
         f"pj AS (SELECT draw, len, {HEX.format(h='h')} % (d-20) AS start FROM pk)",
         "ed AS (SELECT draw, sum(s)/sum(k)-sum(t)/sum(n) AS edge FROM pj JOIN dd ON ix>=start AND ix<start+len GROUP BY draw HAVING sum(k)>0 AND sum(n)>0)"],
        f"SELECT {d('quantile_cont(edge,0.025)')} AS lo, {d('quantile_cont(edge,0.975)')} AS hi, {d('avg(edge)')} AS mean_edge FROM ed WHERE (SELECT d>=42 AND picks>=20 FROM nn)",
        True,
    ),
)


def _regime_forward(spark, sf):
    df = market.regime_series(index_series(spark, sf))
    return df.select("date", "regime", *[((lead("close", h) / c("close") - 1.0) * 100.0).alias(f"fwd{h}") for h in (5, 21, 63)])


RFW = "rf AS (SELECT date, regime, " + ", ".join(f"(lead(close,{h}) OVER (ORDER BY rn)/close-1)*100 AS fwd{h}" for h in (5, 21, 63)) + " FROM rgm), rl AS (SELECT regime, 'fwd5' AS horizon, fwd5 AS v FROM rf UNION ALL SELECT regime, 'fwd21', fwd21 FROM rf UNION ALL SELECT regime, 'fwd63', fwd63 FROM rf)"
register("c18_forward_index_returns", lambda spark, sf: tidy(_regime_forward(spark, sf).select("date", "regime", *[rnd(f"fwd{h}", 4).alias(f"fwd{h}") for h in (5, 21, 63)])), query([*IX, REGIME, RFW], "SELECT strftime(date,'%Y-%m-%d') AS date, regime, " + ", ".join(f"{r(f'fwd{h}', 4)}+0.0::double AS fwd{h}" for h in (5, 21, 63)) + " FROM rf"))
register("c17_regime_confusion", lambda spark, sf: tidy(evaluation.regime_confusion(_regime_forward(spark, sf), ["fwd5", "fwd21", "fwd63"])), query([*IX, REGIME, RFW, "rb AS (SELECT horizon, avg(CASE WHEN v<0 THEN 100.0::double ELSE 0 END) AS b FROM rl WHERE v IS NOT NULL GROUP BY 1)"], f"SELECT horizon, regime, count(*) AS n, {d('avg(v)')} AS avg_fwd, {d('avg(CASE WHEN v<0 THEN 100.0::double ELSE 0 END)')} AS p_fall, {d('avg(CASE WHEN v<0 THEN 100.0::double ELSE 0 END)-any_value(b)')} AS lift FROM rl JOIN rb USING (horizon) WHERE v IS NOT NULL GROUP BY 1,2 HAVING count(*)>=30"))
register("c17_regime_accuracy", lambda spark, sf: tidy(evaluation.regime_accuracy(_regime_forward(spark, sf), ["fwd5", "fwd21", "fwd63"])), query([*IX, REGIME, RFW, "ra AS (SELECT horizon, count(*) FILTER (WHERE wk AND v<0) AS tp, count(*) FILTER (WHERE wk AND v>=0) AS fp, count(*) FILTER (WHERE NOT wk AND v>=0) AS tn, count(*) FILTER (WHERE NOT wk AND v<0) AS fn FROM (SELECT *, regime IN ('BEAR_TREND','RECOVERY','SIDEWAYS') AS wk FROM rl WHERE v IS NOT NULL) GROUP BY 1)"], f"SELECT horizon, tp, fp, tn, fn, {d('tp/(tp+fp)*100-fn/(tn+fn)*100')} AS separation, {d('(tp+tn)/(tp+fp+tn+fn)*100')} AS accuracy, {d('tp/(tp+fp)')} AS precision, {d('tp/(tp+fn)')} AS recall FROM ra WHERE tp+fp>30 AND tn+fn>30"))


def _survivors(spark, sf):
    b = daily_bars(spark, sf)
    span = b.groupBy("symbol").agg(F.min("date").alias("lo"), F.max("date").alias("hi"), F.count("*").alias("n"))
    study = tables.fundamentals(spark, sf).where(~c("banned")).select("symbol", F.lit(True).alias("study"))
    s = span.join(study, "symbol", "full").withColumns({"past": F.coalesce(c("lo") <= F.lit("1995-06-30").cast("date"), F.lit(False)), "recent": F.coalesce(c("hi") >= F.lit("2001-10-25").cast("date"), F.lit(False)), "study": c("study").isNotNull()})
    return tidy(s.agg(F.count_if("past").alias("past"), F.count_if("recent").alias("recent"), F.count_if("study").alias("study"), F.count_if(c("past") & ~c("recent")).alias("vanished"), F.count_if(c("past") & c("study")).alias("covered"), F.count_if(c("past") & ~c("study")).alias("never_seen"), F.count_if(c("n") >= 60).alias("with_history")))


register("c19_survivorship", _survivors, query([BARS, FUNDAMENTALS, "sp AS (SELECT symbol, min(date)<='1995-06-30' AS past, max(date)>='2001-10-25' AS recent, count(*) AS n FROM b GROUP BY 1), ss AS (SELECT coalesce(past,false) AS past, coalesce(recent,false) AS recent, coalesce(n,0) AS n, coalesce(NOT banned,false) AS study FROM sp FULL JOIN fd USING (symbol))"], "SELECT count(*) FILTER (WHERE past) AS past, count(*) FILTER (WHERE recent) AS recent, count(*) FILTER (WHERE study) AS study, count(*) FILTER (WHERE past AND NOT recent) AS vanished, count(*) FILTER (WHERE past AND study) AS covered, count(*) FILTER (WHERE past AND NOT study) AS never_seen, count(*) FILTER (WHERE n>=60) AS with_history FROM ss"))


def cohort(spark, sf):
    """Names picked on a date by score, bought at the next open, held to the end."""
    b = scan.score_log(spark, sf).select("symbol", "date", "rn", "open", "close", c("score100").cast("double").alias("score"))
    cut = F.lit("2001-01-31").cast("date")
    picks = last_rows(b.where(c("date") <= cut).select("symbol", "rn", "score")).where("score >= 50").select("symbol", "score")
    after = b.where(c("date") > cut).groupBy("symbol").agg(F.min_by("open", "rn").alias("entry"), F.max_by("close", "rn").alias("last"), F.count("*").alias("days")).where("days >= 5")
    return evaluation.hold_cohort(picks.join(after, "symbol"), 5000.0, out.ROUND_TRIP_PCT)


COHORT = [*SCAN, f"pk0 AS (SELECT symbol, max_by(cast(score100 AS double), rn) AS score FROM z WHERE date<='2001-01-31' AND rn=(SELECT max(y.rn) FROM z y WHERE y.symbol=z.symbol AND y.date<='2001-01-31') GROUP BY 1), af AS (SELECT symbol, arg_min(open, rn) AS entry, arg_max(close, rn) AS last, count(*) AS days FROM b WHERE date>'2001-01-31' GROUP BY 1 HAVING count(*)>=5), pr AS (SELECT *, count(*) OVER () AS n FROM pk0 JOIN af USING (symbol) WHERE score>=50), pc AS (SELECT *, count(*) OVER () AS m FROM pr WHERE entry<=5000.0::double/n), pq AS (SELECT *, floor(5000.0::double/m/entry) AS qty FROM pc)",
          "co AS (SELECT *, qty*entry AS invested, qty*last AS value, qty*last-qty*entry-qty*entry*0.5582::double/100 AS pnl, (qty*last-qty*entry-qty*entry*0.5582::double/100)/(qty*entry)*100 AS pnl_pct FROM pq WHERE qty>0)"]
register("c20_hold_cohort", lambda spark, sf: tidy(cohort(spark, sf).agg(F.count("*").alias("positions"), F.sum("invested").alias("invested"), F.sum("value").alias("value"), F.sum("pnl").alias("pnl"), F.count_if(c("pnl") > 0).alias("winners"), F.count_if(c("pnl") <= 0).alias("losers")), 3), query(COHORT, f"SELECT count(*) AS positions, {d('sum(invested)', 3)} AS invested, {d('sum(value)', 3)} AS value, {d('sum(pnl)', 3)} AS pnl, count(*) FILTER (WHERE pnl>0) AS winners, count(*) FILTER (WHERE pnl<=0) AS losers FROM co", True))


def _best_worst(spark, sf):
    x = cohort(spark, sf).select("symbol", rnd("pnl_pct", 4).alias("pnl_pct"))
    best = x.orderBy(c("pnl_pct").desc(), "symbol").limit(5).withColumn("side", F.lit("best"))
    return tidy(best.unionByName(x.orderBy("pnl_pct", "symbol").limit(5).withColumn("side", F.lit("worst"))))


register("k05_best_worst_five", _best_worst, query([*COHORT, f"cx AS (SELECT symbol, {r('pnl_pct', 4)}+0.0::double AS pnl_pct FROM co)"], "SELECT *, 'best' AS side FROM (SELECT * FROM cx ORDER BY pnl_pct DESC, symbol LIMIT 5) UNION ALL SELECT *, 'worst' FROM (SELECT * FROM cx ORDER BY pnl_pct, symbol LIMIT 5)", True))


def _scenarios(spark, sf):
    df = bars(spark, sf).withColumn("volume", F.when(F.dayofmonth("date") == 13, 0.0).otherwise(c("volume")))
    o = out.with_fixed_horizon(df).select(F.year("date").alias("year"), c("fixed_ret").alias("ret"))
    return tidy(evaluation.unresolved_scenarios(o, "year"))


register(
    "c22_unresolved_scenarios",
    _scenarios,
    query([BARS, "h1 AS (SELECT *, CASE WHEN day(date)=13 THEN false ELSE true END AS good FROM b)", f"h2 AS (SELECT year(date) AS year, CASE WHEN coalesce(lead(good,1) OVER ({W}),false) AND coalesce(lead(good,21) OVER ({W}),false) THEN 100*(lead(close,21) OVER ({W})/lead(open,1) OVER ({W})-1)-0.5582::double END AS ret FROM h1)", "hg AS (SELECT year, count(*) AS n, count(*)-count(ret) AS missing, coalesce(sum(ret),0) AS s FROM h2 GROUP BY 1)"],
          f"SELECT year, n, missing, x::double AS scenario, {d('(s+x*missing)/n')} AS mean_ret FROM hg, (SELECT unnest([-100.0::double,-20,0,20,100]) AS x)"),
)
register("c24_daily_loss_limit", lambda spark, sf: tidy(sells(spark, sf).groupBy(F.to_date("ts").alias("day")).agg(F.sum(F.round(c("pnl_pct") * 100).cast("long")).alias("pnl")).withColumn("breached", c("pnl") < -900)), query(SELLS, "SELECT strftime(ts,'%Y-%m-%d') AS day, cast(sum(cast(round(pnl_pct*100) AS bigint)) AS bigint) AS pnl, cast(sum(cast(round(pnl_pct*100) AS bigint))< -900 AS bigint) AS breached FROM se GROUP BY 1"))


def _audit_totals(spark, sf):
    from barloom.catalog.archive import dirty
    from barloom.functions.outcomes import valid_bar_tolerant

    b = dirty(spark, sf).groupBy("symbol").agg(F.count("close").alias("r"), F.count_if(~valid_bar_tolerant() & c("close").isNotNull()).alias("i"))
    return tidy(b.agg(F.count("*").alias("symbols"), F.sum("r").alias("rows"), F.sum("i").alias("invalid_rows")))


from barloom.catalog.archive import DIRTY  # noqa: E402

register("c26_audit_totals", _audit_totals, query([BARS, DIRTY], "SELECT count(DISTINCT symbol) AS symbols, count(close) AS rows, count(*) FILTER (WHERE close IS NOT NULL AND (k=6 OR (k IN (1,2,3,4,5,7) AND d7))) AS invalid_rows FROM dq"))
register("c27_run_totals", lambda spark, sf: tidy(scan_log(spark, sf).groupBy("universe").agg(F.count("*").alias("scanned"), F.count_if(c("score100") >= 60).alias("scored_60"), F.count_if((c("score100") >= 60) & (c("scan_type") == "swing")).alias("tradeable_60"))), query(LOG, "SELECT universe, count(*) AS scanned, count(*) FILTER (WHERE score100>=60) AS scored_60, count(*) FILTER (WHERE score100>=60 AND scan_type='swing') AS tradeable_60 FROM slog GROUP BY 1"))


def _open_report(spark, sf):
    h = _holdings(spark, sf).withColumn("avg_price", F.lit(95.0))
    return tidy(h.groupBy("account").agg(F.sum(F.round((c("close") - c("avg_price")) * c("qty") * 100).cast("long")).alias("pnl_cents"), F.sum(c("qty") * 95).alias("cost")).select("account", "pnl_cents", F.try_divide(c("pnl_cents"), c("cost")).alias("pnl_pct")))


register("c28_open_position_report", _open_report, query([BARS, LAST, HOLD], f"SELECT account, cast(sum(cast(round((close-95)*qty*100) AS bigint)) AS bigint) AS pnl_cents, {d('sum(cast(round((close-95)*qty*100) AS bigint))/nullif(sum(qty*95),0)')} AS pnl_pct FROM hp GROUP BY 1"))

# --- K, F, V ----------------------------------------------------------------------
register("k01_result_ordering", lambda spark, sf: tidy(scan_log(spark, sf).where("score100 IS NOT NULL").orderBy((c("universe") == "narrow").desc(), c("score100").desc(), "symbol", "id").select("id", "symbol", "score100")), query(LOG, "SELECT id, symbol, score100 FROM slog WHERE score100 IS NOT NULL ORDER BY universe='narrow' DESC, score100 DESC, symbol, id"))
register("k02_intraday_ordering", lambda spark, sf: tidy(scan_log(spark, sf).where("scan_type = 'intraday'").orderBy(F.coalesce("score100", F.lit(0)).desc(), "id").select("id", F.coalesce("score100", F.lit(0)).alias("rank_score"))), query(LOG, "SELECT id, coalesce(score100,0) AS rank_score FROM slog WHERE scan_type='intraday' ORDER BY 2 DESC, 1"))
register("k03_analysed_first", lambda spark, sf: tidy(scan_log(spark, sf).orderBy(c("score100").isNull(), F.coalesce("score100", F.lit(0)).desc(), "id").select("id", c("score100").isNotNull().alias("analysed"))), query(LOG, "SELECT id, cast(score100 IS NOT NULL AS bigint) AS analysed FROM slog"))
register("k04_history_limit", lambda spark, sf: tidy(scan_log(spark, sf).orderBy(c("scanned_at").desc(), c("score100").desc(), "id").limit(100).select("id", "score100")), query(LOG, "SELECT id, score100 FROM slog ORDER BY scanned_at DESC, score100 DESC NULLS LAST, id LIMIT 100"))
register("k07_seeded_sample", lambda spark, sf: tidy(daily_bars(spark, sf).select("symbol").distinct().orderBy(F.sha2(F.concat("symbol", F.lit("|42")), 256), "symbol").limit(40)), query(BARS, "SELECT symbol FROM (SELECT DISTINCT symbol FROM b) ORDER BY sha256(symbol||'|42'), symbol LIMIT 40"))
register("k08_union_dedup", lambda spark, sf: tidy(read(spark, sf, "customer").select(F.lit("c").alias("k"), c("c_nationkey").alias("n"), c("c_custkey").alias("pos")).unionByName(read(spark, sf, "supplier").select(F.lit("s").alias("k"), c("s_nationkey").alias("n"), c("s_suppkey").alias("pos"))).groupBy("n").agg(F.min("pos").alias("pos"))), "SELECT n, min(pos) AS pos FROM (SELECT c_nationkey AS n, c_custkey AS pos FROM customer UNION ALL SELECT s_nationkey, s_suppkey FROM supplier) GROUP BY 1")
register("k09_difference", lambda spark, sf: tidy(read(spark, sf, "part").select("p_partkey").subtract(read(spark, sf, "lineitem").where("l_quantity > 49").select(c("l_partkey").alias("p_partkey")))), "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity>49")
register("k10_intersection", lambda spark, sf: tidy(read(spark, sf, "customer").select(c("c_nationkey").alias("n"), c("c_mktsegment").alias("s")).intersect(read(spark, sf, "customer").where("c_acctbal > 9000").select(c("c_nationkey").alias("n"), c("c_mktsegment").alias("s")))), "SELECT c_nationkey AS n, c_mktsegment AS s FROM customer INTERSECT SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal>9000")
register("f01_string_functions", lambda spark, sf: tidy(part(spark, sf).select("p_partkey", F.upper(F.trim("p_name")).alias("u"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("rep"), F.substring("p_brand", 1, 5).alias("sub"), c("p_name").startswith("r").alias("pre"), c("p_name").contains("e").alias("has"))), "SELECT p_partkey, upper(trim(p_name)) AS u, replace(p_name,' ','_') AS rep, substr(p_brand,1,5) AS sub, cast(starts_with(p_name,'r') AS bigint) AS pre, cast(contains(p_name,'e') AS bigint) AS has FROM part")
register("f02_regex_functions", lambda spark, sf: tidy(part(spark, sf).select("p_partkey", F.regexp_extract("p_brand", r"#(\d+)", 1).alias("num"), c("p_name").rlike("^(red|blue)").alias("hit"))), "SELECT p_partkey, regexp_extract(p_brand,'#(\\d+)',1) AS num, cast(regexp_matches(p_name,'^(red|blue)') AS bigint) AS hit FROM part")
register("f03_date_functions", lambda spark, sf: tidy(read(spark, sf, "orders").select("o_orderkey", F.date_add(F.to_date("o_orderdate"), 3).alias("plus"), F.dayofweek("o_orderdate").alias("dow"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"), F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01")).alias("days"), F.to_date(F.date_format("o_orderdate", "dd-MMM-yyyy"), "dd-MMM-yyyy").alias("parsed"))), "SELECT o_orderkey, strftime(cast(o_orderdate AS date)+3,'%Y-%m-%d') AS plus, dayofweek(o_orderdate)+1 AS dow, strftime(date_trunc('month',o_orderdate),'%Y-%m-%d') AS month, date_diff('day', DATE '1995-01-01', cast(o_orderdate AS date)) AS days, strftime(o_orderdate,'%Y-%m-%d') AS parsed FROM orders")
register("f04_time_zones", lambda spark, sf: tidy(read(spark, sf, "events").select("event_id", F.date_format(F.from_utc_timestamp(c("ts").cast("timestamp"), "Asia/Kolkata"), "yyyy-MM-dd HH:mm").alias("local"), F.date_format(F.to_utc_timestamp(c("ts").cast("timestamp"), "Asia/Kolkata"), "yyyy-MM-dd HH:mm").alias("utc"))), "SELECT event_id, strftime(ts+INTERVAL 330 MINUTE,'%Y-%m-%d %H:%M') AS local, strftime(ts-INTERVAL 330 MINUTE,'%Y-%m-%d %H:%M') AS utc FROM events")
register("f05_math_functions", lambda spark, sf: tidy(read(spark, sf, "events").select("event_id", F.abs(c("value") - 50).alias("a"), F.signum(c("value") - 50).alias("s"), F.greatest(F.lit(1.0), F.least(F.lit(80.0), c("value"))).alias("clip"), F.floor("value").alias("fl"), F.sqrt("value").alias("sq"), F.pow("value", F.lit(1.5)).alias("pw"), F.ln(c("value") + 1).alias("lg"))), f"SELECT event_id, {d('abs(value-50)')} AS a, {d('sign(value-50)')} AS s, {d('greatest(1,least(80,value))')} AS clip, cast(floor(value) AS bigint) AS fl, {d('sqrt(value)')} AS sq, {d('pow(value,1.5::double)')} AS pw, {d('ln(value+1)')} AS lg FROM events")
register("f06_returns", lambda spark, sf: tidy(bars(spark, sf).select("symbol", "date", rnd(c("close") / wlag("close", 5) - 1.0, 6).alias("r5"), rnd(c("close") / wlag("close", 20) - 1.0, 6).alias("r20")), 6), query(BARS, f"SELECT symbol, strftime(date,'%Y-%m-%d') AS date, {r('close/' + lag('close', 5) + '-1', 6)}+0.0::double AS r5, {r('close/' + lag('close', 20) + '-1', 6)}+0.0::double AS r20 FROM b"))


def _arrays(spark, sf):
    x = F.array(*[(F.col("p_size") * k % 17).cast("long") for k in (3, 5, 7, 11)])
    p = part(spark, sf).select("p_partkey", x.alias("x"))
    return tidy(p.select("p_partkey", F.concat_ws(",", F.array_append(F.slice("x", 2, 2), F.lit(99).cast("long"))).alias("cut"), F.exists("x", lambda v: v > 14).alias("any_big"), F.forall("x", lambda v: v < 17).alias("all_small"), F.array_max("x").alias("top"), F.array_position("x", F.array_max("x")).alias("at")))


register("f07_array_functions", _arrays, "SELECT p_partkey, concat_ws(',', x[2], x[3], 99) AS cut, cast(list_max(x)>14 AS bigint) AS any_big, cast(list_max(x)<17 AS bigint) AS all_small, list_max(x) AS top, cast(list_position(x, list_max(x)) AS bigint) AS at FROM (SELECT p_partkey, [cast(p_size*3%17 AS bigint), cast(p_size*5%17 AS bigint), cast(p_size*7%17 AS bigint), cast(p_size*11%17 AS bigint)] AS x FROM part)".replace(" AS at FROM", " AS \"at\" FROM"))
register("f08_map_functions", lambda spark, sf: tidy(read(spark, sf, "orders").select("o_orderkey", F.coalesce(F.try_element_at(F.create_map(F.lit("F"), F.lit(1), F.lit("O"), F.lit(2)), c("o_orderstatus")), F.lit(0)).alias("w"))), "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END::bigint AS w FROM orders")
register("f09_json_lists", lambda spark, sf: tidy(read(spark, sf, "events").select("event_id", F.coalesce(F.from_json(F.when(c("event_id") % 5 == 0, "oops").otherwise(F.to_json(F.array("event_type", c("user_id").cast("string")))), "array<string>"), F.array()).alias("back"))), "SELECT event_id, CASE WHEN event_id%5=0 THEN '' ELSE event_type||'|'||user_id END AS back FROM events")
register("f10_hash", lambda spark, sf: tidy(part(spark, sf).select("p_partkey", F.sha2("p_name", 256).alias("h"))), "SELECT p_partkey, sha256(p_name) AS h FROM part")


def _stats(spark, sf):
    e = read(spark, sf, "events").select("event_type", "value")
    q = ranking.exact_quantiles(e, ["event_type"], "value", {"q025": 0.025, "median": 0.5, "q975": 0.975})
    m = e.groupBy("event_type").agg(F.stddev_samp("value").alias("sd"), F.stddev_pop("value").alias("sdp"), F.var_samp("value").alias("var"))
    return tidy(q.join(m, "event_type"))


register("f11_statistics", _stats, f"SELECT event_type, {d('quantile_cont(value,0.025)')} AS q025, {d('quantile_cont(value,0.5)')} AS median, {d('quantile_cont(value,0.975)')} AS q975, {d('stddev_samp(value)')} AS sd, {d('stddev_pop(value)')} AS sdp, {d('var_samp(value)')} AS var FROM events GROUP BY 1")
register("f12_null_logic", lambda spark, sf: tidy(read(spark, sf, "events").select("event_id", F.coalesce(F.nanvl(F.when(c("event_id") % 3 == 0, float("nan")).otherwise(c("value")), F.lit(None).cast("double")), F.lit(-1.0)).alias("v"), F.coalesce(F.nullif(c("event_id") % 4, F.lit(0)), F.lit(9)).alias("falsy"))), f"SELECT event_id, {d('CASE WHEN event_id%3=0 THEN -1 ELSE value END')} AS v, coalesce(nullif(event_id%4,0),9) AS falsy FROM events")


def _user_rule(spark, sf):
    book = {"close_up_3": rules.Rule(lambda: (c("close") > wlag("close")) & (wlag("close") > wlag("close", 2)) & (wlag("close", 2) > wlag("close", 3)))}
    return tidy(rules.with_rules(bars(spark, sf), book).select("symbol", "date", c("close_up_3").alias("hit")))


register("v01_pluggable_rule", _user_rule, query(BARS, f"SELECT symbol, strftime(date,'%Y-%m-%d') AS date, cast(coalesce(close>{lag('close')} AND {lag('close')}>{lag('close', 2)} AND {lag('close', 2)}>{lag('close', 3)},false) AS bigint) AS hit FROM b"))
register("v03_rolling_apply", lambda spark, sf: tidy(ind.compose(bars(spark, sf), ind.cci()).select("symbol", "date", rnd(ind.rolling_apply("tp20", 20, lambda w: F.aggregate(w, F.lit(0.0), lambda a, x: a + x * x) / 20.0), 3).alias("mean_square"))), query([*__import__("barloom.catalog.indicators", fromlist=["TECH"]).TECH[:2]], f"SELECT symbol, strftime(date,'%Y-%m-%d') AS date, CASE WHEN rn>=19 THEN {r(f'avg(tp*tp) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)', 3)}+0.0::double END AS mean_square FROM t1"))
register("v05_row_classifier", lambda spark, sf: tidy(tables.index_context(spark, sf).select("date", F.when(c("above_200") & c("above_50"), "on").when(c("above_50"), "early").otherwise("off").alias("state"))), query([*IX, REGIME], "SELECT strftime(date,'%Y-%m-%d') AS date, CASE WHEN above_200 AND above_50 THEN 'on' WHEN above_50 THEN 'early' ELSE 'off' END AS state FROM rgm"))
