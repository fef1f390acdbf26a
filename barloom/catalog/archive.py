"""Archive, parsing and data-quality queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import register, tidy
from barloom.catalog.oracle import BARS, INDEX, query, select
from barloom.catalog.scores import FUNDAMENTALS
from barloom.functions import market, scoring
from barloom.functions.outcomes import valid_bar, valid_bar_tolerant
from barloom.operators import quality
from barloom.operators.lineage import materialize
from barloom.plans import tables
from barloom.plans.tables import daily_bars, index_bars, read
from barloom.sources import archive, pages, parsing
from barloom.sources.barstore import BarStore
from barloom.streaming.ticks import work_folder

c = F.col
OHLCV = "open@4 high@4 low@4 close@4 volume@4"
COLS = ("symbol", "date", "open", "high", "low", "close", "volume")


def scan_log(spark, sf):
    """Orders as logged scan rows: one scored row per order."""
    o = read(spark, sf, "orders")
    cents = F.round(c("o_totalprice") * 100).cast("long")
    score = (cents % 101).cast("long")
    return o.select(
        c("o_orderkey").alias("id"),
        (c("o_orderdate") + F.make_dt_interval(F.lit(0), (c("o_orderkey") % 24).cast("int"))).alias("scanned_at"),
        F.concat(F.lit("c"), c("o_custkey").cast("string"), F.lit(".NS")).alias("symbol"),
        F.when(c("o_orderpriority").isin("1-URGENT", "2-HIGH"), "narrow").otherwise("broad").alias("universe"),
        F.when(c("o_orderstatus") == "P", "intraday").otherwise("swing").alias("scan_type"),
        F.when(cents % 37 != 0, score).alias("score100"),
        (cents % 100000 / 100.0).alias("close"),
        scoring.verdict(score).alias("verdict"),
        c("o_orderpriority").alias("sector"),
    )


LOG = """sl0 AS (SELECT *, cast(round(o_totalprice*100) AS bigint) AS ct FROM orders),
slog AS (SELECT o_orderkey AS id, o_orderdate + to_hours(cast(o_orderkey%24 AS int)) AS scanned_at, 'c'||cast(o_custkey AS varchar)||'.NS' AS symbol, 'C'||cast(o_custkey AS varchar) AS clean,
  CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'narrow' ELSE 'broad' END AS universe, CASE WHEN o_orderstatus='P' THEN 'intraday' ELSE 'swing' END AS scan_type,
  CASE WHEN ct%37<>0 THEN ct%101 END AS score100, (ct%100000)/100.0::double AS close, CASE WHEN ct%101>=75 THEN 'HIGH-QUALITY SETUP' WHEN ct%101>=60 THEN 'GOOD SETUP' WHEN ct%101<=30 THEN 'NOT SUITABLE' WHEN ct%101<=45 THEN 'WEAK / AVOID' ELSE 'WATCHLIST' END AS verdict, o_orderpriority AS sector FROM sl0)"""
ALL = f"SELECT {select('symbol date@d ' + OHLCV)} FROM b"


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def when(x):
    return F.date_format(x, "yyyy-MM-dd HH:mm:ss")


register("a01_load_symbol", lambda spark, sf: tidy(archive.load(daily_bars(spark, sf), "S1").select(*COLS)), query(BARS, ALL + " WHERE symbol='S1'"))
register(
    "a02_load_many",
    lambda spark, sf: tidy(archive.load_many(daily_bars(spark, sf), tables.fundamentals(spark, sf).where(~c("banned"))).select(*COLS)),
    query([BARS, FUNDAMENTALS], ALL + " WHERE symbol IN (SELECT symbol FROM fd WHERE NOT banned)"),
)
register(
    "a03_as_of_calendar",
    lambda spark, sf: tidy(archive.on_calendar(daily_bars(spark, sf), index_bars(spark, sf), "1999-12-31").select("symbol", "date", "close", "volume")),
    query([BARS, INDEX], f"SELECT g.symbol, strftime(g.date,'%Y-%m-%d') AS date, round(b.close,4)+0.0::double AS close, round(b.volume,4)+0.0::double AS volume FROM (SELECT s.symbol, i.date FROM (SELECT DISTINCT symbol FROM b WHERE date<='1999-12-31') s, (SELECT date FROM ix WHERE date<='1999-12-31') i) g LEFT JOIN b USING (symbol, date)"),
)
register(
    "a04_snapshot_status",
    lambda spark, sf: tidy(archive.snapshot_status(daily_bars(spark, sf), "2001-06-30").select("symbol", "rows", "invalid", "newest", "ok")),
    query(BARS, "SELECT symbol, count(*) AS rows, 0::bigint AS invalid, strftime(max(date),'%Y-%m-%d') AS newest, cast(count(*)>=220 AND date_diff('day', max(date), DATE '2001-06-30')<=5 AS bigint) AS ok FROM b WHERE date<='2001-06-30' GROUP BY 1"),
)


def _scaled(spark, sf):
    return _cents(daily_bars(spark, sf))


def _cents(df):
    cents = lambda x: F.round(c(x) * 100).cast("long").cast("string").alias(x)
    return df.select("symbol", "date", *[cents(x) for x in ("open", "high", "low", "close")], c("volume").cast("long").cast("string").alias("volume"))


HASH = """hx AS (SELECT symbol, date, sha256(concat_ws(',', cast(cast(round(open*100) AS bigint) AS varchar), cast(cast(round(high*100) AS bigint) AS varchar), cast(cast(round(low*100) AS bigint) AS varchar), cast(cast(round(close*100) AS bigint) AS varchar), cast(cast(volume AS bigint) AS varchar))) AS h FROM b)"""
register(
    "a06_fingerprint",
    lambda spark, sf: tidy(archive.fingerprint(_scaled(spark, sf), ["open", "high", "low", "close", "volume"])),
    query([BARS, HASH], "SELECT symbol, count(*) AS rows, sha256(string_agg(h, '' ORDER BY date)) AS content_hash FROM hx GROUP BY 1"),
)
def _snapshot(spark, sf):
    """Written once with its provenance, then hashed again from the files; the stored and the new hash must agree."""
    path = work_folder(spark)
    archive.save_snapshot(daily_bars(spark, sf), path, "derived", "raw", ["open", "close"], _cents)
    stored = spark.read.parquet(f"{path}/provenance")
    again = archive.fingerprint(_cents(spark.read.parquet(f"{path}/bars")), ["open", "close"]).select("symbol", c("content_hash").alias("_again"))
    return stored.join(again, "symbol").where("content_hash = _again").select("symbol", "rows", "content_hash", "invalid_rows")


register(
    "a05_snapshot_metadata",
    lambda spark, sf: tidy(_snapshot(spark, sf)),
    query([BARS], "SELECT symbol, count(*) AS rows, sha256(string_agg(sha256(concat_ws(',', cast(cast(round(open*100) AS bigint) AS varchar), cast(cast(round(close*100) AS bigint) AS varchar))), '' ORDER BY date)) AS content_hash, 0::bigint AS invalid_rows FROM b GROUP BY 1"),
)


def _upsert_inputs(spark, sf):
    b = daily_bars(spark, sf)
    k = F.substring("symbol", 2, 10).cast("long")
    old = b.where(c("date") <= F.lit("2000-06-30").cast("date"))
    batch = b.where(~((k % 3 == 0) & (F.year("date") == 1997))).withColumns({"provider": F.when(k % 5 == 0, "B").otherwise("A"), "basis": F.lit("raw")})
    prov = b.select("symbol").distinct().select("symbol", F.lit("A").alias("provider"), F.lit("raw").alias("basis"))
    return old, batch, prov


def _upsert(spark, sf):
    """The gate of each symbol, and its bars after the accepted ones have been merged into a bar store of their own."""
    old, batch, provenance = _upsert_inputs(spark, sf)
    gate = materialize(archive.gate_upsert(old, batch, provenance))
    store = BarStore(spark, work_folder(spark))
    store.write(old)
    store.merge(batch.join(gate.where("accepted").select("symbol"), "symbol", "left_semi"))
    after = store.read().groupBy("symbol").agg(F.count("*").alias("rows"), F.max("date").alias("last"))
    return tidy(gate.join(after, "symbol", "left"))


register(
    "a07_gated_upsert",
    _upsert,
    query(
        BARS,
        "SELECT symbol, CASE WHEN k%5=0 THEN 'B' ELSE 'A' END AS provider, 'raw' AS basis, CASE WHEN n=0 THEN NULL WHEN k%5=0 THEN 'unknown_or_changed_provider_basis' WHEN k%3=0 AND y>0 THEN 'partial_history_requires_review' END AS reason, cast(taken AS bigint) AS accepted, nullif(CASE WHEN NOT taken THEN n WHEN k%3=0 THEN total-y+least(n,y) ELSE total END,0) AS rows, strftime(CASE WHEN NOT taken THEN old_last WHEN k%3=0 THEN coalesce(greatest(new_last,old_last),new_last,old_last) ELSE last END,'%Y-%m-%d') AS last FROM (SELECT *, CASE WHEN n=0 THEN true ELSE NOT (k%5=0 OR (k%3=0 AND y>0)) END AS taken FROM (SELECT symbol, cast(substr(symbol,2) AS bigint) AS k, count(*) AS total, max(date) AS last, max(date) FILTER (WHERE date<='2000-06-30') AS old_last, max(date) FILTER (WHERE year(date)<>1997) AS new_last, count(*) FILTER (WHERE date<='2000-06-30') AS n, count(*) FILTER (WHERE year(date)=1997) AS y FROM b GROUP BY 1))",
    ),
)
register(
    "a08_staleness",
    lambda spark, sf: tidy(
        archive.stale(
            daily_bars(spark, sf).select("symbol").distinct(),
            daily_bars(spark, sf).groupBy("symbol").agg(F.max("date").alias("last_fetched")),
            tables.fundamentals(spark, sf).where("banned").select("symbol", F.lit("2001-10-20").cast("date").alias("day")),
            "2001-10-20",
        )
    ),
    query([BARS, FUNDAMENTALS], "SELECT symbol FROM (SELECT symbol, max(date) AS l FROM b GROUP BY 1) WHERE l<'2001-10-20' AND symbol NOT IN (SELECT symbol FROM fd WHERE banned)"),
)
register(
    "a09_inventory",
    lambda spark, sf: tidy(archive.inventory(daily_bars(spark, sf))),
    query(BARS, "SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, strftime(min(date),'%Y-%m-%d') AS first_date, strftime(max(date),'%Y-%m-%d') AS last_date FROM b"),
)


def _candles(spark, sf):
    e = read(spark, sf, "events")
    v = c("value")
    raw = e.select(c("event_type").alias("symbol"), F.unix_seconds(F.date_trunc("hour", "ts")).alias("epoch"), c("event_id").alias("seq"), v.alias("open"), v.alias("high"), v.alias("low"), v.alias("close"), F.lit(1.0).alias("volume"))
    return tidy(parsing.epoch_candles(raw).select("symbol", when(c("ts")).alias("ts"), "close", "seq"))


register(
    "a10_epoch_candles",
    _candles,
    query("e AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS h, event_id, value FROM events)", f"SELECT symbol, {stamp('h + INTERVAL 330 MINUTE')} AS ts, round(arg_max(value, event_id),4)+0.0::double AS close, max(event_id) AS seq FROM e GROUP BY symbol, h"),
)


def _payload(spark, sf):
    """One payload of parallel arrays per order; every seventh one is short of a price."""
    o = read(spark, sf, "orders")
    n = (c("o_orderkey") % 5 + 2).cast("int")
    lines = F.sequence(F.lit(1), n)
    prices = F.transform(F.sequence(F.lit(1), F.when(c("o_orderkey") % 7 == 0, n - 1).otherwise(n)), lambda i: c("o_totalprice") * i)
    p = o.select("o_orderkey", lines.alias("line"), prices.alias("price"))
    return tidy(parsing.columnar_payload(p, ("line", "price")).select("o_orderkey", "line", "price"))


register(
    "a11_columnar_payload",
    _payload,
    "SELECT o_orderkey, line, round(o_totalprice*line,4)+0.0::double AS price FROM (SELECT o_orderkey, o_totalprice, unnest(range(1, o_orderkey%5+3)) AS line FROM orders WHERE o_orderkey%7<>0)",
)


def _chunks(spark, sf):
    b = daily_bars(spark, sf)
    first = b.where(c("date") < F.lit("1999-01-01").cast("date")).withColumn("part", F.lit(1))
    second = b.where(c("date") >= F.lit("1998-07-01").cast("date")).withColumns({"part": F.lit(2), "close": c("close") + 1.0})
    merged = archive.keep_last(first.unionByName(second), ["symbol", "date"], ["part"])
    enough = merged.groupBy("symbol").agg(F.count("*").alias("_n")).where("_n >= 100").select("symbol")
    return tidy(merged.join(enough, "symbol", "left_semi").select("symbol", "date", "close", "part"))


register(
    "a12_chunked_history",
    _chunks,
    query(BARS, "SELECT symbol, strftime(date,'%Y-%m-%d') AS date, round(CASE WHEN date>='1998-07-01' THEN close+1 ELSE close END,4)+0.0::double AS close, CASE WHEN date>='1998-07-01' THEN 2 ELSE 1 END::bigint AS part FROM b WHERE symbol IN (SELECT symbol FROM b GROUP BY 1 HAVING count(*)>=100)"),
)


def _csv(spark, sf):
    b = daily_bars(spark, sf)
    text = lambda x: F.format_string("%.2f", x)
    line = F.concat_ws(",", c("date").cast("string"), *[text(c(x)) for x in ("open", "high", "low", "close")], F.when(F.dayofmonth("date") == 13, "").otherwise(c("volume").cast("long").cast("string")))
    return tidy(parsing.vendor_csv(b.select("symbol", line.alias("line")), "line", ["Date", "O", "H", "L", "C", "V"]).select(*COLS))


register("a13_vendor_csv", _csv, query(BARS, f"SELECT {select('symbol date@d open@4 high@4 low@4 close@4')}, round(CASE WHEN day(date)=13 THEN 0 ELSE volume END,4)+0.0::double AS volume FROM b WHERE symbol IN (SELECT symbol FROM b GROUP BY 1 HAVING count(*)>=50)"))


def _exchange(spark, sf):
    li = read(spark, sf, "lineitem")
    series = F.element_at(F.array(*[F.lit(x) for x in ("EQ", " BE", "BL", "bz ")]), (c("l_linenumber") % 4 + 1).cast("int"))
    return li.select(
        F.concat(F.lit("S"), c("l_suppkey").cast("string")).alias("symbol"), F.date_format("l_shipdate", "dd-MMM-yyyy").alias("date_text"), series.alias("series"),
        F.format_number("l_extendedprice", 2).alias("close_text"), F.format_number("l_quantity", 0).alias("volume_text"),
    )


register(
    "a14_exchange_file",
    lambda spark, sf: tidy(parsing.exchange_file(_exchange(spark, sf))),
    query(
        "e AS (SELECT 'S'||cast(l_suppkey AS varchar) AS symbol, cast(l_shipdate AS date) AS date, CASE l_linenumber%4 WHEN 0 THEN 'EQ' WHEN 1 THEN 'BE' WHEN 2 THEN 'BL' ELSE 'BZ' END AS series, l_extendedprice AS close, l_quantity AS volume FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY series<>'EQ', series, close, volume) AS k FROM e WHERE series<>'BL')",
        f"SELECT {select('symbol date@d series close@4 volume@4')} FROM r WHERE k=1",
    ),
)


def _delivery(spark, sf):
    li = read(spark, sf, "lineitem")
    d = li.groupBy(F.concat(F.lit("S"), c("l_suppkey").cast("string")).alias("symbol"), F.to_date("l_shipdate").alias("date")).agg(F.sum(F.round(c("l_discount") * 100).cast("long")).alias("s"))
    return tidy(parsing.newest_delivery(d.select("symbol", "date", F.lit("EQ ").alias("series"), (c("s") * 7 % 1000 / 10.0).alias("delivery_pct"))))


register(
    "a15_delivery_percent",
    _delivery,
    query("d AS (SELECT 'S'||cast(l_suppkey AS varchar) AS symbol, cast(l_shipdate AS date) AS date, sum(cast(round(l_discount*100) AS bigint)) AS s FROM lineitem GROUP BY 1,2)", "SELECT symbol, round(arg_max((s*7%1000)/10.0::double, date),1)+0.0::double AS delivery_pct FROM d GROUP BY 1"),
)
register("a16_market_day", lambda spark, sf: tidy(daily_bars(spark, sf).where(c("date") == F.lit("1998-06-15").cast("date")).select(*COLS)), query(BARS, ALL + " WHERE date='1998-06-15'"))


def _append(spark, sf):
    log = scan_log(spark, sf)
    words = F.split(F.translate("verdict", "-/", "  "), "\\s+")
    rows = log.select("id", archive.clean_symbol(c("symbol")).alias("symbol"), "score100", words.alias("signals"))
    path = work_folder(spark)
    for half in (0, 1):  # two appends to one log
        archive.append_scan_log(rows.where(c("id") % 2 == half), path)
    return tidy(spark.read.parquet(path))


register("a17_scan_log_append", _append, query(LOG, "SELECT id, clean AS symbol, score100, array_to_string(regexp_split_to_array(translate(verdict,'-/','  '), '\\s+'),'|') AS signals FROM slog"))


def _runs(spark, sf):
    log = scan_log(spark, sf)
    return log.withColumns({"run_id": F.date_format("scanned_at", "yyyy-MM-dd"), "saved_at": F.date_trunc("day", "scanned_at")})


RUNS = "rl AS (SELECT *, strftime(scanned_at,'%Y-%m-%d') AS run_id, date_trunc('day', scanned_at) AS saved_at FROM slog), rp AS (SELECT scan_type, run_id, max(saved_at) AS saved_at, count(*) AS n FROM rl GROUP BY 1,2), rk AS (SELECT *, row_number() OVER (PARTITION BY scan_type ORDER BY saved_at DESC, run_id DESC) AS r, max(saved_at) OVER (PARTITION BY scan_type) AS newest FROM rp)"
register("a18_snapshot_retention", lambda spark, sf: tidy(archive.newest_snapshots(_runs(spark, sf)).select("id", "scan_type", "run_id")), query([LOG, RUNS], "SELECT id, scan_type, run_id FROM rl JOIN rk USING (scan_type, run_id) WHERE r<=3"))
register(
    "a19_broadest_recent",
    lambda spark, sf: tidy(archive.broadest_recent(_runs(spark, sf), 12, 240).select("scan_type", "run_id", "n")),
    query([LOG, RUNS], "SELECT scan_type, run_id, n FROM (SELECT *, row_number() OVER (PARTITION BY scan_type ORDER BY n DESC, saved_at DESC, run_id DESC) AS k FROM rk WHERE r<=12 AND saved_at>=newest-INTERVAL 240 HOUR) WHERE k=1"),
)


def _merge(spark, sf):
    log = scan_log(spark, sf)
    newest = lambda u: archive.keep_last(log.where(c("universe") == u).select("symbol", "score100", "scanned_at", "id"), ["symbol"], ["scanned_at", "id"])
    return tidy(archive.merge_narrow(newest("broad"), newest("narrow")).select("symbol", "id", "score100"))


register(
    "a20_merge_narrow",
    _merge,
    query([LOG, "m AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY universe='narrow' DESC, scanned_at DESC, id DESC) AS k FROM slog)"], "SELECT symbol, id, score100 FROM m WHERE k=1"),
)
register(
    "a21_history_query",
    lambda spark, sf: tidy(archive.history(scan_log(spark, sf), F.lit("1999-01-01").cast("timestamp"), 200).select("id", "symbol", "score100", when(c("scanned_at")).alias("scanned_at"))),
    query(LOG, f"SELECT id, symbol, score100, {stamp('scanned_at')} AS scanned_at FROM (SELECT * FROM slog WHERE scan_type='swing' AND scanned_at>='1999-01-01' ORDER BY scanned_at DESC, score100 DESC NULLS LAST, id LIMIT 200)"),
)
def _dump(spark, sf):
    """Lines of the dump as they stand in its files."""
    path = work_folder(spark)
    archive.write_dump(scan_log(spark, sf).select("id", "symbol", "score100", "universe"), path, "json")
    return spark.read.text(path).select(F.get_json_object("value", "$.id").cast("long").alias("id"), c("value").alias("line"))


register(
    "a22_evaluation_dump_rows",
    lambda spark, sf: tidy(_dump(spark, sf)),
    query(LOG, "SELECT id, '{\"id\":'||id||',\"symbol\":\"'||symbol||'\"'||coalesce(',\"score100\":'||score100,'')||',\"universe\":\"'||universe||'\"}' AS line FROM slog"),
)
WORDS = ["ing", "sch", "queeux"]
register(
    "a23_keyword_scan",
    lambda spark, sf: tidy(parsing.keyword_hits(read(spark, sf, "documents"), WORDS).select("lang", "doc_id", "position")),
    query("k AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS position FROM documents WHERE contains(lower(text),'ing') OR contains(lower(text),'sch') OR contains(lower(text),'queeux'))", "SELECT lang, doc_id, position FROM k WHERE position<=5"),
)
register(
    "a24_page_metrics",
    lambda spark, sf: tidy(parsing.page_metrics(read(spark, sf, "pages"))),
    """SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title, len(regexp_extract_all(html, '<a '))::bigint AS links, len(regexp_extract_all(html, '<p>'))::bigint AS paragraphs, regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang,
  regexp_extract(html, '<h1>(.*?)</h1>', 1, 's') AS heading, round(try_cast(regexp_extract(html, '([0-9]+(?:\\.[0-9]+)?)\\s*%', 1) AS double),4)+0.0::double AS first_percent FROM pages""",
)


def company_pages(spark, sf):
    """Every page with a company's figures planted by its id: a ratio list, a holdings table with a spanning head, remarks."""
    k, f1 = c("page_id"), lambda x: F.format_string("%.1f", x.cast("double"))
    text = lambda x: F.lit(x)
    li = lambda name, mark, value: F.concat(text(f'<li class="flex"><span class="name">\n {name} </span><span class="{mark}">'), value, text("</span></li>"))
    ratios = F.concat(
        text('<ul id="top-ratios">'), li("Stock P/E", "number", f1(k % 400 / 10 + 1)), li("Book Value", "nowrap value", F.concat(text("₹&nbsp;"), F.format_number(k * 37 % 90000 / 10.0, 1))),
        li("ROCE", "number", F.concat((k % 45).cast("string"), text(" %"))), li("ROE", "number", F.concat((k * 7 % 40).cast("string"), text(" %"))), li("Debt to equity", "number", f1(k % 50 / 10)),
        li("Dividend Yield", "number", F.concat(f1(k % 30 / 10), text("%"))), li("Market Cap", "nowrap", F.concat(F.format_number(k * 11 % 99999, 0), text(" Cr."))), text("</ul>"))
    tr = lambda label, *values: F.concat(text(f"<tr><td class=t>{label}</td>"), *[F.concat(text("<td>"), v, text("</td>")) for v in values], text("</tr>"))
    shares = lambda base, move: (f1(base), text(""), f1(base + 1), f1(base + 1 + move))
    table = F.concat(
        text('<section id="shareholding"><table><tr><th></th><th colspan="3">2023</th><th>2024</th></tr>'),
        tr("Promoters&nbsp;+", *shares(40 + k % 30, (k % 13 - 6) / 2)), tr("FIIs +", *shares(10 + k % 9, (k % 15 - 7) / 2)), tr("DIIs +", *shares(5 + k % 7, (k % 5 - 2) * 1.0)), text("</table>"),
        F.when(k % 3 == 0, F.concat(text("<table>"), tr("Pledged percentage", f1(k % 61), f1(k % 71)), text("</table>"))).otherwise(text("")), text("</section>"))
    remarks = F.concat(text('<section id="analysis"><ul><li>Stock is trading at '), (k % 9).cast("string"), text(" times</li><li>short</li>"), F.when(k % 5 == 0, text("<li>Company has <b>low ROE</b> of late</li>")).otherwise(text("")), text("</ul></section>"))
    book = F.concat(text("<p>The order book stands at Rs "), F.format_number(k * 3 % 7000, 0), text(" Cr now</p>"))
    return read(spark, sf, "pages").select("page_id", F.when(k % 10 != 9, F.concat(F.coalesce("html", F.lit("")), ratios, table, remarks, book)).otherwise(c("html")).alias("html"))


register(
    "a24_company_figures",
    lambda spark, sf: tidy(pages.with_company_figures(company_pages(spark, sf)).select(
        "page_id", "pe", "book_value", "roce", "roe", "debt_to_equity", "dividend_yield", "market_cap", "promoter_holding", "promoter_change", "fii_holding", "fii_change", "dii_holding", "dii_change",
        "promoter_pledged", F.size("remarks").alias("n_remarks"), "order_book", "quality_score", "red_flags", "green_flags")),
    """WITH p AS (SELECT page_id AS k, page_id%10<>9 AS has FROM pages),
v AS (SELECT k, has, (k%400)/10.0::double+1 AS pe, (k*37%90000)/10.0::double AS bv, k%45 AS roce, k*7%40 AS roe, (k%50)/10.0::double AS de, (k%30)/10.0::double AS dy, format('{:,}', k*11%99999)||' Cr.' AS cap,
  40+k%30+1+(k%13-6)/2.0::double AS ph, (k%13-6)/2.0::double AS pc, 10+k%9+1+(k%15-7)/2.0::double AS fh, (k%15-7)/2.0::double AS fc, 5+k%7+1+(k%5-2) AS dh, (k%5-2)::double AS dc,
  CASE WHEN k%3=0 THEN (k%71)::double END AS pl, CASE WHEN k%5=0 THEN 2 ELSE 1 END AS n, format('{:,}', k*3%7000)||' Cr' AS ob FROM p)
SELECT k AS page_id, CASE WHEN has THEN round(pe,4)+0.0::double END AS pe, CASE WHEN has THEN round(bv,4)+0.0::double END AS book_value, CASE WHEN has THEN roce+0.0::double END AS roce, CASE WHEN has THEN roe+0.0::double END AS roe,
  CASE WHEN has THEN round(de,4)+0.0::double END AS debt_to_equity, CASE WHEN has THEN round(dy,4)+0.0::double END AS dividend_yield, CASE WHEN has THEN cap END AS market_cap,
  CASE WHEN has THEN round(ph,4)+0.0::double END AS promoter_holding, CASE WHEN has THEN round(pc,4)+0.0::double END AS promoter_change, CASE WHEN has THEN round(fh,4)+0.0::double END AS fii_holding, CASE WHEN has THEN round(fc,4)+0.0::double END AS fii_change,
  CASE WHEN has THEN dh+0.0::double END AS dii_holding, CASE WHEN has THEN dc+0.0::double END AS dii_change, CASE WHEN has THEN pl+0.0::double END AS promoter_pledged, cast(CASE WHEN has THEN n ELSE 0 END AS bigint) AS n_remarks,
  CASE WHEN has THEN ob END AS order_book,
  cast(CASE WHEN has THEN CASE WHEN roce>15 THEN 2 WHEN roce>10 THEN 1 ELSE 0 END+CASE WHEN roe>15 THEN 2 WHEN roe>10 THEN 1 ELSE 0 END+CASE WHEN de<0.5 THEN 2 WHEN de<1 THEN 1 ELSE 0 END+CASE WHEN fc>0 THEN 1 ELSE 0 END+CASE WHEN dc>0 THEN 1 ELSE 0 END ELSE 0 END+CASE WHEN NOT has OR coalesce(pl,0)<10 THEN 1 ELSE 0 END AS bigint) AS quality_score,
  CASE WHEN has THEN concat_ws('|', CASE WHEN pl>50 THEN 'high_pledge' END, CASE WHEN pl>20 THEN 'pledge' END, CASE WHEN pc< -2 THEN 'promoter_sold' END, CASE WHEN fc< -3 THEN 'fii_sold' END, CASE WHEN de>3 THEN 'high_debt' END, CASE WHEN n=2 AND NOT coalesce(pl>50 AND pc< -2 AND fc< -3 AND de>3,false) THEN 'remark' END) ELSE '' END AS red_flags,
  CASE WHEN has THEN concat_ws('|', CASE WHEN fc>1 THEN 'fii_buying' END, CASE WHEN dc>1 THEN 'dii_buying' END, CASE WHEN pc>0.5 THEN 'promoter_bought' END, CASE WHEN roce>20 THEN 'high_roce' END, CASE WHEN coalesce(pl,0)=0 THEN 'no_pledge' END) ELSE 'no_pledge' END AS green_flags FROM v""",
)


def _answers(spark, sf):
    """Every conversation turn with an answer fenced in prose, and with one nested up to thirty levels inside a broken object, both read back."""
    conv = read(spark, sf, "conversations")
    role, turn = c("role"), c("turn").cast("string")
    fenced = F.concat(c("text"), F.lit(" ```json {\"turn\": "), turn, F.lit(", \"role\": \""), role, F.lit("\"} ``` {broken"))
    depth = F.pmod(c("conv_id") + c("turn"), F.lit(30)).cast("int")
    nested = F.concat(F.lit("{broken "), F.repeat(F.lit('{"n": '), depth), F.lit('{"brace": "}{", "role": "'), role, F.lit('"}'), F.repeat(F.lit("}"), depth), F.lit(" {"))
    j, deep = parsing.first_json(fenced), parsing.first_json(nested)
    return tidy(conv.select(
        "conv_id", "turn", F.get_json_object(j, "$.turn").cast("long").alias("found_turn"), F.get_json_object(j, "$.role").alias("found_role"), deep.alias("nested")))


register(
    "a25_json_in_text",
    _answers,
    """SELECT conv_id, cast(turn AS bigint) AS turn, cast(turn AS bigint) AS found_turn, role AS found_role,
  repeat('{"n": ', cast((conv_id+turn)%30 AS integer))||'{"brace": "}{", "role": "'||role||'"}'||repeat('}', cast((conv_id+turn)%30 AS integer)) AS nested FROM conversations""",
)


def instruments(spark, sf):
    p = read(spark, sf, "part")
    k = c("p_partkey")
    isin = F.concat(F.lit("INE"), F.lpad((F.floor(k / 2)).cast("string"), 9, "0"))
    nse = k % 2 == 0
    return p.select(
        isin.alias("isin"), F.when(nse, "NSE").otherwise("BSE").alias("exchange"), F.when(k % 13 == 0, "DEBT").otherwise("EQ").alias("kind"),
        F.upper("p_name").alias("name"), F.when(nse, F.concat(F.lit("T"), k.cast("string"))).alias("ticker"), (k + 500000).cast("string").alias("code"), c("p_brand").alias("series"),
    )


INSTRUMENTS = """im0 AS (SELECT 'INE'||lpad(cast(p_partkey//2 AS varchar),9,'0') AS isin, CASE WHEN p_partkey%2=0 THEN 'NSE' ELSE 'BSE' END AS exchange, CASE WHEN p_partkey%13=0 THEN 'DEBT' ELSE 'EQ' END AS kind, upper(p_name) AS name, CASE WHEN p_partkey%2=0 THEN 'T'||cast(p_partkey AS varchar) END AS ticker, cast(p_partkey+500000 AS varchar) AS code, p_brand AS series FROM part),
im AS (SELECT isin, coalesce(max(name) FILTER (WHERE exchange='NSE'), max(name)) AS name, max(ticker) AS ticker, max(code) FILTER (WHERE exchange='NSE') AS nse_id, max(code) FILTER (WHERE exchange='BSE') AS bse_code, max(series) AS series FROM im0 WHERE kind='EQ' GROUP BY 1)"""
register("a26_instrument_master", lambda spark, sf: tidy(parsing.instrument_master(instruments(spark, sf))), query(INSTRUMENTS, "SELECT * FROM im"))
register("a27_id_map", lambda spark, sf: tidy(instruments(spark, sf).where("kind = 'EQ' AND exchange = 'NSE'").select("ticker", "code")), query(INSTRUMENTS, "SELECT ticker, code FROM im0 WHERE kind='EQ' AND exchange='NSE'"))


def _members(spark, sf):
    cu = read(spark, sf, "customer")
    a = cu.select(F.lit("by_segment").alias("universe"), c("c_mktsegment").alias("symbol"), c("c_custkey").alias("pos"))
    b = cu.select(F.lit("by_nation").alias("universe"), F.concat(F.lit("N"), c("c_nationkey").cast("string")).alias("symbol"), c("c_custkey").alias("pos"))
    both = a.unionByName(b)
    return both.unionByName(both.withColumn("universe", F.lit("all")))


MEMBERS = "mb AS (SELECT 'by_segment' AS universe, c_mktsegment AS symbol, c_custkey AS pos FROM customer UNION ALL SELECT 'by_nation', 'N'||cast(c_nationkey AS varchar), c_custkey FROM customer), mc AS (SELECT * FROM mb UNION ALL SELECT 'all', symbol, pos FROM mb)"
register("a28_universe_lists", lambda spark, sf: tidy(parsing.universes(_members(spark, sf))), query(MEMBERS, "SELECT universe, symbol, min(pos) AS pos FROM mc GROUP BY 1,2"))
register(
    "a29_watchlist",
    lambda spark, sf: tidy(
        parsing.watchlist_remove(
            parsing.watchlist_add(scan_log(spark, sf).where("score100 > 90").select("symbol"), scan_log(spark, sf).where("score100 < 5").select(F.concat(F.lit(" "), c("symbol")).alias("symbol"))),
            scan_log(spark, sf).where("score100 = 50").select("symbol"),
        )
    ),
    query(LOG, "SELECT DISTINCT upper(symbol) AS symbol FROM slog WHERE (score100>90 OR score100<5) AND symbol NOT IN (SELECT symbol FROM slog WHERE score100=50)"),
)
register("a46_date_range", lambda spark, sf: tidy(archive.date_range(daily_bars(spark, sf), "1997-01-01", "1997-06-30").select(*COLS)), query(BARS, ALL + " WHERE date BETWEEN '1997-01-01' AND '1997-06-30'"))
register(
    "a47_logged_symbols",
    lambda spark, sf: tidy(scan_log(spark, sf).where("scan_type = 'swing' AND universe = 'broad'").select(F.to_date("scanned_at").alias("day"), archive.clean_symbol(c("symbol")).alias("symbol")).distinct()),
    query(LOG, "SELECT DISTINCT strftime(scanned_at,'%Y-%m-%d') AS day, clean AS symbol FROM slog WHERE scan_type='swing' AND universe='broad'"),
)

# --- quality -----------------------------------------------------------------------


def dirty(spark, sf):
    """Bars with a different fault planted per symbol."""
    b = daily_bars(spark, sf)
    k = F.substring("symbol", 2, 10).cast("long") % 12
    day = F.dayofmonth("date")
    return b.select(
        "symbol", "date", F.when((k == 1) & (day == 7), None).otherwise(c("open")).alias("open"),
        F.when((k == 2) & (day == 7), c("low") - 1).otherwise(c("high")).alias("high"), F.when((k == 3) & (day == 7), 0.0).otherwise(c("low")).alias("low"),
        F.when((k == 4) & (day == 7), float("inf")).otherwise(c("close")).alias("close"),
        F.when((k == 5) & (day == 7), -1.0).when(k == 6, 0.0).when((k == 7) & (day == 7), None).otherwise(c("volume")).alias("volume"),
        F.when(k == 8, -F.datediff("date", F.lit("1990-01-01"))).otherwise(F.datediff("date", F.lit("1990-01-01"))).alias("seq"),
    )


DIRTY = """dq0 AS (SELECT *, cast(substr(symbol,2) AS bigint)%12 AS k, day(date)=7 AS d7 FROM b),
dq AS (SELECT symbol, date, CASE WHEN k=1 AND d7 THEN NULL ELSE open END AS open, CASE WHEN k=2 AND d7 THEN low-1 ELSE high END AS high, CASE WHEN k=3 AND d7 THEN 0 ELSE low END AS low, CASE WHEN k=4 AND d7 THEN 'inf'::double ELSE close END AS close,
  CASE WHEN k=5 AND d7 THEN -1 WHEN k=6 THEN 0 WHEN k=7 AND d7 THEN NULL ELSE volume END AS volume, k, d7 FROM dq0)"""
register(
    "a30_validate_bars",
    lambda spark, sf: tidy(quality.validate(dirty(spark, sf), "2001-11-06")),
    query(
        [BARS, DIRTY],
        """SELECT symbol, rows, CASE WHEN rows<30 THEN 'too_few_rows' WHEN date_diff('day', l, DATE '2001-11-06')>12 THEN 'stale' WHEN k=8 THEN 'not_sorted' WHEN k IN (1,4) AND n7>0 THEN 'not_finite' WHEN k=3 AND n7>0 THEN 'non_positive' WHEN k=2 AND n7>0 THEN 'high_below_low' WHEN k=7 AND n7>0 THEN 'bad_volume' WHEN k=5 AND n7>0 THEN 'negative_volume' END AS fatal,
  CASE WHEN k=6 THEN 'zero_volume_everywhere' END AS warning, cast(NOT (rows<30 OR date_diff('day', l, DATE '2001-11-06')>12 OR k=8 OR (k IN (1,2,3,4,5,7) AND n7>0)) AS bigint) AS ok FROM (SELECT symbol, any_value(k) AS k, count(*) AS rows, max(date) AS l, count(*) FILTER (WHERE d7) AS n7 FROM dq GROUP BY 1)""",
    ),
)
register("a31_valid_bar_tolerant", lambda spark, sf: tidy(dirty(spark, sf).select("symbol", "date", valid_bar_tolerant().alias("valid"))), query([BARS, DIRTY], "SELECT symbol, strftime(date,'%Y-%m-%d') AS date, cast(NOT (k=6 OR (k IN (1,2,3,4,5,7) AND d7)) AS bigint) AS valid FROM dq"))
register("a32_valid_bar_strict", lambda spark, sf: tidy(dirty(spark, sf).select("symbol", "date", valid_bar().alias("valid"))), query([BARS, DIRTY], "SELECT symbol, strftime(date,'%Y-%m-%d') AS date, cast(NOT (k=6 OR (k IN (1,2,3,4,5,7) AND d7)) AS bigint) AS valid FROM dq"))


def _completed(spark, sf):
    done = quality.completed_sessions(daily_bars(spark, sf), "2001-06-15 14:00:00")
    weeks = market.weekly_bars(done)
    n = weeks.groupBy("symbol").agg(F.count("*").alias("n_weeks"))
    return tidy(done.groupBy("symbol").agg(F.max("date").alias("last"), F.count("*").alias("rows")).join(n, "symbol").select("symbol", "last", "rows", F.when(c("n_weeks") >= 15, c("n_weeks")).alias("weeks")))


register("a33_completed_sessions", _completed, query(BARS, "SELECT symbol, strftime(max(date),'%Y-%m-%d') AS last, count(*) AS rows, CASE WHEN count(DISTINCT date_trunc('week', date))>=15 THEN count(DISTINCT date_trunc('week', date)) END AS weeks FROM b WHERE date<='2001-06-14' GROUP BY 1"))


def _top_up(spark, sf):
    b = daily_bars(spark, sf)
    k = F.substring("symbol", 2, 10).cast("long")
    old = b.where(c("date") <= F.lit("2001-06-30").cast("date"))
    fresh = b.where(c("date") >= F.lit("2001-06-01").cast("date")).withColumn("close", F.when(k % 7 == 0, c("close") * 2.0).otherwise(c("close")))
    merged, _ = quality.top_up(old, fresh, "2001-11-05")
    return tidy(merged.groupBy("symbol").agg(F.count("*").alias("rows"), F.max("date").alias("last")))


register(
    "a34_top_up_scale_check",
    _top_up,
    query(BARS, "SELECT symbol, count(*) AS rows, strftime(max(date),'%Y-%m-%d') AS last FROM b WHERE NOT (cast(substr(symbol,2) AS bigint)%7=0 AND symbol IN (SELECT symbol FROM b WHERE date BETWEEN '2001-06-01' AND '2001-06-30')) GROUP BY 1"),
)


def _priority(spark, sf):
    d = dirty(spark, sf).withColumns({"source": F.lit("primary"), "priority": F.lit(1)})
    seq = F.datediff("date", F.lit("1990-01-01"))
    clean = daily_bars(spark, sf).withColumns({"seq": seq, "source": F.lit("backup"), "priority": F.lit(2)})
    best = quality.first_valid_source(d.unionByName(clean), "2001-11-06", max_stale_days=None)
    return tidy(best.groupBy("symbol", "source").agg(F.count("*").alias("rows")))


register(
    "a35_source_priority",
    _priority,
    query([BARS, DIRTY], "SELECT symbol, CASE WHEN k=8 OR (k IN (1,2,3,4,5,7) AND n7>0) THEN 'backup' ELSE 'primary' END AS source, rows FROM (SELECT symbol, any_value(k) AS k, count(*) AS rows, count(*) FILTER (WHERE d7) AS n7 FROM dq GROUP BY 1) WHERE rows>=30"),
)
register(
    "a36_latest_known",
    lambda spark, sf: tidy(quality.latest_known(scan_log(spark, sf).select("symbol", "id", "close", c("scanned_at").alias("available_at")), F.lit("1999-01-01").cast("timestamp_ntz")).select("symbol", "id", "close")),
    query([LOG, "lk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY scanned_at DESC, id DESC) AS k FROM slog WHERE scanned_at<='1999-01-01')"], "SELECT symbol, id, round(close,4)+0.0::double AS close FROM lk WHERE k=1"),
)


def _blockers(spark, sf):
    k = F.substring("symbol", 2, 10).cast("long")
    p = tables.fundamentals(spark, sf).select(
        "symbol", F.when(k % 2 == 0, "raw").otherwise("unknown").alias("price_basis"), F.when(k % 3 == 0, "raw").otherwise("unknown").alias("volume_basis"), (k % 5 == 0).alias("calendar_verified"),
        (k % 7 == 0).alias("membership_verified"), F.lit(True).alias("actions_verified"), (k % 4 == 0).alias("adjustment_verified"), F.when(k % 6 == 0, "doc").otherwise("").alias("review_reference"),
    )
    return tidy(p.select("symbol", quality.blockers().alias("blockers")))


register(
    "a37_provenance_blockers",
    _blockers,
    query(FUNDAMENTALS, "SELECT symbol, concat_ws('|', CASE WHEN k%2<>0 THEN 'execution_prices_not_raw' END, CASE WHEN k%3<>0 THEN 'volume_basis_unverified' END, CASE WHEN k%5<>0 THEN 'calendar_unverified' END, CASE WHEN k%7<>0 THEN 'historic_membership_unverified' END, CASE WHEN k%4<>0 THEN 'signal_adjustments_unverified' END, CASE WHEN k%6<>0 THEN 'review_evidence_missing' END) AS blockers FROM fd0"),
)


def _risks(spark, sf):
    f = tables.fundamentals(spark, sf)
    return f.where(c("banned") | c("oi_spurt")).select("symbol", F.when(c("banned"), "blocked").otherwise("watch").alias("status"))


def _eligible(spark, sf):
    rows = daily_bars(spark, sf).groupBy("symbol").agg(F.max("date").alias("bar_date"), F.max_by("volume", "date").alias("v")).withColumn("tradeable", F.when(c("v") > 3000, True))
    session = daily_bars(spark, sf).agg(F.max("date").alias("d")).select("d").scalar()
    e = quality.eligibility(rows, session, _risks(spark, sf))
    return tidy(e.select("symbol", F.concat_ws("|", "eligibility_reasons").alias("reasons"), "screen_eligible", "financial_review_status", "actionable"))


register(
    "a38_eligibility_gate",
    _eligible,
    query(
        [BARS, FUNDAMENTALS, "lx AS (SELECT symbol, max(date) AS bd, arg_max(volume, date) AS v FROM b GROUP BY 1), lr AS (SELECT lx.*, banned, oi_spurt, bd=(SELECT max(date) FROM b) AS cur FROM lx JOIN fd USING (symbol))"],
        "SELECT symbol, concat_ws('|', CASE WHEN NOT v>3000 THEN 'liquidity_failed_or_unknown' END, CASE WHEN NOT cur THEN 'stale_or_incomplete_session' END, CASE WHEN banned THEN 'material_financial_risk' END) AS reasons, cast(v>3000 AND cur AND NOT banned AS bigint) AS screen_eligible, CASE WHEN banned THEN 'blocked' WHEN oi_spurt THEN 'watch' ELSE 'unreviewed' END AS financial_review_status, 0::bigint AS actionable FROM lr",
    ),
)
def _registry(spark, sf):
    """The registry written as JSON lines and read back strictly."""
    path = work_folder(spark)
    _risks(spark, sf).write.json(path)
    return quality.load_risks(spark, path, multi_line=False)


register(
    "a39_risk_registry",
    lambda spark, sf: tidy(tables.fundamentals(spark, sf).select("symbol").join(_registry(spark, sf), "symbol", "left").select("symbol", F.coalesce("status", F.lit("unreviewed")).alias("status"))),
    query(FUNDAMENTALS, "SELECT symbol, CASE WHEN banned THEN 'blocked' WHEN oi_spurt THEN 'watch' ELSE 'unreviewed' END AS status FROM fd"),
)


def _memos(spark, sf):
    """One memo per order: two evidence items and one claim a side, with faults by key."""
    o = read(spark, sf, "orders")
    k = c("o_orderkey")
    at = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00"), F.when(k % 5 == 0, "").otherwise("Z"))
    item = lambda i, url: F.struct(i.alias("id"), at.alias("available_at"), url.alias("source_url"))
    ev = F.array(item(F.lit("e1"), F.when(k % 3 == 0, "http://x").otherwise("https://x")), item(F.when(k % 7 == 0, "e1").otherwise("e2"), F.lit("https://y")))
    claim = lambda ids: F.array(F.struct(F.lit("text").alias("claim"), ids.alias("evidence_ids"), F.when(k % 11 == 0, "").otherwise("below base").alias("invalidation_condition")))
    ids = F.array(F.when(k % 2 == 0, "e9").otherwise("e1"))
    m = o.select("o_orderkey", ev.alias("evidence"), claim(ids).alias("bull"), F.when(k % 13 == 0, F.array_repeat(claim(ids)[0], 0)).otherwise(claim(F.array(F.lit("e1")))).alias("bear"))
    return tidy(m.select("o_orderkey", F.concat_ws("|", F.array_sort(quality.memo_issues(F.lit("1999-01-01").cast("timestamp")))).alias("issues")))


register(
    "a40_memo_check",
    _memos,
    """WITH m AS (SELECT o_orderkey AS k, o_orderdate>TIMESTAMP '1999-01-01' AND o_orderkey%5<>0 AS fut, o_orderkey%5=0 AS badts FROM orders),
x AS (SELECT k, list_sort(list_filter([CASE WHEN k%7=0 THEN 'missing_or_duplicate_evidence_id' END, CASE WHEN fut THEN 'future_evidence:e1' END, CASE WHEN fut THEN CASE WHEN k%7=0 THEN 'future_evidence:e1' ELSE 'future_evidence:e2' END END,
  CASE WHEN badts THEN 'invalid_evidence_timestamp:e1' END, CASE WHEN badts THEN CASE WHEN k%7=0 THEN 'invalid_evidence_timestamp:e1' ELSE 'invalid_evidence_timestamp:e2' END END, CASE WHEN k%3=0 THEN 'missing_source:e1' END,
  CASE WHEN k%2=0 THEN 'unsupported_bull_claim' END, CASE WHEN k%11=0 THEN 'missing_bull_invalidation' END, CASE WHEN k%13=0 THEN 'missing_bear_case' END, CASE WHEN k%11=0 AND k%13<>0 THEN 'missing_bear_invalidation' END], lambda v: v IS NOT NULL)) AS l FROM m)
SELECT k AS o_orderkey, array_to_string(l,'|') AS issues FROM x""",
)


def journal(spark, sf):
    """Eight consecutive orders make one journal; order dates are the recording times."""
    o = read(spark, sf, "orders")
    k = c("o_orderkey")
    kind = F.when(k % 8 == 0, "registration").otherwise(F.element_at(F.array(*[F.lit(x) for x in ("observation", "intent", "skip", "fill")]), (k % 4 + 1).cast("int")))
    return o.select(
        F.floor(k / 8).alias("journal"), (k % 8 + 1).alias("seq"), kind.alias("kind"), k.cast("string").alias("identity"), c("o_orderdate").alias("recorded_at"),
        F.date_add(F.to_date("o_orderdate"), (k % 7).cast("int") - 3).cast("timestamp_ntz").alias("event_at"), F.round(c("o_totalprice") * 100).cast("long").cast("string").alias("payload"),
    )


def _chain(spark, sf):
    """Whole chains; record ``journal % 8 + 1`` of every tenth journal was changed after hashing."""
    j = journal(spark, sf).withColumn("recorded_at", F.date_format("recorded_at", "yyyy-MM-dd"))
    # A journal holds eight records at most, so its chain is built in one row.
    whole = j.groupBy("journal").agg(F.array_sort(F.collect_list(F.struct("seq", "recorded_at", "identity", "payload"))).alias("records"))
    start = F.array().cast("array<struct<seq:bigint,recorded_at:string,identity:string,payload:string,previous_hash:string,hash:string>>")

    def link(done, r):
        before = F.coalesce(F.try_element_at(done, F.lit(-1))["hash"], F.lit(""))
        own = quality.chain_hash(before, r["recorded_at"], r["identity"], r["payload"])
        return F.concat(done, F.array(F.struct(r["seq"].alias("seq"), r["recorded_at"].alias("recorded_at"), r["identity"].alias("identity"), r["payload"].alias("payload"), before.alias("previous_hash"), own.alias("hash"))))

    j = whole.select("journal", F.inline(F.aggregate("records", start, link)))
    changed = (c("journal") % 10 == 0) & (c("seq") == c("journal") % 8 + 1)
    return tidy(quality.verify_chain(j.withColumn("payload", F.when(changed, "0").otherwise(c("payload")))))


# The SQL hashes every record of every chain again: the stored hash from the original payload, the check from what is there now.
register(
    "a41_hash_chain",
    _chain,
    """
WITH RECURSIVE j AS (
    SELECT o_orderkey//8 AS journal, o_orderkey%8+1 AS seq, o_orderkey::varchar AS identity, strftime(o_orderdate, '%Y-%m-%d') AS day,
        (round(o_totalprice*100))::bigint::varchar AS payload FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY journal ORDER BY seq) AS k FROM j),
ch AS (
    SELECT journal, seq, k, day, identity, payload, '' AS prev, sha256(concat_ws('|', '', day, identity, payload)) AS hash FROM r WHERE k = 1
    UNION ALL
    SELECT r.journal, r.seq, r.k, r.day, r.identity, r.payload, ch.hash, sha256(concat_ws('|', ch.hash, r.day, r.identity, r.payload)) FROM ch JOIN r ON r.journal = ch.journal AND r.k = ch.k + 1),
now AS (SELECT *, CASE WHEN journal%10=0 AND seq = journal%8+1 THEN '0' ELSE payload END AS found, lag(hash) OVER (PARTITION BY journal ORDER BY seq) AS before, lag(seq) OVER (PARTITION BY journal ORDER BY seq) AS prior FROM ch)
SELECT journal, cast(bool_and(hash = sha256(concat_ws('|', prev, day, identity, found)) AND prev = coalesce(CASE WHEN prior = seq - 1 THEN before END, '')) AS bigint) AS sound, count(*) AS records
FROM now GROUP BY 1
""",
)
register(
    "a42_journal_admission",
    lambda spark, sf: tidy(quality.admission(journal(spark, sf)).select("journal", "seq", "kind", "rejected")),
    """WITH j AS (SELECT o_orderkey//8 AS journal, o_orderkey%8+1 AS seq, o_orderkey AS k, o_orderdate AS ats, cast(o_orderdate AS date)+cast(o_orderkey%7-3 AS int) AS ev FROM orders),
w AS (SELECT *, first_value(ats) OVER v AS f, max(ats) OVER v AS mx, count(*) OVER v AS n FROM j WINDOW v AS (PARTITION BY journal ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT *, CASE WHEN seq=1 THEN 'registration' ELSE CASE k%4 WHEN 0 THEN 'observation' WHEN 1 THEN 'intent' WHEN 2 THEN 'skip' ELSE 'fill' END END AS kind FROM w)
SELECT journal, seq, kind, CASE WHEN kind='fill' THEN 'kind_not_allowed' WHEN kind<>'registration' AND n=0 THEN 'not_registered' WHEN ats<mx THEN 'backdated' WHEN kind='observation' AND (ev<=f OR ev>ats) THEN 'observation_outside_window' WHEN kind='intent' AND ev<=ats THEN 'intent_not_in_future' END AS rejected FROM x""",
)


def _audit(spark, sf):
    master = parsing.instrument_master(instruments(spark, sf)).where("ticker IS NOT NULL").select(c("ticker").alias("symbol"))
    uni = read(spark, sf, "part").select(F.concat(F.lit("T"), c("p_partkey").cast("string")).alias("symbol"))
    return tidy(uni.join(master, "symbol", "left_anti"))


register("a43_stale_tickers", _audit, "SELECT 'T'||cast(p_partkey AS varchar) AS symbol FROM part WHERE p_partkey%2<>0 OR p_partkey%13=0")


def _noisy(spark, sf):
    e = read(spark, sf, "events")
    return e.select("event_id", F.when(c("event_id") % 5 == 0, float("nan")).when(c("event_id") % 7 == 0, float("inf")).otherwise(c("value")).alias("value"))


register("a44_json_safe", lambda spark, sf: tidy(quality.json_safe(_noisy(spark, sf))), "SELECT event_id, CASE WHEN event_id%5=0 OR event_id%7=0 THEN NULL ELSE round(value,4)+0.0::double END AS value FROM events")
register(
    "a45_safe_number",
    lambda spark, sf: tidy(
        read(spark, sf, "orders").select("o_orderkey", parsing.number(F.when(c("o_orderkey") % 9 == 0, "n/a").otherwise(F.concat(F.lit(" ₹"), F.format_number("o_totalprice", 2), F.lit(" %")))).alias("amount"))
    ),
    "SELECT o_orderkey, CASE WHEN o_orderkey%9=0 THEN NULL ELSE round(o_totalprice,2)+0.0::double END AS amount FROM orders",
)
