"""Streaming queries over the event and order tables and their batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.archive import LOG, stamp, when
from barloom.catalog.base import register, tidy
from barloom.catalog.oracle import query
from barloom.plans.tables import read
from barloom.streaming import ticks

c = F.col


def stream(spark, sf, name):
    schema = read(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}*.parquet")


def tick_stream(spark, sf):
    e = stream(spark, sf, "events")
    return e.select(c("event_type").alias("symbol"), c("ts").cast("timestamp").alias("ts"), c("value").alias("price"), (c("user_id") % 7).cast("double").alias("volume"), "event_id")


TK = "tk AS (SELECT event_type AS symbol, ts, value AS price, (user_id%7)::double AS volume, event_id FROM events)"


register(
    "u01_tick_bars",
    lambda spark, sf: tidy(ticks.newest(ticks.run_available(ticks.tick_bars(tick_stream(spark, sf)), "update"), ["symbol", "start"]).withColumn("start", when(c("start")))),
    query(TK, f"SELECT symbol, {stamp('time_bucket(INTERVAL 15 MINUTE, ts)')} AS start, round(arg_min(price, (ts, event_id)),4)+0.0::double AS open, round(max(price),4)+0.0::double AS high, round(min(price),4)+0.0::double AS low, round(arg_max(price, (ts, event_id)),4)+0.0::double AS close, count(*) AS trades FROM tk GROUP BY symbol, time_bucket(INTERVAL 15 MINUTE, ts)"),
)
register(
    "u02_sliding_activity",
    lambda spark, sf: tidy(ticks.newest(ticks.run_available(ticks.sliding_activity(tick_stream(spark, sf)), "update"), ["symbol", "start"]).withColumn("start", when(c("start")))),
    query([TK, "sw AS (SELECT symbol, price, time_bucket(INTERVAL 10 MINUTE, ts)-to_minutes(10*unnest(range(5))::int) AS start FROM tk)"], f"SELECT symbol, {stamp('start')} AS start, count(*) AS n, round(max(price),4)+0.0::double AS hi, round(min(price),4)+0.0::double AS lo FROM sw GROUP BY symbol, sw.start"),
)
def _rescored(spark, sf):
    stream = ticks.closed(tick_stream(spark, sf), "ts", "symbol")
    return tidy(ticks.run_available(ticks.rescored_candles(stream), "append").drop("batch").withColumn("ts", when(c("ts"))))


register("u02_rescored_candles", _rescored)
register(
    "u03_last_prices",
    lambda spark, sf: tidy(ticks.newest(ticks.run_available(ticks.last_prices(tick_stream(spark, sf)), "update"), ["symbol"]).withColumn("ltp_at", when(c("ltp_at")))),
    query(TK, f"SELECT symbol, round(arg_max(price, (ts, event_id)),4)+0.0::double AS ltp, {stamp('max(ts)')} AS ltp_at FROM tk WHERE price>0 GROUP BY 1"),
)


def _live(spark, sf):
    static = read(spark, sf, "events").groupBy(c("event_type").alias("symbol")).agg(F.count("*").alias("logged"))
    joined = ticks.with_live_price(tick_stream(spark, sf), static)
    return tidy(ticks.run_available(joined.select("event_id", "symbol", "price", "logged"), "append").drop("batch"))


register("u04_live_join", _live, query(TK, "SELECT event_id, symbol, round(price,4)+0.0::double AS price, count(*) OVER (PARTITION BY symbol) AS logged FROM tk"))


def _alerts(spark, sf):
    o = stream(spark, sf, "orders")
    cents = F.round(c("o_totalprice") * 100).cast("long")
    rd = o.select(
        F.concat(F.lit("c"), c("o_custkey").cast("string"), F.lit(".NS")).alias("symbol"), c("o_orderkey").alias("id"),
        (c("o_orderdate") + F.make_dt_interval(F.lit(0), (c("o_orderkey") % 24).cast("int"))).cast("timestamp").alias("scanned_at"), (cents % 101).cast("double").alias("score"), (cents % 37).alias("_k"),
    ).where("_k <> 0").drop("_k")
    buckets = max(1 << 8, read(spark, sf, "orders").count() >> 11)  # about 2,000 readings each, however many there are
    return tidy(ticks.run_available(ticks.crossing_alerts(ticks.closed(rd, "scanned_at", "symbol"), buckets=buckets), "append").drop("batch"))


register(
    "u05_crossing_alerts",
    _alerts,
    query(
        [LOG, "ua AS (SELECT symbol, id, scanned_at, cast(scanned_at AS date) AS day, score100 AS score FROM slog WHERE score100 IS NOT NULL)", "ub AS (SELECT symbol, day, arg_max(score, (scanned_at, id)) AS last FROM ua GROUP BY 1,2)", "uc AS (SELECT symbol, day, lag(last) OVER (PARTITION BY symbol ORDER BY day) AS prior FROM ub)",
         "ud AS (SELECT ua.*, prior, row_number() OVER (PARTITION BY ua.symbol, ua.day ORDER BY scanned_at, id) AS k FROM ua JOIN uc USING (symbol, day) WHERE prior<60 AND score>=60)"],
        "SELECT symbol, strftime(day,'%Y-%m-%d') AS day, round(prior,4)+0.0::double AS prev_score, round(score,4)+0.0::double AS score, id FROM ud WHERE k=1",
    ),
)


def _triggers(spark, sf):
    held = read(spark, sf, "events").select(c("event_type").alias("symbol")).union(spark.range(1).select(F.lit(""))).distinct()
    positions = held.withColumns({"sl": F.lit(1.0), "t1": F.lit(300.0), "cost": F.lit(5.0)})
    stream = ticks.closed(tick_stream(spark, sf), "ts", "symbol")
    return tidy(ticks.run_available(ticks.position_triggers(stream, positions), "append").drop("batch").withColumn("ts", when(c("ts"))))


register(
    "u06_position_triggers",
    _triggers,
    query(
        [TK, "s1 AS (SELECT symbol, min(ts) FILTER (WHERE price<=1) AS stop_at, min(ts) FILTER (WHERE price>=300) AS t1_at FROM tk GROUP BY 1)", "s2 AS (SELECT *, coalesce(t1_at<stop_at, t1_at IS NOT NULL) AS hit FROM s1)", "s3 AS (SELECT s2.symbol, t1_at, hit, CASE WHEN hit THEN (SELECT min(ts) FROM tk k WHERE k.symbol=s2.symbol AND k.ts>s2.t1_at AND k.price<=5) ELSE stop_at END AS out_at FROM s2)",
         "s4 AS (SELECT symbol, t1_at AS ts, 'T1_HIT' AS action FROM s3 WHERE hit UNION ALL SELECT symbol, out_at, 'SL_HIT' FROM s3 WHERE out_at IS NOT NULL)"],
        f"SELECT s4.symbol, {stamp('s4.ts')} AS ts, action, round(price,4)+0.0::double AS price FROM s4 JOIN tk ON tk.symbol=s4.symbol AND tk.ts=s4.ts",
    ),
)
register(
    "u07_session_vwap",
    lambda spark, sf: tidy(ticks.newest(ticks.run_available(ticks.session_vwap(tick_stream(spark, sf)), "update"), ["symbol", "day"])),
    query(TK, "SELECT symbol, strftime(ts,'%Y-%m-%d') AS day, round(sum(price*volume)/nullif(sum(volume),0),4)+0.0::double AS vwap FROM tk GROUP BY 1,2"),
)


def _bursts(spark, sf):
    out = ticks.run_available(ticks.bursts(tick_stream(spark, sf)), "complete").drop("batch")
    return tidy(out.withColumns({"start": when(c("start")), "end": when(c("end"))}))


register(
    "u08_session_bursts",
    _bursts,
    query([TK, "mh AS (SELECT *, CASE WHEN ts-lag(ts) OVER (PARTITION BY symbol ORDER BY ts)<=INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS nw FROM tk WHERE dayofweek(ts) BETWEEN 1 AND 5 AND hour(ts)*60+minute(ts) BETWEEN 555 AND 930)", "mg AS (SELECT *, sum(nw) OVER (PARTITION BY symbol ORDER BY ts) AS g FROM mh)"],
          f"SELECT symbol, {stamp('min(ts)')} AS start, {stamp('max(ts)+INTERVAL 30 MINUTE')} AS \"end\", count(*) AS n FROM mg GROUP BY symbol, g"),
)


def _unique(spark, sf):
    t = tick_stream(spark, sf)
    doubled = t.unionByName(tick_stream(spark, sf))
    out = ticks.run_available(ticks.unique_ticks(doubled, ("symbol", "event_id")).select("symbol", "event_id"), "append")
    return tidy(out.groupBy("symbol").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("distinct_n")))


register("u09_unique_ticks", _unique, query(TK, "SELECT symbol, count(*) AS n, count(DISTINCT event_id) AS distinct_n FROM tk GROUP BY 1"))


def _incremental(spark, sf):
    """Log rows appended by a stream, then read back as a table."""
    o = stream(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), "o_orderstatus")
    out = ticks.run_available(o, "append")
    return tidy(out.groupBy("year", "o_orderstatus").agg(F.count("*").alias("n")))


register("u10_incremental_log", _incremental, "SELECT year(o_orderdate) AS year, o_orderstatus, count(*) AS n FROM orders GROUP BY 1,2")


def _losses(spark, sf):
    o = stream(spark, sf, "orders")
    pnl = (F.round(c("o_totalprice") * 100).cast("long") % 1200) - 700
    t = o.select(c("o_orderdate").cast("timestamp").alias("ts"), pnl.alias("pnl"))
    out = ticks.newest(ticks.run_available(ticks.daily_results(t), "update"), ["day"])
    return tidy(out.withColumn("breached", c("pnl") < -900))


register("u11_daily_loss_limit", _losses, "SELECT strftime(o_orderdate,'%Y-%m-%d') AS day, cast(sum(cast(round(o_totalprice*100) AS bigint)%1200-700) AS bigint) AS pnl, cast(sum(cast(round(o_totalprice*100) AS bigint)%1200-700)< -900 AS bigint) AS breached FROM orders GROUP BY 1")
