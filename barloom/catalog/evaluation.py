"""Replay reports, session VWAP and the intraday scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.archive import when
from barloom.catalog.base import register, tidy
from barloom.catalog.oracle import query
from barloom.functions import outcomes as out
from barloom.functions.scoring import rnd
from barloom.operators.lineage import materialize
from barloom.plans import evaluation, tables
from barloom.plans.tables import bars, read

c = F.col


def ticks(spark, sf):
    return read(spark, sf, "events").select(c("event_type").alias("symbol"), "ts", c("value").alias("price"), (c("user_id") % 7 + 1).cast("double").alias("volume"), "event_id")


register(
    "w13_session_vwap",
    lambda spark, sf: tidy(evaluation.session_vwap(ticks(spark, sf)).select("event_id", "symbol", rnd("vwap", 4).alias("vwap"))),
    query("tk AS (SELECT event_type AS symbol, ts, value AS price, (user_id%7+1)::double AS volume, event_id FROM events), tw AS (SELECT event_id, symbol, sum(price*volume) OVER w/sum(volume) OVER w AS v FROM tk WINDOW w AS (PARTITION BY symbol, cast(ts AS date) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))",
          "SELECT event_id, symbol, cast(round(cast(v AS decimal(24,8)),4) AS double)+0.0::double AS vwap FROM tw"),
)
register("p48_intraday_scan", lambda spark, sf: tidy(evaluation.intraday_scan(ticks(spark, sf)).withColumn("ts", when(c("ts")))))


def _trades(spark, sf):
    t = tables.stored(spark, sf)
    return evaluation.expectancy_trades(t.bars, t.context, t.bounded)


register("c07_regime_score_table", lambda spark, sf: tidy(evaluation.expectancy_table(materialize(_trades(spark, sf)))))
register("x08_signal_capture", lambda spark, sf: tidy(evaluation.captured_signals(tables.stored(spark, sf).bars).select("symbol", "date", "score", "entry", "atr", "sl", "t1", F.size("path").alias("path_bars"))))
register(
    "v02_pluggable_exit",
    lambda spark, sf: tidy(out.sweep(evaluation.captured_signals(tables.stored(spark, sf).bars), [out.Exit("wide trail", "trail", 42, 5.0)]).select("symbol", "date", "variant", "ret")),
)
