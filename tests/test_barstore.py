"""Snapshots of bars, and plans that read them without moving them."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from barloom.functions import indicators as ind
from barloom.functions.windows import with_row_number
from barloom.plans import scan, tables
from barloom.sources.barstore import BarStore
from tests.conftest import BAR_SCHEMA, wave


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merges_make_new_versions(spark, tmp_path):
    first = spark.createDataFrame([r for s in "ABC" for r in wave(20, s)], BAR_SCHEMA)
    store = BarStore(spark, str(tmp_path), 3)
    assert store.write(first) == 0
    day = dt.date(2020, 1, 20)
    batch = [("A", day, 1.0, 1.0, 1.0, 1.0, 1.0), ("D", day, 2.0, 2.0, 2.0, 2.0, 2.0), ("A", dt.date(2020, 1, 21), 3.0, 3.0, 3.0, 3.0, 3.0)]
    assert store.merge(spark.createDataFrame(batch, BAR_SCHEMA)) == 1
    newest = {(r.symbol, r.date): r.close for r in store.read().collect()}
    assert len(newest) == 62 and newest[("A", day)] == 1.0 and newest[("A", dt.date(2020, 1, 21))] == 3.0 and newest[("D", day)] == 2.0
    assert store.read(0).count() == 60 and store.read(0).where("symbol = 'D'").count() == 0
    assert store.merge(spark.createDataFrame(batch[1:2], BAR_SCHEMA), 0) == 2
    assert [(r.version, r.parent, r.n, r.symbols) for r in store.manifest().orderBy("version").collect()] == [(0, None, 60, 3), (1, 0, 62, 4), (2, 1, 61, 4)]
    assert sorted(map(tuple, BarStore(spark, str(tmp_path)).read(1).collect())) == sorted(map(tuple, store.read(1).collect()))


def test_repeated_bars_and_unknown_versions_are_errors(spark, tmp_path):
    bars = spark.createDataFrame(wave(3), BAR_SCHEMA)
    store = BarStore(spark, str(tmp_path))
    with pytest.raises(ValueError):
        store.read()
    with pytest.raises(Exception, match="duplicate symbol date"):
        store.write(bars.union(bars))
    store.write(bars.limit(0))
    assert store.read().count() == 0


def test_stored_bars_do_not_move_for_windows_and_merges(spark, tmp_path):
    store = BarStore(spark, str(tmp_path), 4)
    store.write(spark.createDataFrame([r for s in "ABCDE" for r in wave(90, s)], BAR_SCHEMA))
    df = ind.compose(with_row_number(store.read()), ind.emas(9, 21), ind.macd(), ind.atr(14))
    assert "Exchange" not in plan(df)
    days = spark.createDataFrame([("A", [dt.date(2020, 1, 1)])], "symbol string, _days array<date>")
    kept = store.read().join(days, "symbol", "left").where(F.col("_days").isNull() | ~F.array_contains("_days", F.col("date")))
    assert not re.search(r"Exchange hashpartitioning\(symbol#\d+, 4\).*\n.*FileScan", plan(kept))
    assert kept.count() == 449


def test_scan_reads_trades_once_and_bars_do_not_move_by_date(spark, sf):
    first = tables.stored(spark, sf)
    assert tables.stored(spark, sf) is first and first.bounded
    for df in (scan.scan_newest(spark, sf, "2001-11-04 14:00:00"), scan.scan(spark, sf)):
        text = plan(df)
        assert "lineitem" not in text and not re.search(r"hashpartitioning\(date", text)
    newest = scan.scan_newest(spark, sf, "2001-11-04 14:00:00").select("symbol", "rn", "score100", "base_points")
    every = scan.scan(spark, sf).select("symbol", "rn", F.col("score100").alias("s"), F.col("base_points").alias("p"))
    same = newest.join(every, ["symbol", "rn"]).where("score100 <=> s and base_points <=> p").count()
    assert same == newest.count() == first.bars.select("symbol").distinct().count()


def test_long_index_is_not_broadcast(spark, sf, monkeypatch):
    monkeypatch.setattr(tables, "SESSIONS", 10)
    t = tables.stored(spark, sf)
    assert not t.bounded
    hints = scan.technical_rows(t.bars, t.index, t.bounded)._jdf.queryExecution().analyzed().toString()
    assert "strategy=broadcast" not in hints
