"""Queries that once left out part of their rows: the screen and the backtest, on rows of their own."""

from barloom.catalog.factors import screened
from barloom.catalog.outcomes import backtest_metrics, path_trades
from barloom.functions.windows import with_row_number
from tests.conftest import BAR_SCHEMA, wave


def test_screen_keeps_what_the_picks_leave_out(spark):
    rows = [("both", 1.3, 2.0), ("flat", 1.05, 2.0), ("weak", 1.3, -5.0), ("low", 0.9, 2.0), ("gone", 1.3, -101.0)]
    df = spark.createDataFrame(
        [(s, True, 1e6, v, True, True, rs, 1.0, -5.0) for s, v, rs in rows],
        "symbol string, tradeable boolean, median_turnover double, vol_expansion double, above_ema50 boolean, above_ema200 boolean, rs_vs_index double, ret_3m double, from_high double",
    )
    assert {r.symbol: r.picked for r in screened(df).collect()} == {"both": True, "flat": False, "weak": False}


def test_every_bar_is_traded_and_signals_are_marked(spark):
    bars = spark.createDataFrame(wave(150), BAR_SCHEMA)
    scored = "date", "symbol", "open", "high", "low", "close", "rn * 0.5D AS score100", "close - 1.5D AS sl_buy", "close + 3D AS target1"
    log = with_row_number(bars).selectExpr(*scored, "rn", "_b19", "_b16", "_b8", "_b1", "_b0")
    trades = path_trades(log).cache()
    got = {r.rn: r.signal for r in trades.collect()}
    assert min(got) == 49 and max(got) == 148 and len(got) > 90
    # 150 bars: the span is 69 to 128, a score of 55 begins at 110.
    assert {n for n, s in got.items() if s} == {n for n in got if 110 <= n < 129}
    r = backtest_metrics(trades).first()
    assert r.sample_count == len(got) and r.signal_sample_count == sum(got.values())
    alone = backtest_metrics(trades.where("rn < 100")).first()
    assert alone.sample_count == sum(n < 100 for n in got) and alone.signal_sample_count == 0 and alone.signal_win_rate is None
