"""Outcome, exit and replay operators on hand-made bars."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import outcomes as out, reseeded, scoring
from barloom.functions.windows import with_row_number
from tests.conftest import BAR_SCHEMA, wave

DAY = dt.date(2020, 1, 1)


def bars(spark, values):
    rows = [("A", DAY + dt.timedelta(days=i), *map(float, v)) for i, v in enumerate(values)]
    return with_row_number(spark.createDataFrame(rows, BAR_SCHEMA))


FLAT = (100, 101, 99, 100, 1000)


def test_cost_model():
    assert out.ROUND_TRIP * 100 == pytest.approx(out.ROUND_TRIP_PCT, abs=5e-4)


def test_gap_through_the_stop_fills_at_the_open(spark):
    v = [FLAT] * 40
    v[5] = (80, 82, 79, 81, 1000)
    df = out.with_trade(bars(spark, v).withColumns({"sl": F.lit(95.0), "t1": F.lit(110.0)}), "sl", "t1", 21, True)
    r = df.where("rn = 3").first()
    entry = 100 * (1 + out.SLIPPAGE)
    assert r.outcome == "sl"
    assert r.ret == pytest.approx(((80 * (1 - out.SLIPPAGE)) / entry - 1 - out.CHARGES) * 100)


def test_ambiguous_bar_is_not_a_win_and_entry_is_next_open(spark):
    v = [FLAT] * 30
    v[1] = (100, 105, 95, 100, 1000)
    df = out.with_target_label(bars(spark, v))
    assert df.where("rn = 0").first().label == 0
    assert df.where("rn = 29").first().label is None
    v = [(120, 121, 119.5, 120, 1000)] * 30
    v[0] = FLAT
    assert out.with_target_label(bars(spark, v)).where("rn = 0").first().label == 0


@pytest.mark.parametrize("hole,status", [(8, "observed_with_interior_gap"), (21, "unresolved_exit"), (1, "unknown_entry"), (None, "observed")])
def test_fixed_horizon_status(spark, hole, status):
    v = [(100, 105, 95, 102, 1000)] * 40
    df = bars(spark, v)
    if hole is not None:
        df = df.withColumn("volume", F.when(F.col("rn") == hole, None).otherwise(F.col("volume")))
    r = out.with_fixed_horizon(df).where("rn = 0").first()
    assert r.status == status
    if status.startswith("observed"):
        assert r.fixed_ret == pytest.approx(2 - 0.5582)
    else:
        assert r.fixed_ret is None


def test_rounding_at_the_high_is_tolerated(spark):
    near = bars(spark, [(124, 124.46323394775389, 123, 124.4632339477539, 10), (124, 124.45, 123, 124.4632339477539, 10)])
    got = near.select(out.valid_bar_tolerant().alias("v")).collect()
    assert [r.v for r in got] == [True, False]


def test_user_exit_runs_with_the_others(spark):
    df = bars(spark, [FLAT] * 80).withColumn("path", out.path(63)).where("rn = 0")
    sig = df.select("symbol", "date", F.lit(100.0).alias("entry"), F.lit(1.0).alias("atr"), F.lit(97.0).alias("sl"), F.lit(106.0).alias("t1"), "path")
    got = out.sweep(sig, [*out.EXITS, out.Exit("mine", "trail", 63, 0.5)]).collect()
    assert len(got) == len(out.EXITS) + 1 == 18
    by = {r.variant: r.ret for r in got}
    assert by["time only h5"] == pytest.approx(-out.ROUND_TRIP * 100)
    assert by["mine"] == pytest.approx((99.5 / 100 - 1 - out.ROUND_TRIP) * 100)


def test_reseeded_kernel_equals_the_whole_series_when_the_window_is_the_series(spark):
    rows = [tuple(r) for r in wave(260)]
    df = with_row_number(spark.createDataFrame(rows, BAR_SCHEMA))
    whole = scoring.with_base_signal(scoring.with_technicals(df)).where("rn = 150").first()
    cut = reseeded.replay_inputs(df, back=150, start=150, step=3, tail=5).where("rn = 150").first()
    for name in ("r_ema9", "r_ema21", "r_ema50", "r_rsi", "r_macd_hist", "r_macd_prev", "r_atr", "adx", "plus_di", "minus_di", "st_dir", "obv_trend",
                 "days_above_ema21", "stage", "ema50_dist_pct", "atr_ratio", "breakout_watch", "near_high_pct", "sl_base"):
        a, b = whole[name], cut[name]
        assert a == b or a == pytest.approx(b, rel=1e-9), name


def test_score_ignores_reward_risk(spark, sf):
    from barloom.plans import scan, tables

    df = scan.scan(spark, sf)
    a = df.agg(F.min("score100").alias("lo"), F.max("score100").alias("hi")).first()
    assert 0 <= a.lo and a.hi <= 100
    again = scoring.with_score(df.drop("score100", "score_verdict").withColumns({"rr_ratio": F.lit(10.0), "sl_buy": F.lit(91.0)}).drop(*[c for c in df.columns if c.startswith(("p_", "b_", "cap_"))], "trend_mod", "mom_mod", "regime_cap", "trend_max", "mom_max", "base_max", "score_coverage_pct", "scaled_base", "bonus", "score_cap"))
    same = again.select("symbol", "rn", F.col("score100").alias("s2")).join(df.select("symbol", "rn", "score100"), ["symbol", "rn"])
    assert same.where("NOT (s2 <=> score100)").count() == 0


def test_frames_of_sampled_rows_equal_window_frames(spark):
    from pyspark.sql import Window

    from barloom.functions.windows import frame_array, sampled

    rows = [r for s, n in (("A", 700), ("B", 40), ("C", 257)) for r in wave(n, s)]
    df = with_row_number(spark.createDataFrame(rows, BAR_SCHEMA))
    df = df.withColumn("pick", F.col("rn") % 7 == 3)
    cut = sampled(df, "pick", ("close", "volume"), 200, 63)
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and "ROWS BETWEEN 200" not in plan.upper() and "specifiedwindowframe(RowFrame, 1, 63)" not in plan
    whole = df.select("symbol", "rn", "pick", frame_array(F.col("close"), 201).alias("c"), frame_array(F.col("volume"), 201).alias("v"), out.path(63).alias("p")).where("pick")
    both = cut.join(whole.drop("pick"), ["symbol", "rn"])
    assert both.where("_w_close = c AND _w_volume = v AND path = p").count() == whole.count() == both.count() > 100
    with pytest.raises(ValueError):
        sampled(df, "pick", ("close",), 300)


def test_kernel_sees_few_windows_at_once(monkeypatch):
    """A batch of windows goes through the kernel in slices, with the same values."""
    import pandas as pd

    draw = np.random.default_rng(5)
    close = 100 + draw.normal(0, 1, (1300, 151)).cumsum(axis=1)
    x = close + 1, close - 1, close, draw.uniform(1, 9, close.shape)
    whole, plain, sizes = reseeded.kernel(*x), reseeded.kernel, []
    monkeypatch.setattr(reseeded, "kernel", lambda *a: sizes.append(len(a[0])) or plain(*a))
    got = reseeded.in_slices(tuple(pd.Series(list(v)) for v in x))
    assert max(sizes) <= reseeded.WINDOWS and sum(sizes) == 1300
    pd.testing.assert_frame_equal(got, whole, check_exact=True)
