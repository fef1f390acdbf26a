"""Indicators against direct recomputation and hand cases."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import indicators as ind, rules
from barloom.functions.windows import Ema, Long, span, with_ema, with_long, with_row_number
from tests.conftest import BAR_SCHEMA, wave


def frame(spark, rows):
    return with_row_number(spark.createDataFrame(rows, BAR_SCHEMA))


def flat(closes):
    start = dt.date(2020, 1, 1)
    return [("A", start + dt.timedelta(days=i), c, c + 1, c - 1, c, 1000.0) for i, c in enumerate(map(float, closes))]


@pytest.mark.parametrize("closes,want", [(range(100), 100.0), ([10] * 40, 50.0), (range(100, 0, -1), 0.0)])
def test_rsi_extremes(spark, closes, want):
    df = ind.compose(frame(spark, flat(closes)), ind.rsi())
    last = df.orderBy(F.desc("rn")).first()
    assert last.rsi == pytest.approx(want)


def test_means_survive_long_series(spark):
    """Blocks restart the weights: no overflow and no drift over 20,000 rows."""
    n = 20_000
    x = np.cos(np.arange(n)) * 10 + 100
    df = with_row_number(spark.createDataFrame(pd.DataFrame({"symbol": "A", "date": np.arange(n), "x": x})))
    out = with_ema(df, [span("fast", "x", 9), span("slow", "x", 200), Ema("third", "x", 1 / 3)]).toPandas().sort_values("rn")
    s = pd.Series(x)
    for name, alpha in (("fast", 0.2), ("slow", 2 / 201), ("third", 1 / 3)):
        want = s.ewm(alpha=alpha, adjust=False).mean()
        assert np.allclose(out[name].to_numpy(), want.to_numpy(), rtol=1e-10)


@pytest.mark.parametrize("n", [1, 2, 3, 400, 2000, 5000])
def test_means_of_any_span(spark, n):
    import numpy as np

    x = 100 + np.cumsum(np.random.default_rng(n).standard_normal(50_000)) / 10
    df = with_row_number(spark.createDataFrame([("A", i, float(v)) for i, v in enumerate(x)], "symbol string, date int, x double"))
    got = with_ema(df, [span("e", "x", n)]).select("rn", "e").toPandas().sort_values("rn")["e"].to_numpy()
    alpha, want, level = 2 / (n + 1), [], x[0]
    for v in x:
        level += alpha * (v - level)
        want.append(level)
    assert np.allclose(got, want, rtol=1e-9, atol=0)


def test_one_bad_reading_spoils_only_its_frames(spark):
    rows = [("A", i, float("inf") if i == 50 else float("nan") if i == 60 else float(i % 7)) for i in range(2000)]
    df = with_row_number(spark.createDataFrame(rows, "symbol string, date int, x double"))
    got = with_long(df, [Long("m", "x", 100, "avg"), Long("s", "x", 100, "sd"), Long("h", "x", 100, "max")]).toPandas().sort_values("rn")
    late = got[got.rn >= 160]
    assert late[["m", "s", "h"]].notna().all().all() and late.m.iloc[0] == pytest.approx(sum(i % 7 for i in range(61, 161)) / 100)
    assert got[(got.rn >= 99) & (got.rn < 150)].m.isna().all()


def test_long_frames_equal_sliding_windows(spark):
    df = frame(spark, wave(600))
    out = with_long(df, [Long("hi", "high", 252, "max"), Long("lo", "low", 100, "min", False), Long("m", "close", 200, "avg"), Long("sd", "close", 120, "sd")])
    p = out.toPandas().sort_values("rn").reset_index(drop=True)
    assert np.allclose(p.hi, p.high.rolling(252).max(), equal_nan=True)
    assert np.allclose(p.lo, p.low.rolling(100, min_periods=1).min())
    assert np.allclose(p.m, p.close.rolling(200).mean(), equal_nan=True)
    assert np.allclose(p.sd, p.close.rolling(120).std(), equal_nan=True, rtol=1e-6)


def test_directional_move_is_exclusive(spark):
    """An outside day counts for the larger side only; equal moves count for none."""
    rows = [("A", dt.date(2020, 1, 1), 95.0, 100.0, 90.0, 95.0, 1.0), ("A", dt.date(2020, 1, 2), 100.0, 110.0, 85.0, 100.0, 1.0)]
    r = ind.compose(frame(spark, rows), ind.adx()).orderBy("rn").collect()[1]
    assert (r.pdm, r.mdm) == (10.0, 0.0)
    rows[1] = ("A", dt.date(2020, 1, 2), 95.0, 110.0, 80.0, 95.0, 1.0)
    r = ind.compose(frame(spark, rows), ind.adx()).orderBy("rn").collect()[1]
    assert (r.pdm, r.mdm) == (0.0, 0.0)


def test_cci_by_hand(spark):
    p = ind.compose(frame(spark, wave(40)), ind.cci()).toPandas().sort_values("rn").reset_index(drop=True)
    tp = (p.high + p.low + p.close) / 3
    want = (tp - tp.rolling(20).mean()) / (0.015 * tp.rolling(20).apply(lambda x: np.abs(x - x.mean()).mean()))
    assert np.allclose(p.cci, want, equal_nan=True)


def test_future_bars_never_change_the_past(spark):
    rows = wave(300)
    names = ["rsi_cross_50", "macd_crossover", "psar_bull_flip", "supertrend_bull_flip", "bb_squeeze_breakout"]
    book = {n: rules.RULES[n] for n in names}
    whole = rules.with_rules(frame(spark, rows), book).where("rn < 200").select("rn", *names).orderBy("rn").collect()
    cut = rules.with_rules(frame(spark, rows[:200]), book).select("rn", *names).orderBy("rn").collect()
    assert whole == cut


def test_same_result_for_any_partitioning(spark):
    rows = wave(120, "A") + wave(150, "B") + wave(90, "C")
    got = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = ind.with_supertrend(ind.compose(frame(spark, rows), ind.macd(), ind.adx()))
        got.append(df.select("symbol", "rn", "macd_hist", "adx", "st_line").orderBy("symbol", "rn").collect())
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got[0] == got[1]


def test_layers_share_one_exchange(spark):
    df = ind.compose(frame(spark, wave(60)), ind.macd(), ind.adx(), ind.obv(), ind.keltner())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_user_rule_can_be_added(spark):
    book = {}
    rules.add_rule("up", rules.Rule(lambda: F.col("close") > F.col("open")), book)
    with pytest.raises(ValueError):
        rules.add_rule("up", book["up"], book)
    assert len(rules.RULES) == 60
    assert rules.with_rules(frame(spark, wave(5)), book).agg(F.sum("up")).first()[0] == 0


def test_state_scans_of_one_long_series(spark):
    """50,000 bars of one symbol, in several Arrow batches, equal a plain loop."""
    import numpy as np

    close = 100 + np.cumsum(np.random.default_rng(3).standard_normal(50_000)) / 5
    rows = [("A", i, float(c), float(c + 1), float(c - 1), float(c), 1.0) for i, c in enumerate(close)]
    df = with_row_number(spark.createDataFrame(rows, "symbol string, date int, open double, high double, low double, close double, volume double"))
    got = ind.with_parabolic_sar(df).select("rn", "psar", "psar_dir").toPandas().sort_values("rn")
    sar, ep, af, bull = close[0] - 1, close[0] + 1, 0.02, True
    want = [(sar, 1)]
    for i in range(1, len(close)):
        h, l = close[i] + 1, close[i] - 1
        sar += af * (ep - sar)
        two = (i - 1, max(i - 2, 0))
        sar = min(sar, *(close[k] - 1 for k in two)) if bull else max(sar, *(close[k] + 1 for k in two))
        if (l < sar) if bull else (h > sar):
            bull, sar, ep, af = not bull, ep, l if bull else h, 0.02
        elif (h > ep) if bull else (l < ep):
            ep, af = h if bull else l, min(af + 0.02, 0.2)
        want.append((sar, 1 if bull else -1))
    assert np.allclose(got["psar"], [w[0] for w in want]) and got["psar_dir"].tolist() == [w[1] for w in want]
