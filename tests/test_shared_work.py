"""Steps that must not be done twice, or carried along where nothing reads them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from barloom.catalog import factors, learning
from barloom.functions import indicators as ind, outcomes, rules
from barloom.functions.windows import roll, with_row_number
from barloom.plans import scan
from tests.conftest import BAR_SCHEMA, wave


def nodes(plan, name):
    out, waiting = [], [plan]
    while waiting:
        n = waiting.pop()
        if n.nodeName() == name:
            out.append(n)
        waiting += [n.children().apply(i) for i in range(n.children().size())]
    return out


def windows(df):
    """Output columns and number of functions of each window of the optimised plan."""
    found = nodes(df._jdf.queryExecution().optimizedPlan(), "Window")
    return [({n.output().apply(i).name() for i in range(n.output().size())}, n.windowExpressions().size()) for n in found]


def test_reference_and_index_columns_are_not_carried_through_the_windows_of_the_scan(spark, sf):
    found = windows(scan.scan(spark, sf).select("symbol", "date", "score100"))
    assert found and not any(cols & {"fund_score", "quality_score", "fii_signal", "regime", "above_200"} for cols, _ in found)


def test_repeated_reference_rows_are_found(spark):
    rows = [("A", 1.0), ("B", 2.0), (None, 3.0)]
    assert scan._single(spark.createDataFrame(rows, "symbol string, roe double"))
    assert not scan._single(spark.createDataFrame([*rows, ("B", 2.0)], "symbol string, roe double"))


def test_the_screening_result_is_derived_once_before_it_is_ordered(spark, sf):
    df = factors.swing_scan(spark, sf)
    assert not windows(df) and not nodes(df._jdf.queryExecution().optimizedPlan(), "ArrowEvalPython")


def test_the_split_counts_read_a_written_table(spark, sf):
    assert not windows(learning._split(spark, sf))


def test_rules_share_their_looks_at_the_bar_before(spark):
    df = with_row_number(spark.createDataFrame(wave(30), BAR_SCHEMA))
    rule = rules.Rule(lambda: (F.col("close") > rules.lag("close")) & (rules.lag("close") > rules.lag("open")))
    out = rules.with_rules(df, {"a": rule, "b": rule, "c": rule})
    assert sum(n for _, n in windows(out)) == 1 + 2  # the row number, and one lag of each column
    assert set(out.columns) - set(df.columns) == {"a", "b", "c"}


@pytest.mark.parametrize("n", [26, 52])
def test_long_extremes_equal_plain_rolls_with_gaps(spark, n):
    rows = [(*r[:3], None if i in (70, 71, 130) else r[3], None if i == 100 else r[4], *r[5:]) for i, r in enumerate(wave(220))]
    df = with_row_number(spark.createDataFrame(rows, BAR_SCHEMA))
    out = ind.compose(df, ind.ichimoku())
    name = {26: "kijun", 52: "span52"}[n]
    plain = (roll(F.max, "high", n) + roll(F.min, "low", n)) / 2.0
    got = out.select(F.col(name).alias("got"), plain.alias("want")).collect()
    assert all(r.got == r.want for r in got) and 0 < sum(r.want is None for r in got) < 220
    assert not any(f" BETWEEN {n - 1} PRECEDING" in str(f) for f in ind.ichimoku()["a"].values())


def test_path_trades_equal_a_loop(spark):
    random.seed(4)
    some = lambda lo, hi: None if random.random() < 0.05 else round(random.uniform(lo, hi), 2)
    data = []
    for i in range(400):
        path = [(some(96, 104), some(100, 106), some(94, 100), some(96, 104)) for _ in range(random.randint(0, 6))]
        data.append((i, 95.5, 104.5, path))
    df = spark.createDataFrame(data, "id int, sl double, t1 double, path array<struct<open:double,high:double,low:double,close:double>>")
    for gaps in (True, False):
        out = outcomes.with_path_trade(df, "path", "sl", "t1", gaps)
        assert out._jdf.queryExecution().optimizedPlan().toString().count("lambdafunction") <= 2
        for r, (_, sl, t1, path) in zip(out.orderBy("id").collect(), data):
            entry = path[0][0] * 1.0005 if path and path[0][0] else None
            if entry is None:
                assert (r.outcome, r.ret, r.mae, r.mfe) == (None,) * 4
                continue
            outcome, price, held, gap = "timeout", path[-1][3], len(path), None
            for k, (o, h, l, _) in enumerate(path, 1):
                at_open = gaps and o is not None and (o <= sl or o >= t1)
                if at_open or (l is not None and l <= sl) or (h is not None and h >= t1):
                    if gaps and o is None:  # the range was reached, the open is not known
                        at_open = None
                    stop = o <= sl if at_open else l is not None and l <= sl
                    outcome, price, held = "sl" if stop else "t1", o if at_open else sl if stop else t1, k - bool(at_open)
                    gap = (o / entry - 1) * 100 if at_open else None
                    break
            assert r.outcome == outcome
            if price is not None:
                assert math.isclose(r.ret, ((price * 0.9995 - entry) / entry - outcomes.CHARGES) * 100, rel_tol=1e-9)
            lows = [(x[2] - entry) / entry * 100 for x in path[:held] if x[2] is not None]
            highs = [(x[1] - entry) / entry * 100 for x in path[:held] if x[1] is not None]
            assert r.mae == min([0.0, *lows, *([gap] if gap is not None else [])])
            assert r.mfe == max([0.0, *highs, *([gap] if gap is not None else [])])


def test_positions_sort_their_fills_once(spark, monkeypatch):
    from barloom.operators import portfolio, segmented

    rows = [(s, i // 3, i % 3, "SELL" if i % 4 == 3 else "BUY", 5 + i % 7, 10.0 + i) for s in ("A", "B", None) for i in range(200)]
    fills = spark.createDataFrame(rows, "symbol string, day int, seq int, side string, qty long, price double")
    sorts, plain = [], segmented.placed

    def counted(df, keys, order, name="_at"):
        sorts.append(df.columns)
        return plain(df, keys, order, name)

    monkeypatch.setattr(segmented, "placed", counted)
    if hasattr(portfolio, "placed"):
        monkeypatch.setattr(portfolio, "placed", counted)
    got = portfolio.positions(fills).where("symbol IS NULL").orderBy("day", "seq").collect()
    assert sum("price" in columns for columns in sorts) == 1
    held, cost = 0, 0.0
    for r, (_, _, _, side, qty, price) in zip(got, rows[-200:], strict=True):
        sold = min(qty, held)
        cost = cost + qty * price if side == "BUY" else cost * (1 - sold / held) if held else cost
        held += qty if side == "BUY" else -sold
        assert r.held == held and (r.avg_price is None if not held else math.isclose(r.avg_price, cost / held, rel_tol=1e-9))


def test_arrays_of_readings_do_not_pass_the_windows_of_the_means(spark):
    df = with_row_number(spark.createDataFrame(wave(30), BAR_SCHEMA))
    out = ind.compose(df, ind.cci(), ind.swing_levels(), ind.emas(9, 50)).select("cci", "breakout_level", "key_support", "e9", "e50")
    means = [cols for cols, _ in windows(out) if cols & {"_p_e9", "_p_e50", "_c_e9"}]
    assert means and not any(cols & {"tp20", "swing_highs", "swing_lows"} for cols in means)
