"""The registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, norm

# One query per family; check.py runs all of them.
PICKED = [
    "d01_daily_bars", "w06_macd", "w10_supertrend", "w18_parabolic_sar", "w28_candlestick_labels", "w35_weekly_trend", "s57_elder_triple_screen",
    "p13_score", "x01_path_outcome_gap_aware", "x16_reseeded_replay", "x27_position_rebuild", "c12_exit_rule_evaluation", "c14_score_validation",
    "a30_validate_bars", "j05_as_of_events", "j08_first_bar_after", "u01_tick_bars", "u05_crossing_alerts", "p45_pullback_verdict",
]


def test_names_line_up():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(queries) > 300


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", PICKED)
def test_query_equals_sql(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=str)
    assert got == want


def test_flagship(spark):
    assert entry.entry(spark).count() == 10
