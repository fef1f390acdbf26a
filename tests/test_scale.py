"""Steps whose partitions, shuffles or rounds have to follow the size of the input."""

import numpy as np
import pytest

from barloom.functions import scoring
from barloom.operators import boosting, ranking
from barloom.plans import scan, tables


def test_bars_are_dealt_over_partitions_that_grow_with_the_trades(spark, sf, monkeypatch):
    monkeypatch.setattr(tables, "TRADES", 500)  # 6,000 trades
    n = -(-tables.read(spark, sf, "lineitem").count() // 500)
    assert tables.parts(spark, sf) == n > int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = tables.bars(spark, sf)
    assert df.rdd.getNumPartitions() == n
    wide = scoring.with_technicals(df)  # two Python scans, each followed by an exchange
    assert wide.select("symbol", "rsi", "psar").rdd.getNumPartitions() == n


def test_stored_bars_and_scores_keep_their_partitions(spark, sf, monkeypatch):
    monkeypatch.setattr(tables, "TRADES", 500)
    monkeypatch.setattr(tables, "_STORED", {})
    t = tables.stored(spark, sf)
    assert t.store.buckets == tables.parts(spark, sf) == t.bars.rdd.getNumPartitions()
    assert scan.scan(spark, sf).select("symbol", "score100").rdd.getNumPartitions() == t.store.buckets


@pytest.mark.parametrize("wanted", [0, 50_000])
def test_quantiles_look_only_at_the_buckets_that_hold_them(spark, monkeypatch, wanted):
    monkeypatch.setattr(ranking, "WANTED", wanted)
    rng = np.random.default_rng(3)
    values = {"a": np.concatenate([rng.normal(size=999), np.zeros(300)]), "b": np.array([7.5]), "c": rng.integers(-3, 3, 500).astype(float)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None), ("d", None)], "k string, v double")
    shares = {"lo": 0.025, "mid": 0.5, "hi": 1.0}
    out = ranking.exact_quantiles(df, ["k"], "v", shares)
    got = {r.k: r for r in out.collect()}
    assert set(got) == {"a", "b", "c"}
    for k, vs in values.items():
        assert np.allclose([got[k][o] for o in shares], np.quantile(vs, list(shares.values())), rtol=0, atol=1e-12)
    if wanted:
        assert "SortMergeJoin" not in out._jdf.queryExecution().sparkPlan().toString()


def test_sums_by_node_feature_and_bin_equal_plain_ones():
    rng = np.random.default_rng(5)
    sizes, nodes, n = np.array([2, 9, 1, 2, 30]), 5, 4000
    starts = np.concatenate([[0], np.cumsum(sizes)])
    node = np.sort(rng.choice([0, 1, 3, 4], n))  # no row in node 2
    bins = np.column_stack([rng.integers(0, s, n) for s in sizes]).astype(np.uint8)
    values = np.stack([rng.integers(-(2**33), 2**33, n), rng.integers(0, 2**31, n), np.ones(n)]).astype(float)
    total, plain = np.zeros((3, nodes, starts[-1]), np.int64), np.zeros((3, nodes, starts[-1]), np.int64)
    boosting.add_sums(total, starts, sizes, node, bins, values)
    for f in range(len(sizes)):
        for k in range(3):
            np.add.at(plain[k], (node, starts[f] + bins[:, f]), values[k].astype(np.int64))
    assert (total == plain).all()
