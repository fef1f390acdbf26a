"""Running values over blocks against plain loops, with one key of nearly all rows."""

import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import segmented
from barloom.operators.segmented import Scan, affine, scan


def rows(n=3000, seed=3):
    draw = random.Random(seed)
    return [(("hot" if draw.random() < 0.9 else draw.choice(["a", "b", None])), i, draw.choice([None, draw.randint(-50, 50)])) for i in range(n)]


@pytest.mark.parametrize("block", [4, 64, 1 << 12])
def test_scans_equal_loops(spark, block):
    data = rows(1200 if block == 4 else 3000)
    df = spark.createDataFrame(data, "k string, i int, x int").repartition(5)
    kinds = ("sum", "count", "min", "max", "first", "last")
    scans = [Scan(f"{k}_{int(inc)}", k, F.col("x"), inc) for k in kinds for inc in (True, False)]
    got = {(r.k, r.i): r for r in scan(df, ["k"], [F.col("i")], scans, block).collect()}
    assert len(got) == len(data)
    seen = {}
    for k, i, x in data:
        before = seen.setdefault(k, [])
        for inc, values in ((0, before), (1, before + ([x] if x is not None else []))):
            want = (sum(values), len(values), min(values, default=None), max(values, default=None), values[0] if values else None, values[-1] if values else None)
            assert tuple(got[(k, i)][f"{kind}_{inc}"] for kind in kinds) == want
        if x is not None:
            before.append(x)


def test_hot_key_is_spread_over_blocks(spark):
    df = spark.createDataFrame(rows(4000), "k string, i int, x int")
    out = scan(df, ["k"], [F.col("i")], [Scan("s", "sum", F.col("x"))], 64)
    placed = segmented.placed(df, ["k"], [F.col("i")])
    most = placed.groupBy(F.floor(F.col("_at") / 64)).count().agg(F.max("count")).first()[0]
    assert most <= 64 and out.count() == 4000
    assert "Window" in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [8, 256])
def test_affine_maps_equal_a_loop(spark, block):
    draw = random.Random(9)
    data = [("hot" if draw.random() < 0.9 else draw.choice("ab"), i, draw.choice([1.0, 0.5, 0.0, 0.99, 0.75]), draw.uniform(0, 10)) for i in range(900)]
    df = spark.createDataFrame(data, "k string, i int, keep double, add double").repartition(3)
    got = {(r.k, r.i): (r.y, r.y0) for r in affine(df, ["k"], [F.col("i")], F.col("keep"), F.col("add"), "y", "y0", block).collect()}
    now = {}
    for k, i, keep, add in data:
        before = now.get(k, 0.0)
        now[k] = keep * before + add
        assert got[(k, i)] == (pytest.approx(now[k], rel=1e-12, abs=1e-12), pytest.approx(before, rel=1e-12, abs=1e-12))


def test_no_keys_and_no_rows(spark):
    df = spark.createDataFrame([(i, 1) for i in range(100)], "i int, x int")
    out = scan(df, [], [F.col("i").desc()], [Scan("n", "count", F.lit(1))], 8).collect()
    assert {r.i: r.n for r in out} == {i: 100 - i for i in range(100)}
    assert scan(df.limit(0), ["x"], [F.col("i")], [Scan("n", "sum", F.col("x"))]).count() == 0
    assert affine(df.limit(0), ["x"], [F.col("i")], F.lit(1.0), F.lit(1.0), "y").count() == 0


def test_more_keys_than_a_block_holds(spark):
    """The levels end however many keys there are, and where a key's two rows lie on both sides of a border of blocks."""
    data = [(k, i, k + i) for k in range(40) for i in range(2 if k == 7 else 1)]
    df = spark.createDataFrame(data, "k int, i int, x int")
    got = {(r.k, r.i): (r.s, r.n) for r in scan(df, ["k"], [F.col("i")], [Scan("s", "sum", F.col("x")), Scan("n", "count", F.lit(1), False)], 8).collect()}
    assert got == {(k, i): (15 if (k, i) == (7, 1) else k, i) for k, i, _ in data}
    maps = {(r.k, r.i): (r.y, r.y0) for r in affine(df, ["k"], [F.col("i")], F.lit(0.5), F.col("x"), "y", "y0", 8).collect()}
    assert maps == {(k, i): ((11.5, 7.0) if (k, i) == (7, 1) else (float(k), 0.0)) for k, i, _ in data}


def test_sort_with_more_partitions_than_rows_of_a_key(spark):
    """A level that leaves as many summaries as it got is the last one."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        df = spark.range(60).select(F.lit("a").alias("k"), F.col("id").alias("i"))
        assert {r.i: r.s for r in scan(df, ["k"], [F.col("i")], [Scan("s", "sum", F.col("i"))], 2).collect()} == {i: i * (i + 1) // 2 for i in range(60)}
        assert {r.i: r.y for r in affine(df, ["k"], [F.col("i")], F.lit(1.0), F.col("i"), "y", block=2).collect()} == {i: i * (i + 1) / 2 for i in range(60)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
