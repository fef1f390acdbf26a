"""Archive, quality, ranking, portfolio and learning operators."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.windows import with_row_number
from barloom.operators import evaluation, learning, portfolio, quality, ranking
from barloom.sources import archive, parsing
from tests.conftest import BAR_SCHEMA, wave

D = dt.date


def test_snapshot_refuses_overwrite_and_duplicates(spark, tmp_path):
    df = spark.createDataFrame(wave(50), BAR_SCHEMA)
    archive.save_snapshot(df, str(tmp_path / "s"), "vendor", "raw", ["open", "close"])
    assert spark.read.parquet(str(tmp_path / "s/provenance")).first().invalid_rows == 0
    with pytest.raises(Exception):
        archive.save_snapshot(df, str(tmp_path / "s"), "vendor", "raw", ["open", "close"])
    with pytest.raises(ValueError):
        archive.save_snapshot(df, str(tmp_path / "t"), "vendor", "guess", ["open"])
    with pytest.raises(Exception):
        archive.assert_unique(df.unionByName(df)).collect()


def test_upsert_gate(spark):
    old = spark.createDataFrame(wave(2, "A") + wave(2, "B") + wave(2, "C"), BAR_SCHEMA)
    prov = spark.createDataFrame([("A", "v", "raw"), ("B", "v", "raw"), ("C", "other", "raw")], "symbol string, provider string, basis string")
    batch = spark.createDataFrame(wave(3, "A") + wave(1, "B") + wave(2, "C") + wave(2, "N"), BAR_SCHEMA).withColumns({"provider": F.lit("v"), "basis": F.lit("raw")})
    gate = {r.symbol: r.reason for r in archive.gate_upsert(old, batch, prov).collect()}
    assert gate == {"A": None, "B": "partial_history_requires_review", "C": "unknown_or_changed_provider_basis", "N": None}
    merged = archive.apply_upsert(old, batch, archive.gate_upsert(old, batch, prov))
    assert {r.symbol: r["count"] for r in merged.groupBy("symbol").count().collect()} == {"A": 3, "B": 2, "C": 2, "N": 2}


def test_scan_log_sink_and_dump(spark, tmp_path):
    rows = spark.createDataFrame([(1, [str(i) for i in range(14)])], "id int, signals array<string>")
    archive.append_scan_log(rows, str(tmp_path / "log"))
    archive.append_scan_log(rows, str(tmp_path / "log"))
    assert [len(r.signals) for r in spark.read.parquet(str(tmp_path / "log")).collect()] == [10, 10]
    archive.write_dump(rows.select("id"), str(tmp_path / "csv"))
    archive.write_dump(rows, str(tmp_path / "json"), "json")
    assert spark.read.json(str(tmp_path / "json")).count() == 1


def test_risk_registry_fails_loudly(spark, tmp_path):
    (tmp_path / "ok.json").write_text('[{"symbol": "A", "status": "blocked", "notes": ["x"]}]')
    assert quality.load_risks(spark, str(tmp_path / "ok.json")).first().status == "blocked"
    (tmp_path / "bad.json").write_text("{broken")
    with pytest.raises(Exception):
        quality.load_risks(spark, str(tmp_path / "bad.json")).collect()


def test_as_of_record(spark):
    facts = spark.createDataFrame([("A", D(2020, 5, 1), 10), ("A", D(2020, 8, 1), 999)], "symbol string, available_at date, profit int")
    assert quality.latest_known(facts, F.lit("2020-06-01").cast("date")).first().profit == 10
    with pytest.raises(ValueError):
        quality.latest_known(facts.drop("available_at"), F.current_date())


def test_exact_quantiles_and_ranks_match_numpy(spark):
    rng = random.Random(1)
    vals = [("g", round(rng.gauss(0, 5), 2)) for _ in range(4000)] + [("g", 1.25)] * 2000 + [("h", -3.0), ("h", 0.0), ("h", 8.0)]
    df = spark.createDataFrame(vals, "k string, v double")
    got = {r.k: r for r in ranking.exact_quantiles(df, ["k"], "v", {"lo": 0.025, "mid": 0.5, "hi": 0.975}).collect()}
    for k in ("g", "h"):
        x = np.array([v for kk, v in vals if kk == k])
        assert [got[k].lo, got[k].mid, got[k].hi] == pytest.approx(list(np.quantile(x, [0.025, 0.5, 0.975])))
    two = df.where("k = 'g'").withColumn("w", F.col("v") * F.col("v"))
    p = two.toPandas()
    rho = ranking.spearman(two, [], "v", "w").first().rho
    assert rho == pytest.approx(p.v.rank().corr(p.w.rank()))


def test_positions_match_a_plain_loop(spark):
    rng = random.Random(7)
    rows, seq = [], {}
    for i in range(600):
        s, day = rng.choice("AB"), D(2020, 1, 1) + dt.timedelta(days=i // 20)
        seq[s, day] = seq.get((s, day), 0) + 1
        rows.append((s, day, seq[s, day], rng.choice(["BUY", "SELL"]), rng.randint(1, 30), float(rng.randint(50, 150))))
    df = spark.createDataFrame(rows, "symbol string, day date, seq int, side string, qty long, price double")
    got = {(r.symbol, r.day, r.seq): r for r in portfolio.positions(df).collect()}
    state = {}
    for s, day, n, side, q, px in rows:
        held, cost = state.get(s, (0, 0.0))
        real = 0.0
        if side == "BUY":
            held, cost, f = held + q, cost + q * px, q
        else:
            f = min(q, held)
            if held:
                real = f * (px - cost / held)
                cost *= 1 - f / held
            held -= f
            cost = cost if held else 0.0
        state[s] = (held, cost)
        r = got[s, day, n]
        assert (r.held, r.filled) == (held, f)
        assert r.realised == pytest.approx(real, abs=1e-6)
        assert (r.avg_price or 0.0) == pytest.approx(cost / held if held else 0.0)


def test_positions_of_one_long_day(spark):
    """Thousands of sells that each halve the holding, and near-total sells, keep every figure finite and right."""
    rows, held, cost, want = [], 0, 0.0, []
    for i in range(5000):
        big = i % 1000 == 999
        side, q = ("BUY", 1 << 20) if i % 2 == 0 else ("SELL", held - 1 if big else held // 2)
        px = 100.0 + i % 7
        rows.append(("A", D(2020, 1, 1), i, side, q, px))
        if side == "BUY":
            held, cost = held + q, cost + q * px
        else:
            cost *= 1 - q / held
            held -= q
        want.append(cost / held)
    df = spark.createDataFrame(rows, "symbol string, day date, seq int, side string, qty long, price double")
    got = [r.avg_price for r in portfolio.positions(df).orderBy("seq").collect()]
    assert got == pytest.approx(want, rel=1e-9)


def test_conflicting_actions_are_refused(spark):
    hold = spark.createDataFrame([("A", 10.0, 100.0, D(2020, 1, 1))], "symbol string, qty double, mark double, held_since date")
    for other in (2.0, 0.0, float("inf")):
        act = spark.createDataFrame([("x", "A", "split", 5.0, D(2020, 2, 1)), ("x" if other == 2.0 else "y", "A", "split", other, D(2020, 2, 1))], "id string, symbol string, type string, ratio double, day date")
        with pytest.raises(Exception, match="unsound action"):
            portfolio.apply_splits(hold, act).collect()


def test_split_keeps_value_and_counts_once(spark):
    hold = spark.createDataFrame([("A", 10.0, 100.0, D(2020, 1, 1)), ("B", 5.0, 10.0, D(2020, 1, 1))], "symbol string, qty double, mark double, held_since date")
    act = spark.createDataFrame([("x", "A", "split", 5.0, D(2020, 2, 1)), ("x", "A", "split", 5.0, D(2020, 2, 1))], "id string, symbol string, type string, ratio double, day date")
    got = {r.symbol: (round(r.qty, 6), round(r.mark, 6)) for r in portfolio.apply_splits(hold, act).collect()}
    assert got == {"A": (50.0, 20.0), "B": (5.0, 10.0)}


def test_bootstrap_brackets_the_edge_and_refuses_short_samples(spark):
    rng = random.Random(3)
    rows = [(D(2020, 1, 1) + dt.timedelta(days=i), rng.gauss(1.0 if k else 0.0, 1.0), bool(k)) for i in range(200) for k in (0, 1, 0)]
    df = spark.createDataFrame(rows, "date date, fwd double, pick boolean")
    r = evaluation.block_bootstrap(df, F.col("pick"), draws=300).first()
    p = df.toPandas()
    edge = p.fwd[p.pick].mean() - p.fwd.mean()
    assert r.lo < edge < r.hi
    assert evaluation.block_bootstrap(df.where("date < '2020-02-01'"), F.col("pick"), draws=50).count() == 0


def test_json_and_numbers_in_text(spark):
    df = spark.createDataFrame([('x ```json {"a": 1} ``` {"b": 2}', " ₹1,412.10 "), ("none", "n/a")], "t string, n string")
    got = df.select(parsing.first_json(F.col("t")).alias("j"), parsing.number(F.col("n")).alias("v")).collect()
    assert got[0].j == '{"a": 1}' and got[0].v == 1412.10
    assert got[1].j is None and got[1].v is None


def test_nested_json_in_text(spark):
    cases = [
        ('{"a": 1, "b": {"c": 2}}', '{"a": 1, "b": {"c": 2}}'), ('so: {"k": "a}b"} end', '{"k": "a}b"}'), ('{broken {"x": [1, {"y": {}}]} {', '{"x": [1, {"y": {}}]}'),
        ('{"e": "quote \\" and }"}', '{"e": "quote \\" and }"}'), ('text {"first": 1} ```json\n{"second": {"z": 2}}\n```', '{"second": {"z": 2}}'), ("{}", "{}"), ("{ not json }", None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = [r.j for r in df.select("i", parsing.first_json(F.col("t")).alias("j")).orderBy("i").collect()]
    assert got == [w for _, w in cases]


def test_model_round_trip_and_purge(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        x = rng.random()
        d = D(2020, 1, 1) + dt.timedelta(days=i)
        rows.append(("A", d, d + dt.timedelta(days=15), x, rng.random() if i % 9 else None, int(x > 0.5)))
    df = spark.createDataFrame(rows, "symbol string, date date, label_end date, f1 double, f2 double, label int")
    s = learning.Split("2020-09-30", "2020-10-01", "2020-12-15", "2020-12-16", 300, 100, (50, 20, 10))
    split = learning.purged_split(df, ["f1"], s)
    assert split.where("part = 'train' AND label_end > '2020-09-30'").count() == 0
    model = learning.train(split, ["f1", "f2"], learning.Boosting(depth=2, rounds=5, min_rows=1, rate=0.3))
    m = learning.metrics(model, split)
    assert m["test_auc"] > 0.9
    learning.save(model, str(tmp_path), "m", m)
    again, meta = learning.load(str(tmp_path), "m")
    assert meta.first().label_version == learning.LABEL_VERSION
    a = learning.score(model, df).select("date", "ml_prob").orderBy("date").collect()
    assert a == learning.score(again, df).select("date", "ml_prob").orderBy("date").collect()
    assert learning.score(model, df, "old").where("ml_prob IS NOT NULL").count() == 0
    assert learning.importances(spark, model).first().feature.startswith("f1")


def test_completed_session_cut(spark):
    df = spark.createDataFrame(wave(10), BAR_SCHEMA)
    day = "2020-01-10"
    assert quality.completed_sessions(df, f"{day} 14:00:00").count() == 9
    assert quality.completed_sessions(df, f"{day} 16:30:00").count() == 10


def test_names_resolve_by_their_only_part(spark):
    from barloom.catalog.reference import resolve

    master = spark.createDataFrame([("I1", "ALPHA STEEL", "AST", "1"), ("I2", "ALPHA BANK", "ABK", "2"), ("I3", None, "CCC", "3")], "isin string, name string, ticker string, bse_code string")
    asked = [("steel", "I1"), ("alpha", None), ("a bank", "I2"), ("ast", "I1"), ("i3", "I3"), ("2", "I2"), ("k", "I2"), ("", None), ("zzz", None)]
    got = {r.q: r.isin for r in resolve(spark.createDataFrame([(q,) for q, _ in asked], "q string"), master).collect()}
    assert got == dict(asked)


def test_actions_are_reviewed_and_dividends_follow_entitlement(spark):
    from barloom.operators import portfolio

    a = [
        ("d1", "A", "dividend_payment", None, 3.0, D(2020, 2, 1)), ("d1", "A", "dividend_payment", None, 3.0, D(2020, 2, 1)), ("d2", "A", "dividend_payment", None, -1.0, D(2020, 2, 1)),
        ("s1", "A", "split", 0.5, None, D(2020, 3, 1)), ("s2", "A", "split", float("nan"), None, D(2020, 3, 1)), ("m1", "A", "demerger", None, None, D(2020, 1, 15)),
        ("c1", "A", "split", 2.0, None, D(2020, 3, 1)), ("c1", "A", "split", 3.0, None, D(2020, 3, 1)), ("m2", "B", "merger", None, None, D(2020, 1, 15)),
    ]
    actions = spark.createDataFrame(a, "id string, symbol string, type string, ratio double, cash_per_share double, day date")
    sound, refused = portfolio.reviewed_actions(actions)
    assert {r.id for r in sound.collect()} == {"d1", "s1"}
    changes = spark.createDataFrame([(1, "A", D(2020, 1, 1), 10), (1, "A", D(2020, 2, 2), -8), (2, "A", D(2020, 2, 1), 3), (3, "A", D(2020, 2, 2), 5)], "account int, symbol string, day date, qty long")
    iv = portfolio.entitlements(changes)
    assert {(r.account, r.dividend_cash) for r in portfolio.dividend_cash(iv, sound).collect()} == {(1, 30.0), (2, 9.0)}
    got = {(r.id, r.reason, r.account) for r in portfolio.quarantine(iv, refused).collect()}
    assert got == {("d1", "duplicate_action", None), ("d2", "invalid_dividend", None), ("s2", "invalid_ratio", None), ("c1", "conflicting_action", None), ("m1", "needs_review", 1)}
    hold = spark.createDataFrame([("A", 3.0, 200.0, D(2020, 1, 1)), ("B", 4.0, 200.0, D(2020, 1, 1))], "symbol string, qty double, mark double, held_since date")
    assert {(r.symbol, r.qty, r.mark, r.unresolved) for r in portfolio.apply_splits(hold, sound).collect()} == {("A", 1.5, 400.0, True), ("B", 4.0, 200.0, False)}


def test_json_of_any_depth(spark):
    rng = random.Random(11)
    import json

    def value(depth):
        kind = rng.randrange(4 if depth else 2)
        if kind == 0:
            return rng.choice(["a}b", "{", '"', "\\", "x y", "}{"])
        if kind == 1:
            return rng.randrange(100)
        if kind == 2:
            return [value(depth - 1) for _ in range(rng.randrange(3))]
        return {f"k{i}": value(depth - 1) for i in range(rng.randrange(1, 4))}

    objects = [{"top": value(d % 14)} for d in range(120)]
    deep = "x"
    for i in range(200):
        deep = {f"n{i}": deep}
    texts = [(i, f"He said: it's {{ broken. Answer: {json.dumps(o)} end {{") for i, o in enumerate([*objects, deep])]
    df = spark.createDataFrame(texts, "i int, t string")
    got = [r.j for r in df.select("i", parsing.first_json(F.col("t")).alias("j")).orderBy("i").collect()]
    assert [None if g is None else json.loads(g) for g in got] == [*objects, deep]


def test_entitlement_work_follows_the_answers(spark):
    """No pair of an interval and an action of the same symbol is formed outside the interval; gaps, ends and null keys hold."""
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    iv = [(1, "A", 10, day(0), day(5)), (1, "A", 0, day(5), day(8)), (1, "A", 4, day(8), None), (2, "A", 7, day(3), day(4)), (None, "A", 5, day(0), None), (3, None, 9, day(0), None), (4, "B", 2, None, day(9))]
    iv = spark.createDataFrame(iv, "account long, symbol string, qty long, valid_from date, valid_to date")
    actions = spark.createDataFrame([(i, "A", day(n)) for i, n in enumerate((0, 3, 4, 5, 8, 8, 40))] + [(9, "A", None), (10, None, day(1)), (11, "B", day(3))], "id long, symbol string, day date")
    got = portfolio.entitled(iv, actions)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert all("valid_from" not in line and "valid_to" not in line for line in plan.splitlines() if line.strip(" :+-").startswith("Join"))
    one = {(1, i, 10) for i in (0, 1, 2)} | {(1, i, 4) for i in (4, 5, 6)}
    assert sorted((r.account or 0, r.id, r.qty) for r in got.collect()) == sorted(one | {(2, 1, 7)} | {(0, i, 5) for i in range(7)})
    sound = actions.withColumns({"type": F.lit("dividend_payment"), "cash_per_share": F.lit(0.5)})
    paid = {r.account: (r.dividend_cash, r.payments) for r in portfolio.dividend_cash(iv, sound).collect()}
    assert paid == {1: (21.0, 6), 2: (3.5, 1), None: (17.5, 7)}


def test_evaluations_read_their_input_once(spark):
    """Ranks, sums and ties come from rows written once, however often they are read."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    df = spark.createDataFrame([(f"s{i}", D(2020, 1, 1), float(i % 7), float(i)) for i in range(60)], "symbol string, date date, score double, raw double")
    df = df.withColumn("ret", counted.asNondeterministic()("raw"))
    r = evaluation.decile_edges(df, "score", "ret").first()
    assert r.n == 60 and seen.value == 60
    assert r.top_mean == pytest.approx(np.mean([i for i in sorted(range(60), key=lambda i: (-(i % 7), f"s{i}"))[:6]]))
    assert evaluation.validation_table(df, "score", ["ret"]).first().n == 60 and seen.value == 120
    priced = df.select("symbol", "score", F.lit(1.0).alias("entry"), F.col("ret").alias("last"), F.lit(9).alias("days"))
    assert evaluation.hold_cohort(priced, 5000.0, 0.5).count() == 60 and seen.value == 180
