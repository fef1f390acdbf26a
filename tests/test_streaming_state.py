"""Rules with remembered state: order, late rows, hot keys and initial positions."""

import datetime as dt

from pyspark.sql import functions as F

from barloom.streaming import ticks

AT = dt.datetime(2024, 1, 2, 9, 0)


def feed(spark, folder, schema, *batches):
    """A stream that delivers each batch as a file of its own, in this order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part={i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part=*")


READINGS = "symbol string, scanned_at timestamp, id long, score double"


def reading(symbol, day, minute, i, score):
    return (symbol, AT + dt.timedelta(days=day, minutes=minute), i, float(score))


def test_alerts_follow_event_time_across_batches(spark, tmp_path):
    first = [reading("A", 0, 0, 1, 40), reading("A", 1, 5, 4, 75), reading("B", 0, 0, 6, 70)]
    second = [reading("A", 1, 3, 3, 62), reading("A", 1, 1, 2, 20), reading("B", 1, 0, 7, 80)]  # earlier than rows of the first, not behind the watermark
    stream = ticks.closed(feed(spark, str(tmp_path), READINGS, first, second), "scanned_at", "symbol")
    progress = []
    got = ticks.run_available(ticks.crossing_alerts(stream), "append", progress=progress).drop("batch").collect()
    assert [(r.symbol, r.prev_score, r.score, r.id) for r in got] == [("A", 40.0, 62.0, 3)]
    assert ticks.late_rows(progress) == 0


def test_late_readings_are_dropped_and_counted(spark, tmp_path):
    first = [reading("A", 0, 0, 1, 40), reading("A", 3, 0, 2, 50)]
    second = [reading("A", 3, 5, 3, 55)]
    third = [reading("A", 1, 0, 4, 90), reading("A", 1, 1, 5, 91), reading("A", 4, 0, 6, 66)]  # two of them days behind
    stream = feed(spark, str(tmp_path), READINGS, first, second, third, [reading("A", 9, 0, 7, 1)])
    progress = []
    got = ticks.run_available(ticks.crossing_alerts(stream), "append", progress=progress).drop("batch").collect()
    assert [(r.prev_score, r.score, r.id) for r in got] == [(55.0, 66.0, 6)]
    assert ticks.late_rows(progress) == 2


def test_a_hot_key_is_handed_over_slot_by_slot(spark, tmp_path):
    hot = [reading("A", i // 4000, (i % 4000) % 1300, i, 70 if i % 4000 > 2000 else 30) for i in range(20000)]
    cold = [reading(f"s{i}", 0, i % 50, 10**6 + i, 10) for i in range(2000)]
    stream = ticks.closed(feed(spark, str(tmp_path), READINGS, hot + cold), "scanned_at", "symbol")

    longest = spark.sparkContext.accumulator(0)
    follow = ticks._Crossing.follow

    def watched(self, symbol, state, rows, out):
        longest.add(max(0, len(rows) - 400))  # an hour of the hot key has about 185 readings
        return follow(self, symbol, state, rows, out)

    ticks._Crossing.follow = watched
    try:
        got = ticks.run_available(ticks.crossing_alerts(stream), "append").drop("batch").collect()
    finally:
        ticks._Crossing.follow = follow
    assert longest.value == 0
    last, want = {}, []
    for s, at, i, score in sorted(hot, key=lambda r: (r[1], r[2])):
        day = at.date()
        prior = last.get(day - dt.timedelta(days=1))
        if prior is not None and prior < 60 <= score and day not in {w[0] for w in want}:
            want.append((day, i))
        last[day] = score
    assert sorted((r.day, r.id) for r in got) == sorted(want)


def test_triggers_begin_with_positions(spark, tmp_path):
    schema = "symbol string, ts timestamp, price double"
    at = lambda m: AT + dt.timedelta(minutes=m)
    rows = [("A", at(9), 94.0), ("A", at(1), 111.0), ("A", at(5), 99.0), ("B", at(2), 80.0), ("C", at(0), 5.0), ("B", at(3), 70.0), ("D", at(1), 500.0)]
    positions = spark.createDataFrame([("A", 95.0, 110.0, 100.0), ("B", 85.0, 120.0, 90.0), ("", 0.0, 1.0, 0.0), ("D", 1.0, 600.0, 2.0)], "symbol string, sl double, t1 double, cost double")
    stream = ticks.closed(feed(spark, str(tmp_path), schema, rows), "ts", "symbol")
    got = ticks.run_available(ticks.position_triggers(stream, positions), "append").drop("batch").orderBy("symbol", "ts").collect()
    assert [(r.symbol, r.action, r.price) for r in got] == [("A", "T1_HIT", 111.0), ("A", "SL_HIT", 99.0), ("B", "SL_HIT", 80.0)]


def test_candles_are_scored_like_the_batch_on_the_same_fifty(spark, tmp_path):
    import random

    from barloom.functions import scoring
    from barloom.functions.windows import with_row_number

    draw, rows, price = random.Random(4), [], {"A": 100.0, "B": 50.0}
    for i in range(140):
        for s in ("A", "B") if i % 3 else ("A",):
            for j in range(3):
                price[s] *= 1 + draw.gauss(0.001 if i % 40 < 20 else -0.001, 0.004)
                rows.append((s, AT + dt.timedelta(minutes=i, seconds=10 * j), price[s], float(draw.randint(1, 50)), len(rows)))
    schema = "symbol string, ts timestamp, price double, volume double, event_id long"
    half = len(rows) // 2
    stream = ticks.closed(feed(spark, str(tmp_path), schema, rows[:half], rows[half:]), "ts", "symbol")
    got = ticks.run_available(ticks.rescored_candles(stream), "append").drop("batch").collect()
    bars = spark.createDataFrame(rows, schema).groupBy("symbol", F.window("ts", "1 minute").alias("w")).agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("volume").alias("volume"))
    bars = bars.select("symbol", F.col("w.start").alias("date"), "open", "high", "low", "close", "volume").orderBy("symbol", "date").collect()
    want = {}
    windows = []
    for s in ("A", "B"):
        own = [b for b in bars if b.symbol == s]
        for end in range(49, len(own)):
            windows += [(f"{s}{end}", *b[1:]) for b in own[end - 49 : end + 1]]
            want[f"{s}{end}"] = (s, own[end].date)
    scored = scoring.with_base_signal(with_row_number(spark.createDataFrame(windows, "symbol string, date timestamp, open double, high double, low double, close double, volume double"))).where("rn = 49")
    want = {(*want[r.symbol], r.base_points, r.base_verdict) for r in scored.select("symbol", "base_points", "base_verdict").collect()}
    second = lambda t: t.replace(second=0, microsecond=0)
    assert {(r.symbol, second(r.ts), r.points, r.verdict) for r in got} == want and len(got) == len(want) > 120


def test_few_waiting_rows_need_one_call_whatever_their_slots(spark, tmp_path):
    rows = [reading("A", i, 0, i, 70 if i % 3 else 30) for i in range(300)]
    calls = spark.sparkContext.accumulator(0)
    expired = ticks._Crossing.handleExpiredTimer

    def counted(self, key, timerValues, info):
        calls.add(1)
        yield from expired(self, key, timerValues, info)

    ticks._Crossing.handleExpiredTimer = counted
    try:
        got = ticks.run_available(ticks.crossing_alerts(ticks.closed(feed(spark, str(tmp_path), READINGS, rows), "scanned_at", "symbol")), "append").collect()
    finally:
        ticks._Crossing.handleExpiredTimer = expired
    assert calls.value <= 2
    assert sorted(r.id for r in got) == [i for i in range(300) if i % 3 == 1]


def test_few_waiting_rows_become_many(spark, tmp_path):
    before = [reading("A", 0, 0, 0, 30)]
    second = [reading("A", 1, i % 40, 1 + i, 30) for i in range(400)]  # one hour, not over after this batch
    third = [reading("A", 1, 39 + i % 15, 1000 + i, 30 if i else 65) for i in range(400)] + [reading("A", 2, 0, 5000, 75)]
    stream = feed(spark, str(tmp_path), READINGS, before, second, third, [reading("A", 3, 0, 6000, 80)], [reading("A", 9, 0, 7000, 1)])
    got = ticks.run_available(ticks.crossing_alerts(stream), "append").collect()
    assert [(r.day.day, r.prev_score, r.score, r.id) for r in sorted(got, key=lambda r: r.id)] == [(3, 30.0, 65.0, 1000), (4, 30.0, 75.0, 5000)]  # the last two readings wait for the watermark
