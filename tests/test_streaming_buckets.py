"""Alerts of many symbols with few readings each."""

from barloom.streaming import ticks
from tests.test_streaming_state import READINGS, feed, reading


def test_symbols_of_a_bucket_share_their_calls(spark, tmp_path):
    names = [*[f"s{i}" for i in range(300)], None]
    first = [reading(s, d, 7 * d, 10 * i + d, 30 if d % 2 == 0 else 70) for i, s in enumerate(names) for d in range(3)]
    second = [reading(s, 3, 1, 10 * i + 3, 80) for i, s in enumerate(names) if i % 2]
    calls = spark.sparkContext.accumulator(0)
    plain = ticks._Crossing.handleInputRows

    def counted(self, key, rows, timerValues):
        calls.add(1)
        yield from plain(self, key, rows, timerValues)

    ticks._Crossing.handleInputRows = counted
    try:
        stream = ticks.closed(feed(spark, str(tmp_path), READINGS, first, second), "scanned_at", "symbol")
        got = ticks.run_available(ticks.crossing_alerts(stream, buckets=8), "append").collect()
    finally:
        ticks._Crossing.handleInputRows = plain
    assert calls.value <= 3 * 8  # two batches and the end
    want = {(s, 30.0, 70.0, 10 * i + 1) for i, s in enumerate(names)} | {(s, 30.0, 80.0, 10 * i + 3) for i, s in enumerate(names) if i % 2}
    assert {(r.symbol, r.prev_score, r.score, r.id) for r in got} == want and len(got) == len(want)
