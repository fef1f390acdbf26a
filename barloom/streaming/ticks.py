"""Streams of ticks, readings and trades.

Every function takes and returns a (streaming) DataFrame.  Windowed and
running results use built-in aggregations with a watermark; the rules that
compare a reading with remembered state (:func:`crossing_alerts`,
:func:`position_triggers`) keep named state variables with timers.
"""

from __future__ import annotations

import contextlib
import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from barloom.functions.reseeded import LIVE_BARS, live_points, live_verdict
from barloom.operators.lineage import checkpoint_folder

LATE = "10 minutes"


def moment(ticks: DataFrame) -> Column:
    """Order of ticks: time, then ``event_id`` where there is one, so that equal times don't depend on partitioning."""
    return F.struct("ts", "event_id") if "event_id" in ticks.columns else F.col("ts")


def tick_bars(ticks: DataFrame, width: str = "15 minutes") -> DataFrame:
    """OHLCV bars per symbol and tumbling window."""
    at = moment(ticks)
    g = ticks.withWatermark("ts", LATE).groupBy("symbol", F.window("ts", width).alias("w"))
    return g.agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", at).alias("close"), F.count("*").alias("trades"),
    ).select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "trades")


def sliding_activity(ticks: DataFrame, width: str = "50 minutes", step: str = "10 minutes") -> DataFrame:
    """Range and count over a sliding window (the last fifty one-minute candles)."""
    g = ticks.withWatermark("ts", LATE).groupBy("symbol", F.window("ts", width, step).alias("w"))
    return g.agg(F.count("*").alias("n"), F.max("price").alias("hi"), F.min("price").alias("lo")).select("symbol", F.col("w.start").alias("start"), "n", "hi", "lo")


def last_prices(ticks: DataFrame) -> DataFrame:
    """Newest positive price per symbol; one small state row per symbol."""
    return ticks.where("price > 0").groupBy("symbol").agg(F.max_by("price", moment(ticks)).alias("ltp"), F.max("ts").alias("ltp_at"))


def with_live_price(ticks: DataFrame, scores: DataFrame) -> DataFrame:
    """Stream of prices onto a static score table."""
    return ticks.join(scores, "symbol", "left")


def session_vwap(ticks: DataFrame) -> DataFrame:
    """Volume-weighted price so far per symbol and day; yesterday's state is dropped by the watermark."""
    day = F.window("ts", "1 day").alias("w")
    g = ticks.withWatermark("ts", LATE).groupBy("symbol", day)
    return g.agg(F.sum(F.col("price") * F.col("volume")).alias("pv"), F.sum("volume").alias("v")).select(
        "symbol", F.to_date("w.start").alias("day"), F.when(F.col("v") != 0, F.col("pv") / F.col("v")).alias("vwap")
    )


def market_hours(ts: Column) -> Column:
    """Weekdays 09:15 to 15:30 local time."""
    minutes = F.hour(ts) * 60 + F.minute(ts)
    return F.dayofweek(ts).between(2, 6) & minutes.between(9 * 60 + 15, 15 * 60 + 30)


def bursts(ticks: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Runs of activity separated by a gap, inside market hours."""
    g = ticks.where(market_hours(F.col("ts"))).withWatermark("ts", LATE)
    out = g.groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def unique_ticks(ticks: DataFrame, keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """Ticks without repeats; late rows past the watermark are dropped."""
    return ticks.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(list(keys))


def daily_results(trades: DataFrame) -> DataFrame:
    """Running realised result per day, in cents."""
    g = trades.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day").alias("w"))
    return g.agg(F.sum("pnl").alias("pnl")).select(F.to_date("w.start").alias("day"), "pnl")


# --- rules with remembered state -------------------------------------------------

HOUR = 3_600_000
#: Rows of a key that wait as one value.
FEW = 512


class _Slotted(StatefulProcessor):
    """Rows of a key, put aside by slots of event time and handed over in order when the watermark has passed a slot.

    A micro-batch of any size passes in Arrow chunks.  A key with few rows
    waiting, as most have, keeps them as one value with one timer at a time,
    whatever the number of their slots.  Beyond ``few_rows`` they are cut by
    slot, each piece is one packed entry of the key's map state, and a timer
    at the end of each slot reads that slot only, so memory is bounded by one
    key's rows of one slot, not by its rows of a batch.  Rows go when they
    have been read.
    """

    #: Name of the event time, other columns kept, their types in the state, the width of a slot, and the rows that wait as one value.
    time, kept, types, width, few_rows = "ts", (), (), HOUR, FEW

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        packed = "at array<timestamp>, " + ", ".join(f"{c} array<{t}>" for c, t in zip(self.kept, self.types))
        self.few = handle.getValueState("few", f"in_slot array<long>, {packed}, in_pieces int")  # in_pieces: slots that wait in pieces; then no row waits here
        self.rows = handle.getMapState("rows", "slot long, piece int", packed)
        self.pieces = handle.getMapState("pieces", "slot long", "n int")
        self.last = handle.getValueState("last", self.state)

    def waiting(self) -> tuple[list[tuple], int]:
        """Few rows, each (slot, time, kept columns), or else the number of slots in pieces."""
        few = self.few.get()
        return (list(zip(*few[:-1])), few[-1]) if few else ([], 0)

    def keep(self, rows: list[tuple], opened: int) -> None:
        if rows or opened:
            self.few.update((*([list(x) for x in zip(*rows)] or [[] for _ in range(2 + len(self.kept))]), opened))
        else:
            self.few.clear()

    def put_aside(self, rows: list[tuple]) -> int:
        """Rows into pieces of their slots; the number of slots that had none."""
        by_slot: dict[int, list[tuple]] = {}
        for slot, *row in rows:
            by_slot.setdefault(slot, []).append(row)
        opened = 0
        for slot, own in sorted(by_slot.items()):
            n = self.pieces.getValue((slot,))[0] if self.pieces.containsKey((slot,)) else 0
            if not n:
                self.handle.registerTimer((slot + 1) * self.width)
                opened += 1
            self.rows.updateValue((slot, n), tuple(list(x) for x in zip(*own)))
            self.pieces.updateValue((slot,), (n + 1,))
        return opened

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        few: list[tuple] | None = None
        opened, first = 0, None
        for chunk in rows:
            chunk = chunk[chunk[self.kept[0]].notna()]
            if not len(chunk):
                continue
            chunk = chunk.astype({c: "int64" for c, t in zip(self.kept, self.types) if t == "long"})  # a null beside them made them floats
            slots = chunk[self.time].astype("datetime64[ms]").astype("int64") // self.width
            fresh = list(zip(slots.tolist(), *(chunk[c].tolist() for c in (self.time, *self.kept))))
            if few is None:
                few, opened = self.waiting()
                first = min((r[0] for r in few), default=None)
            if not opened and len(few) + len(fresh) <= self.few_rows:
                few += fresh
            else:
                opened += self.put_aside(few + fresh)
                few = []
        if few is not None:
            if few and (first is None or min(r[0] for r in few) < first):
                self.handle.registerTimer((min(r[0] for r in few) + 1) * self.width)
            self.keep(few, opened)
        yield pd.DataFrame(columns=self.out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = expiredTimerInfo.getExpiryTimeInMs()
        few, opened = self.waiting()
        ready: dict[int, list[tuple]] = {}
        if opened:
            slot = passed // self.width - 1
            if not self.pieces.containsKey((slot,)):
                return
            own = ready.setdefault(slot, [])
            for i in range(self.pieces.getValue((slot,))[0]):
                own += zip(*self.rows.getValue((slot, i)))
                self.rows.removeKey((slot, i))
            self.pieces.removeKey((slot,))
            self.keep([], opened - 1)
        else:
            passed = max(passed, timerValues.getCurrentWatermarkInMs())
            later = [r for r in few if (r[0] + 1) * self.width > passed]
            for slot, *row in few:
                if (slot + 1) * self.width <= passed:
                    ready.setdefault(slot, []).append(tuple(row))
            if not ready:
                return
            if later:
                self.handle.registerTimer((min(r[0] for r in later) + 1) * self.width)
            self.keep(later, 0)
        out: list[tuple] = []
        self.advance(key, ready, out)
        yield pd.DataFrame(out, columns=self.out)

    def advance(self, key: tuple, ready: dict[int, list[tuple]], out: list[tuple]) -> None:
        """Follow the rows of the slots that are over, in their order."""
        state = self.last.get()
        for slot in sorted(ready):
            state = self.follow(key[0], state, sorted(ready[slot]), out)
        if state is not None:
            self.last.update(state)

    def close(self) -> None:
        pass


ALERT_SCHEMA = "symbol string, day date, prev_score double, score double, id long"


class _Crossing(_Slotted):
    """Symbols of a bucket together: a call, a timer and an access to the state cost milliseconds, a symbol's few readings do not."""

    time, kept, types, few_rows = "scanned_at", ("id", "score", "symbol"), ("long", "double", "string"), 1 << 13
    state, out = "symbol array<string>, day array<date>, score array<double>, prior array<double>, alerted array<date>", ["symbol", "day", "prev_score", "score", "id"]

    def __init__(self, bar: float) -> None:
        self.bar = bar

    def advance(self, key, ready, out):
        packed = self.last.get()
        states = {symbol: state for symbol, *state in zip(*packed)} if packed else {}
        for slot in sorted(ready):
            own: dict[str | None, list[tuple]] = {}
            for *row, symbol in ready[slot]:
                own.setdefault(symbol, []).append(tuple(row))
            for symbol, rows in own.items():
                states[symbol] = self.follow(symbol, states.get(symbol), sorted(rows), out)
        self.last.update(tuple(list(x) for x in zip(*((symbol, *state) for symbol, state in states.items()))))

    def follow(self, symbol, state, rows, out):
        day, score, prior, alerted = state or (None, None, None, None)
        for at, rid, value in rows:
            today = at.date()
            if today != day:
                prior, day = score, today
            score = float(value)
            if prior is not None and prior < self.bar <= score and alerted != today:
                alerted = today
                out.append((symbol, today, prior, score, rid))
        return day, score, prior, alerted


def crossing_alerts(readings: DataFrame, bar: float = 60.0, buckets: int = 1 << 12) -> DataFrame:
    """One alert per symbol and day when a reading reaches the bar from below the day before.

    Readings are followed in the order of their event time, whatever the
    batches they come in; those behind the watermark are dropped and counted
    by the engine (``late_rows``).  State per symbol is four scalars and the
    readings of hours that the watermark has not passed.  Symbols are dealt
    over ``buckets`` that are kept together, a few thousand readings each at
    best; a bucket with more goes hour by hour.
    """
    kept = readings.select("symbol", "scanned_at", "id", "score").withWatermark("scanned_at", LATE)
    dealt = kept.withColumn("_bucket", F.pmod(F.xxhash64("symbol"), F.lit(buckets)))
    return dealt.groupBy("_bucket").transformWithStateInPandas(_Crossing(bar), ALERT_SCHEMA, "append", "EventTime")


TRIGGER_SCHEMA = "symbol string, ts timestamp, action string, price double"


class _Triggers(_Slotted):
    kept, types = ("price",), ("double",)
    state, out = "stop double, target double, cost double, live boolean, done boolean", ["symbol", "ts", "action", "price"]

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        first = initialState.iloc[0]
        self.last.update((float(first["sl"]), float(first["t1"]), float(first["cost"]), True, False))

    def follow(self, symbol, state, rows, out):
        if state is None:  # no position
            return None
        stop, target, cost, live, done = state
        for ts, price in rows:
            if not live:
                break
            if price <= stop:
                live = False
                out.append((symbol, ts, "SL_HIT", price))
            elif not done and price >= target:
                stop, done = cost, True
                out.append((symbol, ts, "T1_HIT", price))
        return stop, target, cost, live, done


def position_triggers(ticks: DataFrame, positions: DataFrame) -> DataFrame:
    """First price through stop or target per open position; after the target the stop moves to cost.

    ``positions`` (symbol, sl, t1, cost), one row a symbol, are the state the
    stream begins with.  Prices are followed in the order of their time; a
    symbol without a position and a closed position leave no trace.
    """
    # Prices that can trigger nothing never leave the JVM.
    levels = positions.select("symbol", F.greatest("sl", "cost").alias("_low"), F.col("t1").alias("_high"))
    near = ticks.join(levels, "symbol").where((F.col("price") <= F.col("_low")) | (F.col("price") >= F.col("_high")) | F.col("price").isNull())
    kept = near.select("symbol", "ts", "price").withWatermark("ts", LATE)
    first = positions.select("symbol", *[F.col(c).cast("double").alias(c) for c in ("sl", "t1", "cost")])
    return kept.groupBy("symbol").transformWithStateInPandas(_Triggers(), TRIGGER_SCHEMA, "append", "EventTime", first.groupBy("symbol"))


CANDLE_SCHEMA = "symbol string, ts timestamp, close double, points long, verdict string"


def candles(ticks: DataFrame, width: str = "1 minute") -> DataFrame:
    """Finished bars per symbol and window, emitted once the watermark has passed them; ``ts`` is the last moment of the window."""
    at = moment(ticks)
    g = ticks.withWatermark("ts", LATE).groupBy("symbol", F.window("ts", width).alias("w"))
    bars = g.agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"),
    )
    return bars.select("symbol", F.window_time("w").alias("ts"), "open", "high", "low", "close", "volume")


class _Rescored(_Slotted):
    kept, types = ("open", "high", "low", "close", "volume"), ("double",) * 5
    state, out = "high array<double>, low array<double>, close array<double>, volume array<double>", ["symbol", "ts", "close", "points", "verdict"]

    def follow(self, symbol, state, rows, out):
        past = [list(x) for x in state] if state else [[], [], [], []]
        have = len(past[2])
        for series, place in zip(past, (2, 3, 4, 5)):  # a row is (ts, open, high, low, close, volume)
            series += [r[place] for r in rows]
        whole = np.array(past, float)
        ends = [i for i in range(have, whole.shape[1]) if i + 1 >= LIVE_BARS]
        if ends:
            windows = np.lib.stride_tricks.sliding_window_view(whole, LIVE_BARS, axis=1)[:, [i + 1 - LIVE_BARS for i in ends]]
            points = live_points(*windows)
            out += [(symbol, rows[i - have][0], float(whole[2, i]), int(p), live_verdict(int(p))) for i, p in zip(ends, points)]
        return tuple(series[-LIVE_BARS:] for series in past)


def rescored_candles(ticks: DataFrame, width: str = "1 minute") -> DataFrame:
    """Signal points of each finished candle over the last fifty candles of its symbol, as a poll of the live market would score them.

    Two stateful steps: candles by window, then a ring of fifty candles a
    symbol, advanced in the order of time.  The recursions of a signal begin
    with the first candle of the ring.
    """
    return candles(ticks, width).groupBy("symbol").transformWithStateInPandas(_Rescored(), CANDLE_SCHEMA, "append", "EventTime")


# --- running -----------------------------------------------------------------------


def work_folder(spark) -> str:
    """A new folder under the shared checkpoint folder."""
    return os.path.join(checkpoint_folder(spark), uuid.uuid4().hex)


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def _state_store(spark):
    """Queries started inside keep their state in RocksDB, which named state variables and timers need."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def late_rows(progress: list[dict]) -> int:
    """Rows that stateful operators dropped because the watermark had passed them."""
    return sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])


def closed(stream: DataFrame, time: str, key: str, last: str = "2100-01-01") -> DataFrame:
    """``stream`` with one more row, of an empty key far in the future, that moves the watermark past all others: the end of a replay."""
    spark = stream.sparkSession
    folder = work_folder(spark)
    spark.range(1).select(F.lit("").alias(key), F.lit(last).cast(dict(stream.dtypes)[time]).alias(time)).write.parquet(folder)
    end = spark.readStream.schema(f"{key} string, {time} {dict(stream.dtypes)[time]}").parquet(folder)
    return stream.unionByName(end, allowMissingColumns=True)


def run_available(stream: DataFrame, mode: str, folder: str | None = None, progress: list[dict] | None = None) -> DataFrame:
    """Process what is there and return the emitted rows with their batch number.

    Batches are appended as parquet with the batch number; a batch that is
    replayed after a failure overwrites its own part.  ``progress`` collects
    the reports of the batches.
    """
    folder = folder or work_folder(stream.sparkSession)

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    with _state_store(stream.sparkSession):
        query = (
            stream.writeStream.outputMode(mode)
            .foreachBatch(sink)
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()
    if progress is not None:
        progress += [json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress]
    return stream.sparkSession.read.schema(_with_batch(stream)).parquet(f"{folder}/out")


def _with_batch(stream: DataFrame):
    from pyspark.sql import types as T

    return T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])


def newest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Last update of each key, as an update-mode sink would hold it."""
    rest = [c for c in updates.columns if c not in keys]
    g = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x"))
    return g.select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest if c != "batch"])
