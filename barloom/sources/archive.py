"""Reading and writing bar archives and scan logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.outcomes import valid_bar_tolerant


def load(bars: DataFrame, symbol: str) -> DataFrame:
    """All bars of one symbol in date order; the filter reaches the scan."""
    return bars.where(F.col("symbol") == symbol).orderBy("date")


def load_many(bars: DataFrame, universe: DataFrame) -> DataFrame:
    """Bars of every symbol of a universe table; unknown symbols drop out."""
    return bars.join(universe.select("symbol").distinct(), "symbol", "left_semi")


def date_range(bars: DataFrame, start: str, end: str) -> DataFrame:
    return bars.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def on_calendar(bars: DataFrame, index: DataFrame, end: str, min_sessions: int = 260) -> DataFrame:
    """Bars up to ``end``, every symbol re-indexed onto the index calendar.

    The calendar is one array (bounded by the sessions) unfolded per symbol,
    so no product of two tables is built.  Duplicate (symbol, date) rows or a
    short calendar make the read fail.
    """
    until = F.lit(end).cast("date")
    old = bars.where(F.col("date") <= until)
    sessions = index.where(F.col("date") <= until).agg(F.sort_array(F.collect_set("date")).alias("d"))
    dates = sessions.select("d").scalar()
    dates = F.when(F.size(dates) >= min_sessions, dates).otherwise(F.raise_error(F.lit("calendar too short")))
    grid = old.select("symbol").distinct().select("symbol", F.explode(dates).alias("date"))
    return grid.join(assert_unique(old), ["symbol", "date"], "left")


def assert_unique(bars: DataFrame) -> DataFrame:
    """Fail on a repeated (symbol, date); one aggregation, no per-symbol sort."""
    rest = [c for c in bars.columns if c not in ("symbol", "date")]
    g = bars.groupBy("symbol", "date").agg(F.count("*").alias("_n"), F.any_value(F.struct(*rest)).alias("_r"))
    checked = F.when(F.col("_n") == 1, F.col("_r")).otherwise(F.raise_error(F.lit("duplicate symbol date")))
    return g.select("symbol", "date", checked.alias("_r")).select("symbol", "date", *[F.col(f"_r.{c}").alias(c) for c in rest])


def snapshot_status(bars: DataFrame, cutoff: str, min_rows: int = 220, max_age: int = 5) -> DataFrame:
    """Per-symbol verdict of a frozen price snapshot."""
    day = F.lit(cutoff).cast("date")
    used = bars.where(F.col("date") <= day)
    return used.groupBy("symbol").agg(
        F.count("*").alias("rows"),
        F.count_if(~valid_bar_tolerant()).alias("invalid"),
        F.max("date").alias("newest"),
    ).withColumn(
        "ok", (F.col("rows") >= min_rows) & (F.col("invalid") == 0) & (F.datediff(day, "newest") <= max_age)
    )


PRICE_BASES = ("raw", "split_adjusted", "total_return_adjusted", "unknown")


def row_hash(*columns: str) -> Column:
    return F.sha2(F.concat_ws(",", *columns), 256)


def fingerprint(bars: DataFrame, columns: list[str]) -> DataFrame:
    """One content hash per symbol over its rows in date order (bounded by the calendar)."""
    hashed = bars.select("symbol", F.struct("date", row_hash(*columns).alias("h")).alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["h"])
    return hashed.groupBy("symbol").agg(F.count("*").alias("rows"), F.sha2(F.array_join(ordered, ""), 256).alias("content_hash"))


def save_snapshot(bars: DataFrame, path: str, source: str, price_basis: str, columns: list[str], as_text: Callable[[DataFrame], DataFrame] = lambda x: x) -> None:
    """Write bars and their provenance once; an existing folder is an error.

    ``as_text`` turns the hashed columns into the text that is hashed.
    """
    if not source or price_basis not in PRICE_BASES:
        raise ValueError("an explicit source and a supported price basis are required")
    assert_unique(bars).write.mode("errorifexists").parquet(f"{path}/bars")
    meta = fingerprint(as_text(bars), columns).join(
        bars.groupBy("symbol").agg(F.count_if(~valid_bar_tolerant()).alias("invalid_rows")), "symbol"
    )
    meta.withColumns({"source": F.lit(source), "price_basis": F.lit(price_basis)}).write.mode("errorifexists").parquet(f"{path}/provenance")


def gate_upsert(existing: DataFrame, batch: DataFrame, provenance: DataFrame) -> DataFrame:
    """Per batch symbol: accepted, or the reason it waits for review.

    ``provenance(symbol, provider, basis)`` describes the stored series and
    ``batch`` carries its own ``provider`` and ``basis``.
    """
    keys = batch.groupBy("symbol").agg(F.any_value("provider").alias("provider"), F.any_value("basis").alias("basis"))
    lost = existing.select("symbol", "date").join(batch.select("symbol", "date"), ["symbol", "date"], "left_anti")
    lost = lost.groupBy("symbol").agg(F.count("*").alias("missing_dates"))
    known = existing.select("symbol").distinct().withColumn("_known", F.lit(True))
    p = provenance.select("symbol", F.col("provider").alias("_p"), F.col("basis").alias("_b"))
    df = keys.join(known, "symbol", "left").join(p, "symbol", "left").join(lost, "symbol", "left")
    same = F.coalesce((F.col("_p") == F.col("provider")) & (F.col("_b") == F.col("basis")), F.lit(False))
    reason = (
        F.when(F.col("_known").isNull(), F.lit(None).cast("string"))
        .when(~same, "unknown_or_changed_provider_basis")
        .when(F.coalesce("missing_dates", F.lit(0)) > 0, "partial_history_requires_review")
    )
    return df.select("symbol", "provider", "basis", reason.alias("reason"), reason.isNull().alias("accepted"))


def apply_upsert(existing: DataFrame, batch: DataFrame, gate: DataFrame) -> DataFrame:
    """Accepted batch rows win by (symbol, date); everything else stays."""
    good = batch.join(gate.where("accepted").select("symbol"), "symbol", "left_semi").select(*existing.columns)
    return existing.join(good.select("symbol", "date"), ["symbol", "date"], "left_anti").unionByName(good)


def stale(symbols: DataFrame, fetched: DataFrame, queue: DataFrame, today: str) -> DataFrame:
    """Symbols neither fetched nor queued today."""
    day = F.lit(today).cast("date")
    df = symbols.join(fetched, "symbol", "left").join(queue.withColumnRenamed("day", "queued"), "symbol", "left")
    return df.where((F.col("last_fetched").isNull() | (F.col("last_fetched") < day)) & (F.col("queued").isNull() | (F.col("queued") != day))).select("symbol")


def inventory(bars: DataFrame) -> DataFrame:
    """Counted per symbol first, so the distinct count stays a plain sum."""
    per = bars.groupBy("symbol").agg(F.count("*").alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi"))
    return per.agg(F.sum("n").alias("rows"), F.count("*").alias("symbols"), F.min("lo").alias("first_date"), F.max("hi").alias("last_date"))


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` per key.

    An aggregation with partial combine: a key repeated by a third of all
    rows shrinks before the shuffle, unlike a row number over the group.
    """
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_x"))
    return g.select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest])


# --- scan log --------------------------------------------------------------------


def clean_symbol(x: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(x, r"\.NS$", "")))


def append_scan_log(rows: DataFrame, path: str) -> None:
    rows.withColumn("signals", F.slice("signals", 1, 10)).write.mode("append").parquet(path)


def newest_snapshots(log: DataFrame, keep: int = 3) -> DataFrame:
    """Rows of the ``keep`` newest runs of each scan type."""
    runs = log.groupBy("scan_type", "run_id").agg(F.max("saved_at").alias("saved_at"))
    w = Window.partitionBy("scan_type").orderBy(F.col("saved_at").desc(), F.col("run_id").desc())
    kept = runs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep)
    return log.join(kept.select("scan_type", "run_id"), ["scan_type", "run_id"], "left_semi")


def broadest_recent(log: DataFrame, runs: int = 12, hours: int = 12) -> DataFrame:
    """Among the newest runs, the broadest one saved within ``hours`` of the newest, per scan type."""
    per = log.groupBy("scan_type", "run_id").agg(F.max("saved_at").alias("saved_at"), F.count("*").alias("n"))
    w = Window.partitionBy("scan_type").orderBy(F.col("saved_at").desc(), F.col("run_id").desc())
    per = per.withColumns({"_r": F.row_number().over(w), "_newest": F.max("saved_at").over(Window.partitionBy("scan_type"))})
    near = per.where((F.col("_r") <= runs) & (F.col("saved_at") >= F.col("_newest") - F.expr(f"INTERVAL {hours} HOURS")))
    best = near.groupBy("scan_type").agg(F.max_by(F.struct("run_id", "saved_at", "n"), F.struct("n", "saved_at", "run_id")).alias("b"))
    return best.select("scan_type", "b.run_id", "b.saved_at", "b.n")


def merge_narrow(held: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh rows win per symbol, other held rows stay."""
    both = held.withColumn("_v", F.lit(0)).unionByName(fresh.withColumn("_v", F.lit(1)))
    return keep_last(both, ["symbol"], ["_v"]).drop("_v")


def history(log: DataFrame, since: Column, limit: int = 200, scan_type: str = "swing") -> DataFrame:
    return log.where((F.col("scan_type") == scan_type) & (F.col("scanned_at") >= since)).orderBy(
        F.col("scanned_at").desc(), F.col("score100").desc(), "id"
    ).limit(limit)


def write_dump(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Evaluation dumps: raw observations and values as CSV, events as JSON lines."""
    writer = df.write.mode("errorifexists")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)
