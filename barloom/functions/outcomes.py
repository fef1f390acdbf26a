"""What happened after a bar: forward paths, stop/target touches and exit rules.

A forward path is an array of at most 63 bars taken by a bounded frame, so
its size does not depend on the length of the series.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions.windows import by_symbol, lead

# Cost components of one round trip as fractions of the notional.
BROKERAGE = 0.0010
SECURITIES_TAX = 0.0010
EXCHANGE_FEE = 0.0000297
REGULATOR_FEE = 0.000001
STAMP_DUTY = 0.00015
GST = 0.18
SLIPPAGE = 0.0005

CHARGES = (
    2 * (BROKERAGE + SECURITIES_TAX + EXCHANGE_FEE + REGULATOR_FEE)
    + STAMP_DUTY
    + 2 * GST * (BROKERAGE + EXCHANGE_FEE + REGULATOR_FEE)
)
ROUND_TRIP = CHARGES + 2 * SLIPPAGE
ROUND_TRIP_PCT = 0.5582


def path(n: int) -> Column:
    bar = F.struct("open", "high", "low", "close")
    return F.collect_list(bar).over(by_symbol().rowsBetween(1, n))


def first_touch(bars: Column, stop: Column, target: Column, gaps: bool) -> Column:
    """The first bar that reaches the stop or the target, or null.

    Within a bar an opening gap comes first (``gaps``), then the stop, then
    the target.
    """

    def at_open(x: Column) -> Column:
        return F.lit(gaps) & ((x["open"] <= stop) | (x["open"] >= target))

    def touch(place: Column) -> Column:
        x = F.get(bars, place - 1)
        stopped = F.when(at_open(x), x["open"] <= stop).otherwise(x["low"] <= stop)
        price = F.when(at_open(x), x["open"]).when(stopped, stop).otherwise(target)
        return F.when(
            place > 0,
            F.struct(place.cast("int").alias("bar"), at_open(x).alias("at_open"), F.when(stopped, "sl").otherwise("t1").alias("outcome"), price.alias("price")),
        )

    # Only whether a bar is reached is asked of every bar; the rest of the first one that is.
    hits = F.transform(bars, lambda x: F.coalesce(at_open(x) | (x["low"] <= stop) | (x["high"] >= target), F.lit(False)))
    return F.get(F.transform(F.array(F.array_position(hits, True)), touch), 0)


def with_trade(df: DataFrame, stop: str, target: str, hold: int, gaps: bool) -> DataFrame:
    """Enter at the next open, leave at stop, target or the last bar of the horizon.

    Adds ``outcome`` (sl / t1 / timeout), ``ret``, ``mae`` and ``mfe`` in
    percent; null when there is no next bar.
    """
    return with_path_trade(df.withColumn("_path", path(hold)), "_path", stop, target, gaps)


def with_path_trade(df: DataFrame, bars: str, stop: str, target: str, gaps: bool) -> DataFrame:
    """As :func:`with_trade` over a forward path that is already a column."""
    df = df.withColumnRenamed(bars, "_path")
    df = df.withColumn("_touch", first_touch(F.col("_path"), F.col(stop), F.col(target), gaps))
    entry = F.try_element_at("_path", F.lit(1))["open"] * (1 + SLIPPAGE)
    df = df.withColumn("entry", F.when(F.try_element_at("_path", F.lit(1))["open"] > 0, entry))
    touch = F.col("_touch")
    held = F.coalesce(touch["bar"], F.size("_path"))
    # An exit at the open sees nothing of that bar's range. The percentage rises with the price, so the extreme price has the extreme one.
    inside = F.when(touch["at_open"], held - 1).otherwise(held)
    low = F.array_min(F.slice(F.col("_path")["low"], 1, inside))
    high = F.array_max(F.slice(F.col("_path")["high"], 1, inside))
    gap = F.when(touch["at_open"], (touch["price"] / F.col("entry") - 1.0) * 100.0)
    leave = F.coalesce(touch["price"], F.try_element_at("_path", F.lit(-1))["close"]) * (1 - SLIPPAGE)
    known = F.col("entry").isNotNull()
    return df.select(
        *[c for c in df.columns if c not in ("_path", "_touch")],
        F.when(known, F.coalesce(touch["outcome"], F.lit("timeout"))).alias("outcome"),
        F.when(known, ((leave - F.col("entry")) / F.col("entry") - CHARGES) * 100.0).alias("ret"),
        F.when(known, F.least(F.lit(0.0), (low - F.col("entry")) / F.col("entry") * 100.0, gap)).alias("mae"),
        F.when(known, F.greatest(F.lit(0.0), (high - F.col("entry")) / F.col("entry") * 100.0, gap)).alias("mfe"),
    )


def target_label(hold: int = 15, up_pct: float = 2.0, down_pct: float = 1.0) -> dict[str, Column]:
    """1 when +2% is reached before -1% within 15 bars of the next open, else 0; null without a full horizon."""
    first_open = F.try_element_at("_label_path", F.lit(1))["open"]
    entry = first_open * (1 + SLIPPAGE)
    finite = F.forall(
        "_label_path",
        lambda x: x["open"].isNotNull() & x["high"].isNotNull() & x["low"].isNotNull(),
    )
    touch = first_touch(F.col("_label_path"), entry * (1 - down_pct / 100), entry * (1 + up_pct / 100), True)
    whole = (F.size("_label_path") == hold) & finite & (first_open > 0)
    return {"label": F.when(whole, F.when(F.coalesce(touch["outcome"], F.lit("sl")) == "t1", 1).otherwise(0))}


def with_target_label(df: DataFrame, hold: int = 15) -> DataFrame:
    df = df.withColumn("_label_path", path(hold))
    return df.withColumns(target_label(hold)).drop("_label_path")


def valid_bar() -> Column:
    """Strict bar check: finite, positive, ordered, traded."""
    o, h, l, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    finite = ~(F.isnan(o) | F.isnan(h) | F.isnan(l) | F.isnan(c) | F.isnan(v))
    infinite = F.greatest(F.abs(o), F.abs(h), F.abs(l), F.abs(c), F.abs(v)) == float("inf")
    return F.coalesce(
        o.isNotNull() & h.isNotNull() & l.isNotNull() & c.isNotNull() & v.isNotNull()
        & finite & ~infinite
        & (F.least(o, h, l, c) > 0)
        & (h >= F.greatest(o, l, c))
        & (l <= F.least(o, h, c))
        & (v > 0),
        F.lit(False),
    )


def valid_bar_tolerant() -> Column:
    """As :func:`valid_bar`, forgiving machine rounding at the high and the low."""
    o, h, l, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    eps = F.greatest(F.abs(o), F.abs(h), F.abs(l), F.abs(c)) * 1e-10 + 1e-8
    finite = ~(F.isnan(o) | F.isnan(h) | F.isnan(l) | F.isnan(c) | F.isnan(v))
    infinite = F.greatest(F.abs(o), F.abs(h), F.abs(l), F.abs(c), F.abs(v)) == float("inf")
    return F.coalesce(
        o.isNotNull() & h.isNotNull() & l.isNotNull() & c.isNotNull() & v.isNotNull()
        & finite & ~infinite
        & (F.least(o, h, l, c) > 0)
        & (h + eps >= F.greatest(o, l, c))
        & (l - eps <= F.least(o, h, c))
        & (v > 0),
        F.lit(False),
    )


def with_fixed_horizon(df: DataFrame, cost_pct: float = ROUND_TRIP_PCT) -> DataFrame:
    """Open of the next bar to the close 21 bars on, with the reason when unknown."""
    df = df.withColumn("_good", valid_bar())
    inner = by_symbol().rowsBetween(2, 20)
    entry, leave = F.coalesce(lead("_good", 1), F.lit(False)), F.coalesce(lead("_good", 21), F.lit(False))
    whole = (F.count("_good").over(inner) == 19) & F.min("_good").over(inner)
    status = (
        F.when(~entry, "unknown_entry")
        .when(~leave, "unresolved_exit")
        .when(whole, "observed")
        .otherwise("observed_with_interior_gap")
    )
    ret = 100.0 * (lead("close", 21) / lead("open", 1) - 1.0) - cost_pct
    return df.select("*", status.alias("status"), F.when(entry & leave, ret).alias("fixed_ret")).drop("_good")


def forward_returns(horizons: dict[str, int], cost_pct: float = ROUND_TRIP_PCT) -> dict[str, Column]:
    """Net return from the next open to the n-th close after it; null until reached."""
    usable = lead("close", 5).isNotNull() & (lead("open", 1) > 0)
    return {
        name: F.when(usable, (lead("close", n) / lead("open", 1) - 1.0) * 100.0 - cost_pct)
        for name, n in horizons.items()
    }


# --- exit rules ------------------------------------------------------------


@dataclass(frozen=True)
class Exit:
    """One exit rule: its name, kind and parameters."""

    name: str
    kind: str  # fixed | trail | breakeven | time
    hold: int
    mult: float = 2.5
    trigger: float = 1.0


EXITS: list[Exit] = (
    [Exit(f"fixed h{h}", "fixed", h) for h in (5, 10, 21)]
    + [Exit(f"trail {m}atr h{h}", "trail", h, m) for h in (10, 21, 63) for m in (1.5, 2.5, 3.5)]
    + [Exit(f"be+trail 2.5 h{h}", "breakeven", h) for h in (21, 63)]
    + [Exit(f"time only h{h}", "time", h) for h in (5, 21, 63)]
)


def _leave_fixed(bars: Column, x: Exit) -> Column:
    return first_touch(bars, F.col("sl"), F.col("t1"), False)["price"]


def _leave_trailing(bars: Column, x: Exit) -> Column:
    start = F.struct(F.col("entry").alias("peak"), F.lit(None).cast("double").alias("price"))

    def step(s: Column, bar: Column) -> Column:
        stop = s["peak"] - x.mult * F.col("atr")
        return F.struct(
            F.greatest(s["peak"], bar["high"]).alias("peak"),
            F.coalesce(s["price"], F.when(bar["low"] <= stop, stop)).alias("price"),
        )

    return F.aggregate(bars, start, step, lambda s: s["price"])


def _leave_breakeven(bars: Column, x: Exit) -> Column:
    stop0 = F.coalesce(F.col("sl"), F.col("entry") - 2.0 * F.col("atr"))
    start = F.struct(
        stop0.alias("stop"), F.col("entry").alias("peak"), F.lit(False).alias("armed"),
        F.lit(None).cast("double").alias("price"),
    )

    def step(s: Column, bar: Column) -> Column:
        peak = F.greatest(s["peak"], bar["high"])
        armed = s["armed"] | (peak >= F.col("entry") + x.trigger * F.col("atr"))
        return F.struct(
            F.when(armed, F.greatest(s["stop"], peak - x.mult * F.col("atr"))).otherwise(s["stop"]).alias("stop"),
            peak.alias("peak"),
            armed.alias("armed"),
            F.coalesce(s["price"], F.when(bar["low"] <= s["stop"], s["stop"])).alias("price"),
        )

    return F.aggregate(bars, start, step, lambda s: s["price"])


_LEAVE = {
    "fixed": _leave_fixed,
    "trail": _leave_trailing,
    "breakeven": _leave_breakeven,
    "time": lambda bars, x: F.lit(None).cast("double"),
}


def exit_return(x: Exit) -> Column:
    """Net percent return of one signal row (entry, atr, sl, t1, path) under an exit rule."""
    bars = F.slice("path", 1, x.hold)
    price = F.coalesce(_LEAVE[x.kind](bars, x), F.try_element_at(bars, F.lit(-1))["close"])
    return (price / F.col("entry") - 1.0 - ROUND_TRIP) * 100.0


def sweep(signals: DataFrame, exits: list[Exit] = EXITS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every exit rule on every signal, in long form."""
    rows = []
    for x in exits:
        best = F.array_max(F.transform(F.slice("path", 1, x.hold), lambda b: b["high"]))
        rows.append(
            F.struct(
                F.lit(x.name).alias("variant"),
                F.lit(x.hold).alias("hold"),
                exit_return(x).alias("ret"),
                ((best / F.col("entry") - 1.0) * 100.0).alias("mfe"),
            )
        )
    return signals.select("symbol", "date", *keep, F.inline(F.array(*rows)))
