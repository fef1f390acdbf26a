"""Dated picks, valuations and the table-shaped parts of portfolio accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.operators.lineage import materialize, written
from barloom.operators.segmented import Scan, affine, placed, scan

ARMS = ("stable_control", "momentum", "momentum_trend", "year_high")


def month_ends(index: DataFrame) -> DataFrame:
    """Last session of each month of an index calendar, except an unfinished last one."""
    w = Window.partitionBy("symbol").orderBy("date")
    nxt = F.lead("date").over(w)
    return index.withColumn("_next", nxt).where(F.month("_next") != F.month("date")).select("date")


def monthly_picks(features: DataFrame, signal_days: DataFrame, risk_on: DataFrame, top: int = 20) -> DataFrame:
    """Ranked symbols per (date, arm).

    A date holds one row per symbol, and the rank filter trims each task to
    ``top`` rows before the shuffle.
    """
    c = F.col
    f = features.where("eligible").join(signal_days, "date", "left_semi").join(risk_on, "date", "left")
    arms = F.array(
        F.struct(F.lit("stable_control").alias("arm"), F.lit(0.0).alias("value"), F.sha2("symbol", 256).alias("key")),
        F.struct(F.lit("momentum").alias("arm"), c("momentum").alias("value"), F.lit("").alias("key")),
        F.struct(F.lit("momentum_trend").alias("arm"), F.when(c("risk_on"), c("momentum")).alias("value"), F.lit("").alias("key")),
        F.struct(F.lit("year_high").alias("arm"), F.when(c("year_high") >= 0.95, c("year_high")).alias("value"), F.lit("").alias("key")),
    )
    long = f.select("date", "symbol", F.inline(arms)).where(c("value").isNotNull() & ~F.isnan("value"))
    w = Window.partitionBy("date", "arm").orderBy("key", c("value").desc(), "symbol")
    return long.withColumn("position", F.row_number().over(w)).where(c("position") <= top).drop("key")


def price_jumps(bars: DataFrame, limit: float = 0.4) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("date")
    move = F.col("close") / F.lag("close").over(w) - 1.0
    return bars.withColumn("move", move).where(F.abs("move") > limit)


def allocate(
    targets: DataFrame, nav: float, cash: float, max_weight: float, participation: float, max_sector: float, side_cost: float
) -> DataFrame:
    """Whole-share buys for one date in rank order, before any fill.

    Each order is capped by weight and by turnover; running sums by rank then
    cut what exceeds the sector and cash limits.  A date holds one row per
    picked symbol.
    """
    c = F.col
    price = c("price")
    budget = F.least(c("budget"), F.lit(max_weight * nav))
    qty = F.floor(F.least(budget / price, participation * c("turnover") / price))
    df = targets.where((price > 0) & (c("turnover") > 0)).withColumn("want", qty).where(c("want") > 0)
    by_sector = Window.partitionBy("date", "sector").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(c("want") * price).over(by_sector), F.lit(0.0))
    df = df.withColumn("want", F.least("want", F.greatest(F.lit(0), F.floor((F.lit(max_sector * nav) - used) / price)))).where(c("want") > 0)
    by_rank = Window.partitionBy("date").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(c("want") * price * (1 + side_cost)).over(by_rank), F.lit(0.0))
    left = F.floor((F.lit(cash) - spent) / (price * (1 + side_cost)))
    return df.withColumn("quantity", F.least("want", F.greatest(F.lit(0), left))).where(c("quantity") > 0).drop("want")


def positions(fills: DataFrame) -> DataFrame:
    """Quantity, average cost and realised result after each fill of a symbol.

    ``fills(symbol, day, seq, side, qty, price)``, (day, seq) unique in a
    symbol.  Sells beyond the held quantity fill only what is held.  Quantity
    is a running sum less its own lowest dip, cost the affine recursion
    cost = keep * cost + add; both are scanned over blocks of fills, so a
    symbol may hold nearly all of them, and a full close (keep = 0) starts anew.
    """
    c = F.col
    order = [c("day"), c("seq")]
    signed = F.when(c("side") == "BUY", c("qty")).otherwise(-c("qty"))
    df = placed(fills.withColumn("_d", signed), ["symbol"], order, "_pos")  # sorted once for all three
    df = scan(df, ["symbol"], order, [Scan("_s", "sum", c("_d"))], at="_pos")
    df = scan(written(df), ["symbol"], order, [Scan("_low", "min", c("_s")), Scan("_low0", "min", c("_s"), False)], at="_pos")
    zero = F.lit(0)
    df = df.withColumns({
        "held": c("_s") - F.least(zero, c("_low")),
        "_prev": c("_s") - c("_d") - F.least(zero, F.coalesce("_low0", zero)),
    })
    df = df.withColumn("filled", F.when(c("side") == "BUY", c("qty")).otherwise(F.least(c("qty"), c("_prev"))))
    keep = F.when((c("side") == "BUY") | (c("_prev") == 0), 1.0).otherwise(1.0 - c("filled") / c("_prev"))
    add = F.when(c("side") == "BUY", c("qty") * c("price")).otherwise(0.0)
    df = affine(df, ["symbol"], order, keep, add, "_cost", "_before", at="_pos")
    realised = F.when((c("side") != "BUY") & (c("_prev") > 0), c("filled") * (c("price") - c("_before") / c("_prev"))).otherwise(0.0)
    return df.select(
        "symbol", "day", "seq", "side", "filled", "held", F.when(c("held") > 0, c("_cost") / c("held")).alias("avg_price"), realised.alias("realised")
    )


def valuation(holdings: DataFrame, marks: DataFrame, cash: Column) -> DataFrame:
    """Net value per account; unknown when any held position lacks a mark."""
    df = holdings.join(marks, "symbol", "left")
    return df.groupBy("account").agg(
        F.count_if(F.col("mark").isNull()).alias("missing"), F.sum(F.col("qty") * F.col("mark")).alias("held_value"), F.first(cash).alias("cash")
    ).select("account", "missing", F.when(F.col("missing") == 0, F.col("cash") + F.col("held_value")).alias("nav"))


def reviewed_actions(actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Corporate actions that may be applied, one row an id, and those that may not, with the reason.

    ``actions(id, symbol, type, ratio, cash_per_share, day)``.  An id that is
    repeated counts once and the repetition is refused; one that is repeated
    with other values is refused altogether.  Ratios must be finite and
    positive, dividends finite and not negative; every other type needs review.
    """
    c = F.col
    fields = ("symbol", "type", "ratio", "cash_per_share", "day")
    said = F.struct(*fields)
    once = actions.groupBy("id").agg(F.min(said).alias("a"), F.max(said).alias("b"), F.count(F.lit(1)).alias("n"))
    once = once.select("id", *[c(f"a.{f}").alias(f) for f in fields], "n", (~c("a").eqNullSafe(c("b"))).alias("differs"))
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    fault = (
        F.when(c("differs"), "conflicting_action")
        .when((c("type") == "split") & ~(finite(c("ratio")) & (c("ratio") > 0)), "invalid_ratio")
        .when((c("type") == "dividend_payment") & ~(finite(c("cash_per_share")) & (c("cash_per_share") >= 0)), "invalid_dividend")
        .when(~F.coalesce(c("type").isin("split", "dividend_payment"), F.lit(False)), "needs_review")
    )
    judged = materialize(once.withColumn("reason", fault))
    refused = judged.where(c("reason").isNotNull()).select("id", "symbol", "type", "day", "reason")
    repeated = judged.where(c("reason").isNull() & (c("n") > 1)).select("id", "symbol", "type", "day", F.lit("duplicate_action").alias("reason"))
    return judged.where(c("reason").isNull()).select("id", *fields), refused.unionByName(repeated)


def entitlements(changes: DataFrame) -> DataFrame:
    """Quantities as intervals: (account, symbol, qty, valid_from, valid_to), the end open while null.

    ``changes(account, symbol, day, qty)`` are signed; the quantity of an
    interval is what was held after its first day's changes.
    """
    daily = changes.groupBy("account", "symbol", "day").agg(F.sum("qty").alias("_d"))
    w = Window.partitionBy("account", "symbol").orderBy("day")
    held = F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return daily.select("account", "symbol", held.alias("qty"), F.col("day").alias("valid_from"), F.lead("day").over(w).alias("valid_to"))


def entitled(intervals: DataFrame, actions: DataFrame) -> DataFrame:
    """Each action with the accounts that hold its symbol on its day and what they hold then, never what they hold later.

    The intervals of an account and symbol do not overlap.  Days that an
    account is asked about are put among the beginnings of its intervals, and
    the newest of these counts if it has not ended; so the work is that of
    the days asked and of the answers, not of all intervals with all actions.
    """
    c = F.col
    owner = ("account", "symbol")
    kept = [x for x in intervals.columns if x not in (*owner, "valid_from", "valid_to")]
    held = intervals.where("qty > 0 AND symbol IS NOT NULL AND valid_from IS NOT NULL")
    days = actions.select("symbol", "day").distinct().where("symbol IS NOT NULL AND day IS NOT NULL")
    spans = held.groupBy(*owner).agg(F.min("valid_from").alias("_first"), F.max("valid_to").alias("_end"), F.count_if(c("valid_to").isNull()).alias("_open"))
    asked = days.join(spans, "symbol").where((c("_first") <= c("day")) & ((c("_open") > 0) | (c("day") < c("_end"))))
    begun = held.select(*owner, c("valid_from").alias("day"), F.struct(*kept, "valid_to").alias("_is"))
    both = begun.unionByName(asked.select(*owner, "day"), allowMissingColumns=True)
    w = Window.partitionBy(*owner).orderBy("day", c("_is").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_held", F.last("_is", ignorenulls=True).over(w)).where("_is IS NULL AND (_held.valid_to IS NULL OR day < _held.valid_to)")
    return found.select(*owner, *[c(f"_held.{x}").alias(x) for x in kept], "day").join(actions, ["symbol", "day"])


def dividend_cash(intervals: DataFrame, sound: DataFrame) -> DataFrame:
    """Dividends per account on the quantity held at each entitlement; those of a symbol and day are added up first."""
    daily = sound.where("type = 'dividend_payment'").groupBy("symbol", "day").agg(F.sum("cash_per_share").alias("_cash"), F.count(F.lit(1)).alias("_n"))
    paid = entitled(intervals, daily)
    return paid.groupBy("account").agg(F.sum(F.col("qty") * F.col("_cash")).alias("dividend_cash"), F.sum("_n").alias("payments"))


def apply_splits(holdings: DataFrame, sound: DataFrame) -> DataFrame:
    """Quantity times, and mark divided by, all split ratios of a symbol after ``held_since``, in the order of their days; each action once.

    ``sound`` are reviewed actions: one that is repeated with other values, or
    a ratio that is not finite and positive, is an error here.  ``unresolved`` tells a holding that some split left with a fraction of a
    share: what becomes of it needs evidence, so its value is not known.
    """
    c = F.col
    said = F.struct("symbol", "ratio", "day")
    once = sound.where("type = 'split'").groupBy("id").agg(F.min(said).alias("a"), F.max(said).alias("b"))
    good = c("a").eqNullSafe(c("b")) & (c("a.ratio") > 0) & (c("a.ratio") < float("inf"))
    ratio = F.when(good, c("a.ratio")).otherwise(F.raise_error(F.concat(F.lit("conflicting or unsound action "), c("id").cast("string"))).cast("double"))
    splits = once.select(c("a.symbol").alias("_symbol"), c("a.day").alias("day"), "id", ratio.alias("ratio"))
    met = holdings.join(splits, (c("symbol") == c("_symbol")) & (c("day") > c("held_since")), "left")
    keys = holdings.columns
    grouped = met.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(c("id").isNotNull(), F.struct("day", "id", "ratio")))).alias("_s"))
    start = F.struct(c("qty").cast("double").alias("q"), F.lit(1.0).alias("f"), F.lit(False).alias("odd"))

    def step(acc: Column, s: Column) -> Column:
        q = acc["q"] * s["ratio"]
        return F.struct(q.alias("q"), (acc["f"] * s["ratio"]).alias("f"), (acc["odd"] | (F.abs(q - F.rint(q)) > 1e-9)).alias("odd"))

    done = grouped.withColumn("_e", F.aggregate("_s", start, step))
    rest = [k for k in keys if k not in ("qty", "mark")]
    return done.select(*rest, c("_e.f").alias("factor"), c("_e.q").alias("qty"), (c("mark") / c("_e.f")).alias("mark"), c("_e.odd").alias("unresolved"))


def quarantine(intervals: DataFrame, refused: DataFrame) -> DataFrame:
    """Refused actions: those that need review for each account that holds the symbol on the day, all others once, without an account."""
    review = entitled(intervals, refused.where("reason = 'needs_review'")).select("id", "symbol", "type", "reason", "account")
    return review.unionByName(refused.where("reason <> 'needs_review'").select("id", "symbol", "type", "reason", F.lit(None).cast(dict(intervals.dtypes)["account"]).alias("account")))


def exit_action(price: Column, sl: Column, t1: Column, qty: Column, age_days: Column, cost: Column, max_age: int = 10) -> dict[str, Column]:
    """What an open position does at a price: stop sells all, target sells half and raises the stop to cost, age sells all."""
    action = F.when(price <= sl, "SL_HIT").when(price >= t1, "T1_HIT").when(age_days >= max_age, "MAX_HOLD")
    sell = F.when(action == "T1_HIT", F.greatest(F.lit(1), F.floor(qty / 2))).when(action.isNotNull(), qty)
    return {"action": action, "sell_qty": sell, "stop": F.when(action == "T1_HIT", F.greatest(sl, cost)).when(action.isNull(), sl)}


def nav_metrics(nav: DataFrame, capital: float, side_cost: float = 0.0028) -> DataFrame:
    """Return, growth rate and drawdown per series; one row per (arm, date), bounded by the calendar."""
    c = F.col
    w = Window.partitionBy("arm").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    df = nav.withColumn("_peak", F.greatest(F.lit(capital), F.max("nav").over(w)))
    out = df.groupBy("arm").agg(
        F.count("*").alias("sessions"), F.max_by("nav", "date").alias("end"), F.max_by("cash", "date").alias("cash"),
        F.min(c("nav") / c("_peak") - 1.0).alias("dd"), (F.datediff(F.max("date"), F.min("date")) / 365.25).alias("years"),
        F.max("max_weight").alias("max_weight"), F.count_if(c("nav").isNull()).alias("unknown"),
    )
    whole = c("unknown") == 0
    return out.select(
        "arm", "sessions", "max_weight",
        F.when(whole, (c("end") / capital - 1.0) * 100.0).alias("total_return_pct"),
        F.when(whole, (F.pow(c("end") / capital, 1.0 / c("years")) - 1.0) * 100.0).alias("cagr_pct"),
        F.when(whole, F.least(c("dd"), F.lit(0.0)) * 100.0).alias("max_drawdown_pct"),
        F.when(whole, ((c("end") - (c("end") - c("cash")) * side_cost) / capital - 1.0) * 100.0).alias("liquidation_return_pct"),
    )


def yearly_returns(nav: DataFrame, capital: float) -> DataFrame:
    ends = nav.groupBy("arm", F.year("date").alias("year")).agg(F.max_by("nav", "date").alias("end"))
    w = Window.partitionBy("arm").orderBy("year")
    return ends.select("arm", "year", ((F.col("end") / F.coalesce(F.lag("end").over(w), F.lit(capital)) - 1.0) * 100.0).alias("return_pct"))
