"""Per-symbol window building blocks.

Every per-symbol operator uses one physical layout: hash-partitioned by
``symbol`` and sorted by ``(_b19, _b16, _b8, _b1, _b0, rn)``.  The ``_b``
columns are coarse row blocks that grow with ``rn``, each level inside the one
before, so the sort equals date order, and one exchange plus one sort serves
the plain windows and the blocked windows of :func:`with_ema` alike.

Size of a window group: bars are unique per (symbol, date) -- enforced by the
aggregation that builds them -- so a daily group holds at most ~366 rows a
year however many trades the symbol has.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Block levels, coarsest first; each size is a multiple of the next.
LEVELS = {"_b19": 1 << 19, "_b16": 1 << 16, "_b8": 1 << 13, "_b1": 1 << 10, "_b0": 1 << 8}
#: Largest power of e that weights inside a block may reach (a double ends near 709), and
#: the least that rows two blocks back must have decayed by (1e-17).
MOST_GROWTH, LEAST_DECAY = 575.0, 39.0

ORDER = (*LEVELS, "rn")

# The same window as SQL text: one parsed expression is much cheaper to build
# than a chain of Column calls, and wide plans hold hundreds of them.
OVER = f"PARTITION BY symbol ORDER BY {', '.join(ORDER)}"


@lru_cache(maxsize=None)
def _spec(app: str):
    return Window.partitionBy("symbol").orderBy(*ORDER)


def by_symbol():
    return _spec(SparkContext._active_spark_context.applicationId)


def _frame(n: int) -> str:
    return f"({OVER} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def with_row_number(bars: DataFrame, order: str = "date") -> DataFrame:
    """Add ``rn`` (0-based row number per symbol) and the block numbers."""
    w = Window.partitionBy("symbol").orderBy(order)
    numbered = bars.withColumn("rn", F.row_number().over(w) - 1)
    return numbered.withColumns({level: F.floor(F.col("rn") / size) for level, size in LEVELS.items()})


def dealt(bars: DataFrame, parts: int) -> DataFrame:
    """Rows dealt by symbol over ``parts`` partitions; the column keeps the number for :func:`dealt_again`.

    Adaptive execution joins partitions by the bytes of the narrow rows that
    were shuffled, but the layers above make a row many times as wide, and its
    sorts then spill.  A named number of partitions is kept as it is.
    """
    return tagged(bars.repartition(parts, "symbol"), parts)


def tagged(bars: DataFrame, parts: int) -> DataFrame:
    return bars.withMetadata("symbol", {"parts": parts})


def dealt_again(df: DataFrame) -> DataFrame:
    """After a Python scan or a join, which lose the partitioning: the exchange that the next window needs, over as many partitions as before."""
    parts = df.schema["symbol"].metadata.get("parts")
    return df.repartition(parts, "symbol") if parts else df


def drop_layout(df: DataFrame) -> DataFrame:
    return df.drop(*LEVELS)


_LAGS: list[dict[str, Column]] = []


@contextmanager
def shared_lags() -> Iterator[dict[str, Column]]:
    """Inside, ``lag`` of a column's name is a column that the dict describes; to be added before what was built is selected.

    Many expressions that look at the same reading of the bar before then
    share one window function instead of one each.
    """
    _LAGS.append({})
    try:
        yield _LAGS[-1]
    finally:
        _LAGS.pop()


def lag(x: Column | str, k: int = 1) -> Column:
    if isinstance(x, str) and _LAGS:
        name = f"_lag{k}_{x}"
        _LAGS[-1][name] = F.expr(f"lag(`{x}`, {k}) OVER ({OVER}) AS `{name}`")
        return F.col(name)
    if isinstance(x, str):
        return F.expr(f"lag(`{x}`, {k}) OVER ({OVER})")
    return F.lag(x, k).over(by_symbol())


def lead(x: Column | str, k: int = 1) -> Column:
    return F.lead(x, k).over(by_symbol())


def roll(fn: Callable[[Column], Column], x: Column | str, n: int) -> Column:
    """Aggregate over the last ``n`` rows; null until all ``n`` are non-null."""
    if isinstance(x, str):
        over = _frame(n)
        return F.expr(f"CASE WHEN count(`{x}`) OVER {over} = {n} THEN {fn.__name__}(`{x}`) OVER {over} END")
    w = by_symbol().rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(w) == n, fn(x).over(w))


def tail(fn: Callable[[Column], Column], x: Column | str, n: int) -> Column:
    """Aggregate over the last ``n`` rows, fewer at the start of a series."""
    if isinstance(x, str):
        return F.expr(f"{fn.__name__}(`{x}`) OVER {_frame(n)}")
    return fn(x).over(by_symbol().rowsBetween(-(n - 1), 0))


def frame_array(x: Column, n: int) -> Column:
    """The last ``n`` values as an array in row order (bounded by ``n``)."""
    return F.collect_list(x).over(by_symbol().rowsBetween(-(n - 1), 0))


HALO = LEVELS["_b0"]


def sampled(df: DataFrame, picked: str, values: Sequence[str] = (), back: int = 0, ahead: int = 0, path: str = "path") -> DataFrame:
    """The rows of ``df`` where ``picked`` is true, with the frames around them.

    Adds ``_w_{x}`` for each of ``values``, the last ``back`` + 1 values up to
    the row, and ``path``, the next ``ahead`` bars (structs of open, high, low,
    close); both are shorter at the ends of a series.

    Each symbol's rows are put together in blocks of ``HALO`` and a block sees
    the arrays of the one before and the one after.  Frames are cut out of
    those three for the picked rows only, so a row that is not picked never
    carries one.  Neither frame may be longer than a block.
    """
    if max(back, ahead) > HALO:
        raise ValueError(f"frames reach at most {HALO} rows")
    rest = [c for c in df.columns if c not in ("symbol", "_b0", picked)]
    bar = ("open", "high", "low", "close")
    needed = [x for x in dict.fromkeys([*(values if back else ()), *(bar if ahead else ())]) if x != "rn"]
    own = F.array_sort(F.collect_list(F.struct("rn", *needed)))
    rows = F.collect_list(F.when(F.col(picked), F.struct(*rest)))
    blocks = df.groupBy("symbol", "_b0").agg(own.alias("_own"), rows.alias("_rows"))
    near = Window.partitionBy("symbol").orderBy("_b0")
    of = lambda x: lambda b: b[x]
    cols = {f"_a_{x}": F.transform("_own", of(x)) for x in (values if back else ())}
    if ahead:
        cols["_a_path"] = F.transform("_own", lambda b: F.struct(*[b[x].alias(x) for x in bar]))
    blocks = blocks.select("symbol", "_b0", "_rows", F.size("_own").alias("_n"), *[v.alias(k) for k, v in cols.items()])
    before = [F.coalesce(F.lag(f"_a_{x}").over(near), F.array()).alias(f"_p_{x}") for x in (values if back else ())]
    after = [F.coalesce(F.lead("_a_path").over(near), F.array()).alias("_q_path")] if ahead else []
    blocks = blocks.select("*", *before, *after).where(F.size("_rows") > 0)
    if back:  # one array a column: the end of the block before, then the block
        blocks = blocks.select("symbol", "_b0", "_rows", *(["_a_path", "_q_path"] if ahead else []), F.size(f"_p_{values[0]}").alias("_off"), *[F.concat(f"_p_{x}", f"_a_{x}").alias(f"_h_{x}") for x in values])
    if ahead:
        blocks = blocks.withColumn("_h_path", F.concat("_a_path", "_q_path")).drop("_a_path", "_q_path")

    def framed(row: Column) -> Column:
        at = (row["rn"] - F.col("_b0") * HALO).cast("int")
        fields = [row[c].alias(c) for c in rest]
        if back:
            first = F.col("_off") + at - back
            fields += [F.slice(f"_h_{x}", F.greatest(first, F.lit(0)) + 1, F.lit(back + 1) + F.least(first, F.lit(0))).alias(f"_w_{x}") for x in values]
        if ahead:
            fields.append(F.slice("_h_path", at + 2, F.lit(ahead)).alias(path))
        return F.struct(*fields)

    return blocks.select("symbol", "_b0", F.inline(F.transform("_rows", framed)))


def running(fn: Callable[[Column], Column], x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return fn(x).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))


def nonzero(x: Column) -> Column:
    return F.nullif(x, F.lit(0.0))


def cross_up(a: Column, b: Column, a_prev: Column, b_prev: Column) -> Column:
    return (a > b) & (a_prev <= b_prev)


@dataclass(frozen=True)
class Long:
    """A trailing max, min, avg or sd over ``n`` rows of a column.

    ``full`` makes it null until ``n`` values are there.
    """

    out: str
    source: str
    n: int
    kind: str
    full: bool = True


STRIDE = 16


def strided(both: str, short: str, n: int) -> Column:
    """``greatest`` or ``least`` of the last ``n`` rows from ``short``, a full roll of ``STRIDE`` rows; null until all ``n`` are non-null."""
    places = [f"lag(`{short}`, {k}) OVER ({OVER})" if k else f"`{short}`" for k in [*range(0, n - STRIDE, STRIDE), n - STRIDE]]
    return F.expr(f"CASE WHEN {' AND '.join(f'{x} IS NOT NULL' for x in places)} THEN {both}({', '.join(places)}) END")


def with_long(df: DataFrame, specs: Sequence[Long]) -> DataFrame:
    """Add trailing aggregates whose cost per row does not grow with ``n``.

    Extremes of a long frame are the extremes of 16-row frames taken 16 rows
    apart; means and deviations are differences of running sums.  Short
    frames use a plain sliding window.  Infinite values and NaN count as
    missing, so one bad reading spoils only the frames that hold it.
    """
    first, outs = {}, []
    upto = f"({OVER} ROWS UNBOUNDED PRECEDING)"
    short_frame = _frame(STRIDE)
    for s in specs:
        x = s.source
        if s.n <= 2 * STRIDE:
            fn = {"max": F.max, "min": F.min, "avg": F.avg, "sd": F.stddev_samp}[s.kind]
            outs.append((roll if s.full else tail)(fn, x, s.n).alias(s.out))
            continue

        def trailing(total: str) -> str:
            return f"(`{total}` - coalesce(lag(`{total}`, {s.n}) OVER ({OVER}), 0))"

        # Not finite: the difference with itself is not 0.
        finite = f"CASE WHEN `{x}` - `{x}` = 0 THEN `{x}` END"
        first[f"_n_{x}"] = f"count({finite}) OVER {upto}"
        seen = trailing(f"_n_{x}")
        if s.kind in ("max", "min"):
            short = f"_{s.kind}_{x}"
            first[short] = f"{s.kind}({finite}) OVER {short_frame}"
            steps = [*range(0, s.n - STRIDE, STRIDE), s.n - STRIDE]
            both = "greatest" if s.kind == "max" else "least"
            value = f"{both}({', '.join(f'lag(`{short}`, {k}) OVER ({OVER})' for k in steps)})"
        else:
            first[f"_s_{x}"] = f"sum(CAST({finite} AS DOUBLE)) OVER {upto}"
            part = trailing(f"_s_{x}")
            value = f"{part} / {seen}"
            if s.kind == "sd":
                first[f"_q_{x}"] = f"sum({finite} * {finite}) OVER {upto}"
                spread = f"{trailing(f'_q_{x}')} - {part} * {part} / {seen}"
                value = f"sqrt(greatest(0.0D, {spread}) / ({seen} - 1))"
        outs.append(F.expr(f"CASE WHEN {seen} = {s.n} THEN {value} END AS `{s.out}`" if s.full else f"{value} AS `{s.out}`"))
    if not first:
        return df.select("*", *outs)
    kept = df.columns
    return df.select("*", *[F.expr(f"{v} AS `{k}`") for k, v in first.items()]).select(*kept, *outs)


@dataclass(frozen=True)
class Ema:
    """One recursive mean ``E = alpha*x + (1-alpha)*E_prev``.

    ``seed`` is the row number whose value starts the recursion: an int, or
    the name of a column holding it.
    """

    out: str
    source: str
    alpha: float
    seed: int | str = 0


def span(out: str, source: str, n: int, seed: int | str = 0) -> Ema:
    return Ema(out, source, 2.0 / (n + 1.0), seed)


def wilder(out: str, source: str, n: int, seed: int | str = 0) -> Ema:
    return Ema(out, source, 1.0 / n, seed)


def _blocks(alpha: float) -> tuple[int, list[str]]:
    """Size and levels of the blocks of a recursion: the coarsest whose weights fit a double."""
    decay = -math.log(1.0 - alpha)
    for i, (level, size) in enumerate(LEVELS.items()):
        if decay * size <= MOST_GROWTH:
            if decay * size < LEAST_DECAY:
                raise ValueError(f"smoothing {alpha} reaches back further than the largest block")
            return size, list(LEVELS)[: i + 1]
    raise ValueError(f"smoothing {alpha} is too close to 1")


def with_ema(df: DataFrame, specs: Sequence[Ema]) -> DataFrame:
    """Add recursive means as window sums.

    Unrolled, ``E_t = keep^j * sum(w_s x_s keep^-s)``.  The exponent restarts
    in every block so it never overflows; the value at the end of the block
    before is carried in.  Blocks are as long as the smoothing allows, so
    that anything older weighs less than 1e-17.  A smoothing of 1 is the
    series itself.
    """
    parts, carries, outs = [], [], []
    for s in specs:
        if s.alpha == 1.0:
            outs.append(F.expr(f"CASE WHEN rn >= {s.seed} THEN CAST(`{s.source}` AS DOUBLE) END AS `{s.out}`"))
            continue
        size, block = _blocks(s.alpha)
        order = ", ".join(c for c in ORDER if c not in block)
        inner = f"PARTITION BY symbol, {', '.join(block)} ORDER BY {order} ROWS UNBOUNDED PRECEDING"
        before = f"{OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
        keep, j = f"{1.0 - s.alpha!r}D", f"(rn % {size})"
        part, carry = f"_p_{s.out}", f"_c_{s.out}"
        weight = f"CASE WHEN rn = {s.seed} THEN 1.0D ELSE {s.alpha!r}D END"
        parts.append(F.expr(f"sum({weight} * `{s.source}` * pow({keep}, -{j})) OVER ({inner}) AS `{part}`"))
        end = f"CASE WHEN {j} = {size - 1} THEN pow({keep}, {j}) * `{part}` END"
        carries.append(F.expr(f"last({end}, true) OVER ({before}) AS `{carry}`"))
        outs.append(
            F.expr(
                f"CASE WHEN rn >= {s.seed} THEN pow({keep}, {j}) * "
                f"(coalesce(`{part}`, 0.0D) + {keep} * coalesce(`{carry}`, 0.0D)) END AS `{s.out}`"
            )
        )
    kept = df.columns
    return df.select("*", *parts).select("*", *carries).select(*kept, *outs)


def first_seen(x: Column) -> Column:
    """Row number of the first non-null value so far (seed of a masked series)."""
    return running(F.min, F.when(x.isNotNull(), F.col("rn")))
