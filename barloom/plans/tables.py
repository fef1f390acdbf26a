"""Analytic tables derived from the given parquet tables.

The given tables hold no price series, so each supplier is treated as an
instrument whose line items are its trades.  A day's log return is the
quantity-weighted discount around its mean, gaps come from the tax rate and
wicks from the cents of the traded amounts.  All sums are over integers, so
the result does not depend on the order in which partitions are merged.

The only wide step over raw rows is one ``groupBy(symbol, date)`` with
map-side partial aggregation: a hot supplier shrinks to one row per day
before the shuffle.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from barloom.functions.windows import dealt, tagged, with_row_number
from barloom.operators.lineage import checkpoint_folder, materialize
from barloom.sources.barstore import BarStore

INDEX_SYMBOL = "^INDEX"
#: An index of at most so many sessions (a row each) is broadcast; a longer one is joined by shuffle.
SESSIONS = 50_000
#: Trades behind a partition of bars: at most so many (a wide bar takes 1 to 2 kB in each sort), and below that no fewer than these.
TRADES, LEAST_TRADES = 1 << 17, 1 << 14


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions of the bars of a table folder: as many as shuffles have, fewer for a small table, and more as the trades grow."""
    trades = read(spark, sf_dir, "lineitem").count()
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-trades // TRADES), min(usual, -(-trades // LEAST_TRADES)))


def _daily_sums(items: DataFrame, symbol) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    qty = F.col("l_quantity").cast("long")
    return items.groupBy(symbol.alias("symbol"), F.to_date("l_shipdate").alias("date")).agg(
        F.sum(qty).alias("qty"),
        F.sum(F.round(F.col("l_discount") * 100).cast("long") * qty).alias("disc"),
        F.sum(F.round(F.col("l_tax") * 100).cast("long") * qty).alias("tax"),
        F.max(F.pmod(cents, F.lit(97))).alias("up"),
        F.max(F.pmod(cents, F.lit(89))).alias("down"),
    )


SUMS = ("qty", "disc", "tax", "up", "down")


def _walk(sums: DataFrame, scale: float, keep: tuple[str, ...] = ()) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("date")
    ret = (F.col("disc") / (F.col("qty") * 100.0) - 0.05) * scale
    gap = (F.col("tax") / (F.col("qty") * 100.0) - 0.04) * 0.15
    level = 100.0 * F.exp(F.sum(ret).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = 100.0 * F.exp(F.coalesce(F.sum(ret).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    priced = sums.select(
        "symbol",
        "date",
        F.round(before * F.exp(gap), 2).alias("open"),
        F.round(level, 2).alias("close"),
        (F.col("qty") * 100.0).alias("volume"),
        *SUMS,
    )
    return priced.select(
        "symbol",
        "date",
        "open",
        F.round(F.greatest("open", "close") * (1.0 + F.col("up") / 97.0 * 0.012), 2).alias("high"),
        F.round(F.least("open", "close") * (1.0 - F.col("down") / 89.0 * 0.012), 2).alias("low"),
        "close",
        "volume",
        *keep,
    )


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One OHLCV bar per (supplier, ship date)."""
    items = read(spark, sf_dir, "lineitem")
    sums = _daily_sums(items, F.concat(F.lit("S"), F.col("l_suppkey").cast("string")))
    return _walk(dealt(sums, parts(spark, sf_dir)), 0.5)


def index_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per ship date over all suppliers (bounded by the calendar)."""
    return _walk(_daily_sums(read(spark, sf_dir, "lineitem"), F.lit(INDEX_SYMBOL)), 1.5)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars with the row-number layout the indicators need."""
    return with_row_number(daily_bars(spark, sf_dir))


def index_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_row_number(index_bars(spark, sf_dir))


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of reference data per supplier: ratios, holdings, flags.

    Values are spread deterministically from the key and the account balance.
    """
    k = F.col("s_suppkey")
    cents = F.abs(F.round(F.col("s_acctbal") * 100).cast("long"))
    known = k % 11 != 0
    sectors = ("Financial Services", "Technology", "Energy", "Healthcare", "Industrials")
    sector = F.element_at(F.array(*[F.lit(s) for s in sectors]), (F.col("s_nationkey") % 5 + 1).cast("int"))
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % n + 1).cast("int"))
    return read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), k.cast("string")).alias("symbol"),
        F.when(known, cents % 3500 / 100.0 - 5.0).alias("roe"),
        F.when(known, k * 37 % 500 / 100.0).alias("debt_equity"),
        F.when(known, cents % 410 / 10.0 - 8.0).alias("net_margin"),
        F.when(known, cents % 593 / 10.0 - 20.0).alias("revenue_growth"),
        F.when(known & (k % 4 != 0), cents % 701 / 10.0 - 25.0).alias("earnings_growth"),
        sector.alias("sector"),
        F.when(k % 7 == 0, "Banks - Regional").otherwise("General").alias("industry"),
        (k * 17 % 70).cast("double").alias("promoter_pledged"),
        (k * 13 % 80 / 10.0 - 4.0).alias("promoter_change"),
        (k * 19 % 90 / 10.0 - 4.5).alias("fii_change"),
        (k * 23 % 60 / 10.0 - 3.0).alias("dii_change"),
        F.when(known, k * 41 % 400 / 10.0).alias("roce"),
        F.when(k % 9 != 0, k * 29 % 1000 / 10.0).alias("delivery_pct"),
        (k % 6 == 0).alias("oi_spurt"),
        (k % 10 == 0).alias("banned"),
        (k % 8 == 0).alias("bulk_deal"),
        pick(3, "BULLISH", "BEARISH", "NEUTRAL").alias("fii_signal"),
        pick(5, "BUY", "SELL", "NEUTRAL", "NEUTRAL", "NEUTRAL").alias("retail_signal"),
        F.lit(None).cast("double").alias("_unused"),
    ).drop("_unused")


def index_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regime, index position and volatility per session."""
    return context_of(index_series(spark, sf_dir))


def context_of(index: DataFrame) -> DataFrame:
    from barloom.functions.market import regime_series

    df = regime_series(index)
    vix = 10.0 + F.pmod((F.col("volume") / 100).cast("long"), F.lit(2000)) / 100.0
    return df.select("date", "regime", "above_200", "above_50", vix.alias("vix"), (vix > 25).alias("vix_high"))


@dataclass
class Stored:
    """Bars in buckets of their symbol with the row-number layout, the index and what a session's scores read of it.

    ``sessions`` is the number of index rows; ``bounded`` tells whether the index tables may be broadcast.
    """

    store: BarStore
    bars: DataFrame
    index: DataFrame
    context: DataFrame
    sessions: int

    @property
    def bounded(self) -> bool:
        return self.sessions <= SESSIONS


def fingerprint(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    """What tells one state of a table's files from another."""
    return tuple(read(spark, sf_dir, name).agg(F.max("_metadata.file_modification_time"), F.sum("_metadata.file_size"), F.count(F.lit(1))).first())


_STORED: dict[tuple, Stored] = {}


def stored(spark: SparkSession, sf_dir: str) -> Stored:
    """The bar archive of a table folder, built from one scan of the trades and kept for the application while the files are the same."""
    key = spark.sparkContext.applicationId, sf_dir, *fingerprint(spark, sf_dir, "lineitem")
    if key not in _STORED:
        store = BarStore(spark, f"{checkpoint_folder(spark).rstrip('/')}/archive-{uuid.uuid4().hex}", parts(spark, sf_dir))
        sums = _daily_sums(read(spark, sf_dir, "lineitem"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")))
        store.write(_walk(dealt(sums, store.buckets), 0.5, SUMS), unique=True, placed=True)
        whole = store.read().groupBy(F.lit(INDEX_SYMBOL).alias("symbol"), "date").agg(
            *[F.sum(x).alias(x) for x in ("qty", "disc", "tax")], *[F.max(x).alias(x) for x in ("up", "down")])
        index = materialize(with_row_number(_walk(whole, 1.5)))
        rows = tagged(with_row_number(store.read().drop(*SUMS)), store.buckets)
        _STORED[key] = Stored(store, rows, index, materialize(context_of(index)), index.count())
    return _STORED[key]
