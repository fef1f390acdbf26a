"""The screening pipeline: bars to scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.functions import market, scoring
from barloom.functions.windows import LEVELS, dealt_again, lead
from barloom.operators import quality
from barloom.plans import tables
from barloom.sources.barstore import BarStore


def with_fund_score(df: DataFrame) -> DataFrame:
    """Lender flag, fundamental score and quality points from reference columns."""
    c = F.col
    df = df.withColumn("is_lender", scoring.is_lender(c("sector"), c("industry")))
    score = scoring.fund_score_a(c("roe"), c("revenue_growth"), c("debt_equity"), c("net_margin"))
    return df.withColumns(
        {
            "fund_score": F.when(c("roe").isNotNull(), score).cast("double"),
            "quality_score": scoring.quality_points(
                c("roce"), c("roe"), c("debt_equity"), c("fii_change"), c("dii_change"), c("promoter_pledged")
            ).cast("double"),
        }
    )


def _looked_up(bars: DataFrame, index: DataFrame, bounded: bool) -> DataFrame:
    """Directions, strength and weekly trend: all that scans or joins, on narrow rows.

    A join loses the partitioning by symbol, so every join comes before the
    wide indicator layers; those then share one exchange and one sort.
    """
    df = scoring.with_directions(bars)
    return market.with_weekly_trend(market.with_strength(df, index, bounded))


def _technical(df: DataFrame) -> DataFrame:
    df = dealt_again(df)
    df = scoring.with_base_signal(scoring.with_technicals(df))
    return scoring.with_trade_levels(scoring.with_indicator_points(df))


def technical_rows(bars: DataFrame, index: DataFrame, bounded: bool = False) -> DataFrame:
    """Signals, levels, strength and weekly trend on every bar (causal: no later row is read)."""
    return _technical(_looked_up(bars, index, bounded))


REFERENCE = (
    "symbol", "fund_score", "quality_score", "is_lender", "debt_equity", "revenue_growth", "promoter_pledged", "delivery_pct",
    "oi_spurt", "bulk_deal", "fii_signal", "retail_signal",
)


def scored_rows(bars: DataFrame, index: DataFrame, context: DataFrame, reference: DataFrame, bounded: bool = False, last_only: bool = False, single: bool = False) -> DataFrame:
    """Bars scored with the context of their date and the reference data of their symbol.

    ``bounded`` tells that the index tables may be broadcast, so that bars
    never move by date.  With ``last_only`` the recursions run over all bars
    and all that reads a single row over each symbol's newest one.
    ``single`` tells that no symbol has two rows of reference data.
    """
    if last_only:
        bars = bars.withColumn("_newest", lead("date").isNull())
    df = _looked_up(bars, index, bounded)
    sessions = context.select("date", "regime", "above_200", "above_50", "vix_high")
    if not bounded:
        df = df.join(sessions, "date", "left")
    facts = with_fund_score(reference).select(*REFERENCE)
    if not single:
        df = df.join(facts, "symbol", "left")
    df = _technical(df)
    if last_only:
        df = df.where("_newest").drop("_newest")
    # No window reads these: joined after the windows, they are not copied through each of them. Neither join moves a bar.
    if bounded:
        df = df.join(F.broadcast(sessions), "date", "left")
    if single:
        df = df.join(facts, "symbol", "left")
    return scoring.with_score(df)


def _single(reference: DataFrame) -> bool:
    """Whether each symbol has one row at most; counted, as tables may repeat a key."""
    return reference.groupBy("symbol").count().where("count > 1").isEmpty()


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bar of the archive scored."""
    t = tables.stored(spark, sf_dir)
    reference = tables.fundamentals(spark, sf_dir)
    return scored_rows(t.bars, t.index, t.context, reference, t.bounded, single=_single(reference))


#: What evaluations read of a scored bar.
LOGGED = (
    "symbol", "date", "rn", *LEVELS, "open", "high", "low", "close", "volume", "score100", "stage", "rr_ratio", "composite_rs", "promoter_pledged", "sl_buy", "target1", "r_atr",
)
_LOGS: dict[int, DataFrame] = {}


def score_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of every bar as a written log in buckets of the symbol, made once for each archive; evaluations read it instead of scoring anew."""
    t = tables.stored(spark, sf_dir)
    if id(t) not in _LOGS:
        log = BarStore(spark, f"{t.store.folder}-scores", t.store.buckets)
        log.write(scan(spark, sf_dir).select(*LOGGED), unique=True, placed=True)
        _LOGS[id(t)] = log.read()
    return _LOGS[id(t)]


def scan_newest(spark: SparkSession, sf_dir: str, now_local: str) -> DataFrame:
    """The newest completed bar of each symbol scored; today counts from 16:15 local time."""
    t = tables.stored(spark, sf_dir)
    reference = tables.fundamentals(spark, sf_dir)
    return scored_rows(quality.completed_sessions(t.bars, now_local), t.index, t.context, reference, t.bounded, last_only=True, single=_single(reference))


def technical(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.stored(spark, sf_dir)
    return technical_rows(t.bars, t.index, t.bounded)
