"""Do scores predict anything: bucket tables, deciles, arms, regimes, resampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.operators.lineage import materialize
from barloom.operators.ranking import spearman, value_ranks
from barloom.operators.segmented import Scan, scan

c = F.col


def bucket_table(scored: DataFrame, horizons: Sequence[str], bucket: str, min_n: int = 5) -> DataFrame:
    """Mean, edge over everything and Welch-style t per (bucket, horizon)."""
    long = scored.select(bucket, F.inline(F.array(*[F.struct(F.lit(h).alias("horizon"), c(h).alias("v")) for h in horizons]))).where("v IS NOT NULL")
    # All-rows figures come from the bucket sums, not from a second pass.
    per = long.groupBy(bucket, "horizon").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("var"))
    base = long.groupBy("horizon").agg(F.count("*").alias("bn"), F.avg("v").alias("bmean"), F.var_samp("v").alias("bvar"))
    t = (c("mean") - c("bmean")) / F.sqrt(c("var") / c("n") + c("bvar") / c("bn"))
    return per.where(c("n") >= min_n).join(base, "horizon").select(
        bucket, "horizon", "n", c("mean").alias("mean_ret"), (c("mean") - c("bmean")).alias("edge"), F.when(c("bn") > 5, t).alias("t_stat")
    )


def decile_edges(scored: DataFrame, score: str, ret: str, share: float = 0.10, least: int = 5) -> DataFrame:
    """Mean return of the k highest and k lowest scores against all, k = max(share, least).

    Counted distinct scores tell the value at which each side ends.  Rows
    above it are taken, rows of that value are put in order of symbol and
    date by a distributed sort and taken up to k, so a score shared by any
    number of rows is never in one task.
    """
    df = materialize(scored.where(c(score).isNotNull() & c(ret).isNotNull()).select("symbol", "date", score, ret))
    ranks = materialize(value_ranks(df, [], score).select(score, "below", "n_equal"))
    n = ranks.agg(F.sum("n_equal")).first()[0] or 0
    k = max(int(n * share), least)
    sums = [df.agg(F.count("*").alias("n"), F.avg(ret).alias("base"))]
    for side, before in (("top", n - c("below") - c("n_equal")), ("bottom", c("below"))):
        at = ranks.withColumn("_before", before)
        whole = at.where(c("_before") + c("n_equal") <= k).select(score)
        border = at.where((c("_before") < k) & (c("_before") + c("n_equal") > k)).first()
        taken = df.join(whole, score, "left_semi").agg(F.sum(ret).alias("s"), F.count(ret).alias("m"))
        if border is not None:
            tied = scan(df.where(c(score) == border[score]), [], [c("symbol"), c("date")], [Scan("_place", "count", F.lit(1))])
            taken = taken.union(tied.where(c("_place") <= k - border["_before"]).agg(F.sum(ret), F.count(ret)))
        sums.append(taken.agg((F.sum("s") / F.sum("m")).alias(f"{side}_mean")))
    df = sums[0].select("n", "base", *[x.select(x.columns[0]).scalar().alias(x.columns[0]) for x in sums[1:]])
    return df.select("n", "base", "top_mean", (c("top_mean") - c("base")).alias("top_edge"), "bottom_mean", (c("bottom_mean") - c("base")).alias("bottom_edge"))


def validation_table(scored: DataFrame, score: str, horizons: Sequence[str]) -> DataFrame:
    """Rank correlation of the score with the return at each horizon."""
    long = scored.select(score, F.inline(F.array(*[F.struct(F.lit(h).alias("horizon"), c(h).alias("v")) for h in horizons])))
    return spearman(materialize(long.where(c(score).isNotNull() & c("v").isNotNull())), ["horizon"], score, "v")


def arm_comparison(obs: DataFrame, arms: dict[str, Column], ret: str = "fwd", min_n: int = 20) -> DataFrame:
    """Overlapping arms against the unfiltered mean: one pass with conditional aggregates."""
    aggs = [F.avg(ret).alias("_base")]
    for i, cond in enumerate(arms.values()):
        x = F.when(cond, c(ret))
        aggs += [F.count(x).alias(f"_n{i}"), F.avg(x).alias(f"_m{i}"), F.avg(F.when(x > 0, 100.0).when(x <= 0, 0.0)).alias(f"_w{i}")]
    one = obs.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(n).alias("arm"), c(f"_n{i}").alias("n"), c(f"_m{i}").alias("mean"), c(f"_w{i}").alias("win_rate")) for i, n in enumerate(arms)])
    return one.select("_base", F.inline(rows)).where(c("n") >= min_n).select("arm", "n", c("mean").alias("mean_ret"), (c("mean") - c("_base")).alias("edge"), "win_rate")


def block_bootstrap(obs: DataFrame, chosen: Column, draws: int = 1000, width: int = 21, seed: int = 42) -> DataFrame:
    """95% interval of the edge from resampled blocks of dates.

    Returns are first summed per date; block sums come from running sums over
    the dates (bounded by the calendar), so a draw only adds up a few
    precomputed blocks.  The last block of a draw is cut so that a draw holds
    as many dates as the sample.
    """
    daily = obs.groupBy("date").agg(
        F.sum("fwd").alias("t"), F.count("fwd").alias("n"), F.sum(F.when(chosen, c("fwd"))).alias("s"), F.count(F.when(chosen, c("fwd"))).alias("k")
    )
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    ahead = w.rowsBetween(0, width - 1)
    blocks = daily.select(
        (F.row_number().over(w) - 1).alias("start"), F.count("*").over(ahead).alias("len"),
        *[F.sum(F.coalesce(x, F.lit(0))).over(ahead).alias(f"b{x}") for x in ("t", "n", "s", "k")],
        *[F.collect_list(F.coalesce(x, F.lit(0)).cast("double")).over(ahead).alias(f"l{x}") for x in ("t", "n", "s", "k")],
    )
    size = daily.agg(F.count("*").alias("d"), F.sum("k").alias("picks"))
    days = size.select("d").scalar()
    per_draw = F.ceil(days / width).cast("int")
    spark = obs.sparkSession
    picks = spark.range(draws).select(c("id").alias("draw"), F.explode(F.sequence(F.lit(1), per_draw)).alias("i"))
    span = days - width + 1
    picks = picks.withColumn("start", F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", "draw", "i", F.lit(seed)), 256), 1, 8), 16, 10).cast("long"), span.cast("long")).cast("int"))
    rest = days - (per_draw - 1) * width  # dates of the last block
    picks = picks.withColumns({"rest": rest.cast("int"), "final": c("i") == per_draw})
    cut = lambda x: F.aggregate(F.slice(f"l{x}", F.lit(1), c("rest")), F.lit(0.0), lambda a, v: a + v)
    sums = picks.join(blocks, "start").groupBy("draw").agg(*[F.sum(F.when(c("final"), cut(x)).otherwise(c(f"b{x}"))).alias(x) for x in ("t", "n", "s", "k")])
    edges = sums.where("k > 0 AND n > 0").select((c("s") / c("k") - c("t") / c("n")).alias("edge"))
    # A fixed number of draws: the exact percentile holds at most that many values.
    enough = (days >= 2 * width) & (size.select("picks").scalar() >= 20)
    return edges.agg(F.percentile("edge", F.lit(0.025)).alias("lo"), F.percentile("edge", F.lit(0.975)).alias("hi"), F.avg("edge").alias("mean_edge")).where(enough)


WEAK, STRONG = ("BEAR_TREND", "RECOVERY", "SIDEWAYS"), ("BULL_TREND", "BULL_WEAK")


def regime_confusion(series: DataFrame, horizons: Sequence[str], min_n: int = 30) -> DataFrame:
    """How often the market fell after each regime, with the lift over all dates."""
    long = series.select("regime", F.inline(F.array(*[F.struct(F.lit(h).alias("horizon"), c(h).alias("v")) for h in horizons]))).where("v IS NOT NULL")
    fell = F.when(c("v") < 0, 100.0).otherwise(0.0)
    base = long.groupBy("horizon").agg(F.avg(fell).alias("base_fall"))
    per = long.groupBy("horizon", "regime").agg(F.count("*").alias("n"), F.avg("v").alias("avg_fwd"), F.avg(fell).alias("p_fall"))
    return per.where(c("n") >= min_n).join(base, "horizon").select("horizon", "regime", "n", "avg_fwd", "p_fall", (c("p_fall") - c("base_fall")).alias("lift"))


def regime_accuracy(series: DataFrame, horizons: Sequence[str]) -> DataFrame:
    """The weak/strong call against what followed: separation, accuracy, precision, recall."""
    long = series.select(c("regime").isin(*WEAK).alias("weak"), F.inline(F.array(*[F.struct(F.lit(h).alias("horizon"), c(h).alias("v")) for h in horizons]))).where("v IS NOT NULL")
    fell = c("v") < 0
    g = long.groupBy("horizon").agg(
        F.count_if(c("weak") & fell).alias("tp"), F.count_if(c("weak") & ~fell).alias("fp"), F.count_if(~c("weak") & ~fell).alias("tn"), F.count_if(~c("weak") & fell).alias("fn"),
    ).where((c("tp") + c("fp") > 30) & (c("tn") + c("fn") > 30))
    return g.select(
        "horizon", "tp", "fp", "tn", "fn",
        (c("tp") / (c("tp") + c("fp")) * 100.0 - c("fn") / (c("tn") + c("fn")) * 100.0).alias("separation"),
        ((c("tp") + c("tn")) / (c("tp") + c("fp") + c("tn") + c("fn")) * 100.0).alias("accuracy"),
        F.try_divide(c("tp"), c("tp") + c("fp")).alias("precision"), F.try_divide(c("tp"), c("tp") + c("fn")).alias("recall"),
    )


SCENARIOS = (-100.0, -20.0, 0.0, 20.0, 100.0)


def unresolved_scenarios(outcomes: DataFrame, group: str) -> DataFrame:
    """Mean outcome when every unresolved one is replaced by a scenario value.

    Known results are summed once per group; each scenario only adds its
    value times the number missing.
    """
    g = outcomes.groupBy(group).agg(F.count("*").alias("n"), F.count_if(c("ret").isNull()).alias("missing"), F.coalesce(F.sum("ret"), F.lit(0.0)).alias("_s"))
    return g.select(
        group, "n", "missing", F.explode(F.array(*[F.lit(s) for s in SCENARIOS])).alias("scenario"), "_s"
    ).select(group, "n", "missing", "scenario", ((c("_s") + c("scenario") * c("missing")) / c("n")).alias("mean_ret"))


def hold_cohort(priced: DataFrame, capital: float, cost_pct: float, max_positions: int | None = None) -> DataFrame:
    """Equal slices of capital over the picks that a slice can buy; whole shares.

    ``priced(symbol, score, entry, last, days)``.  Slices are re-cut once
    after unaffordable names drop out; sizes come from scalar counts.
    """
    chosen = priced
    if max_positions is not None:
        chosen = priced.orderBy(c("score").desc(), "symbol").limit(max_positions)
    # The counts and the rows are read apart; a pick is one row a symbol.
    chosen = materialize(chosen)
    n = chosen.agg(F.count("*").alias("n")).select("n").scalar()
    affordable = chosen.where(c("entry") <= capital / n)
    m = affordable.agg(F.count("*").alias("n")).select("n").scalar()
    qty = F.floor(F.lit(capital) / m / c("entry"))
    df = affordable.withColumn("qty", qty).where("qty > 0")
    invested, value = c("qty") * c("entry"), c("qty") * c("last")
    df = df.withColumns({"invested": invested, "value": value})
    df = df.withColumn("pnl", c("value") - c("invested") - c("invested") * cost_pct / 100.0)
    return df.withColumn("pnl_pct", c("pnl") / c("invested") * 100.0)
