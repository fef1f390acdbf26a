"""Outcome, exit-rule and evaluation queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from barloom.catalog.base import register, tidy
from barloom.catalog.indicators import TECH
from barloom.catalog.market import STOCK_REGIME
from barloom.catalog.oracle import BARS, W, query, select
from barloom.catalog.rules import LAB_SQL, hit, rule_source
from barloom.catalog.scores import SCAN, TECHNICAL, r
from barloom.functions import indicators as ind, market, outcomes as out, rules, scoring
from barloom.functions.windows import LEVELS, lag as wlag, lead, sampled
from barloom.operators import reports
from barloom.operators.lineage import materialize, written
from barloom.plans import scan, tables
from barloom.plans.tables import bars

c = F.col
SLIP = f"{out.SLIPPAGE!r}::double"
CHARGES = f"{out.CHARGES!r}::double"
ROUND = f"{out.ROUND_TRIP!r}::double"


def levels(df: DataFrame) -> DataFrame:
    """Stop and first target of every bar."""
    return scoring.with_trade_levels(scoring.with_base_signal(ind.compose(df, ind.pivots())))


def path_sql(name: str, source: str, stop: str, target: str, hold: int, gaps: bool) -> str:
    """First touch of stop or target over the joined forward path of ``source``."""
    gap = f"(f.open<={stop} OR f.open>={target})" if gaps else "false"
    return f"""{name}_p AS (SELECT s.symbol, s.rn, s.date, s.entry, f.rn-s.rn AS j, f.open, f.high, f.low, f.close, {gap} AS at_open,
   CASE WHEN {gap} THEN CASE WHEN f.open<={stop} THEN 'sl' ELSE 't1' END WHEN f.low<={stop} THEN 'sl' WHEN f.high>={target} THEN 't1' END AS hit,
   CASE WHEN {gap} THEN f.open WHEN f.low<={stop} THEN {stop} WHEN f.high>={target} THEN {target} END AS px
   FROM {source} s JOIN b f ON f.symbol=s.symbol AND f.rn BETWEEN s.rn+1 AND s.rn+{hold}),
{name}_f AS (SELECT symbol, rn, min(CASE WHEN hit IS NOT NULL THEN j END) AS jx, max(j) AS jl FROM {name}_p GROUP BY 1,2),
{name} AS (SELECT p.symbol, p.rn, any_value(p.date) AS date, any_value(p.entry) AS entry, coalesce(max(CASE WHEN j=jx THEN hit END),'timeout') AS outcome,
   ((coalesce(max(CASE WHEN j=jx THEN px END), max(CASE WHEN j=jl THEN p.close END))*(1-{SLIP})-any_value(p.entry))/any_value(p.entry)-{CHARGES})*100 AS ret,
   least(0, min(CASE WHEN j<=coalesce(jx,jl) THEN CASE WHEN j=jx AND at_open THEN (px/p.entry-1)*100 ELSE (p.low-p.entry)/p.entry*100 END END)) AS mae,
   greatest(0, max(CASE WHEN j<=coalesce(jx,jl) THEN CASE WHEN j=jx AND at_open THEN (px/p.entry-1)*100 ELSE (p.high-p.entry)/p.entry*100 END END)) AS mfe
   FROM {name}_p p JOIN {name}_f f USING (symbol, rn) GROUP BY 1,2)"""


ENTRY = f"(lead(open) OVER ({W})*(1+{SLIP}))"


LOOKBACK, FORWARD_BARS, LEAST_SCORE, FIRST_BAR = 60, 21, 55, 49


def path_trades(log: DataFrame) -> DataFrame:
    """Trades of every bar from the 50th on by the levels of the bar itself.

    ``signal`` marks the bars with a score of at least 55 among the 60 before
    the last 21 of a symbol with a long enough history.
    """
    df = log.select("symbol", "date", "rn", *LEVELS, "open", "high", "low", "close", "score100", "sl_buy", "target1")
    ends = F.max("rn").over(Window.partitionBy("symbol")) + 1
    df = df.withColumn("_n", ends)
    span = (c("rn") >= c("_n") - LOOKBACK - FORWARD_BARS) & (c("rn") < c("_n") - FORWARD_BARS) & (c("_n") >= LOOKBACK + FORWARD_BARS + 52)
    df = df.withColumns({"signal": F.coalesce(span & (c("score100") >= LEAST_SCORE), F.lit(False)), "_pick": c("rn") >= FIRST_BAR}).drop("_n")
    df = sampled(df, "_pick", ahead=FORWARD_BARS)
    df = out.with_path_trade(df, "path", "sl_buy", "target1", True)
    return df.where((c("sl_buy") > 0) & (c("sl_buy") < c("entry")) & (c("entry") < c("target1")))


def backtest_trades(spark, sf) -> DataFrame:
    return path_trades(scan.score_log(spark, sf))


BACKTEST = [
    *SCAN, f"xs0 AS (SELECT symbol, rn, date, sl_buy, target1, score100, {ENTRY} AS entry, max(rn) OVER (PARTITION BY symbol)+1 AS n FROM z)",
    f"xs AS (SELECT *, coalesce(rn>=n-{LOOKBACK + FORWARD_BARS} AND rn<n-{FORWARD_BARS} AND n>={LOOKBACK + FORWARD_BARS + 52} AND score100>={LEAST_SCORE}, false) AS signal FROM xs0 WHERE rn>={FIRST_BAR} AND sl_buy>0 AND sl_buy<entry AND entry<target1)",
    path_sql("xp", "xs", "s.sl_buy", "s.target1", FORWARD_BARS, True),
    "xo AS (SELECT xp.*, signal FROM xp JOIN xs USING (symbol, rn))",
]
register(
    "x01_path_outcome_gap_aware",
    lambda spark, sf: tidy(backtest_trades(spark, sf).select("symbol", "date", "outcome", "ret", "mae", "mfe", "signal")),
    query(BACKTEST, f"SELECT {select('symbol date@d outcome ret@4 mae@4 mfe@4 signal@i')} FROM xo", True),
)


def _short_path(spark, sf):
    """Every third bar, levels from the bar itself, five bars, stop before target."""
    df = levels(bars(spark, sf))
    df = out.with_trade(df, "sl_buy", "target1", 5, False)
    picked = (c("rn") >= 150) & ((c("rn") - 150) % 3 == 0) & c("entry").isNotNull() & (c("sl_buy") < c("close"))
    return df.where(picked)


SHORT_PATH = [
    *TECHNICAL,
    f"xs0 AS (SELECT symbol, rn, date, close, sl_buy, target1, {ENTRY} AS entry FROM q8)",
    "xs AS (SELECT * FROM xs0 WHERE rn>=150 AND (rn-150)%3=0 AND entry IS NOT NULL AND sl_buy<close)",
    path_sql("xo", "xs", "s.sl_buy", "s.target1", 5, False),
]
register(
    "x02_path_outcome_five_bars",
    lambda spark, sf: tidy(_short_path(spark, sf).select("symbol", "date", "outcome", "ret", "mae", "mfe")),
    query(SHORT_PATH, f"SELECT {select('symbol date@d outcome ret@4 mae@4 mfe@4')} FROM xo", True),
)
LABEL = [
    BARS,
    f"ls AS (SELECT symbol, rn, date, {ENTRY} AS entry FROM b)",
    path_sql("lo", "ls", "(s.entry*(1-1.0::double/100))", "(s.entry*(1+2.0::double/100))", 15, True),
    "lb AS (SELECT b.symbol, b.date, b.rn, CASE WHEN f.jl=15 THEN CASE WHEN lo.outcome='t1' THEN 1 ELSE 0 END END AS label FROM b LEFT JOIN lo USING (symbol, rn) LEFT JOIN lo_f f USING (symbol, rn))",
]
register(
    "x03_target_label",
    lambda spark, sf: tidy(out.with_target_label(bars(spark, sf)).select("symbol", "date", "label")),
    query(LABEL, f"SELECT {select('symbol date@d label@i')} FROM lb"),
)
register(
    "x04_label_horizon_end",
    lambda spark, sf: tidy(bars(spark, sf).select("symbol", "date", lead("date", 15).alias("label_end"))),
    query(BARS, f"SELECT symbol, strftime(date,'%Y-%m-%d') AS date, strftime(lead(date,15) OVER ({W}),'%Y-%m-%d') AS label_end FROM b"),
)


def _holed(df):
    """Bars with some volumes missing, to exercise the status codes."""
    return df.withColumn("volume", F.when((F.dayofmonth("date") == 13), 0.0).otherwise(c("volume")))


register(
    "x05_fixed_horizon_status",
    lambda spark, sf: tidy(out.with_fixed_horizon(_holed(bars(spark, sf))).select("symbol", "date", "status", "fixed_ret")),
    query(
        [
            BARS,
            "h0 AS (SELECT *, CASE WHEN day(date)=13 THEN 0 ELSE volume END AS v FROM b)",
            "h1 AS (SELECT *, least(open,high,low,close)>0 AND high>=greatest(open,low,close) AND low<=least(open,high,close) AND v>0 AS good FROM h0)",
            f"h2 AS (SELECT *, coalesce(lead(good,1) OVER ({W}),false) AS ge, coalesce(lead(good,21) OVER ({W}),false) AS gx, sum(CASE WHEN good THEN 1 ELSE 0 END) OVER ({W} ROWS BETWEEN 2 FOLLOWING AND 20 FOLLOWING) AS gi, 100*(lead(close,21) OVER ({W})/lead(open,1) OVER ({W})-1)-0.5582::double AS fr FROM h1)",
        ],
        "SELECT symbol, strftime(date,'%Y-%m-%d') AS date, CASE WHEN NOT ge THEN 'unknown_entry' WHEN NOT gx THEN 'unresolved_exit' WHEN gi=19 THEN 'observed' ELSE 'observed_with_interior_gap' END AS status, CASE WHEN ge AND gx THEN round(fr,4)+0.0::double END AS fixed_ret FROM h2",
    ),
)
HORIZONS = {"d5": 5, "d21": 21, "d63": 63}
FORWARD = f"""fw AS (SELECT *, CASE WHEN lead(close,5) OVER ({W}) IS NOT NULL THEN (lead(close,5) OVER ({W})/lead(open,1) OVER ({W})-1)*100-0.5582::double END AS d5,
   CASE WHEN lead(close,5) OVER ({W}) IS NOT NULL THEN (lead(close,21) OVER ({W})/lead(open,1) OVER ({W})-1)*100-0.5582::double END AS d21,
   CASE WHEN lead(close,5) OVER ({W}) IS NOT NULL THEN (lead(close,63) OVER ({W})/lead(open,1) OVER ({W})-1)*100-0.5582::double END AS d63"""
register(
    "x06_forward_returns",
    lambda spark, sf: tidy(bars(spark, sf).select("symbol", "date", *[scoring.rnd(v, 4).alias(k) for k, v in out.forward_returns(HORIZONS).items()])),
    query([BARS, FORWARD + " FROM b)"], f"SELECT symbol, strftime(date,'%Y-%m-%d') AS date, {r('d5', 4)}+0.0::double AS d5, {r('d21', 4)}+0.0::double AS d21, {r('d63', 4)}+0.0::double AS d63 FROM fw"),
)

# --- exits over a signal set: every fifth bar with a score of at least 50 ---------


def exit_signals(spark, sf) -> DataFrame:
    """Every fifth bar from 200 with a score of at least 50 and a whole path after it, with its levels and what the index did meanwhile."""
    t = tables.stored(spark, sf)
    df = scan.score_log(spark, sf)
    index = t.index.select("date", ((lead("close", 63) / c("close") - 1.0) * 100.0).alias("mkt_fwd"))
    picked = (c("rn") >= 200) & ((c("rn") - 200) % 5 == 0) & (c("score100") >= 50) & lead("close", 64).isNotNull() & (c("r_atr") > 0)
    df = df.select("symbol", "date", "rn", "_b0", "open", "high", "low", "close", "r_atr", "sl_buy", "target1", picked.alias("_pick"))
    df = sampled(df, "_pick", ahead=63).select(
        "symbol", "date", F.element_at("path", 1)["open"].alias("entry"), c("r_atr").alias("atr"), c("sl_buy").alias("sl"), c("target1").alias("t1"), "path"
    )
    df = df.join(F.broadcast(index) if t.bounded else index, "date", "left")
    return df.withColumn("direction", F.when(c("mkt_fwd") < 0, "fell").when(c("mkt_fwd") >= 0, "rose"))


EXIT_BASE = [
    *SCAN,
    f"im AS (SELECT date, (lead(close,63) OVER (ORDER BY rn)/close-1)*100 AS mkt_fwd FROM ix)",
    f"es0 AS (SELECT symbol, rn, date, lead(open) OVER ({W}) AS entry, r_atr AS atr, sl_buy AS sl, target1 AS t1, score100>=50 AS sig, lead(close,64) OVER ({W}) AS c64 FROM z)",
    "es AS (SELECT es0.*, CASE WHEN mkt_fwd<0 THEN 'fell' WHEN mkt_fwd>=0 THEN 'rose' END AS direction FROM es0 LEFT JOIN im USING (date) WHERE rn>=200 AND (rn-200)%5=0 AND sig AND c64 IS NOT NULL AND atr>0)",
    "ep AS (SELECT s.*, f.rn-s.rn AS j, f.high, f.low, f.close, max(f.high) OVER (PARTITION BY s.symbol, s.rn ORDER BY f.rn) AS hh FROM es s JOIN b f ON f.symbol=s.symbol AND f.rn BETWEEN s.rn+1 AND s.rn+63)",
    "eq AS (SELECT *, greatest(entry, hh) AS peak, greatest(entry, coalesce(lag(hh) OVER (PARTITION BY symbol, rn ORDER BY j), entry)) AS peak0 FROM ep)",
]


def _exit_sql(x: out.Exit) -> str:
    price = {
        "fixed": "CASE WHEN low<=sl THEN sl WHEN high>=t1 THEN t1 END",
        "trail": f"CASE WHEN low<=peak0-{x.mult}::double*atr THEN peak0-{x.mult}::double*atr END",
        "breakeven": f"CASE WHEN low<=CASE WHEN peak0>=entry+{x.trigger}::double*atr AND j>1 THEN greatest(sl, peak0-{x.mult}::double*atr) ELSE sl END THEN CASE WHEN peak0>=entry+{x.trigger}::double*atr AND j>1 THEN greatest(sl, peak0-{x.mult}::double*atr) ELSE sl END END",
        "time": "NULL::double",
    }[x.kind]
    return f"""SELECT symbol, rn, any_value(date) AS date, any_value(direction) AS direction, '{x.name}' AS variant, {x.hold} AS hold,
  (coalesce(arg_min(px, j) FILTER (WHERE px IS NOT NULL), arg_max(close, j))/any_value(entry)-1-{ROUND})*100 AS ret, (max(high)/any_value(entry)-1)*100 AS mfe
  FROM (SELECT *, {price} AS px FROM eq WHERE j<={x.hold}) GROUP BY symbol, rn"""


EXIT_SWEEP = [*EXIT_BASE, "ev AS (" + "\nUNION ALL\n".join(_exit_sql(x) for x in out.EXITS) + ")"]


def _exit_query(kind: str):
    mine = [x for x in out.EXITS if x.kind == kind]

    def run(spark, sf):
        swept = out.sweep(exit_signals(spark, sf), mine)
        return tidy(swept.select("symbol", "date", "variant", "ret", "mfe"))

    text = "ev AS (" + "\nUNION ALL\n".join(_exit_sql(x) for x in mine) + ")"
    return run, query([*EXIT_BASE, text], f"SELECT {select('symbol date@d variant ret@4 mfe@4')} FROM ev", True)


for _key, _kind in (("x09_exit_fixed", "fixed"), ("x10_exit_trailing", "trail"), ("x11_exit_breakeven", "breakeven"), ("x12_exit_time", "time")):
    register(_key, *_exit_query(_kind))
register(
    "x13_exit_sweep",
    lambda spark, sf: tidy(
        out.sweep(exit_signals(spark, sf), keep=("direction",)).groupBy("variant", "direction").agg(F.count("*").alias("n"), F.avg("ret").alias("avg_ret"))
    ),
    query(EXIT_SWEEP, f"SELECT variant, direction, count(*) AS n, round(avg(ret),4)+0.0::double AS avg_ret FROM ev GROUP BY 1,2", True),
)


def _exit_report(spark, sf):
    sig = exit_signals(spark, sf).where(c("direction").isNotNull())
    swept = written(out.sweep(sig, keep=("direction",)).drop("symbol", "date"))
    rep = reports.exit_report(swept)
    held = swept.where("variant = 'time only h63'").groupBy("direction").agg(F.avg("ret").alias("_bench"))
    rep = rep.join(held, "direction")
    return tidy(rep.select("variant", "direction", "n", "avg_ret", "median_ret", "win_rate", "profit_factor", "sharpe", "median_capture", (c("avg_ret") - c("_bench")).alias("vs_benchmark")))


register(
    "c12_exit_rule_evaluation",
    _exit_report,
    query(
        [*EXIT_SWEEP, "bm AS (SELECT direction, avg(ret) AS bench FROM ev WHERE variant='time only h63' GROUP BY 1)"],
        f"""SELECT variant, direction, count(*) AS n, round(avg(ret),4)+0.0::double AS avg_ret, round(quantile_cont(ret,0.5),4)+0.0::double AS median_ret, round(avg(CASE WHEN ret>0 THEN 100.0::double ELSE 0 END),4)+0.0::double AS win_rate,
  round(sum(CASE WHEN ret>0 THEN ret ELSE 0 END)/nullif(abs(sum(CASE WHEN ret<=0 THEN ret END)),0),4)+0.0::double AS profit_factor, round(avg(ret)/stddev_pop(ret)*sqrt(252.0::double/max(hold)),4)+0.0::double AS sharpe,
  round(quantile_cont(ret/mfe*100,0.5) FILTER (WHERE mfe>0.5),4)+0.0::double AS median_capture, round(avg(ret)-any_value(bench),4)+0.0::double AS vs_benchmark
  FROM ev JOIN bm USING (direction) GROUP BY 1,2 HAVING count(*)>=50""",
        True,
    ),
)
register(
    "j06_index_return_by_date",
    lambda spark, sf: tidy(exit_signals(spark, sf).select("symbol", "date", "mkt_fwd", "direction")),
    query(EXIT_BASE, f"SELECT es.symbol, strftime(es.date,'%Y-%m-%d') AS date, round(mkt_fwd,4)+0.0::double AS mkt_fwd, direction FROM es JOIN im USING (date)", True),
)


def _cells(spark, sf, keys):
    return reports.trade_cells(_short_path(spark, sf), keys)


CELL_SQL = """count(*) AS sample_count, {figs}, cast(count(*)<10 AS bigint) AS insufficient_data"""
_FIG = {
    "t1_hit_rate": "avg(CASE WHEN outcome='t1' THEN 100.0::double ELSE 0 END)", "sl_hit_rate": "avg(CASE WHEN outcome='sl' THEN 100.0::double ELSE 0 END)", "timeout_rate": "avg(CASE WHEN outcome='timeout' THEN 100.0::double ELSE 0 END)",
    "win_rate": "avg(CASE WHEN ret>0 THEN 100.0::double ELSE 0 END)", "avg_win": "coalesce(avg(ret) FILTER (WHERE ret>0),0)", "avg_loss": "coalesce(avg(ret) FILTER (WHERE ret<=0),0)", "avg_mae": "avg(mae)", "avg_mfe": "avg(mfe)",
    "profit_factor": "coalesce(sum(ret) FILTER (WHERE ret>0),0)/nullif(abs(sum(ret) FILTER (WHERE ret<=0)),0)", "avg_return": "avg(ret)", "expectancy": "avg(ret)",
}
CELLS = CELL_SQL.format(figs=", ".join(f"CASE WHEN count(*)>=10 THEN round({v},4)+0.0::double END AS {k}" for k, v in _FIG.items()))
register(
    "c06_trade_outcome_cells",
    lambda spark, sf: tidy(_cells(spark, sf, ["symbol"])),
    query(SHORT_PATH, f"SELECT symbol, {CELLS} FROM xo GROUP BY 1", True),
)


BACKTEST_FIGURES = ("win_rate", "t1_hit_rate", "profit_factor", "expectancy", "avg_mae", "avg_mfe")


def backtest_metrics(trades: DataFrame) -> DataFrame:
    """Figures of all trades of a symbol, and under ``signal_`` of its signals alone."""
    def figures(t: DataFrame, prefix: str = "") -> DataFrame:
        cells = reports.trade_cells(t, ["symbol"], 1)
        streak = reports.losing_streak(t, ["symbol"], ["rn"])
        names = ("sample_count", *BACKTEST_FIGURES, "max_consec_loss")
        return cells.join(streak, "symbol").select("symbol", *[c(x).alias(prefix + x) for x in names])

    both = figures(trades).join(figures(trades.where("signal"), "signal_"), "symbol", "left")
    return both.withColumn("signal_sample_count", F.coalesce("signal_sample_count", F.lit(0)))


def _backtest(spark, sf):
    return tidy(backtest_metrics(materialize(backtest_trades(spark, sf).select("symbol", "rn", "outcome", "ret", "mae", "mfe", "signal"))))


STREAK = f"""rk AS (SELECT *, sum(CASE WHEN ret>0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY rn) AS run FROM xo),
mx AS (SELECT symbol, max(n) AS m FROM (SELECT symbol, run, count(*) AS n FROM rk WHERE ret<=0 GROUP BY 1,2) GROUP BY 1)"""


def _figures_sql(prefix: str = "") -> str:
    figures = ", ".join(f"round({_FIG[k]},4)+0.0::double AS {prefix}{k}" for k in BACKTEST_FIGURES)
    return f"count(*) AS {prefix}sample_count, {figures}, coalesce(any_value(m),0) AS {prefix}max_consec_loss"


register(
    "c08_backtest_metrics",
    _backtest,
    query(
        [*BACKTEST, STREAK, STREAK.replace("rk ", "rks ").replace("mx ", "mxs ").replace("FROM rk ", "FROM rks ").replace("FROM xo", "FROM xo WHERE signal"),
         f"fa AS (SELECT symbol, {_figures_sql()} FROM xo LEFT JOIN mx USING (symbol) GROUP BY 1)",
         f"fs AS (SELECT symbol, {_figures_sql('signal_')} FROM xo LEFT JOIN mxs USING (symbol) WHERE signal GROUP BY 1)"],
        "SELECT fa.*, " + ", ".join(["coalesce(signal_sample_count,0) AS signal_sample_count", *[f"signal_{k}" for k in BACKTEST_FIGURES], "signal_max_consec_loss"]) + " FROM fa LEFT JOIN fs USING (symbol)",
        True,
    ),
)


def _streaks(spark, sf):
    t = _short_path(spark, sf)
    return tidy(reports.losing_streak(t, ["symbol"], ["rn"]))


register(
    "c09_losing_streak",
    _streaks,
    query([*SHORT_PATH, STREAK], "SELECT DISTINCT xo.symbol, coalesce(m,0) AS max_consec_loss FROM xo LEFT JOIN mx USING (symbol)", True),
)


def lab_trades(spark, sf) -> DataFrame:
    """Close to the fifth close after, for every lab rule, in long form."""
    df = rules.with_rules(bars(spark, sf), rules.LAB_RULES, "hit_")
    df = market.stock_regime(df)
    entry, leave = c("close") * (1 + 0.0005), lead("close", 5) * (1 - 0.0005)
    df = df.withColumn("ret", ((leave - entry) / entry - 0.001 * 2) * 100.0)
    pairs = F.array(*[F.struct(F.lit(n).alias("strategy"), c(f"hit_{n}").alias("hit")) for n in rules.LAB_RULES])
    df = df.where(c("ret").isNotNull())
    return df.select("symbol", "date", "rn", "regime", "ret", F.inline(pairs)).where("hit = 1")


_lab_ctes, _lab_from, _ = rule_source(["supertrend_rsi"])
LAB = [
    *_lab_ctes,
    STOCK_REGIME,
    f"lt0 AS (SELECT t8.symbol, t8.rn, date, close, {', '.join(f'{hit(t)} AS h_{n}' for n, t in LAB_SQL.items())} FROM {_lab_from})",
    f"lt1 AS (SELECT *, ((lead(close,5) OVER ({W})*(1-0.0005::double)-close*(1+0.0005::double))/(close*(1+0.0005::double))-0.001::double*2)*100 AS ret FROM lt0)",
    "lt AS (" + " UNION ALL ".join(f"SELECT symbol, rn, date, ret, '{n}' AS strategy FROM lt1 WHERE h_{n}=1 AND ret IS NOT NULL" for n in LAB_SQL) + ")",
    "lr AS (SELECT lt.*, sr.regime FROM lt JOIN sr USING (symbol, rn))",
    "lc AS (SELECT *, sum(ret) OVER (PARTITION BY symbol, strategy ORDER BY rn) AS cum FROM lr)",
    "ld AS (SELECT *, max(cum) OVER (PARTITION BY symbol, strategy ORDER BY rn)-cum AS dd FROM lc)",
    """ls AS (SELECT symbol, strategy, count(*) AS trade_count, count(*) FILTER (WHERE ret>0) AS wins, count(*) FILTER (WHERE ret<=0) AS losses, avg(ret) AS avg_return,
   coalesce(sum(ret) FILTER (WHERE ret>0),0)/nullif(abs(sum(ret) FILTER (WHERE ret<=0)),0) AS profit_factor, max(dd) AS max_drawdown, """
    + ", ".join(
        f"count(*) FILTER (WHERE regime='{g}') AS {g}_n, CASE WHEN count(*) FILTER (WHERE regime='{g}')>=3 THEN avg(CASE WHEN ret>0 THEN 100.0::double ELSE 0 END) FILTER (WHERE regime='{g}') END AS {g}_win_rate, CASE WHEN count(*) FILTER (WHERE regime='{g}')>=3 THEN avg(ret) FILTER (WHERE regime='{g}') END AS {g}_avg"
        for g in ("bull", "bear", "sideways")
    )
    + """, count(*) FILTER (WHERE ret>0)/count(*)*100 AS win_rate, CASE WHEN stddev_pop(ret)>0 THEN avg(ret)/stddev_pop(ret)*sqrt(252.0::double/5) END AS sharpe
   FROM ld GROUP BY 1,2 HAVING count(*)>=10)""",
]
register(
    "x14_fixed_hold_return",
    lambda spark, sf: tidy(lab_trades(spark, sf).select("symbol", "date", "strategy", "ret")),
    query(LAB, f"SELECT {select('symbol date@d strategy ret@4')} FROM lt", True),
)
_STATS = "trade_count@i wins@i losses@i avg_return@4 profit_factor@4 max_drawdown@4 bull_n@i bull_win_rate@4 bull_avg@4 bear_n@i bear_win_rate@4 bear_avg@4 sideways_n@i sideways_win_rate@4 sideways_avg@4 win_rate@4 sharpe@4"
register(
    "c10_strategy_stats_per_symbol",
    lambda spark, sf: tidy(reports.strategy_stats(lab_trades(spark, sf), ["symbol", "strategy"], "rn")),
    query(LAB, f"SELECT {select('symbol strategy ' + _STATS)} FROM ls", True),
)
register(
    "c11_strategy_stats_overall",
    lambda spark, sf: tidy(reports.across_symbols(materialize(reports.strategy_stats(lab_trades(spark, sf), ["symbol", "strategy"], "rn")))),
    query(
        LAB,
        "SELECT strategy, count(*) AS symbol_count, cast(sum(trade_count) AS bigint) AS total_trades, "
        + ", ".join(f"round(avg({a}),4)+0.0::double AS {b}" for a, b in (("win_rate", "avg_win_rate"), ("avg_return", "avg_return"), ("sharpe", "avg_sharpe"), ("profit_factor", "avg_profit_factor"), ("max_drawdown", "avg_max_drawdown"), ("bull_win_rate", "bull_win_rate"), ("bull_avg", "bull_avg"), ("bear_win_rate", "bear_win_rate"), ("bear_avg", "bear_avg"), ("sideways_win_rate", "sideways_win_rate"), ("sideways_avg", "sideways_avg")))
        + ", round(quantile_cont(win_rate,0.5),4)+0.0::double AS median_win_rate, row_number() OVER (ORDER BY coalesce(avg(sharpe),0) DESC, coalesce(avg(ls.avg_return),0) DESC, strategy) AS position FROM ls GROUP BY strategy",
        True,
    ),
)
register(
    "v04_explode_results",
    lambda spark, sf: tidy(
        reports.strategy_stats(lab_trades(spark, sf), ["symbol", "strategy"], "rn").select(
            "symbol", "strategy", F.expr("stack(3, 'bull', bull_n, bull_avg, 'bear', bear_n, bear_avg, 'sideways', sideways_n, sideways_avg) AS (regime, n, avg_ret)")
        )
    ),
    query(
        LAB,
        "SELECT symbol, strategy, regime, n, round(a,4)+0.0::double AS avg_ret FROM (SELECT symbol, strategy, 'bull' AS regime, bull_n AS n, bull_avg AS a FROM ls UNION ALL SELECT symbol, strategy, 'bear', bear_n, bear_avg FROM ls UNION ALL SELECT symbol, strategy, 'sideways', sideways_n, sideways_avg FROM ls)",
        True,
    ),
)


# --- re-seeded windows -----------------------------------------------------------


def reseeded(df: DataFrame, back: int = 150) -> DataFrame:
    """Means as if the series had started ``back`` bars ago: take out what the older bars left behind."""
    df = ind.compose(df, ind.emas(9, 21, 50), ind.rsi(), ind.atr(14))

    def shift(e: str, x: str, alpha: float, k: int):
        return c(e) - F.pow(F.lit(1.0 - alpha), F.lit(k)) * (wlag(e, k) - wlag(x, k))

    df = df.withColumn("_hl", c("high") - c("low"))
    full = c("rn") >= back
    means = {f"e{n}_w": F.when(full, shift(f"e{n}", "close", 2.0 / (n + 1), back)).otherwise(c(f"e{n}")) for n in (9, 21, 50)}
    gain = F.when(full, shift("rsi_gain", "gain", 1 / 14, back - 1)).otherwise(c("rsi_gain"))
    loss = F.when(full, shift("rsi_loss", "loss", 1 / 14, back - 1)).otherwise(c("rsi_loss"))
    tr = F.when(full, shift("atr14", "_hl", 1 / 14, back)).otherwise(c("atr14"))
    return df.select("*", *[v.alias(k) for k, v in means.items()], (100.0 - 100.0 / (1.0 + gain / F.nullif(loss, F.lit(0.0)))).alias("rsi_w"), tr.alias("atr_w"))


register(
    "x16_reseeded_replay",
    lambda spark, sf: tidy(reseeded(bars(spark, sf)).where("rn >= 49").select("symbol", "date", "e9_w", "e21_w", "e50_w", "rsi_w", "atr_w")),
    query(
        [
            *TECH[:5],
            # Brute force: join every sampled bar with its own 151-bar window and weigh it directly.
            """rw AS (SELECT a.symbol, a.rn, a.date, greatest(a.rn-150,0) AS w0, x.rn AS xr, x.close, CASE WHEN x.rn=greatest(a.rn-150,0) THEN x.high-x.low ELSE x.tr END AS tr, x.gain, x.loss
   FROM t4 a JOIN t4 x ON x.symbol=a.symbol AND x.rn BETWEEN greatest(a.rn-150,0) AND a.rn WHERE a.rn>=49)""",
            "rv AS (SELECT symbol, rn, any_value(date) AS date, "
            + ", ".join(f"sum(close*pow(1-2.0::double/{n + 1}, rn-xr)*CASE WHEN xr=w0 THEN 1 ELSE 2.0::double/{n + 1} END) AS e{n}_w" for n in (9, 21, 50))
            + ", sum(CASE WHEN xr>w0 THEN gain*pow(1-1.0::double/14, rn-xr)*CASE WHEN xr=w0+1 THEN 1 ELSE 1.0::double/14 END END) AS g, sum(CASE WHEN xr>w0 THEN loss*pow(1-1.0::double/14, rn-xr)*CASE WHEN xr=w0+1 THEN 1 ELSE 1.0::double/14 END END) AS l, sum(tr*pow(1-1.0::double/14, rn-xr)*CASE WHEN xr=w0 THEN 1 ELSE 1.0::double/14 END) AS atr_w FROM rw GROUP BY 1,2)",
        ],
        f"SELECT {select('symbol date@d e9_w@4 e21_w@4 e50_w@4 atr_w@4')}, round(100-100/(1+g/nullif(l,0)),4)+0.0::double AS rsi_w FROM rv",
    ),
)
register(
    "x17_sampling_step",
    lambda spark, sf: tidy(bars(spark, sf).where((c("rn") >= 150) & ((c("rn") - 150) % 3 == 0)).select("symbol", "date", "rn")),
    query(BARS, f"SELECT {select('symbol date@d rn@i')} FROM b WHERE rn>=150 AND (rn-150)%3=0"),
)
register(
    "x15_point_in_time_replay",
    lambda spark, sf: tidy(
        ind.compose(bars(spark, sf), ind.emas(9, 50), ind.atr(14), ind.highs(20)).where(c("rn") >= 150).select("symbol", "date", "e9", "e50", "atr14", "hh20")
    ),
    query(
        [
            *TECH[:2],
            # Each bar recomputed from its own prefix only.
            """pr AS (SELECT a.symbol, a.rn, a.date, x.rn AS xr, x.close, x.tr, x.high FROM t1 a JOIN t1 x ON x.symbol=a.symbol AND x.rn<=a.rn WHERE a.rn>=150)""",
            "pv AS (SELECT symbol, rn, any_value(date) AS date, sum(close*pow(0.8::double, rn-xr)*CASE WHEN xr=0 THEN 1 ELSE 0.2::double END) AS e9, sum(close*pow(1-2.0::double/51, rn-xr)*CASE WHEN xr=0 THEN 1 ELSE 2.0::double/51 END) AS e50, sum(tr*pow(1-1.0::double/14, rn-xr)*CASE WHEN xr=0 THEN 1 ELSE 1.0::double/14 END) AS atr14, max(CASE WHEN xr>rn-20 THEN high END) AS hh20 FROM pr GROUP BY 1,2)",
        ],
        f"SELECT {select('symbol date@d e9@4 e50@4 atr14@4 hh20@4')} FROM pv",
    ),
)
