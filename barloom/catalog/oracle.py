"""SQL text shared by the check queries (run by DuckDB on the same parquet)."""

from __future__ import annotations


def cents() -> str:
    return "cast(round(l_extendedprice*100) as bigint)"


def walk_ctes(prefix: str, symbol: str, scale: float) -> str:
    return f"""{prefix}_sums AS (
  SELECT {symbol} AS symbol, cast(l_shipdate AS date) AS date,
         sum(cast(l_quantity AS bigint)) AS qty,
         sum(cast(round(l_discount*100) AS bigint)*cast(l_quantity AS bigint)) AS disc,
         sum(cast(round(l_tax*100) AS bigint)*cast(l_quantity AS bigint)) AS tax,
         max({cents()} % 97) AS up, max({cents()} % 89) AS down
  FROM lineitem GROUP BY 1, 2),
{prefix}_path AS (
  SELECT *, sum((disc/(qty*100.0::double)-0.05::double)*{scale}::double) OVER (PARTITION BY symbol ORDER BY date) AS lvl,
         sum((disc/(qty*100.0::double)-0.05::double)*{scale}::double) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lvl0
  FROM {prefix}_sums),
{prefix}_oc AS (
  SELECT symbol, date, round(100.0::double*exp(coalesce(lvl0,0.0::double))*exp((tax/(qty*100.0::double)-0.04::double)*0.15::double),2) AS open,
         round(100.0::double*exp(lvl),2) AS close, (qty*100)::double AS volume, up, down
  FROM {prefix}_path),
{prefix} AS (
  SELECT symbol, date, open, round(greatest(open,close)*(1.0+up/97.0::double*0.012),2) AS high,
         round(least(open,close)*(1.0-down/89.0::double*0.012),2) AS low, close, volume,
         cast(row_number() OVER (PARTITION BY symbol ORDER BY date) AS bigint)-1 AS rn
  FROM {prefix}_oc)"""


BARS = walk_ctes("b", "'S' || cast(l_suppkey AS varchar)", 0.5)
INDEX = walk_ctes("ix", "'^INDEX'", 1.5)

W = "PARTITION BY symbol ORDER BY rn"


def select(spec: str) -> str:
    """Expand ``"symbol date@d x@4 n@i"`` to an output list in tidy form."""
    out = []
    for item in spec.split():
        name, _, kind = item.partition("@")
        if kind == "d":
            out.append(f"strftime({name}, '%Y-%m-%d') AS {name}")
        elif kind == "i":
            out.append(f"cast({name} AS bigint) AS {name}")
        elif kind:
            out.append(f"round({name}, {kind})+0.0::double AS {name}")
        else:
            out.append(name)
    return ", ".join(out)


def roll(fn: str, x: str, n: int) -> str:
    frame = f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {frame} = {n} THEN {fn}({x}) OVER {frame} END"


def tail(fn: str, x: str, n: int) -> str:
    return f"{fn}({x}) OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({W})"


def ema(x: str, alpha: str, seed: str = "0") -> str:
    keep = f"(1.0::double-{alpha})"
    return (
        f"CASE WHEN rn >= {seed} THEN pow({keep}, rn) * sum((CASE WHEN rn = {seed} THEN 1.0::double ELSE {alpha} END)"
        f" * {x} * pow({keep}, -rn)) OVER ({W}) END"
    )


def span(x: str, n: int, seed: str = "0") -> str:
    return ema(x, f"(2.0::double/{n + 1})", seed)


def wilder(x: str, n: int, seed: str = "0") -> str:
    return ema(x, f"(1.0::double/{n})", seed)


def query(ctes: list[str] | str, body: str, recursive: bool = False) -> str:
    text = ctes if isinstance(ctes, str) else ",\n".join(ctes)
    return f"WITH {'RECURSIVE ' if recursive else ''}{text}\n{body}"
