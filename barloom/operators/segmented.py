"""Running values along an order, inside keys, without a task that holds a whole key.

Rows are sorted by key and order into range partitions and cut into blocks of
a fixed number of rows.  Inside a block the running value is a window; a block
is summed up by one row, the summaries are scanned in the same way, level by
level, until no key has more than a block of them, and what comes before a
block is put in front of its rows.  The number of keys does not matter.  A key
that holds nearly all rows is spread over its blocks like any other; results
do not depend on the blocks, only rounding of doubles does.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.operators.lineage import materialize, written

#: Rows of a block, a power of two; summaries of so many blocks are scanned at once.
BLOCK = 1 << 12
#: Rows of a block of affine maps, whose running values are built as arrays.
MAPS = 1 << 8


@dataclass(frozen=True)
class Scan:
    """``out``: the running ``kind`` (sum, count, min, max, first, last) of ``value`` up to the row, or before it if not ``inclusive``.

    Nulls are passed over; a running sum of nothing is 0, everything else of
    nothing is null.
    """

    out: str
    kind: str
    value: Column
    inclusive: bool = True


_OVER = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def _window(s: Scan, column: str, w) -> Column:
    if s.kind == "first":
        return F.first(column, ignorenulls=True).over(w)
    if s.kind == "last":
        return F.last(column, ignorenulls=True).over(w)
    return _OVER[s.kind](column).over(w)


def _total(s: Scan, column: str) -> Column:
    if s.kind in ("first", "last"):
        pick = F.min_by if s.kind == "first" else F.max_by
        return pick(F.col(column), F.when(F.col(column).isNotNull(), F.col("_at")))
    return _OVER[s.kind](column)


def _joined(s: Scan, before: Column, here: Column) -> Column:
    if s.kind in ("sum", "count"):
        return F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0))
    if s.kind == "first":
        return F.coalesce(before, here)
    if s.kind == "last":
        return F.coalesce(here, before)
    return (F.least if s.kind == "min" else F.greatest)(before, here)


def placed(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "_at") -> DataFrame:
    """``df`` written in the order of ``keys`` and ``order``, with ``name`` rising along it (not without gaps)."""
    return written(df.sort(*[F.col(k).asc_nulls_first() for k in keys], *order).withColumn(name, F.monotonically_increasing_id()))


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[Column], scans: Sequence[Scan], block: int = BLOCK, at: str | None = None) -> DataFrame:
    """``df`` with the running values; ``order`` must be total inside a key. Null keys are keys of their own.

    ``at`` names a column of a written ``df`` that :func:`placed` has made for the same keys and order; rows are then not sorted again.
    """
    named = [F.struct(F.col(k).isNull().alias("n"), F.col(k).alias("v")).alias(f"_k{i}") for i, k in enumerate(keys)]
    df = df.select("*", *named, *[s.value.alias(f"_v{i}") for i, s in enumerate(scans)])
    own = [f"_k{i}" for i in range(len(keys))]
    out = _levels(df.withColumn("_at", F.col(at)) if at else placed(df, keys, order), own, scans, block)
    return out.drop("_at", "_block", *own, *[f"_v{i}" for i in range(len(scans))])


def _most(totals: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the key that has most."""
    return totals.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def _last_level(most: int, before: int | None, block: int) -> bool:
    """Whether every key's summaries fit one block, or no longer get fewer: a level leaves a key a summary for each partition of the sort
    that holds its rows, so where it does not halve them there are only a few times as many as partitions."""
    return most <= block or (before is not None and 2 * most > before)


def _levels(rows: DataFrame, keys: list[str], scans: Sequence[Scan], block: int, before_most: int | None = None) -> DataFrame:
    rows = rows.withColumn("_block", F.floor(F.col("_at") / block))
    inside = Window.partitionBy(*keys, "_block").orderBy("_at")
    frames = [inside.rowsBetween(Window.unboundedPreceding, 0 if s.inclusive else -1) for s in scans]
    rows = rows.select("*", *[_window(s, f"_v{i}", w).alias(f"_r{i}") for i, (s, w) in enumerate(zip(scans, frames))])
    totals = rows.groupBy(*keys, F.col("_block").alias("_next")).agg(*[_total(s, f"_v{i}").alias(f"_v{i}") for i, s in enumerate(scans)])
    # What a block passes on excludes the block itself; counts are added up from here on.
    before = [Scan(f"_b{i}", "sum" if s.kind == "count" else s.kind, F.col(f"_v{i}"), False) for i, s in enumerate(scans)]
    totals = materialize(totals.withColumnRenamed("_next", "_at"))
    most = _most(totals, keys)
    if _last_level(most, before_most, block):
        w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        carries = totals.select(*keys, F.col("_at").alias("_block"), *[_window(s, f"_v{i}", w).alias(s.out) for i, s in enumerate(before)])
    else:
        # Blocks keep their order; numbers are made dense so that a block of them is full.
        dense = placed(totals.withColumnRenamed("_at", "_of"), keys, [F.col("_of")])
        carries = _levels(dense, keys, before, block, most).select(*keys, F.col("_of").alias("_block"), *[s.out for s in before])
    met = rows.join(carries, [*keys, "_block"])
    results = [_joined(s, F.col(f"_b{i}"), F.col(f"_r{i}")).alias(s.out) for i, s in enumerate(scans)]
    rest = [c for c in rows.columns if not c.startswith("_r") or not c[2:].isdigit()]
    return met.select(*rest, *results)


def affine(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: Column, add: Column, out: str, before: str | None = None, block: int = MAPS, at: str | None = None) -> DataFrame:
    """``df`` with ``out``, the value of y = keep * y + add along the order, beginning at 0, and ``before``, the y a row begins with.

    ``keep`` and ``add`` are never null.  A block of rows is one affine map,
    and maps are composed in the order of their blocks; nothing is divided, so
    a ``keep`` of 0 starts anew.  ``at`` is as in :func:`scan`.
    """
    named = [F.struct(F.col(k).isNull().alias("n"), F.col(k).alias("v")).alias(f"_k{i}") for i, k in enumerate(keys)]
    own = [f"_k{i}" for i in range(len(keys))]
    whole = df.columns
    rows = df.select("*", *named, keep.cast("double").alias("_keep"), add.cast("double").alias("_add"))
    rows = rows.withColumn("_at", F.col(at)) if at else placed(rows, keys, order)
    rows = rows.select(F.struct(*whole).alias("_row"), *own, "_keep", "_add", "_at")
    return _maps(rows, own, block).select("_row.*", F.col("_y").alias(out), *([F.col("_y0").alias(before)] if before else []))


def _maps(rows: DataFrame, keys: list[str], block: int, before_most: int | None = None, whole: bool = False) -> DataFrame:
    """Rows with ``_y`` and ``_y0``, the value after and before the row; with ``whole`` a key is one block."""
    rows = rows.withColumn("_block", F.lit(0) if whole else F.floor(F.col("_at") / block))
    rest = [c for c in rows.columns if c not in (*keys, "_block")]
    grouped = rows.groupBy(*keys, "_block").agg(F.array_sort(F.collect_list(F.struct("_at", *[c for c in rest if c != "_at"]))).alias("_rows"))
    zero = F.struct(F.lit(1.0).alias("k"), F.lit(0.0).alias("a"))
    step = lambda m, r: F.struct((r["_keep"] * m["k"]).alias("k"), (r["_keep"] * m["a"] + r["_add"]).alias("a"))
    start = F.array(zero)
    upto = F.aggregate("_rows", start, lambda acc, r: F.concat(acc, F.array(step(F.element_at(acc, -1), r))))
    grouped = grouped.select(*keys, "_block", "_rows", upto.alias("_maps"))  # _maps[i]: before row i
    grouped = written(grouped)
    totals = grouped.select(*keys, F.col("_block").alias("_of"), F.element_at("_maps", -1)["k"].alias("_keep"), F.element_at("_maps", -1)["a"].alias("_add"))
    most = 1 if whole else _most(totals, keys)
    if most <= 1:  # one block a key
        carried = totals.select(*keys, F.col("_of").alias("_block"), F.lit(0.0).alias("_c"))
    else:
        last = _last_level(most, before_most, block)
        dense = totals.withColumn("_at", F.col("_of")) if last else placed(totals, keys, [F.col("_of")])
        carried = _maps(dense, keys, block, most, last).select(*keys, F.col("_of").alias("_block"), F.col("_y0").alias("_c"))
    met = grouped.join(carried, [*keys, "_block"])
    at = lambda m: m["k"] * F.col("_c") + m["a"]
    pairs = F.transform("_rows", lambda r, i: F.struct(*[r[c].alias(c) for c in rest], at(F.get("_maps", i + 1)).alias("_y"), at(F.get("_maps", i)).alias("_y0")))
    return met.select(*keys, F.inline(pairs))
