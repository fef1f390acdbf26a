"""Mixing sources to target weights by exact subset sums over document lengths.

Each source gets a budget of words.  Whole passes over the source are taken
first.  For the rest, documents are counted by exact length, every length
gives its proportional share rounded down, and a bounded knapsack over the
length counts fills what remains.  Which documents of a length are taken is
decided by a seeded hash, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.llm.common import narrow, written

#: No document is taken more often than this, and no target exceeds so many times its source.
MOST_PASSES = 3
#: Words left to the exact knapsack after whole shares are taken.
KNAPSACK_WORDS = 1 << 15
#: Documents of one length and source that are ranked together.
CELL = 256


def source_weight(position: Column) -> Column:
    """1, 2, 3 repeating over the sources in order (position from 0)."""
    return (F.pmod(position, F.lit(3)) + 1).cast("double")


def fill(lengths: list[int], counts: list[int], budget: int, over: int = 0) -> list[int]:
    """How many items of each length to take so that their sum is nearest to ``budget``, and at most ``over`` above it.

    Bounded knapsack over a bit set: bit s says that s words can be reached.
    Counts are split into powers of two; for each sum the piece that first
    reached it is kept, and earlier pieces lead back from the best sum.
    """
    taken = [0] * len(lengths)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:  # down to what the knapsack holds, longest first
        if lengths[i] and budget > KNAPSACK_WORDS:
            taken[i] = min(counts[i], (budget - KNAPSACK_WORDS) // lengths[i])
            budget -= taken[i] * lengths[i]
    most = budget + over
    mask, reached, first, pieces = (1 << (most + 1)) - 1, 1, np.full(most + 1, -1, np.int32), []
    for i in order:
        left, copies = (min(counts[i] - taken[i], most // lengths[i]) if lengths[i] else 0), 1
        while left and not reached >> budget & 1:
            copies = min(copies, left)
            fresh = (reached << copies * lengths[i]) & mask & ~reached
            if fresh:
                bits = np.unpackbits(np.frombuffer(fresh.to_bytes(most // 8 + 1, "little"), np.uint8), bitorder="little")
                first[np.flatnonzero(bits)] = len(pieces)
                pieces.append((i, copies))
                reached |= fresh
            left -= copies
            copies *= 2
    at = (reached & ((1 << (budget + 1)) - 1)).bit_length() - 1
    above = reached >> (budget + 1)
    if above and (above & -above).bit_length() < budget - at:
        at = budget + (above & -above).bit_length()
    while at:
        i, copies = pieces[first[at]]
        taken[i] += copies
        at -= copies * lengths[i]
    return taken


def _fit(cells: pd.DataFrame) -> pd.DataFrame:
    """Whole passes and further documents of each length of one source."""
    lengths, counts = [int(x) for x in cells["size"]], [int(x) for x in cells["n"]]
    total = sum(a * b for a, b in zip(lengths, counts))
    budget = min(round(float(cells["target"].iloc[0])), MOST_PASSES * total)
    passes, rest = divmod(budget, total) if total else (0, 0)
    extra = [n * rest // total if total else 0 for n in counts]
    rest -= sum(a * b for a, b in zip(lengths, extra))
    more = fill(lengths, [n - e for n, e in zip(counts, extra)], rest, min((x for x in lengths if x), default=0) if rest else 0)
    return pd.DataFrame({"skey": cells["skey"], "size": lengths, "passes": passes, "extra": [a + b for a, b in zip(extra, more)]})


def _positions(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``position`` from 0 in a total order: index within its range partition plus the rows of those before."""
    ranged = written(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "ordered")
    ranged = ranged.withColumn("_part", F.shiftright("_id", 33))
    parts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    offsets = parts.select("_part", before.alias("_before"))
    return ranged.join(offsets, "_part").withColumn("position", F.col("_id") - F.shiftleft(F.col("_part"), 33) + F.col("_before")).drop("_id", "_part", "_before")


def targets(sources: DataFrame) -> DataFrame:
    """``target`` of each source from ``source_size`` and ``weight``.

    The sources share the sum of all sizes by weight; a target stops at
    ``MOST_PASSES`` times its source's size and the excess is shared by the
    others until none is above.  Only the running level comes to the driver.
    """
    cap = F.col("source_size").cast("double") * MOST_PASSES
    level = -1.0
    while True:
        full = cap <= F.lit(level) * F.col("weight")
        total, capped, weight = sources.agg(F.sum("source_size"), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        new = ((total or 0) - (capped or 0.0)) / weight if weight else float("inf")
        if new <= level or weight is None:
            break
        level = new
    return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def _chosen(own: DataFrame, seed: int) -> DataFrame:
    """Copies of each of (row, id, source, text, rest); ``rest`` tells rows apart whose other columns differ."""
    own = own.select(
        "row", "rest", "id", "source", F.coalesce(F.expr(r"regexp_count(text, '[^\\x20\\x09-\\x0D]+')"), F.lit(0)).cast("long").alias("size"),
        F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), "source")).alias("skey"),
        row_hash(seed, F.col("id"), F.coalesce("text", F.lit(""))).alias("h"),
    )
    own = written(own, "sizes")
    cells = written(own.groupBy("skey", "size").agg(F.first("source").alias("source"), F.count(F.lit(1)).alias("n")), "cells")
    sources = cells.groupBy("skey").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    placed = _positions(sources, F.col("source").isNull(), F.col("source"))
    sources = written(targets(written(placed.withColumn("weight", source_weight(F.col("position"))), "weights")).drop("position", "source"), "targets")
    fitted = cells.join(sources.select("skey", "target"), "skey").groupBy("skey").applyInPandas(_fit, "skey string, size long, passes long, extra long")
    plan = written(cells.select("skey", "size", "n").join(fitted, ["skey", "size"]), "plan")
    # Documents of one source and length are dealt into small cells by hash; cells are filled in order.
    # Equal rows are counted, not ranked: the group of them in which the extra passes end is found first.
    dealt = own.join(plan, ["skey", "size"]).withColumn("cell", F.pmod("h", F.ceil(F.col("n") / CELL)))
    dealt = written(dealt.withColumn("group", F.struct("cell", "h", F.col("id").isNotNull().alias("known"), F.coalesce("id", F.lit(0)).alias("id"), "rest")), "dealt")
    groups = written(dealt.groupBy("skey", "size", "extra", "cell", "group").agg(F.count(F.lit(1)).alias("m")), "groups")
    filled = groups.groupBy("skey", "size", "cell").agg(F.sum("m").alias("in_cell"))
    before = F.sum("in_cell").over(Window.partitionBy("skey", "size").orderBy("cell")) - F.col("in_cell")
    filled = filled.select("skey", "size", "cell", before.alias("before"))
    within = F.sum("m").over(Window.partitionBy("skey", "size", "cell").orderBy("group").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")
    ends = groups.join(filled, ["skey", "size", "cell"]).withColumn("before", F.col("before") + within)
    ends = ends.where((F.col("before") < F.col("extra")) & (F.col("extra") <= F.col("before") + F.col("m")))
    ends = written(ends.select("skey", "size", F.col("group").alias("end"), "m", (F.col("extra") - F.col("before")).alias("share")), "ends")
    met = dealt.join(ends, ["skey", "size"], "left")
    split = F.coalesce((F.col("group") == F.col("end")) & (F.col("share") < F.col("m")), F.lit(False))
    fields = ["row", "id", "source", "skey", "size", "h"]
    whole = met.where(~split).select(*fields, (F.col("passes") + F.coalesce(F.col("group") <= F.col("end"), F.lit(False)).cast("long")).alias("copies"))
    # Rows of a group that gets a part are equal; any will do, so they are dealt out by row.
    parts = met.where(split).withColumn("part", F.pmod(F.xxhash64("row"), F.ceil(F.col("m") / CELL)))
    sums = parts.groupBy("skey", "size", "part").agg(F.count(F.lit(1)).alias("in_part"))
    ahead = F.sum("in_part").over(Window.partitionBy("skey", "size").orderBy("part")) - F.col("in_part")
    parts = parts.join(sums.select("skey", "size", "part", ahead.alias("ahead")), ["skey", "size", "part"])
    place = F.row_number().over(Window.partitionBy("skey", "size", "part").orderBy("row"))
    parts = parts.withColumn("place", F.col("ahead") + place).select(*fields, (F.col("passes") + (F.col("place") <= F.col("share")).cast("long")).alias("copies"))
    return whole.union(parts).join(sources, "skey")


def mix(docs: DataFrame, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often each document goes into the mix.

    Returns ``id_col``, ``source_col``, ``size`` (words of the text),
    ``source_size``, ``target`` (of its source), ``copies`` and ``taken``
    (``size * copies``), one row per input row, and ``row_hash``.

    A null text has size 0 and takes nothing; a null source is a source of its
    own, last in order; null ids are allowed.  Repeated rows are separate
    documents.  An empty table, or one without a word, gives targets of 0.
    Further columns are dropped.
    """
    own = narrow(docs, **{id_col: "long", source_col: "string", text_col: "string"}).toDF("id", "source", "text")
    chosen = _chosen(own.withColumn("row", F.monotonically_increasing_id()).withColumn("rest", F.lit(0).cast("long")), seed)
    return chosen.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"),
        F.col("h").alias("row_hash"),
    )


def row_hash(seed: int, doc_id: Column, text: Column) -> Column:
    """Seeded hash of a row, by which rows of one length are chosen."""
    return F.xxhash64(F.lit(seed), doc_id, F.xxhash64(text))


def mixed(docs: DataFrame, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row of ``docs``, all its columns, as often as ``mix`` takes it.  Columns beginning with ``_mix_`` are dropped."""
    keep = [c for c in docs.columns if not c.startswith("_mix_")]
    own = docs.select(*[F.col(f"`{c}`") for c in keep])
    # Rows are named by a written key, so each meets its own number of copies.
    own = written(own.withColumn("_mix_row", F.monotonically_increasing_id()), "rows")
    named = own.select(
        F.col("_mix_row").alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"),
        F.col(f"`{text_col}`").cast("string").alias("text"), F.xxhash64(*[F.col(f"`{c}`") for c in keep]).alias("rest"),
    )
    shares = _chosen(named, seed).where("copies > 0").select(F.col("row").alias("_mix_row"), F.col("copies").cast("int").alias("_mix_times"))
    own = own.join(shares, "_mix_row")
    return own.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_times")))).select(*[F.col(f"`{c}`") for c in keep])
