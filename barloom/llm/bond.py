"""Hard negatives by a vertical scan with bounds.

Vectors are kept by columns.  For each anchor the dimensions are read in the
descending order of its own magnitudes; after some of them, a row's score lies
between what has been summed and the least and the most that the remaining
dimensions can add, by their smallest and largest value in the block.  Rows
whose bounds fall outside every window that is asked for, or below as many
rows as are asked for that are surely inside, leave the bitmap.  What is left
when all dimensions are read has exact scores.

Anchors are met with all rows in groups: a group of anchors and a block of
rows form one task's work, and the best of each group are put together by rank.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.llm.common import written
from barloom.llm.groups import binary, column, groups, matrix

#: Rows of a block, anchors of a group; blocks of long vectors are smaller.
ROWS, ANCHORS, BLOCK_BYTES = 8192, 512, 8 << 20
#: Dimensions read between two cuts of the bitmap; share of a block's rows from which columns are summed whole.
STEP, DENSE = 16, 4
#: Sums below this are exact in double precision.
EXACT = float(1 << 53)


class Block:
    """Rows of one block by columns, with the smallest and the largest value of each."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, values: np.ndarray) -> None:
        self.ids, self.rows, self.labels = ids, rows, labels
        self.columns = np.ascontiguousarray(values.T)
        self.low = self.columns.min(axis=1) if len(rows) else np.zeros(len(self.columns))
        self.high = self.columns.max(axis=1) if len(rows) else np.zeros(len(self.columns))

    def scan(self, anchor: np.ndarray, alive: np.ndarray, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Rows left of ``alive`` (places) and their exact scores; ``keep`` tells from lower and upper bounds which rows may matter."""
        columns, low, high, kind = self.columns, self.low, self.high, np.float64
        if (np.abs(anchor) * np.maximum(np.abs(low), np.abs(high))).sum() >= EXACT:  # whole numbers of any size
            as_int = np.frompyfunc(int, 1, 1)
            columns, anchor, low, high, kind = as_int(columns), as_int(anchor), as_int(low), as_int(high), object
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = np.stack([anchor * low, anchor * high])[:, order]
        least, most = (np.concatenate([np.cumsum(e[::-1])[::-1], [0]]) for e in (ends.min(axis=0), ends.max(axis=0)))
        # While many rows are left a column is summed whole, later only at the rows that are left.
        whole = len(alive) >= columns.shape[1] // DENSE
        total = np.zeros(columns.shape[1] if whole else len(alive), kind)
        for i in range(0, len(order), STEP):
            dims = order[i : i + STEP]
            total = total + anchor[dims] @ (columns[dims] if whole else columns[dims[:, None], alive])
            own = total[alive] if whole else total
            left = keep(own + least[min(i + STEP, len(order))], own + most[min(i + STEP, len(order))])
            if not left.all():
                alive, own = alive[left], own[left]
            if not whole or len(alive) < columns.shape[1] // DENSE:
                whole, total = False, own
            if not len(alive):
                break
        if whole:
            total = total[alive]
        return alive, total


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _kth(values: np.ndarray, k: int) -> float:
    """The ``k``-th largest value; without so many, none is too small."""
    if len(values) < k:
        return -np.inf
    return np.sort(values)[-k] if values.dtype == object else np.partition(values, len(values) - k)[-k]


def top_same(block: Block, row: int, label: int, anchor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` first rows of the anchor's label other than itself: places and scores."""
    alive = np.flatnonzero((block.labels == label) & (block.rows != row))
    at, score = block.scan(anchor, alive, lambda low, high: high >= _kth(low, k))
    best = _first(score, block.ids[at], k)
    return at[best], score[best]


def top_in_windows(block: Block, label: int, anchor: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window of scores (both ends included) the ``k`` first rows of other labels inside it."""

    open_ = [w for w in set(windows) if w[0] <= w[1]]
    bottom, top = (min(w[0] for w in open_), max(w[1] for w in open_)) if open_ else (1, 0)
    widest = max((most - least for least, most in open_), default=-1)

    def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        wanted = (low <= top) & (high >= bottom)
        # All rows have bounds equally far apart: farther than a window is wide, none is surely inside one.
        if not open_ or not len(low) or high[0] - low[0] > widest:
            return wanted & bool(open_)
        at = np.flatnonzero(wanted)
        low, high, inside = low[at], high[at], np.zeros(len(at), bool)
        for least, most in open_:
            sure = low[(low >= least) & (high <= most)]
            inside |= (low <= most) & (high >= max(least, _kth(sure, k)))
        wanted[at] = inside
        return wanted

    at, score = block.scan(anchor, np.flatnonzero(block.labels != label), keep)
    out = []
    for least, most in windows:
        inside = np.flatnonzero((score >= least) & (score <= most))
        best = inside[_first(score[inside], block.ids[at[inside]], k)]
        out.append((at[best], score[best]))
    return out


def window(positive: int, least: int, most: int) -> tuple[int, int]:
    """Whole scores s with least * positive <= 100 * s <= most * positive."""
    return -((-least * positive) // 100), (most * positive) // 100


def _prepared(vectors: DataFrame, scale: float, relabel: Callable[[Column, Column], Column], id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(row, id, label, dims, f): whole components as bytes of doubles."""
    own = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("d"))
    finite = F.forall("d", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = own.where(F.col("label").isNotNull() & F.col("d").isNotNull() & finite)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, size = batch.column(3).flatten().to_numpy(zero_copy_only=False), batch.column(3).value_lengths().to_numpy()
            with np.errstate(over="ignore"):
                whole = np.floor(scale * flat)
            if not np.isfinite(whole).all():
                raise OverflowError("a scaled component is beyond double precision")
            data = whole.astype("<f8")
            at = pa.array(np.concatenate([[0], np.cumsum(size) * 8]).astype(np.int64))
            f = pa.Array.from_buffers(pa.large_binary(), len(size), [None, at.buffers()[1], pa.py_buffer(data)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(size.astype(np.int32)), f], names=["row", "id", "label", "dims", "f"])

    numbered = own.select(F.monotonically_increasing_id().alias("row"), "id", relabel(F.col("id"), F.col("label")).alias("label"), "d")
    return written(numbered.mapInArrow(run, "row long, id long, label long, dims int, f binary"), "rows")


def _met(rows: DataFrame, anchors: DataFrame, solve: Callable[[Block, pa.Table], Iterator[pa.RecordBatch]], out: str, n: int, asking: int) -> DataFrame:
    """``solve`` over each block of ``rows`` and group of ``anchors`` (row, label, dims, f, asks) of one length."""
    # Each side is dealt by row over as many blocks as its count asks for, and goes once to each block of the other.
    size = F.greatest(F.lit(1), F.least(F.lit(ROWS), F.lit(BLOCK_BYTES) / (8 * F.greatest("dims", F.lit(1)))))
    blocks, parties = F.ceil(F.lit(n) / size), max(1, -(-asking // ANCHORS))
    deal = lambda count: F.pmod(F.xxhash64("row"), count)
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), count - 1))
    key = F.shiftleft(F.col("dims").cast("long"), 48).bitwiseOR(F.shiftleft(F.col("party").cast("long"), 24)).bitwiseOR(F.col("block").cast("long")).alias("part")
    none = F.lit(None).cast("array<long>")
    left = rows.withColumn("block", deal(blocks)).withColumn("party", every(F.lit(parties).cast("long"))).select(key, F.lit(0).alias("kind"), "row", "id", "label", "f", none.alias("asks"))
    right = anchors.withColumn("party", deal(F.lit(parties))).withColumn("block", every(blocks.cast("long"))).select(key, F.lit(1).alias("kind"), "row", F.lit(None).cast("long").alias("id"), "label", "f", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            own = table["kind"].to_numpy() == 0
            if own.all() or not own.any():
                continue
            ids = column(table, "id", own)
            ids = ids.fill_null(np.iinfo(np.int64).max).to_numpy()  # a null id is last among ties
            block = Block(ids, column(table, "row", own).to_numpy(), column(table, "label", own).to_numpy(), matrix(column(table, "f", own)))
            yield from solve(block, table.filter(pa.array(~own)))

    return left.union(right).repartition("part").sortWithinPartitions("part", "kind", "row").mapInArrow(run, out)


def _long(scores: np.ndarray) -> pa.Array:
    return pa.array([int(s) for s in scores], pa.int64())


def hard_negatives(
    vectors: DataFrame, is_anchor: Callable[[Column], Column], relabel: Callable[[Column, Column], Column] = lambda _, label: label,
    positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: float = 256.0,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """The first ``negatives`` rows of another label for each anchor and positive.

    Components become floor(``scale`` * x); scores are whole inner products
    with the anchor, higher ones first, ties to smaller ids.  Positives are an
    anchor's first ``positives`` other rows of its label; a negative's score
    times 100 lies between ``least`` and ``most`` times the positive's.

    Returns anchor_id, positive_id, rank (from 1), negative_id,
    positive_score and negative_score; no row where a window is empty.

    Rows with a null label, a null vector or a null or non-finite component
    take no part.  A row meets the rows whose vectors are as long as its own.
    Repeated rows are rows of their own, each a candidate for the others; null
    ids are never anchors and come last among ties.  Scores are exact at any
    size; one beyond a long is an error.  An empty table gives an empty one.
    """
    rows = _prepared(vectors, scale, relabel, id_col, vector_col, label_col)
    anchors = rows.where(F.coalesce(is_anchor(F.col("id")), F.lit(False)))
    n, asking = rows.count(), anchors.count()

    def nearest(block: Block, asked: pa.Table) -> Iterator[pa.RecordBatch]:
        for row, label, values in zip(asked["row"].to_pylist(), asked["label"].to_pylist(), matrix(asked["f"].combine_chunks())):
            at, score = top_same(block, row, label, values, positives)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row)), pa.array(block.ids[at]), pa.array(block.rows[at]), _long(score)], names=["row", "id", "other", "score"])

    found = _met(rows, anchors.withColumn("asks", F.lit(None).cast("array<long>")), nearest, "row long, id long, other long, score long", n, asking)
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "id", "other"))
    found = written(found.withColumn("place", place).where(F.col("place") <= positives), "positives")

    def between(block: Block, asked: pa.Table) -> Iterator[pa.RecordBatch]:
        for row, label, values, scores in zip(asked["row"].to_pylist(), asked["label"].to_pylist(), matrix(asked["f"].combine_chunks()), asked["asks"].to_pylist()):
            for positive, (at, score) in zip(scores, top_in_windows(block, label, values, [window(s, least, most) for s in scores], negatives)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), row)), pa.array(np.full(len(at), positive)), pa.array(block.ids[at]), pa.array(block.rows[at]), _long(score)],
                    names=["row", "positive_score", "id", "other", "score"])

    asks = anchors.join(found.groupBy("row").agg(F.array_sort(F.collect_set("score")).alias("asks")), "row")
    inside = _met(rows, asks, between, "row long, positive_score long, id long, other long, score long", n, asking)
    place = F.row_number().over(Window.partitionBy("row", "positive_score").orderBy(F.desc("score"), "id", "other"))
    inside = inside.withColumn("rank", place).where(F.col("rank") <= negatives)
    known = lambda c: F.when(F.col(c) != np.iinfo(np.int64).max, F.col(c))
    pairs = found.select("row", known("id").alias("positive_id"), F.col("score").alias("positive_score")).join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
    return pairs.join(inside, ["row", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), known("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
