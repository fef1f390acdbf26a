"""Approximate nearest neighbours: a graph grown by NN-descent, searched greedily.

Index.  Vectors start with neighbours found inside blocks of vectors that are
nearest to the same of some random pivots, dealt anew several times.  Then
neighbours of neighbours are compared in rounds: each vector's list (its
neighbours and a sample of the vectors that list it) goes to the part of the
table that its number belongs to, each vector of those lists goes there once
however many of them hold it, every pair of a list with a new member is
measured, and the nearest found for either end go to that end's list.  Rounds
end when few lists change.

Search.  Each query keeps a beam of the nearest vectors seen.  In each round
the nearest ones not yet expanded are replaced by their neighbours in the
graph; a query is done when all of its beam is expanded.

Equal vectors are one node; the rows behind it are brought back at the end, so
ties are exact however often a vector is repeated.  What is returned is
measured once more, in one place, on the original vectors.
"""

from __future__ import annotations

import itertools
import logging
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.llm.common import written
from barloom.llm.groups import binary, column, groups, lists as list_of, matrix

log = logging.getLogger(__name__)

NEIGHBOURS, REVERSE = 24, 16
#: Starting blocks: rows of a block, neighbours taken from it.
BLOCK, START_NEIGHBOURS = 512, 12
#: For up to 2 ** GROWS_FROM vectors: how often all are dealt into blocks, pivots of a half; beyond, they grow with log n.
STARTS, PIVOTS, GROWS_FROM = 8, 128, 13
#: Rounds go on until at most this share of the list entries is new.
SETTLED = 0.01
#: Squared distances below this share of the squared lengths are taken from differences.
CANCELS = 1e-6
BEAM, EXPAND, ENTRIES = 128, 32, 256
#: Bytes of vectors that the lists of one part may name, each in double precision.
PART_BYTES = 32 << 20
#: Candidates a task holds before it keeps the nearest of each end only; lists compared at once.
HELD, AT_ONCE = 1 << 21, 32
#: Pairs of query and node measured in one group.
PAIRS = 1 << 18

LISTS = "u long, f binary, v array<long>, d array<double>, fresh array<boolean>"
FOUND = "u long, v long, dist double"


def grown(least: int, n: int) -> int:
    """``least``, times log n over ``GROWS_FROM`` for larger ``n``."""
    return max(least, math.ceil(least * math.log2(max(n, 1)) / GROWS_FROM))


def part(node: Column, dims: int) -> Column:
    """Part of the table that a node belongs to: neighbouring numbers, few enough that the vectors of their lists fit in memory."""
    lists = max(1, PART_BYTES // (8 * max(dims, 1) * (NEIGHBOURS + REVERSE)))
    return F.shiftright(node, lists.bit_length() - 1)


def packed(nodes: DataFrame) -> tuple[DataFrame, str]:
    """(id, f): vectors as bytes of floats if all components are floats, else of doubles, and which; nothing is rounded."""
    exact = F.forall("d", lambda x: x.cast("float").cast("double") == x)
    kind = "<f4" if nodes.agg(F.min(exact)).first()[0] else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), binary(rows.astype(kind))], names=["id", "f"])

    return nodes.select("id", "d").mapInArrow(run, "id long, f binary"), kind


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``a`` and ``b`` (matrices, or stacks of them); where the product form cancels or overflows, from the differences."""
    with np.errstate(all="ignore"):
        both = (a * a).sum(axis=-1)[..., :, None] + (b * b).sum(axis=-1)[..., None, :]
        far = both - 2 * (a @ np.swapaxes(b, -1, -2))
        rough = np.nonzero(~(far > CANCELS * both))
        for i in range(0, len(rough[0]), 1 << 14):
            *of, x, y = (r[i : i + (1 << 14)] for r in rough)
            gap = a[(*of, x)] - b[(*of, y)]
            far[(*of, x, y)] = (gap * gap).sum(axis=-1)
        return far


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays in double precision."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _found(u: np.ndarray, v: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64)), pa.array(d.astype(np.float64))], names=["u", "v", "dist"])


def _kept(u: np.ndarray, v: np.ndarray, d: np.ndarray, mark: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` nearest different ``v`` of each ``u``, in order; of an equal pair the one with the smaller mark stays."""
    by = np.lexsort((mark, v, u))
    u, v, d, mark = u[by], v[by], d[by], mark[by]
    first = np.ones(len(u), bool)
    first[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    u, v, d, mark = u[first], v[first], d[first], mark[first]
    by = np.lexsort((v, d, u))
    u, v, d, mark = u[by], v[by], d[by], mark[by]
    starts = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.zeros(0, int)
    rank = np.arange(len(u)) - np.repeat(starts, np.diff(np.append(starts, len(u))))
    return u[rank < k], v[rank < k], d[rank < k], mark[rank < k]


def _dealt(nodes: DataFrame, kind: str, pivots: list[np.ndarray], lines: list[np.ndarray]) -> DataFrame:
    """(deal, code, place, u, f) for each deal: nearest pivot of each half of its pivots, place along its line."""
    shared = nodes.sparkSession.sparkContext.broadcast([(p - np.median(p, axis=0), np.median(p, axis=0), line) for p, line in zip(pivots, lines)])
    near = lambda x, c: np.nan_to_num((c * c).sum(axis=1)[None] - 2 * (x @ c.T), nan=np.inf).argmin(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = matrix(batch.column(1), kind).astype(np.float64)
            for deal, (all_, middle, line) in enumerate(shared.value):
                half = max(len(all_) // 2, 1)
                with np.errstate(all="ignore"):
                    x = raw - middle
                    code = near(x, all_[:half]) * max(len(all_) - half, 1) + (near(x, all_[half:]) if len(all_) > half else 0)
                    place = x @ line
                deals = np.full(batch.num_rows, deal, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(deals), pa.array(code.astype(np.int64)), pa.array(place), *batch.columns], names=["deal", "code", "place", "u", "f"])

    return nodes.mapInArrow(run, "deal int, code long, place double, u long, f binary")


def _nearest_in_blocks(kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (deal, u, f) come sorted; each run of ``BLOCK`` rows of a deal is a block, the last up to twice as long."""

    def solve(n: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        k = min(START_NEIGHBOURS, len(n) - 1)
        far = _squares(x, x)
        np.fill_diagonal(far, np.inf)
        near = np.argpartition(far, k - 1, axis=1)[:, :k] if k else np.zeros((len(n), 0), int)
        return _found(np.repeat(n, k), n[near.ravel()], np.sqrt(np.maximum(np.take_along_axis(far, near, 1).ravel(), 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal, ids, vectors = -1, np.zeros(0, np.int64), np.zeros((0, 0))
        for batch in batches:
            deals, own, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), kind).astype(np.float64)
            cuts = [0, *(np.flatnonzero(deals[1:] != deals[:-1]) + 1), len(deals)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi > lo and deals[lo] != deal:
                    if len(ids):
                        yield solve(ids, vectors)
                    deal, ids, vectors = deals[lo], np.zeros(0, np.int64), np.zeros((0, x.shape[1]))
                ids, vectors = np.concatenate([ids, own[lo:hi]]), np.concatenate([vectors, x[lo:hi]]) if hi > lo else vectors
                while len(ids) >= 2 * BLOCK:
                    yield solve(ids[:BLOCK], vectors[:BLOCK])
                    ids, vectors = ids[BLOCK:], vectors[BLOCK:]
        if len(ids):
            yield solve(ids, vectors)

    return run


def _compare(kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per part: vectors with their radius (kind 0), then lists of members (kind 1); gives the nearest pairs found for either end."""

    def pairs(ids: np.ndarray, x: np.ndarray, radius: np.ndarray, lists: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
        members, fresh = lists["ms"].combine_chunks(), lists["fr"].combine_chunks()
        lengths = members.value_lengths().to_numpy()
        start = np.cumsum(lengths) - lengths
        at = np.searchsorted(ids, members.flatten().to_numpy())
        new = fresh.flatten().to_numpy(zero_copy_only=False)
        news = np.add.reduceat(new.astype(np.int64), start) if len(start) else np.zeros(0, int)
        order = np.lexsort((lengths, news))
        for i in range(0, len(order), AT_ONCE):
            own = order[i : i + AT_ONCE]
            wide, front = lengths[own].max(), news[own].max()
            if not front:
                continue
            place = start[own][:, None] + np.arange(wide)[None]
            there = np.arange(wide)[None] < lengths[own][:, None]
            place[~there] = 0
            m, fr = at[place], new[place] & there
            by = np.argsort(~fr, axis=1, kind="stable")  # new members first
            m, fr, there = (np.take_along_axis(a, by, 1) for a in (m, fr, there))
            far = _squares(x[m[:, :front]], x[m])
            good = fr[:, :front, None] & there[:, None, :] & (m[:, :front, None] != m[:, None, :])
            for ends, others, near in ((0, 1, far < radius[m[:, :front]][:, :, None]), (1, 0, far < radius[m][:, None, :])):
                l, *ab = np.nonzero(good & near)
                yield ids[m[l, ab[ends]]], ids[m[l, ab[others]]], far[l, ab[0], ab[1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            kinds = table["kind"].to_numpy()
            ids = column(table, "u", kinds == 0).to_numpy()
            if not len(ids) or (kinds == 0).all():
                continue
            x = matrix(column(table, "f", kinds == 0), kind).astype(np.float64)
            radius = np.square(column(table, "radius", kinds == 0).to_numpy())
            held: list[tuple[np.ndarray, ...]] = []
            for got in pairs(ids, x, radius, table.filter(pa.array(kinds == 1))):
                held.append(got)
                if sum(len(h[0]) for h in held) > HELD:
                    u, v, d = (np.concatenate(c) for c in zip(*held))
                    held = [_kept(u, v, d, np.zeros(len(u), np.int8), NEIGHBOURS)[:3]]
            if held:
                u, v, d = (np.concatenate(c) for c in zip(*held))
                u, v, d, _ = _kept(u, v, d, np.zeros(len(u), np.int8), NEIGHBOURS)
                yield _found(u, v, np.sqrt(np.maximum(d, 0)))

    return run


def _merge(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per part: lists (kind 0) and what was found for them (kind 1: v and d of one element); the ``k`` nearest of both. What is new is fresh, the rest as it was."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            kinds = table["kind"].to_numpy()
            lists = table.filter(pa.array(kinds == 0)).combine_chunks()
            ids = lists["u"].to_numpy()
            old, new = column(table, "v", kinds == 0), kinds == 1
            length = old.value_lengths().to_numpy()
            u = np.concatenate([np.repeat(ids, length), column(table, "u", new).to_numpy()])
            v = np.concatenate([old.flatten().to_numpy(), column(table, "v", new).flatten().to_numpy()])
            d = np.concatenate([column(table, "d", kinds == 0).flatten().to_numpy(), column(table, "d", new).flatten().to_numpy()])
            mark = np.concatenate([column(table, "fresh", kinds == 0).flatten().to_numpy(zero_copy_only=False).astype(bool), np.ones(new.sum(), bool)])
            u, v, d, mark = _kept(u, v, d, mark, k)
            sizes = np.searchsorted(u, ids, "right") - np.searchsorted(u, ids, "left")
            columns = [lists["u"].chunk(0) if len(ids) else pa.array([], pa.int64()), column(table, "f", kinds == 0)]
            yield pa.RecordBatch.from_arrays([*columns, list_of(pa.array(v), sizes), list_of(pa.array(d), sizes), list_of(pa.array(mark), sizes)], names=["u", "f", "v", "d", "fresh"])

    return run


def merged(lists: DataFrame, found: DataFrame, k: int, of: Callable[[Column], Column]) -> DataFrame:
    """``lists`` with what was ``found`` for them; what is new is marked fresh."""
    old = lists.select(of(F.col("u")).alias("part"), F.lit(0).alias("kind"), "u", "f", "v", "d", "fresh")
    new = found.select(of(F.col("u")).alias("part"), F.lit(1).alias("kind"), "u", F.lit(None).cast("binary").alias("f"), F.array("v").alias("v"), F.array("dist").alias("d"), F.array(F.lit(True)).alias("fresh"))
    return old.union(new).repartition("part").sortWithinPartitions("part", "kind", "u").mapInArrow(_merge(k), LISTS)


def build(nodes: DataFrame, kind: str, dims: int, n: int, seed: int = 11) -> DataFrame:
    """Neighbour lists (u, f, v, d, fresh) of ``n`` nodes (u, f), ``NEIGHBOURS`` a node, nearest first."""
    of = lambda node: part(node, dims)
    # Pivots go to all tasks; their number grows with log n.
    deals, count = grown(STARTS, n), max(2, min(2 * grown(PIVOTS, n), n // 32))
    drawn = matrix(nodes.orderBy(F.xxhash64(F.lit(seed), "u"), "u").limit(count * deals).select("f").toArrow()["f"].combine_chunks(), kind).astype(np.float64)
    random = np.random.default_rng(seed)
    pivots = [drawn[random.choice(len(drawn), min(count, len(drawn)), replace=False)] for _ in range(deals)]
    dealt = _dealt(nodes, kind, pivots, [random.standard_normal(dims) for _ in range(deals)])
    dealt = dealt.orderBy("deal", "code", "place", F.xxhash64("u"))
    none = [F.array().cast(f"array<{t}>").alias(c) for c, t in (("v", "long"), ("d", "double"), ("fresh", "boolean"))]
    starts = dealt.select("deal", "u", "f").mapInArrow(_nearest_in_blocks(kind), FOUND)
    lists = written(merged(nodes.select("u", "f", *none), starts, NEIGHBOURS, of), "lists")
    # A round only brings nearer neighbours into lists, so rounds come to an end without a bound.
    for number in itertools.count():
        listed = lists.select(F.col("u").alias("m"), F.inline(F.arrays_zip(F.col("v").alias("v"), F.col("fresh").alias("fresh"))).alias("u", "fresh"))
        turn = F.row_number().over(Window.partitionBy("u").orderBy(~F.col("fresh"), F.xxhash64("m", F.lit(number)), "m"))
        back = listed.withColumn("turn", turn).where(F.col("turn") <= REVERSE).groupBy("u").agg(F.collect_list(F.struct("m", "fresh")).alias("back"))
        ms, fr = F.concat("v", F.coalesce("back.m", F.array().cast("array<long>"))), F.concat("fresh", F.coalesce("back.fresh", F.array().cast("array<boolean>")))
        members = lists.select("u", "v", "fresh").join(back, "u", "left").select("u", ms.alias("ms"), fr.alias("fr"))
        # Lists without a new member have been compared.
        members = written(members.where(F.exists("fr", lambda x: x)), "members")
        full = F.when(F.size("d") < NEIGHBOURS, float("inf")).otherwise(F.element_at("d", -1))
        wanted = members.select(of(F.col("u")).alias("part"), F.explode("ms").alias("u")).distinct()
        vectors = wanted.join(lists.select("u", "f", full.alias("radius")), "u").select("part", F.lit(0).alias("kind"), "u", "f", "radius", *[F.lit(None).cast(t).alias(c) for c, t in (("ms", "array<long>"), ("fr", "array<boolean>"))])
        own = members.select(of(F.col("u")).alias("part"), F.lit(1).alias("kind"), "u", F.lit(None).cast("binary").alias("f"), F.lit(None).cast("double").alias("radius"), "ms", "fr")
        better = vectors.union(own).repartition("part").sortWithinPartitions("part", "kind", "u").mapInArrow(_compare(kind), FOUND)
        known = lists.withColumn("fresh", F.transform("v", lambda _: F.lit(False)))
        lists = written(merged(known, better, NEIGHBOURS, of), "lists")
        new = lists.agg(F.sum(F.size(F.filter("fresh", lambda x: x)))).first()[0] or 0
        log.info("op4 round %d: %d of %d list entries are new", number + 1, new, NEIGHBOURS * n)
        if new <= SETTLED * NEIGHBOURS * n:
            return lists


def _measure(kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per part: nodes (kind 0), queries with their radius (kind 1), pairs of query and node (kind 2); gives the pairs inside the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            kinds = table["kind"].to_numpy()
            if not (kinds == 2).any():
                continue
            nodes, asked = column(table, "v", kinds == 0).to_numpy(), column(table, "q", kinds == 1).to_numpy()
            x, y = (matrix(column(table, "f", kinds == i), kind) for i in (0, 1))
            radius = column(table, "radius", kinds == 1).to_numpy()
            q, v = column(table, "q", kinds == 2).to_numpy(), column(table, "v", kinds == 2).to_numpy()
            at, by = np.searchsorted(nodes, v), np.searchsorted(asked, q)
            for i in range(0, len(q), 1 << 15):
                a, b = at[i : i + (1 << 15)], by[i : i + (1 << 15)]
                with np.errstate(all="ignore"):
                    d = np.sqrt(np.square(x[a].astype(np.float64) - y[b]).sum(axis=1))
                near = d < radius[b]
                yield _found(q[i : i + (1 << 15)][near], v[i : i + (1 << 15)][near], d[near])

    return run


def greedy_search(nodes: DataFrame, graph: DataFrame, queries: DataFrame, kind: str, dims: int, n: int, beam: int | None = None, seed: int = 11) -> DataFrame:
    """The ``beam`` nearest nodes found for each query: (u, f, v, d, fresh), ``u`` being the query.

    ``nodes`` (u, f), ``graph`` the lists of ``build``, ``queries`` (u, f).
    All queries begin at the same nodes, whose vectors are broadcast
    (``ENTRIES``, growing with log n as the beam does), and those that are
    nodes themselves also at their own.
    """
    beam = beam or grown(BEAM, n)
    of = lambda node: part(node, dims)
    turn = F.row_number().over(Window.partitionBy("u").orderBy(F.xxhash64("m"), "m"))
    back = graph.select(F.col("u").alias("m"), F.explode("v").alias("u")).withColumn("turn", turn).where(F.col("turn") <= 2 * NEIGHBOURS)
    back = back.groupBy("u").agg(F.collect_list("m").alias("back"))
    links = graph.select("u", "v").join(back, "u", "left").select("u", F.array_union("v", F.coalesce("back", F.array().cast("array<long>"))).alias("near"))
    links = written(links, "links")
    chosen = nodes.orderBy(F.xxhash64(F.lit(seed), "u"), "u").limit(grown(ENTRIES, n)).toArrow()
    entries = nodes.sparkSession.sparkContext.broadcast((chosen["u"].to_numpy(), matrix(chosen["f"].combine_chunks(), kind).astype(np.float64)))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = entries.value
        for batch in batches:
            y = matrix(batch.column(1), kind).astype(np.float64)
            for i in range(0, len(y), 256):
                far = np.sqrt(np.maximum(_squares(y[i : i + 256], x), 0))
                near = np.argsort(far, axis=1, kind="stable")[:, :beam]
                yield _found(np.repeat(batch.column(0).to_numpy()[i : i + 256], near.shape[1]), ids[near.ravel()], np.take_along_axis(far, near, 1).ravel())

    none = [F.array().cast(f"array<{t}>").alias(c) for c, t in (("v", "long"), ("d", "double"), ("fresh", "boolean"))]
    state = queries.select("u", "f", *none)
    own = queries.select("u", F.col("u").alias("v"), F.lit(0.0).alias("dist"))
    # A fresh entry of a beam has not been expanded.
    state = written(merged(state, queries.select("u", "f").mapInArrow(enter, FOUND).union(own), beam, of), "beam")
    while True:
        ready = F.slice(F.filter("v", lambda v, i: F.get("fresh", i)), 1, EXPAND)
        front = state.select(F.col("u").alias("q"), ready.alias("ready"))
        if front.where(F.size("ready") > 0).isEmpty():
            return state
        full = F.when(F.size("d") < beam, float("inf")).otherwise(F.element_at("d", -1))
        pairs = front.select("q", F.explode("ready").alias("u")).join(links, "u").select("q", F.explode("near").alias("v")).distinct()
        pairs = written(pairs.withColumn("part", of(F.col("v"))), "pairs")
        # A part that many queries come to is dealt over several tasks by query.
        salts = pairs.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / PAIRS).alias("salts"))
        key = lambda salt: (F.shiftleft("part", 24) + salt).alias("part")
        pairs = pairs.join(salts, "part").select(key(F.pmod(F.xxhash64("q"), "salts")), "q", "v")
        there = nodes.withColumn("part", of(F.col("u"))).join(salts, "part").select("u", "f", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
        there = there.select(key(F.col("salt")), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("q"), F.col("u").alias("v"), "f", F.lit(None).cast("double").alias("radius"))
        asked = pairs.select("part", "q").distinct().join(state.select(F.col("u").alias("q"), "f", full.alias("radius")), "q")
        asked = asked.select("part", F.lit(1).alias("kind"), "q", F.lit(None).cast("long").alias("v"), "f", "radius")
        pairs = pairs.select("part", F.lit(2).alias("kind"), "q", "v", F.lit(None).cast("binary").alias("f"), F.lit(None).cast("double").alias("radius"))
        met = there.union(asked).union(pairs).repartition("part").sortWithinPartitions("part", "kind", "v", "q").mapInArrow(_measure(kind), FOUND)
        spent = F.transform(F.sequence(F.lit(1), F.size("v")), lambda i: F.get("fresh", i - 1) & ~F.array_contains("ready", F.get("v", i - 1)))
        spent = F.when(F.size("v") > 0, spent).otherwise(F.array().cast("array<boolean>"))
        left = state.withColumn("ready", ready).select("u", "f", "v", "d", spent.alias("fresh"))
        state = written(merged(left, met, beam, of), "beam")


def nearest_rows(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest other rows of each row for whose id ``is_query`` holds.

    Returns query_id, rank (from 1), ``id_col`` and score (the distance in
    double precision on the original vectors, summed in the order of the
    components), nearest first, ties to smaller ids; all candidates if there
    are fewer than ``k``.

    Null vectors, zero vectors and those with null or non-finite components
    take no part, nor do lengths other than the commonest (the longest of
    those as common).  Repeated rows are rows of their own, each a candidate
    for the others; rows with a null id are candidates, last among ties.  An
    empty table gives an empty one.
    """
    own = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("d"))
    finite = F.forall("d", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = own.where(F.col("d").isNotNull() & finite & F.exists("d", lambda x: x != 0))
    own = written(own.withColumn("row", F.monotonically_increasing_id()).withColumn("d", F.transform("d", lambda x: x + 0.0)), "rows")
    common = own.groupBy(F.size("d").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    dims = common["size"] if common else 0
    own = own.where(F.size("d") == dims)
    nodes = written(own.groupBy("d").agg(F.count(F.lit(1)).alias("n")).select(F.monotonically_increasing_id().alias("id"), "d"), "nodes")
    n = nodes.count()
    rows = written(own.join(nodes.select(F.col("id").alias("node"), "d"), "d").select("row", "id", "node", F.coalesce(is_query(F.col("id")), F.lit(False)).alias("asks")), "members")
    if n == 0:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias(id_col), F.lit(0.0).alias("score"))
    vectors_, kind = packed(nodes)
    # Numbers follow a first deal, so that the lists of one part name common vectors.
    drawn = nodes.orderBy(F.xxhash64(F.lit(5), "id"), "id").limit(2 * grown(PIVOTS, n)).select("d").toArrow()["d"].combine_chunks()
    pivots = drawn.flatten().to_numpy().reshape(-1, dims)
    placed = _dealt(vectors_, kind, [pivots], [np.ones(dims)]).orderBy("code", "place", F.xxhash64("u"))
    placed = written(placed.select(F.col("u").alias("id"), "f", F.monotonically_increasing_id().alias("u")), "placed")
    numbered = placed.select("u", "f")
    lists = build(numbered, kind, dims, n)
    asked = rows.where("asks").select("node").distinct().join(placed, F.col("node") == F.col("id")).select("u", "f")
    found = greedy_search(numbered, lists, asked, kind, dims, n)
    # The beams are measured once more, on the original vectors.
    exact = nodes.join(placed.select("id", "u"), "id")
    found = found.select("u", F.explode("v").alias("v"))
    found = found.join(exact.select("u", F.col("id").alias("q"), F.col("d").alias("x")), "u").join(exact.select(F.col("u").alias("v"), F.col("id").alias("node"), "d"), "v")
    found = written(found.select("q", F.col("node").alias("v"), distance(F.col("x"), F.col("d")).alias("dist")), "found")
    # Rows behind the nodes found: the first k + 1 of each node, then of each query's node.
    by_id = [F.col("id").isNull(), F.col("id"), F.col("row")]
    first = rows.withColumn("at", F.row_number().over(Window.partitionBy("node").orderBy(*by_id))).where(F.col("at") <= k + 1).select(F.col("node").alias("v"), "id", "row")
    near = found.join(first, "v").withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy("dist", *by_id))).where(F.col("at") <= k + 1)
    near = near.select("q", "dist", "id", "row")
    asks = rows.where("asks").select(F.col("node").alias("q"), F.col("id").alias("query_id"), F.col("row").alias("asking"))
    pairs = asks.join(near, "q").where("asking <> row")
    place = F.row_number().over(Window.partitionBy("asking").orderBy("dist", *by_id))
    return pairs.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), F.col("dist").alias("score"))
