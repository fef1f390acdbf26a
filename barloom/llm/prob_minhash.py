"""Near-duplicates by ProbMinHash signatures, banding and exact verification.

A document is the weighted set of its runs of five words (lower case), each
weighing as often as it occurs.  Every element draws arrivals of a Poisson
process whose rate is its weight; an arrival goes to a random one of the
signature's slots, and a slot keeps the element that arrives first.  An
element stops as soon as its next arrival is later than the latest slot, so a
document costs about as many steps as it has elements and slots.  The share of
slots in which two documents agree estimates their probability Jaccard
similarity (for unweighted sets, the Jaccard similarity).

Documents that agree in all slots of a band share a bucket, and the pairs of a
bucket are settled without forming them.  First, in two rounds, a few pivots of
each bucket are compared with the members of other classes, one row a member
and pivot; links join classes, so that copies by the thousand become one class
after a comparison or two each.  What is then still foreign to the largest
class of its bucket is compared with the bucket in blocks of bounded size: a
task gets two blocks with signatures and texts, passes over pairs whose
signatures differ too much, measures the others exactly, and returns only
links between different classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from barloom.llm.common import batches_of, narrow, tidy_worker, written
from barloom.llm.textblocks import Block, blocks, mix, shingles

WORDS = 5
SIMILARITY = 0.8
#: Bands and slots of a band: two documents at 0.8 share no bucket with a probability of 5e-6.
BANDS, ROWS = 40, 6
#: Pivots of a bucket in the rounds that join large classes, and members of a block after them.
PIVOTS = (1, 4)
BLOCK = 64
#: Rows handed to Python at a time: texts, pairs of texts, pairs of blocks (up to 2 * BLOCK texts each).
TEXTS_AT_ONCE, PAIRS_AT_ONCE, BLOCKS_AT_ONCE = 1024, 256, 8
#: Standard deviations by which two signatures may fall short of the threshold before a pair is passed over (3e-6).
SLACK = 4.5

_STEP = np.uint64(0x9E3779B97F4A7C15)


def weighted(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, element, weight) of a block, sorted by document and element."""
    doc, element = shingles(block, WORDS)
    order = np.lexsort((element, doc))
    doc, element = doc[order], element[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (element[1:] != element[:-1])
    at = np.flatnonzero(first)
    return doc[at], element[at], np.diff(np.append(at, len(doc))).astype(float)


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, slots: int = BANDS * ROWS) -> np.ndarray:
    """n x slots elements that arrive first; rows of documents without elements are 0."""
    best, who = np.full(n * slots, np.inf), np.zeros(n * slots, np.uint64)
    limit = np.full(n, np.inf)
    time = np.zeros(len(doc))  # without the weight: the same for an element in every document
    done = 0
    while len(doc):
        steps = 1 if done == 0 else max(1, min(64, 8192 // len(doc)))
        number = (np.arange(done + 1, done + steps + 1, dtype=np.uint64) * _STEP)[None, :]
        draw = mix(element[:, None] + number)
        wait = -np.log(((draw >> np.uint64(11)).astype(float) + 1) * 2.0**-53)
        times = np.cumsum(np.concatenate([time[:, None], wait], axis=1), axis=1)[:, 1:]
        arrive = times / weight[:, None]
        slot = ((draw & np.uint64(2047)) * np.uint64(slots)) >> np.uint64(11)
        near = arrive <= limit[doc][:, None]
        place = (doc[:, None] * slots + slot.astype(np.int64))[near]
        at = arrive[near]
        np.minimum.at(best, place, at)
        won = best[place] == at
        who[place[won]] = np.broadcast_to(element[:, None], near.shape)[near][won]
        touched = doc[np.concatenate([[True], doc[1:] != doc[:-1]])]
        limit[touched] = best.reshape(n, slots)[touched].max(axis=1)
        alive = arrive[:, -1] <= limit[doc]
        doc, element, weight, time = doc[alive], element[alive], weight[alive], times[alive, -1]
        done += steps
    return who.reshape(n, slots)


def bands(signature: np.ndarray) -> np.ndarray:
    """n x BANDS bucket keys; the band's number is part of the key."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP, parts.shape[:2]).copy()
    for i in range(ROWS):
        key = mix(key + parts[:, :, i])
    return key.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard similarity of two weighted sets (elements sorted, weights); 0 if one is empty.

    The sum over an element's competitors depends only on the ratio of its two
    weights, so it is formed once for each ratio that occurs.
    """
    (ea, wa), (eb, wb) = a, b
    if not len(ea) or not len(eb):
        return 0.0
    union = np.union1d(ea, eb)
    xa, xb = np.zeros(len(union)), np.zeros(len(union))
    xa[np.searchsorted(union, ea)], xb[np.searchsorted(union, eb)] = wa, wb
    both = (xa > 0) & (xb > 0)
    ratio, which = np.unique(xa[both] / xb[both], return_inverse=True)
    shares = np.bincount(which, xa[both], minlength=len(ratio))
    return float(sum(s / np.maximum(xa, r * xb).sum() for s, r in zip(shares, ratio)))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, of, text) to (id, of, buckets, sign): a byte of each slot; texts without a word have no buckets."""
    for batch in batches:
        rows: list[np.ndarray] = []
        signs: list[bytes] = []
        for block in blocks(batch.column(2), lower=True):
            doc, element, weight = weighted(block)
            some = np.bincount(doc, minlength=block.n) > 0
            signature = signatures(doc, element, weight, block.n)
            rows += [k if s else k[:0] for k, s in zip(bands(signature), some)]
            signs += [x.tobytes() for x in (signature >> np.uint64(56)).astype(np.uint8)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.int64())), pa.array(signs, pa.binary())], names=["id", "of", "buckets", "sign"]
        )


def _sets(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Elements and weights of each text."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for block in blocks(texts, lower=True):
        doc, element, weight = weighted(block)
        cuts = np.searchsorted(doc, np.arange(1, block.n))
        out += zip(np.split(element, cuts), np.split(weight, cuts))
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) to (a, b, similarity)."""
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            found = [similarity(x, y) for x, y in zip(_sets(part.column(2)), _sets(part.column(3)))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.float64())], names=["a", "b", "similarity"])


def _compare_blocks(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of two blocks, each a list of (node, own, sign, text), to links (a, b) between different classes."""
    least = threshold - SLACK * (threshold * (1 - threshold) / (BANDS * ROWS)) ** 0.5

    def block(members: list[dict]) -> tuple[np.ndarray, list, np.ndarray, list]:
        signs = np.frombuffer(b"".join(m["sign"] for m in members), np.uint8).reshape(len(members), -1)
        return np.array([m["own"] for m in members]), [m["node"] for m in members], signs, [m["text"] for m in members]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[int, int], None] = {}
            for i in range(batch.num_rows):
                own_x, node_x, sign_x, text_x = block(batch.column(0)[i].as_py())
                own_y, node_y, sign_y, text_y = block(batch.column(1)[i].as_py())
                sets_x = sets_y = None
                root: dict[int, int] = {}

                def top(c: int) -> int:
                    while c in root:
                        c = root[c]
                    return c

                for k in range(len(node_x)):
                    near = np.flatnonzero(((sign_y == sign_x[k]).mean(axis=1) >= least) & (own_y != own_x[k]))
                    for m in near.tolist():
                        a, b = top(int(own_x[k])), top(int(own_y[m]))
                        if a == b:
                            continue  # linked by another pair of this block
                        if sets_x is None:
                            sets_x, sets_y = _sets(pa.array(text_x, pa.string())), _sets(pa.array(text_y, pa.string()))
                        if similarity(sets_x[k], sets_y[m]) >= threshold:
                            root[max(a, b)] = min(a, b)
                            found[(int(own_x[k]), int(own_y[m]))] = None
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(id, class): the smallest id that is connected with it, of every id in ``edges`` (a, b).

    Every id takes the smallest class among its neighbours, then the class of
    its class, until nothing changes.  Sums and joins only: no group is
    gathered.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    state = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("class")), "classes")
    while True:
        least = both.join(state.select(F.col("id").alias("b"), "class"), "b").groupBy(F.col("a").alias("id")).agg(F.min("class").alias("near"))
        hooked = state.join(least, "id").select("id", F.col("class").alias("old"), F.least("class", "near").alias("class"))
        jump = state.select(F.col("id").alias("class"), F.col("class").alias("further"))
        new = hooked.join(jump, "class", "left").select("id", "old", F.least("class", F.coalesce("further", "class")).alias("class"))
        new = written(new, "classes")
        state = new.drop("old")
        if new.where("class <> old").isEmpty():
            return state


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``class_id`` (the smallest id of its class), and digests of its text and of the class's (``of``, ``class_of``), of every row.

    Equal texts are of one class; further classes join over links of at least
    ``threshold``.  Null texts count as empty; texts without a word are near
    only to equal texts.  Texts of fewer than five words are one element.
    Rows without an id have no class.  Repeated ids with different texts keep
    a row each.  Further columns are dropped; an empty table gives an empty one.
    """
    own = narrow(docs, **{id_col: "long", text_col: "string"}).toDF("id", "text")
    own = own.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("of", F.sha2("text", 256))
    named = own.where("id is not null")
    # One node per distinct text, called by its smallest id; an id that is repeated with other texts names only one of them.
    reps = named.groupBy("of").agg(F.min("id").alias("rep"))
    reps = written(reps, "texts")
    firsts = reps.groupBy("rep").agg(F.min("of").alias("first"))
    nodes = reps.join(firsts, "rep").select("of", "rep", F.when(F.col("of") == F.col("first"), F.col("rep")).otherwise(-1 - F.abs(F.xxhash64("of") / 2).cast("long")).alias("node"))
    nodes = written(nodes, "nodes")

    spark = docs.sparkSession
    with batches_of(spark, TEXTS_AT_ONCE):
        signed = written(named.select("id", "of", "text").mapInArrow(tidy_worker(_sign), "id long, of string, buckets array<long>, sign binary"), "signatures")
    members = signed.join(nodes, "of").where("id = rep").select("node", F.explode("buckets").alias("key")).distinct()
    members = written(members, "members")
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    members = written(members.join(shared, "key"), "buckets")
    wanted = members.select("node").distinct().join(nodes, "node").select("node", F.col("rep").alias("id"), "of")
    texts = written(named.join(wanted, ["id", "of"]).select("node", "text").dropDuplicates(["node"]), "compared")
    signs = signed.join(wanted, ["id", "of"]).select("node", "sign").dropDuplicates(["node"])

    classes = written(members.select(F.col("node").alias("id")).distinct().withColumn("class", F.col("id")), "classes")
    members = members.withColumn("own", F.col("node"))
    tested: DataFrame | None = None
    called = lambda side, name: classes.select(F.col("id").alias(side), F.col("class").alias(name))

    def join_classes(links: DataFrame) -> None:
        nonlocal classes, members
        if not links.isEmpty():
            joined = components(links).select(F.col("id").alias("class"), F.col("class").alias("root"))
            classes = written(classes.join(joined, "class", "left").select("id", F.coalesce("root", "class").alias("class")), "classes")
        now = members.drop("own").join(called("node", "own"), "node")
        open_ = now.groupBy("key").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo <> hi").select("key")
        members = written(now.join(open_, "key").select("key", "node", "own"), "buckets")

    for number, pivots in enumerate(PIVOTS):
        drawn = members.withColumn("h", F.xxhash64(F.lit(number), "node"))
        place = F.row_number().over(Window.partitionBy("key").orderBy("h", "node"))
        chosen = drawn.withColumn("place", place).where(F.col("place") <= pivots).select("key", F.col("node").alias("pivot"), F.col("own").alias("its"))
        met = members.join(chosen, "key").where("own <> its")
        pairs = met.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(
            texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        with batches_of(spark, PAIRS_AT_ONCE):
            fresh = written(pairs.select("a", "b", "text_a", "text_b").mapInArrow(tidy_worker(_verify), "a long, b long, similarity double"), "tested")
        tested = fresh.select("a", "b") if tested is None else tested.union(fresh.select("a", "b"))
        links = fresh.where(F.col("similarity") >= threshold).join(called("a", "ca"), "a").join(called("b", "cb"), "b").where("ca <> cb")
        join_classes(written(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "links"))

    if not members.isEmpty():
        sizes = members.groupBy("key", "own").agg(F.count(F.lit(1)).alias("n"))
        largest = sizes.groupBy("key").agg(F.max(F.struct("n", "own")).alias("top"), F.sum("n").alias("size"))
        placed = members.join(largest.select("key", F.col("top.own").alias("main"), "size"), "key")
        placed = placed.withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.ceil(F.col("size") / BLOCK)))
        placed = placed.join(signs, "node").join(texts, "node")
        member = F.struct("node", "own", "sign", "text")
        whole = placed.groupBy("key", "block").agg(F.collect_list(member).alias("y"))
        foreign = placed.where("own <> main").groupBy("key", "block").agg(F.collect_list(member).alias("x"))
        blocks_ = written(foreign.select("key", "x"), "foreign").join(written(whole.select("key", "y"), "blocks"), "key").select("x", "y")
        links = blocks_.mapInArrow(tidy_worker(_compare_blocks(threshold)), "a long, b long")
        with batches_of(spark, BLOCKS_AT_ONCE):
            links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        join_classes(links)

    found = nodes.join(classes.select(F.col("id").alias("node"), "class"), "node", "left").select("of", "rep", F.coalesce("class", "node").alias("class"))
    smallest = found.groupBy("class").agg(F.min(F.struct("rep", "of")).alias("least"))
    found = written(found.join(smallest, "class").select("of", F.col("least.rep").alias("class_id"), F.col("least.of").alias("class_of")), "found")
    known = named.select("id", "of").join(found, "of").select(F.col("id").alias(id_col), "class_id", "of", "class_of")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("class_id", "long"), ("of", "string"), ("class_of", "string"))]
    return known.unionByName(own.where("id is null").select(F.col("id").alias(id_col), *nothing))


def deduplicated(docs: DataFrame, threshold: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs``, with all its columns, of every class: that of the smallest id.

    Of repeated rows one stays.  Rows without an id all stay.  Columns
    beginning with ``_dup_`` are dropped.
    """
    keep = [F.col(f"`{c}`") for c in docs.columns if not c.startswith("_dup_")]
    found = near_duplicates(docs, threshold, id_col, text_col).where("of = class_of")
    stays = written(found.where(F.col(id_col) == F.col("class_id")).groupBy(F.col(id_col).alias("_dup_id"), F.col("of").alias("_dup_of")).agg(F.count(F.lit(1)).alias("_dup_n")), "stays")
    own = docs.select(*keep).withColumn("_dup_id", F.col(f"`{id_col}`").cast("long"))
    named = own.where("_dup_id is not null").withColumn("_dup_of", F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), 256)).join(stays, ["_dup_id", "_dup_of"])
    first = F.row_number().over(Window.partitionBy("_dup_id", "_dup_of").orderBy("_dup_of"))
    named = named.where("_dup_n = 1").select(*keep).union(named.where("_dup_n > 1").withColumn("_dup_n", first).where("_dup_n = 1").select(*keep))
    return named.union(own.where("_dup_id is null").select(*keep))
