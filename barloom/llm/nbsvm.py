"""Quality classifier: support vectors over Naive Bayes features.

Indicators of n-grams (byte triples, words, pairs of neighbouring words; a
word equal to the one before counts as a mark of repetition) are hashed into a
fixed number of features.  Each is scaled by the log of the ratio of its
smoothed shares in the two classes, counted over all labelled rows; a linear
hinge-loss model over the scaled indicators is fitted by dual coordinate
descent on a bounded sample, pulled toward the Naive Bayes model, and its
margins are turned into probabilities on rows of the sample left out of the fit.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from barloom.llm.common import narrow, tidy_worker
from barloom.llm.textblocks import Block, blocks, mix

log = logging.getLogger(__name__)

BITS = 17
FEATURES = 1 << BITS
#: Labelled rows the hinge-loss model is fitted on; all other counts cover every labelled row.
SAMPLE = 6000
#: ``ROUNDS`` bounds the passes of the descent; where it has not settled by then, the duality gap is logged.
SMOOTHING, COST, ROUNDS, PULL = 1.0, 0.5, 30, 0.25
#: Runs of one repeated word are told apart up to this length; longer ones have the features of this one.
LONGEST_RUN = 12
CALIBRATION_SHARE = 4  # one row in so many
THRESHOLD = 0.3
#: Largest label table that is broadcast, in rows of 12 bytes.
BROADCAST_ROWS = 2_000_000

_REPEATED = np.uint64(0x5BD1E9955BD1E995)


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of the distinct features of each document of a block, in order."""
    data, bounds = block.data.astype(np.uint64), block.bounds
    keys = []
    if len(data) > 2:
        doc = np.repeat(np.arange(block.n), np.diff(bounds))
        inside = doc[:-2] == doc[2:]
        gram = (data[:-2] << np.uint64(16)) | (data[1:-1] << np.uint64(8)) | data[2:]
        keys.append((doc[:-2][inside], gram[inside]))
    if len(block.word):
        word = block.word.copy()
        again = np.zeros(len(word), bool)
        again[1:] = (block.word[1:] == block.word[:-1]) & (block.doc[1:] == block.doc[:-1])
        word[again] = _REPEATED
        keys.append((block.doc, word ^ np.uint64(1)))
        pair = block.doc[1:] == block.doc[:-1]
        keys.append((block.doc[1:][pair], (mix(word[:-1]) + word[1:])[pair] ^ np.uint64(2)))
        run, length = again.copy(), 1
        while length < LONGEST_RUN and run.any():  # n-grams of marks: runs of one word
            keys.append((block.doc[run], np.full(run.sum(), _REPEATED + np.uint64(length))))
            run[1:] = run[1:] & run[:-1] & again[1:]
            run[0] = False
            length += 1
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    packed = np.concatenate([(d.astype(np.uint64) << np.uint64(BITS)) | (mix(h) >> np.uint64(64 - BITS)) for d, h in keys])
    packed.sort()
    packed = packed[np.concatenate([[True], packed[1:] != packed[:-1]])]
    return (packed >> np.uint64(BITS)).astype(np.int64), (packed & np.uint64(FEATURES - 1)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray  # per feature, the log-count ratio included
    bias: float
    slope: float
    shift: float

    def margins(self, block: Block) -> np.ndarray:
        doc, feature = features(block)
        total = np.bincount(doc, self.weights[feature], minlength=block.n)
        return total / np.sqrt(np.maximum(np.bincount(doc, minlength=block.n), 1)) + self.bias

    def scores(self, block: Block) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(block) + self.shift, -500, 500)))


def log_count_ratio(counts: np.ndarray, totals: tuple[float, float]) -> np.ndarray:
    """Log ratio of the smoothed shares of label-1 and label-0 documents with each feature; ``counts`` is features x 2, label 0 first."""
    share = (counts + SMOOTHING) / (np.array(totals) + 2 * SMOOTHING)
    return np.log(share[:, 1] / share[:, 0])


def dual_descent(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model: coordinate descent on the dual, one variable a row.

    A row is its scaled indicators divided by the root of their number, and a
    constant.  Costs weigh the classes equally.
    """
    sign = np.where(labels == 1, 1.0, -1.0)
    cost = COST * len(labels) / (2 * np.where(labels == 1, max((labels == 1).sum(), 1), max((labels == 0).sum(), 1)))
    values = lambda i: ratio[rows[i]] / np.sqrt(max(len(rows[i]), 1))  # noqa: E731  kept for no row: they would weigh more than the rows
    norm = np.array([(v := values(i)) @ v + 1.0 for i in range(len(rows))])
    weights, bias, dual = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(ROUNDS):
        moved = 0.0
        for i in order.permutation(len(rows)):
            value = values(i)
            gradient = sign[i] * (weights[rows[i]] @ value + bias) - 1
            new = min(max(dual[i] - gradient / norm[i], 0.0), cost[i])
            step = (new - dual[i]) * sign[i]
            if step:
                weights[rows[i]] += step * value
                bias += step
                dual[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    else:
        margin = np.array([weights[r] @ values(i) for i, r in enumerate(rows)]) + bias
        log.info("op2: the descent ended after %d rounds at a duality gap of %.3g", ROUNDS, weights @ weights + bias * bias + cost @ np.maximum(0, 1 - sign * margin) - dual.sum())
    return weights, bias


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of the labels over the margins, with smoothed targets, by Newton's method."""
    if not len(labels) or len(set(labels.tolist())) < 2:
        return 1.0, 0.0
    n1, n0 = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
        grad = np.array([((p - target) * margins).sum() + 1e-3 * (a - 1), (p - target).sum()])
        w = p * (1 - p) + 1e-9
        hess = np.array([[(w * margins**2).sum() + 1e-3, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


def train(rows: list[np.ndarray], labels: np.ndarray, counts: np.ndarray, totals: tuple[float, float]) -> Model:
    """Model from the sample's feature rows and the counts of all labelled rows; a constant where a class is missing."""
    if min(totals) == 0 or len(set(labels.tolist())) < 2:
        prior = (totals[1] + 1) / (sum(totals) + 2)
        return Model(np.zeros(FEATURES), 0.0, 1.0, float(np.log(prior / (1 - prior))))
    ratio = log_count_ratio(counts, totals)
    aside = np.arange(len(rows)) % CALIBRATION_SHARE == 0
    fit = np.flatnonzero(~aside)
    weights, bias = dual_descent([rows[i] for i in fit], labels[fit], ratio)
    weights = ((1 - PULL) * np.abs(weights).sum() / max((weights != 0).sum(), 1) + PULL * weights) * ratio
    bias *= PULL
    margins = np.array([weights[r].sum() / np.sqrt(max(len(r), 1)) + bias for r in rows])
    return Model(weights, bias, *calibrate(margins[aside], labels[aside]))


def held_out(doc_id: Column) -> Column:
    """Whether a row takes no part in learning: the CRC-32 of its id as text is divisible by five."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _texts(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(batch.schema.get_field_index("text"))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: documents of either label by feature, at most one row a feature."""
    total = np.zeros((FEATURES + 1, 2), np.int64)
    for batch in batches:
        label = np.asarray(batch.column(batch.schema.get_field_index("label")).to_numpy(zero_copy_only=False)).astype(int)
        for block in blocks(_texts(batch)):
            doc, feature = features(block)
            own = label[block.first : block.first + block.n]
            total[:-1] += np.bincount(feature * 2 + own[doc], minlength=2 * FEATURES).reshape(-1, 2)
            total[-1] += np.bincount(own, minlength=2)
    used = np.flatnonzero(total.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used, 0]), pa.array(total[used, 1])], names=["feature", "n0", "n1"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[np.ndarray] = []
        for block in blocks(_texts(batch)):
            doc, feature = features(block)
            rows += np.split(feature.astype(np.int32), np.searchsorted(doc, np.arange(1, block.n)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("label")), pa.array(rows, pa.list_(pa.int32()))],
            names=["doc_id", "label", "features"],
        )


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 7) -> Model:
    """Learn from the labelled rows that are not held out.

    The counts cover all of them.  The driver gets those counts (at most
    ``FEATURES`` rows) and the features of about ``sample`` rows, never more
    than twice as many, chosen by a seeded hash; a row that is repeated is
    chosen once.  A document with several labels counts as the highest; null
    ids and null labels teach nothing.
    """
    own = narrow(docs, doc_id="long", text="string").where(F.col("doc_id").isNotNull())
    marks = narrow(labels, doc_id="long", quality="int").where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("label"))
    marks = marks.where(~held_out(F.col("doc_id")))
    if (n := marks.count()) <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    rows = own.join(marks, "doc_id")
    counted = rows.select("text", "label").mapInArrow(tidy_worker(_counts), "feature int, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    found = counted.toArrow()
    table = np.zeros((FEATURES + 1, 2))
    table[found["feature"].to_numpy()] = np.column_stack([found["n0"].to_numpy(), found["n1"].to_numpy()])
    del found
    share = min(1.0, sample / max(n, 1))
    chosen = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    picked = rows.where(chosen).dropDuplicates(["doc_id", "text"]).select("doc_id", "label", "text").mapInArrow(tidy_worker(_rows), "doc_id long, label int, features array<int>")
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("features")).limit(2 * sample).toArrow()
    sets = [part for chunk in picked["features"].chunks if len(chunk) for part in np.split(chunk.flatten().to_numpy(), np.cumsum(chunk.value_lengths().to_numpy())[:-1])]
    order = np.lexsort((picked["label"].to_numpy(), picked["doc_id"].to_numpy()))
    return train([sets[i] for i in order], picked["label"].to_numpy().astype(int)[order], table[:-1], (float(table[-1, 0]), float(table[-1, 1])))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with ``name`` (double, 0 to 1, of the whole text); a column of that name is replaced.

    Only texts go in.  Null texts count as empty, and an empty text gets the
    score of a document without features.  Repeated rows get equal scores; an
    empty table gives an empty one.
    """
    keep = [f for f in docs.schema.fields if f.name != name]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = [f.name for f in keep].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.scores(b) for b in blocks(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found) if found else np.zeros(0))], names=[*batch.schema.names, name])

    return docs.select(*[F.col(f"`{f.name}`") for f in keep]).mapInArrow(tidy_worker(run), T.StructType([*keep, T.StructField(name, T.DoubleType())]))
