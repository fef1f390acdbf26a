"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are read in stretches of ``STRETCH`` bytes, forward by
one network and backward by another; at every byte a softmax over both states
gives the probability of each language, and a document's probability is the
mean over all of its bytes.  Every byte of a text is read.

The network is trained in NumPy by backpropagation through time, every
position carrying its document's label, on a bounded sample of stretches.
Arrays hold units by rows and stretches by columns, so that a step over
thousands of stretches is a handful of array operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.llm.common import narrow

UNITS, STRETCH = 8, 64
#: Stretches a language the network is trained on, drawn by hash; at most ``DRAWS`` a document.
SAMPLE, DRAWS = 1500, 2
EPOCHS, BATCH, RATE, CLIP = 10, 256, 0.02, 1.0
#: Stretches read at once when scoring.
AT_ONCE = 2048
UNKNOWN = "und"
LETTER = r"\p{L}"

Weights = dict[str, np.ndarray]


def start(languages: int, units: int = UNITS, seed: int = 7) -> Weights:
    """Random weights: per direction an input table (3 units x 256), recurrent weights and biases; output weights of both."""
    random = np.random.default_rng(seed)
    draw = lambda *shape, scale: (random.standard_normal(shape) * scale).astype(np.float32)
    weights = {}
    for way in ("f", "b"):
        weights[f"W{way}"] = draw(3 * units, 256, scale=0.3)
        weights[f"U{way}"] = draw(3 * units, units, scale=1 / np.sqrt(units))
        weights[f"V{way}"] = draw(languages, units, scale=1 / np.sqrt(units))
    weights["c"] = np.zeros((languages, 1), np.float32)
    return weights


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def states(weights: Weights, way: str, codes: np.ndarray, length: np.ndarray, trace: list | None = None) -> np.ndarray:
    """States (steps x units x stretches) of one direction; ``codes`` is steps x stretches, ``length`` the bytes of each.

    The backward direction starts at each stretch's own last byte.  ``trace``
    collects what the gradient needs, in the order of the steps.
    """
    table, recurrent = weights[f"W{way}"], weights[f"U{way}"]
    steps, n = codes.shape
    units = recurrent.shape[1]
    out, h = np.zeros((steps, units, n), table.dtype), np.zeros((units, n), table.dtype)
    given, shortest = np.empty((3 * units, n), table.dtype), int(length.min()) if n else 0
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        np.take(table, codes[t], axis=1, out=given, mode="clip")
        from_state = recurrent @ h
        gates = _sigmoid(given[: 2 * units] + from_state[: 2 * units])
        z, r = gates[:units], gates[units:]
        new = np.tanh(given[2 * units :] + r * from_state[2 * units :])
        if trace is not None:
            trace.append((t, h, z, r, new, from_state[2 * units :]))
        h = new + z * (h - new)
        if t >= shortest:
            h *= t < length
        out[t] = h
    return out


def log_shares(weights: Weights, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    """Log-probabilities (steps x languages x stretches) at every byte."""
    x = weights["Vf"] @ forward + weights["Vb"] @ backward + weights["c"]
    x -= x.max(axis=1, keepdims=True)
    x -= np.log(np.exp(x).sum(axis=1, keepdims=True))
    return x


def gradient(weights: Weights, codes: np.ndarray, length: np.ndarray, label: np.ndarray) -> tuple[float, Weights]:
    """Mean cross-entropy over all bytes and its gradient, by backpropagation through time."""
    steps, n = codes.shape
    inside = (np.arange(steps)[:, None] < length[None]).astype(weights["c"].dtype)
    count = max(float(inside.sum()), 1.0)
    traces: dict[str, list] = {"f": [], "b": []}
    out = {way: states(weights, way, codes, length, traces[way]) for way in ("f", "b")}
    logs = log_shares(weights, out["f"], out["b"])
    loss = -float((logs[:, label, np.arange(n)] * inside).sum()) / count
    error = np.exp(logs)
    error[:, label, np.arange(n)] -= 1
    error *= inside[:, None, :] / count
    grad = {"c": error.sum(axis=(0, 2))[:, None]}
    for way in ("f", "b"):
        recurrent = weights[f"U{way}"]
        units = recurrent.shape[1]
        grad[f"V{way}"] = np.einsum("tkn,tun->ku", error, out[way])
        from_output = weights[f"V{way}"].T @ error
        given = np.zeros((steps, 3 * units, n), recurrent.dtype)
        dU, dh = np.zeros_like(recurrent), np.zeros((units, n), recurrent.dtype)
        for t, h, z, r, new, hidden in reversed(traces[way]):
            dh = (dh + from_output[t]) * inside[t]
            dnew = dh * (1 - z) * (1 - new * new)
            given[t, :units] = dh * (h - new) * z * (1 - z)
            given[t, units : 2 * units] = dnew * hidden * r * (1 - r)
            given[t, 2 * units :] = dnew
            to_state = given[t].copy()
            to_state[2 * units :] *= r
            dU += to_state @ h.T
            dh = dh * z + recurrent.T @ to_state
        flat = codes.ravel()
        grad[f"U{way}"] = dU
        grad[f"W{way}"] = np.stack([np.bincount(flat, row.ravel(), 256) for row in given.transpose(1, 0, 2)]).astype(recurrent.dtype)
    return loss, grad


def train(stretches: list[bytes], label: np.ndarray, languages: int, seed: int = 7, epochs: int = EPOCHS) -> Weights:
    """Weights after ``epochs`` passes of Adam over the stretches in random order, the rate falling to a tenth."""
    weights, random = start(languages, seed=seed), np.random.default_rng(seed)
    codes, length = padded(stretches)
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    number, total = 0, max(1, epochs * -(-len(stretches) // BATCH))
    for _ in range(epochs):
        order = random.permutation(len(stretches))
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            _, grad = gradient(weights, codes[: length[own].max(), own], length[own], label[own])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            number += 1
            rate = RATE * (1 - 0.9 * number / total)
            for k, g in grad.items():
                g = g * min(1.0, CLIP / max(norm, 1e-12))
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                weights[k] = weights[k] - (rate * (first[k] / (1 - 0.9**number)) / (np.sqrt(second[k] / (1 - 0.999**number)) + 1e-8)).astype(weights[k].dtype)
    return weights


def padded(stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (steps x stretches) and lengths."""
    length = np.array([len(s) for s in stretches], np.int64)
    codes = np.zeros((int(length.max()) if len(length) else 0, len(length)), np.uint8)
    for i, s in enumerate(stretches):
        codes[: len(s), i] = np.frombuffer(s, np.uint8)
    return codes, length


@dataclass
class Model:
    languages: list[str]
    weights: Weights | None

    def shares(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Mean probability of each language over all bytes of each text: texts x languages, zeros for empty texts."""
        size = np.diff(bounds)
        count = -(-size // STRETCH)
        doc = np.repeat(np.arange(len(size)), count)
        begin = bounds[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * STRETCH
        length = np.minimum(bounds[1:][doc] - begin, STRETCH)
        total = np.zeros((len(self.languages), len(size)))
        for i in range(0, len(doc), AT_ONCE):
            own, n = begin[i : i + AT_ONCE], length[i : i + AT_ONCE]
            steps = int(n.max())
            codes = data[np.minimum(own[None] + np.arange(steps)[:, None], len(data) - 1)]
            shares = np.exp(log_shares(self.weights, states(self.weights, "f", codes, n), states(self.weights, "b", codes, n)))
            if n.min() < steps:
                shares *= (np.arange(steps)[:, None] < n[None])[:, None, :]
            sums = shares.sum(axis=0, dtype=np.float64)
            for k in range(len(sums)):
                total[k] += np.bincount(doc[i : i + AT_ONCE], sums[k], minlength=len(size))
        return (total / np.maximum(size, 1)).T


def held_out(doc_id: Column) -> Column:
    """Whether a row takes no part in learning: the CRC-32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def fit(docs: DataFrame, sample: int = SAMPLE, seed: int = 7) -> Model:
    """Learn from text and language of the rows that are not held out.

    The driver gets at most ``sample`` different stretches a language, those
    with the smallest seeded hashes of id and place; rows with a null id, null
    language or a text without a letter teach nothing.  Without any labelled
    text the model knows no language.
    """
    own = narrow(docs, doc_id="long", text="string", lang="string")
    own = own.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(LETTER) & ~held_out(F.col("doc_id")))
    texts = F.approx_count_distinct(F.xxhash64("text")).alias("n")
    counts = {r["lang"]: max(r["n"], 1) for r in own.groupBy("lang").agg(texts).collect()}  # a row a language
    if not counts:
        return Model([], None)
    # Of the draws of a language, those below the bar pass: some times the sample, so that repeated stretches do not use it up.
    bar = {lang: min(1.0, 4 * sample / (DRAWS * n)) for lang, n in counts.items()}

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy().astype(np.uint64)
            langs, texts = batch.column(2), batch.column(1)
            limit = np.array([bar[x] for x in langs.to_pylist()]) * 2.0**64
            size = pc.binary_length(texts.cast(pa.large_binary())).to_numpy(zero_copy_only=False).astype(np.uint64)
            for turn in range(DRAWS):
                key = _mixed(ids * np.uint64(2 * DRAWS) + np.uint64(turn) + _mixed(np.full(1, seed, np.uint64)))
                chosen = np.flatnonzero(key.astype(np.float64) < limit)
                place = _mixed(key[chosen]) % (np.maximum(size[chosen], np.uint64(STRETCH)) - np.uint64(STRETCH) + np.uint64(1))
                pieces = [texts[int(i)].as_buffer().to_pybytes()[int(p) : int(p) + STRETCH] for i, p in zip(chosen, place)]
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(chosen)), pa.array((key[chosen] >> np.uint64(1)).astype(np.int64)), pa.array(pieces, pa.binary())], names=["lang", "key", "piece"])

    drawn = own.mapInArrow(draw, "lang string, key long, piece binary").groupBy("lang", "piece").agg(F.min("key").alias("key"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key", "piece"))
    rows = drawn.withColumn("place", place).where(F.col("place") <= sample).select("lang", "piece", "place").toArrow().sort_by([("lang", "ascending"), ("place", "ascending")])
    languages = sorted(set(rows["lang"].to_pylist()))
    number = {lang: i for i, lang in enumerate(languages)}
    label = np.array([number[x] for x in rows["lang"].to_pylist()], np.int64)
    return Model(languages, train(rows["piece"].to_pylist(), label, len(languages), seed))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (the mean probability of that language, 0 to 1) of every row.

    Only texts go in, whole.  ``und`` with a score of 0 stands for null and
    empty texts, those without a letter, and all texts if the model knows no
    language.  Ties go to the first language by name.  Repeated rows get equal
    results, further columns play no part, an empty table gives an empty one.
    """
    own = narrow(docs, doc_id="long", text="string")
    own = own.select("doc_id", F.when(F.col("text").rlike(LETTER), F.col("text")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = batch.column(1)
            none = texts.is_null().to_numpy(zero_copy_only=False) | (not known.languages)
            pred, score = np.full(len(none), UNKNOWN, object), np.zeros(len(none))
            if not none.all():
                whole = texts.filter(pa.array(~none)).cast(pa.large_string())
                bounds = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
                data = np.frombuffer(whole.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
                shares = known.shares(data, bounds - bounds[0])
                best = shares.argmax(axis=1)
                pred[~none], score[~none] = np.array(known.languages, object)[best], np.clip(shares[np.arange(len(best)), best], 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return own.mapInArrow(run, "doc_id long, lang_pred string, score double")
