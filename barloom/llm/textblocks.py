"""Hashes of the words and byte grams of whole Arrow batches, without a Python step per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at a time; a longer text is a block by itself.
BLOCK_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(which: str, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        steps = np.full(n, _BASE if which == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        _powers[which] = np.cumprod(steps, dtype=np.uint64)
    return _powers[which][:n]


@dataclass
class Block:
    """Texts ``first`` to ``first + n`` of a batch: their bytes, and their words in order."""

    first: int
    n: int
    data: np.ndarray
    bounds: np.ndarray  # n + 1 byte offsets
    doc: np.ndarray  # of each word
    start: np.ndarray
    end: np.ndarray
    word: np.ndarray  # hash of each word


def blocks(texts: pa.Array, lower: bool = False) -> Iterator[Block]:
    """Blocks of the texts; nulls are empty, words are runs of anything but ASCII white space.

    With ``lower``, letters are lower-cased by Unicode rules first.
    """
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.utf8_lower(texts)
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, "right")) - 1)
        yield _block(i, whole[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def _block(first: int, data: np.ndarray, bounds: np.ndarray) -> Block:
    n = len(data)
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = bounds[:-1][bounds[:-1] < n]
    begins[inner] = solid[inner]
    start = np.flatnonzero(begins)
    stops = solid.copy()
    stops[:-1] &= ~solid[1:]
    last = bounds[1:][bounds[1:] > 0] - 1
    stops[last] = solid[last]
    end = np.flatnonzero(stops) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", n), out=sums[1:])
    word = mix((sums[end] - sums[start]) * _power("down", n)[start]) if len(start) else np.zeros(0, np.uint64)
    return Block(first, len(bounds) - 1, data, bounds, np.searchsorted(bounds, start, "right") - 1, start, end, word)


def shingles(block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every run of ``k`` words; a document of fewer words gives one run of all of them."""
    word, doc = block.word, block.doc
    per_doc = np.bincount(doc, minlength=block.n)
    n = len(word) - k + 1
    docs, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n > 0:
        inside = np.flatnonzero(doc[:n] == doc[k - 1 :])
        total = np.zeros(len(inside), np.uint64)
        for i in range(k):
            total = mix(total + word[inside + i])
        docs, hashes = doc[inside], total
    short = np.flatnonzero((per_doc > 0) & (per_doc < k))
    if len(short):
        firsts = np.searchsorted(doc, short)
        total = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            more = per_doc[short] > i
            total[more] = mix(total[more] + word[firsts[more] + i])
        docs, hashes = np.concatenate([docs, short]), np.concatenate([hashes, total ^ np.uint64(_BASE)])
    return docs, hashes
