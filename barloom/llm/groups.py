"""Arrow batches of sorted rows as one table a group, and number columns as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array, kind: str = "<f8") -> np.ndarray:
    """Rows of a binary column without nulls, all of one length, as a matrix of ``kind`` numbers."""
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros((0, 0), kind)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].copy() if column.buffers()[2] else np.zeros(0, np.uint8)
    return data.view(kind).reshape(len(column), (at[1] - at[0]) // np.dtype(kind).itemsize)


def binary(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as a binary column."""
    data = np.ascontiguousarray(x)
    wide = data.shape[1] * data.itemsize if data.ndim == 2 else 0
    offsets = np.arange(len(x) + 1, dtype=np.int64) * wide
    return pa.Array.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def lists(rows: pa.Array, lengths: np.ndarray) -> pa.Array:
    """List column of consecutive ``rows``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), rows)


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """A table for each value of the first column, by which the rows come sorted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if hi > lo:
                if held and held[0].column(0)[0].as_py() != key[lo]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def column(table: pa.Table, name: str, rows: np.ndarray) -> pa.Array:
    """Chosen rows of a column, in one piece."""
    chosen = table[name].filter(pa.array(rows)).combine_chunks()
    return chosen.chunk(0) if isinstance(chosen, pa.ChunkedArray) and chosen.num_chunks else pa.array([], table.schema.field(name).type) if isinstance(chosen, pa.ChunkedArray) else chosen
