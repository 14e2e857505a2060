"""Numpy helpers inside tasks: texts of an Arrow batch as one byte array, its words and their hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SMALL = np.arange(256, dtype=np.uint8)
SMALL[65:91] += 32
U = np.uint64
_draw = np.random.default_rng(20240607)
_BYTE = _draw.integers(1, 2**64, 256, dtype=U, endpoint=False)
_PLACE = _draw.integers(0, 2**63, 1 << 12, dtype=U) * U(2) + U(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (the published splitmix64 finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, nulls as empty texts, and the places where texts begin and end."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(at) or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], most: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of batches (column 'text') with about ``most`` bytes of text, or one longer text each.

    After each part Arrow gives back what it doesn't need, as idle workers would else keep it."""
    pool = pa.default_memory_pool()
    for batch in batches:
        if not batch.num_rows:
            continue
        data, at = texts(batch.column(batch.schema.get_field_index("text")))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
            yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
            pool.release_unused()
            i = j


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each text, and for each text the index of its first word (one more at the end)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(at), np.int64)
    ink = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    begins, finishes = ink.copy(), ink.copy()
    begins[1:] &= ~ink[:-1] | edge[1:-1]
    finishes[:-1] &= ~ink[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, which depends on its bytes only."""
    if not len(starts):
        return np.zeros(0, U)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    flat = np.arange(int(lens.sum())) - np.repeat(first, lens)
    values = _BYTE[data[flat + np.repeat(starts, lens)]]
    values *= _PLACE[flat & (len(_PLACE) - 1)]
    return mixed(np.add.reduceat(values, first) + lens.astype(U) * U(0x9E3779B97F4A7C15))


def binary(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())
