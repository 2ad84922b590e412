"""Whole Arrow string columns as bytes in numpy: slices of rows, word boundaries and word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .slices import BLANK, LOWER, U, slice_hashes, word_bounds  # noqa: F401

_SEED = np.random.default_rng(20240607)
BASE = U(int(_SEED.integers(1 << 60)) * 2 + 0x9E3779B97F4A7C15 | 1)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
BYTE_CODE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
PIECE = 1 << 19
_tables: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** 0..n-1 and their inverses modulo 2 ** 64."""
    if "base" not in _tables or len(_tables["base"]) < n:
        size = max(n, PIECE + 1024)
        for name, factor in (("base", BASE), ("inverse", INVERSE)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps)
    return _tables["base"], _tables["inverse"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(32))) * U(0xA0761D6478BD642F | 1)
    return h ^ (h >> U(32))


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(h).view(np.int64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    offsets = offsets.astype(np.int64)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of up to ``limit`` bytes, at least one row each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def _stripped(inner: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    some = np.cumsum(inner)
    some = np.concatenate([[0], some])
    full = some[e] > some[s]
    s, e = s[full], e[full]
    loose = np.flatnonzero(~inner[s])
    while len(loose):
        s[loose] += 1
        loose = loose[~inner[s[loose]]]
    loose = np.flatnonzero(~inner[e - 1])
    while len(loose):
        e[loose] -= 1
        loose = loose[~inner[e[loose] - 1]]
    return s, e


def word_hashes(buf: np.ndarray, offsets: np.ndarray, fold: bool = False, core: np.ndarray | None = None) \
        -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word and the word index at which each row starts.

    ``offsets`` are the rows' bounds in ``buf``. A word is a longest run of bytes that are no blanks, within a row. With
    ``fold`` A-Z count as a-z. With ``core`` (a flag per byte value) words lose other bytes at both ends, and words without
    core bytes are left out.
    """
    start, end, _ = word_bounds(buf, offsets)
    if core is not None:
        start, end = _stripped(core[buf], start, end)
    return slice_hashes(LOWER[buf] if fold else buf, start, end), start, end, np.searchsorted(start, offsets)
