"""Slices of a byte buffer: where words start and end, and hashes that no fixed pair of texts makes equal by construction."""

from __future__ import annotations

import numpy as np

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
U = np.uint64


def spread(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every bit depends on all."""
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def word_bounds(raw: np.ndarray, offsets: np.ndarray, between: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word: a longest run of bytes that are not in ``between``, within a row of ``offsets``."""
    solid = ~between[raw]
    begin, stop = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    stop[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    begin[inner] = solid[inner]
    stop[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return start, end, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))


def slice_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every slice: eight bytes at a time go through a bijection together with what came before, so slices
    of up to eight bytes and one length never collide, and longer ones do by chance only."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)]).tobytes()
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, 0, (1,))
    left = end - start
    kinds = spread(np.arange(65, dtype=np.uint64) + U(1 + seed * 0x1B54A32D192ED03))
    out = np.where(left <= 64, kinds[np.minimum(left, 64)], spread(left.astype(np.uint64) + U(0x5851F42D4C957F2D)))

    def taken(at, n):
        return eight[at] << ((8 - np.minimum(n, 8)) * 8).astype(np.uint64)

    out = np.where(left > 0, spread(out ^ taken(start, left)), out)
    rows = np.flatnonzero(left > 8)
    at, left = start[rows] + 8, left[rows] - 8
    while len(rows):
        out[rows] = spread(out[rows] * U(0x9E3779B97F4A7C15) ^ taken(at, left))
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    return out


def joined(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all slices with a blank behind each, bounds of the slices with their blanks)."""
    size = end - start + 1
    bounds = np.concatenate([[0], np.cumsum(size)])
    place = np.repeat(start - bounds[:-1], size) + np.arange(bounds[-1])
    out = np.concatenate([raw, np.zeros(1, np.uint8)])[place]
    out[bounds[1:] - 1] = 32
    return out, bounds
