"""Words of whole batches of texts in numpy."""
from __future__ import annotations

import numpy as np

from .common import mix64

BASE = 0x9E3779B97F4A7C15 | 1
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, count: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i below count; kept for the next call."""
    held = _powers.get(base)
    if held is None or len(held) < count:
        size = max(count, 1 << 20)
        held = np.empty(size, np.uint64)
        held[0], done = 1, 1
        step = base
        while done < size:
            n = min(done, size - done)
            held[done : done + n] = held[:n] * np.uint64(step)
            done, step = done + n, step * step & (1 << 64) - 1
        if size <= 1 << 24:
            _powers[base] = held
    return held[:count]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of bytes that aren't 0x20 or 0x09 to 0x0D."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~BLANK[data]
    change = solid[1:] != solid[:-1]
    # a row's end parts words as well
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    both = inner[solid[inner] & solid[inner + 1]]
    starts = np.flatnonzero(change & solid[1:])
    ends = np.flatnonzero(change & ~solid[1:])
    if len(both):
        both = np.unique(both)
        starts, ends = np.sort(np.concatenate([starts, both])), np.sort(np.concatenate([ends, both]))
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word: a polynomial read off prefix sums, then mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=prefix[1:])
    inverse = pow(BASE, -1, 1 << 64)
    return mix64((prefix[ends] - prefix[starts]) * powers(inverse, len(data))[starts] + (ends - starts).astype(np.uint64))
