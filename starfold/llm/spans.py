"""Hashes of many spans of a byte buffer at once."""

from __future__ import annotations

import numpy as np

#: Bytes that must follow the last span in its buffer.
PAD = 8
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in this order."""
    return mix(a * _M3 + mix(b + _M1))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """64-bit hash of every ``data[start:end]``, seeded; ``data`` ends with ``PAD`` bytes of no span."""
    eight = np.ndarray((len(data) - PAD + 1,), dtype="<u8", buffer=data, strides=(1,))
    left = end - start
    h = mix(seeds + left.astype(np.uint64) * _M3)
    at, rows = start, np.arange(len(left))
    while len(rows):
        part = eight[at] & _TAIL[np.minimum(left, 8)]
        h[rows] = mix(h[rows] ^ (part * _M2 + _M3))
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    return h
