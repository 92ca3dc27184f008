"""Golomb-Rice coding of sorted unsigned integers, as numpy array operations."""

from __future__ import annotations

import numpy as np


def encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """(remainder width, unary stream, remainder stream) of sorted uint64 values."""
    if not len(values):
        return 0, b"", b""
    gaps = np.diff(values, prepend=np.uint64(0))
    mean = float(gaps.astype(np.float64).mean())
    width = max(0, int(np.log2(mean))) if mean >= 1 else 0
    quotients = (gaps >> np.uint64(width)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + len(values), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    shifts = np.arange(width, dtype=np.uint64)
    low = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return width, np.packbits(unary).tobytes(), np.packbits(low.ravel()).tobytes()


def decode(n: int, width: int, unary: bytes, low: bytes) -> np.ndarray:
    """The ``n`` values that ``encode`` was given."""
    if not n:
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(width)
    bits = np.unpackbits(np.frombuffer(low, np.uint8))[: n * width].reshape(n, width)
    for at in range(width):
        gaps |= bits[:, at].astype(np.uint64) << np.uint64(at)
    return np.cumsum(gaps, dtype=np.uint64)
