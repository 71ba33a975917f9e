"""Windows of words in Arrow batches: texts as arrays of 64-bit word hashes, one behind another.

A pad stands behind each text. Word hashes are odd and pads even, so that no run of equal words goes beyond its text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def padded(words: pa.Array, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all texts, where each text begins and how many words it has. A null text has none."""
    n = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(n + 1) - n - 1
    w = np.full(n.sum() + len(n), pad, np.uint64)
    hashes = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    w[np.arange(len(hashes)) + np.repeat(np.arange(len(n)), n)] = hashes | np.uint64(1)
    return w, starts, n


def places(starts: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each window of ``size`` words begins, and its text. Texts under ``size`` words have none."""
    k = np.maximum(n - size + 1, 0)
    text = np.repeat(np.arange(len(n)), k)
    return np.arange(len(text)) - np.repeat(np.cumsum(k) - k, k) + starts[text], text


def digests(w: np.ndarray, at: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the ``size`` words from each place on; another one for another seed."""
    by = _SEEDS[seed % 2] + np.uint64(seed // 2 * 2)
    last = max(len(w) - size + 1, 0)
    h = np.full(last, seed, np.uint64)
    for i in range(size):
        h = (h ^ w[i : i + last]) * by
        h ^= h >> np.uint64(29)
    return (h * by)[at]
