"""Vectorised MinHash signatures of short texts."""

from __future__ import annotations

import numpy as np

_ODD = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = np.uint64(0x100000001B3)


def signatures(texts: list[str], size: int = 5, hashes: int = 2) -> np.ndarray:
    """One 64-bit signature for each text: ``hashes`` MinHash values over its character ``size``-grams, combined. Equal texts
    have equal signatures; texts of Jaccard similarity s agree with probability s ** hashes."""
    return banded(texts, 1, hashes, size)[0]


def banded(texts: list[str], bands: int, rows: int, size: int = 5) -> np.ndarray:
    """``bands`` such signatures of ``rows`` MinHash values for each text, one array for each band. Equal texts agree in every
    band; texts of Jaccard similarity s in at least one with probability 1 - (1 - s ** rows) ** bands."""
    out = np.zeros((bands, len(texts)), np.uint64)
    if not texts:
        return out
    pad = "\0" * size  # a text shorter than a gram still has one of its own
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join([t + pad for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    h = np.zeros(len(codes) - size + 1, np.uint64)
    for k in range(size):
        h *= _STEP
        h += codes[k : len(codes) - size + 1 + k]
    starts = np.r_[0, np.cumsum(lengths + size)[:-1]]
    counts = np.maximum(1, lengths - size + 1)
    # keep only the grams within a text
    at = np.repeat(starts - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
    h = h[at]
    begin = np.r_[0, np.cumsum(counts)[:-1]]
    for band in range(bands):
        out[band] = band
        for i in range(band * rows, (band + 1) * rows):
            x = (h + np.uint64(i)) * _ODD[0]
            x ^= x >> np.uint64(29)
            x *= _ODD[1]
            x ^= x >> np.uint64(32)
            out[band] = out[band] * _STEP + np.minimum.reduceat(x, begin)
    return out
