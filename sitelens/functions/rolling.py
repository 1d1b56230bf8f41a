"""Fingerprints of all windows of a fixed length of byte strings, by prefix sums of a polynomial modulo 2**64."""

from __future__ import annotations

import numpy as np

_BASE = 0xD1342543DE82EF95
_BACK = pow(_BASE, -1, 1 << 64)
_kept: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_kept.get(base, ())) < n:
        factors = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        factors[0] = 1
        _kept[base] = np.multiply.accumulate(factors)
    return _kept[base][:n]


def windows(data: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """For each length the 64-bit fingerprint of the window that begins at each byte, as far as windows fit."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=sums[1:])
    back, out = _powers(_BACK, len(data)), {}
    for n in lengths:
        fit = max(0, len(data) - n + 1)
        h = (sums[n : n + fit] - sums[:fit]) * back[:fit] + np.uint64(n)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        out[n] = h ^ (h >> np.uint64(29))
    return out
