"""Vectorised hashes of words and byte strings, by prefix sums of a polynomial modulo 2^64."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 … base^(n-1) at least; kept and grown by doubling."""
    held = _POWERS.get(int(base), np.ones(1, np.uint64))
    while len(held) < n:
        held = np.concatenate([held, held * held[-1] * base])
    _POWERS[int(base)] = held
    return held


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of (byte + 1) · BASE^position, with a zero before the first."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data))[: len(data)], out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: equal values stay equal, near ones part."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each pair; it depends on the bytes alone, not on where they stand."""
    return mix((sums[end] - sums[start]) * powers(INVERSE, len(sums))[start])
