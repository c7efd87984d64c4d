"""Hashed words and word shingles of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Multipliers and shifts of the 64-bit mixing step.
_MIX = (U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))
_STEP, _BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * _MIX[0]
    x = (x ^ (x >> U(27))) * _MIX[1]
    return x ^ (x >> U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers that depend on seed only."""
    at = [((seed * 1_000_003 + i + 1) * _STEP) & (2**64 - 1) for i in range(n)]
    return mix(np.array(at, np.uint64)) | U(1)


_BYTE = constants(256, 1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n of each at least."""
    if len(_powers[0]) < n:
        for i, x in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            held = np.full(n + n // 4, x, np.uint64)
            held[0] = 1
            _powers[i] = np.cumprod(held)
    return _powers


def word_hashes(held: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased), and where each text's words begin (n + 1 places)."""
    n = len(held)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(at), np.int64)
    space = _SPACE[held]
    inner = ~space
    start = inner.copy()
    start[1:] &= space[:-1]
    begins = at[:-1][at[:-1] < n]
    start[begins] = inner[begins]  # texts touch each other
    stop = inner.copy()
    stop[:-1] &= space[1:]
    ends = at[1:][at[1:] > 0] - 1
    stop[ends] = inner[ends]
    a, b = np.flatnonzero(start), np.flatnonzero(stop) + 1
    power, inverse = _grown(n + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[held] * power[:n])])
    words = mix((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64) * U(_STEP))
    return words, np.searchsorted(a, at)


_PLACE, _WHOLE = constants(8, 2), constants(1, 3)[0]


def shingle_sets(held: np.ndarray, at: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Each text's set of hashed k-word shingles, sorted; of fewer words, the whole sequence is one."""
    words, begins = word_hashes(held, at)
    n = max(0, len(words) - k + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(k):
        rolled += words[j : j + n] * _PLACE[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            out.append(mix((words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.array([b - a], np.uint64) * _WHOLE))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_key(held: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the set alone, as two signed integers."""
    a, b = mix(held ^ U(_STEP)).sum(dtype=np.uint64), mix(held + U(_BASE)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))
