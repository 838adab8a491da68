"""Truncated path signatures of one bounded window."""

from __future__ import annotations

from itertools import product

import numpy as np


def signature(path: np.ndarray, depth: int) -> list[np.ndarray]:
    """Levels 1 .. depth of the signature of a path (time, channel)."""
    d = path.shape[1]
    levels = [np.zeros(d ** k) for k in range(1, depth + 1)]
    for dx in np.diff(path, axis=0):
        power = [np.ones(1)]
        for k in range(1, depth + 1):
            power.append(np.kron(power[-1], dx) / k)
        old = [np.ones(1), *levels]
        levels = [sum(np.kron(old[j], power[k - j]) for j in range(k + 1)) for k in range(1, depth + 1)]
    return levels


def logarithm(levels: list[np.ndarray]) -> list[np.ndarray]:
    """Tensor logarithm of 1 + levels."""
    depth = len(levels)
    out = [np.zeros_like(v) for v in levels]
    power = [v.copy() for v in levels]
    for n in range(1, depth + 1):
        sign = (1 if n % 2 else -1) / n
        out = [o + sign * p for o, p in zip(out, power)]
        nxt = [np.zeros_like(v) for v in levels]
        for a in range(1, depth + 1):
            for b in range(1, depth + 1 - a):
                nxt[a + b - 1] += np.kron(power[a - 1], levels[b - 1])
        power = nxt
    return out


def lyndon_words(d: int, depth: int) -> list[tuple[int, ...]]:
    """Words that are smaller than all of their proper rotations, by length, then in order."""
    words = []
    for n in range(1, depth + 1):
        for w in product(range(d), repeat=n):
            if all(w < w[k:] + w[:k] for k in range(1, n)):
                words.append(w)
    return words


def log_signature(path: np.ndarray, depth: int) -> np.ndarray:
    """Log-signature at the Lyndon words."""
    d = path.shape[1]
    logs = logarithm(signature(path, depth))
    place = lambda w: sum(c * d ** (len(w) - 1 - k) for k, c in enumerate(w))
    return np.array([logs[len(w) - 1][place(w)] for w in lyndon_words(d, depth)])


def with_time(path: np.ndarray) -> np.ndarray:
    """Path with a first channel running from 0 to 1."""
    return np.column_stack([np.linspace(0, 1, len(path)), path])
