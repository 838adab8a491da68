"""Hashed features of a text, for the linear models."""

from __future__ import annotations

import re
import zlib

import numpy as np

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
#: Tokens a worker remembers the hashes of; beyond it starts anew.
REMEMBERED = 1 << 19
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _shape(token: str) -> str:
    if token.isdigit():
        return "9"
    if not token[0].isalnum():
        return token[:2]
    return "X" if len(token) > 1 and token.isupper() else "Xx" if token[0].isupper() else "x"


class Hasher:
    """Hashed word n-grams of a text: words, word pairs, word shapes and pairs of shapes, each in 2**bits buckets."""

    def __init__(self, bits: int, pairs: bool = True) -> None:
        self.shift, self.pairs = np.uint64(64 - bits), pairs
        self.seen: dict[str, tuple[int, int]] = {}

    def _numbers(self, token: str) -> tuple[int, int]:
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        low = zlib.crc32(token.lower().encode("utf-8", "surrogatepass"))
        both = self.seen[token] = low, zlib.crc32(_shape(token).encode("utf-8", "surrogatepass")) ^ 0x5BD1E995
        return both

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Buckets in ascending order and how often each occurs."""
        get, number = self.seen.get, self._numbers
        both = np.array([get(t) or number(t) for t in _TOKEN.findall(text or "")], np.uint64).reshape(-1, 2)
        parts = [both[:, 0] + np.uint64(1)]
        if self.pairs:
            parts += [both[:, 1] << np.uint64(1), (both[:-1, 0] * np.uint64(31) + both[1:, 0]) ^ np.uint64(1 << 40),
                      (both[:-1, 1] * np.uint64(37) + both[1:, 1]) ^ np.uint64(1 << 41)]
        return np.unique(((np.concatenate(parts) * _MIX) >> self.shift).astype(np.int64), return_counts=True)
