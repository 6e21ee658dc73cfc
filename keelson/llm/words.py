"""Vectorised views of text batches: code points, words and hashes of parts of words.

Everything works on whole texts; a batch is cut into slices between texts only.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd; so it has an inverse modulo 2**64
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point whether it is a letter (a surrogate is not)."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1)
def word_chars() -> np.ndarray:
    """For each code point whether it is a letter or a digit."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    return np.random.default_rng(5).integers(1, 2**63, 1 << 16, dtype=np.int64).astype(np.uint64)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        grow = lambda b: np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, b, np.uint64))])
        return grow(BASE), grow(INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class Words:
    """The words (runs of letters, or of letters and digits) of a column of texts, lower case.

    chars: code points of all texts; start, end: of each word in chars; doc: its text's
    index; n: the number of texts. Null texts have no words.
    """

    def __init__(self, texts: pa.Array, digits: bool = False):
        low = [(t or "").lower() for t in texts.to_pylist()]
        self.n = len(low)
        self.chars = np.frombuffer("\n".join(low).encode("utf-32-le", "replace"), np.uint32)
        self.first = np.cumsum([0] + [len(t) + 1 for t in low])[:-1]
        inside = np.zeros(len(self.chars) + 2, np.int8)
        inside[1:-1] = (word_chars() if digits else letters())[self.chars]
        step = np.diff(inside)
        self.start, self.end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.doc = np.searchsorted(self.first, self.start, side="right") - 1
        self.sums: np.ndarray | None = None

    def hashes(self, prefix: int | None = None) -> np.ndarray:
        """64-bit hashes of the words, or of their first letters."""
        grow, shrink = _powers(1 << max(12, len(self.chars).bit_length()))
        with np.errstate(over="ignore"):
            if self.sums is None:
                codes = _codes()[self.chars & 0xFFFF] + (self.chars >> 16).astype(np.uint64)
                self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * grow[: len(self.chars)], dtype=np.uint64)])
            end = self.end if prefix is None else np.minimum(self.end, self.start + prefix)
            return mix((self.sums[end] - self.sums[self.start]) * shrink[self.start])
