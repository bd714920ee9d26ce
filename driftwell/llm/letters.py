"""Lower-cased letters of whole texts as code points, and hashes over them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def letters(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each with a gap before and after; 0 stands for any run of other
    characters. And where each text begins (one more entry at the end); null reads as empty."""
    raw = ["\0" + (t or "").lower() + "\0" for t in texts]
    codes = np.frombuffer("".join(raw).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    real = letter_table()[codes]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    keep = real.copy()
    keep[0] = True
    keep[1:] |= ~real[1:] & real[:-1]  # the first of a run of others
    keep[bounds[:-1]] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    return np.where(real, codes, 0)[keep].astype(np.uint64), at[bounds]


def bucket(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - bits)).astype(np.int64)


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n code points from each place on."""
    h = np.full(max(0, len(codes) - n + 1), n, dtype=np.uint64)
    for k in range(n):
        h = h * np.uint64(0x100000001B3) + codes[k : len(codes) - n + 1 + k]
    return h


def word_starts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin, and their lengths."""
    inside = codes > 0
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begins = np.flatnonzero(edge == 1)
    return begins, np.flatnonzero(edge == -1) - begins


def word_hashes(codes: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    if not len(begins):
        return np.zeros(0, dtype=np.uint64)
    place = np.arange(len(codes)) - np.repeat(np.concatenate([[0], begins]), np.diff(np.concatenate([[0], begins, [len(codes)]])))
    powers = np.cumprod(np.full(int(lengths.max()) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))
    return np.add.reduceat(codes * powers[np.minimum(place, len(powers) - 1)], begins)
