"""Words of whole texts and hashes of their windows, as arrays over UTF-8 bytes.

A word is a run of bytes other than blank, tab, line feed, vertical tab, form feed and carriage
return. Hashes of words up to ``SHORT`` bytes are polynomials modulo 2**64 with random values per byte, mixed
at the end. Long words can be made to collide under any polynomial modulo a power of two
(Thue-Morse words), so those are hashed by XXH64.
"""

from __future__ import annotations

import numpy as np
import xxhash

from driftwell.llm.memory import spread

#: Such words of this length agree in 20 bits of 64 at most, before mixing.
SHORT = 32

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over all 64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rehash_long(h: np.ndarray, data: np.ndarray, starts: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """``h`` with a hash of another family for words of more than ``SHORT`` bytes."""
    for i in np.flatnonzero(size > SHORT):
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + size[i]].tobytes(), seed)
    return h


class Hash:
    def __init__(self, seed: int):
        self.seed = seed
        draw = np.random.default_rng(seed)
        self.of_byte = draw.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.of_byte[SPACE] = 0
        self.base, self.step = (draw.integers(0, 2**62, 2, dtype=np.uint64) * np.uint64(4) + np.uint64(5)).tolist()

    def powers(self, base: int, n: int) -> np.ndarray:
        return np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(max(0, n - 1), base, dtype=np.uint64)]))

    def words(self, data: np.ndarray, place: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """``place``: of each byte in its word; ``starts``: of words."""
        if not len(starts):
            return np.zeros(0, dtype=np.uint64)
        powers, near = self.powers(self.base, SHORT), np.minimum(place, SHORT - 1).astype(np.uint8)
        h = mix(np.add.reduceat(self.of_byte[data] * powers[near], starts))
        return rehash_long(h, data, starts, np.maximum.reduceat(place, starts) + 1, self.seed)

    def windows(self, words: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros(len(first), dtype=np.uint64)
        for j, factor in enumerate(self.powers(self.step, width)):
            out += words[first + j] * factor
        return mix(out)


FIRST, SECOND = Hash(1), Hash(2)


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin among all bytes, and the number of words of each text."""
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[:-1][np.diff(offsets) > 0]  # no word goes on from one text to the next
    begins[edge] = inside[edge]
    starts = np.flatnonzero(begins)
    return starts, np.diff(np.searchsorted(starts, offsets))


def word_hashes(data: np.ndarray, starts: np.ndarray, hashes: tuple[Hash, ...]) -> list[np.ndarray]:
    mark = np.zeros(len(data), dtype=np.int64)
    mark[starts] = starts
    place = np.arange(len(data)) - np.maximum.accumulate(mark) if len(starts) else mark
    place[SPACE[data]] = 0
    return [h.words(data, place, starts) for h in hashes]


def window_hashes(data: np.ndarray, offsets: np.ndarray, width: int, hashes: tuple[Hash, ...] = (FIRST, SECOND)) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Number of words of each text, number of windows of each text, hashes of all windows in turn."""
    starts, n_words = find_words(data, offsets)
    n_windows = np.maximum(n_words - width + 1, 0)
    first = spread(np.cumsum(n_words) - n_words, n_windows)
    return n_words, n_windows, [h.windows(w, first, width) for h, w in zip(hashes, word_hashes(data, starts, hashes))]
