"""Encodings of strings that a Python worker has met already, within a bound."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Strings and ids kept by a worker. The strings met first stay, so frequent ones do.
KEPT, KEPT_IDS = 400_000, 8 << 20

Encode = Callable[[list], tuple[np.ndarray, np.ndarray]]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...`` for ``lengths[i]`` places, for each i in turn."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class Memory(dict):
    """Numbers strings as they come up. ``encode`` turns a list of new strings into all their ids
    in turn and the number of ids of each. ``kept`` lowers the bound of strings."""

    def __init__(self, encode: Encode, odd: Callable[[str], bool] | None = None, kept: int | None = None):
        super().__init__()
        self.encode, self.odd, self.met_odd, self.kept = encode, odd, False, kept
        self.new: list = []
        self.settled = 0
        self.ids, self.counts, self.starts = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def __missing__(self, key) -> int:
        if self.odd and self.odd(key):
            self.met_odd = True
            return -1
        return self.add(key)

    def add(self, key) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n

    def get_counts(self, numbers: np.ndarray) -> np.ndarray:
        """How many ids each of the numbered strings has. New strings are encoded together, so
        ask for many at a time."""
        if fresh := self.new[self.settled :]:
            ids, counts = self.encode(fresh)
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
            self.starts = np.cumsum(self.counts) - self.counts
            self.settled = len(self.new)
        return self.counts[numbers]

    def get_ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the numbered strings in turn, and how many each has."""
        size = self.get_counts(numbers)
        return self.ids[spread(self.starts[numbers], size)], size

    def end_step(self) -> None:
        """Numbers given since the last step are no longer needed: drop what is beyond the bound."""
        if len(self) > min(KEPT, self.kept or KEPT) or len(self.ids) > KEPT_IDS:
            for key in self.new:
                del self[key]
            n = len(self)
            self.ids, self.counts, self.starts = self.ids[: int(self.counts[:n].sum())], self.counts[:n], self.starts[:n]
        self.new, self.settled, self.met_odd = [], 0, False
