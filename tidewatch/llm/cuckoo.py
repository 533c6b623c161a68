"""A cuckoo filter over 64-bit hashes, with numpy: membership with deletion in two bytes or so a key."""

from __future__ import annotations

import numpy as np

SLOTS = 4
_KICKS = 500


class Full(Exception):
    """No place was found; the filter must be made anew, larger."""


class Cuckoo:
    """Each key has a 16-bit print in one of two buckets of four slots.

    A key that was added is always found; another is found by chance about once in
    8,000. Adding the same hash twice holds two prints, deleting one removes one.
    """

    def __init__(self, cells: np.ndarray):
        self.cells = cells

    @classmethod
    def for_keys(cls, count: int) -> Cuckoo:
        buckets = 1 << max(4, int(np.ceil(np.log2(max(count, 1) / SLOTS / 0.75))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def filled(cls, hashes: np.ndarray) -> Cuckoo:
        size = len(hashes)
        while True:
            made = cls.for_keys(size)
            try:
                made.add(hashes)
                return made
            except Full:
                size = 2 * max(size, 8)

    @classmethod
    def from_bytes(cls, data: bytes) -> Cuckoo:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.cells.tobytes()

    def _other(self, bucket, mark):
        return bucket ^ (mark.astype(np.uint64) * np.uint64(0x5BD1E995) & np.uint64(len(self.cells) - 1))

    def _places(self, hashes: np.ndarray):
        mark = (hashes >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        first = hashes & np.uint64(len(self.cells) - 1)
        return mark, first, self._other(first, mark)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(hashes)
        return (self.cells[a] == mark[:, None]).any(1) | (self.cells[b] == mark[:, None]).any(1)

    def add(self, hashes: np.ndarray) -> None:
        """Add all; raises Full when one finds no place (the filter is then no longer whole)."""
        mark, a, b = self._places(hashes)
        for second in (False, True):
            order = np.argsort(b if second else a, kind="stable")
            mark, a, b = mark[order], a[order], b[order]
            bucket = b if second else a
            rank = np.arange(len(bucket)) - np.searchsorted(bucket, bucket)
            taken = self.cells[bucket] != 0
            fits = rank < SLOTS - taken.sum(1)
            slot = np.argsort(taken, axis=1, kind="stable")
            self.cells[bucket[fits], slot[fits, rank[fits]]] = mark[fits]
            mark, a, b = mark[~fits], a[~fits], b[~fits]
        for m, bucket in zip(mark, b):
            self._push(m, bucket)

    def _push(self, mark, bucket) -> None:
        for turn in range(_KICKS):
            cell = self.cells[bucket]
            free = np.flatnonzero(cell == 0)
            if len(free):
                cell[free[0]] = mark
                return
            slot = turn % SLOTS
            mark, cell[slot] = cell[slot], mark
            bucket = self._other(bucket, mark)
        raise Full

    def remove(self, hashes: np.ndarray) -> None:
        """Remove one print of each hash; only hashes that were added may be given."""
        for mark, a, b in zip(*self._places(hashes)):
            for bucket in (a, b):
                at = np.flatnonzero(self.cells[bucket] == mark)
                if len(at):
                    self.cells[bucket, at[0]] = 0
                    break
