"""Frequent keys of a stream in bounded room."""

from __future__ import annotations

import numpy as np


class Frequent:
    """The frequent ones among many keys, in bounded room (Misra-Gries over blocks of keys)."""

    def __init__(self, room: int = 1 << 16):
        self.room, self.keys, self.counts, self.lost = room, np.zeros(0, np.uint64), np.zeros(0, np.int64), 0

    def add(self, keys):
        distinct, counts = np.unique(keys, return_counts=True)
        more = counts > 1
        self.lost += 1
        merged, which = np.unique(np.concatenate([self.keys, distinct[more]]), return_inverse=True)
        total = np.bincount(which, np.concatenate([self.counts, counts[more]]), len(merged)).astype(np.int64)
        if len(merged) > self.room:
            less = np.partition(total, len(total) - self.room)[len(total) - self.room]
            merged, total, self.lost = merged[total > less], total[total > less] - less, self.lost + int(less)
        self.keys, self.counts = merged, total

    def above(self, least: float):
        found = self.counts + self.lost >= max(least, self.lost + 1)
        return self.keys[found], self.counts[found]
