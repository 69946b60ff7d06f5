"""A table from integers to small integers, looked up for whole arrays."""

from __future__ import annotations

import numpy as np

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class IntTable:
    """Open addressing with linear probing; keys are distinct and not negative."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys = np.asarray(keys, np.int64)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys))))) + 2)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.value = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = todo[self.key[slot[todo]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.key[slot[put]], self.value[slot[put]] = keys[put], np.asarray(values)[put]
            todo = todo[self.key[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _FACTOR) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where it has none."""
        slot = self._slot(keys)
        found = self.key[slot]
        out = np.where(found == keys, self.value[slot], -1)
        rest = np.flatnonzero((found != keys) & (found >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self.mask
            found = self.key[slot[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.value[slot[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        return out
