"""An open-addressing table of 64-bit keys in numpy, for bulk lookups inside tasks."""

from __future__ import annotations

import numpy as np

from .shingles import mix64


class HashTable:
    """Distinct non-zero uint64 keys; ``find`` gives their places in ``keys`` as passed, or -1."""

    def __init__(self, keys: np.ndarray):
        keys = keys.astype(np.uint64)
        size = 16
        while size < 2 * len(keys):
            size *= 2
        self.mask = np.uint64(size - 1)
        self.slots = np.zeros(size, np.uint64)
        self.where = np.full(size, -1, np.int32)
        todo, at = np.arange(len(keys)), (mix64(keys) & self.mask).astype(np.int64)
        while len(todo):
            free = self.slots[at] == 0
            _, first = np.unique(at[free], return_index=True)
            took = np.flatnonzero(free)[first]
            self.slots[at[took]], self.where[at[took]] = keys[todo[took]], todo[took]
            left = np.ones(len(todo), bool)
            left[took] = False
            todo, at = todo[left], (at[left] + 1) & (size - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = (mix64(keys) & self.mask).astype(np.int64)
        held = self.slots[at]
        out = np.where(held == keys, self.where[at], -1)
        todo = np.flatnonzero((held != keys) & (held != 0))
        at = at[todo]
        while len(todo):
            at = (at + 1) & int(self.mask)
            held = self.slots[at]
            hit = held == keys[todo]
            out[todo[hit]] = self.where[at[hit]]
            go = ~hit & (held != 0)
            todo, at = todo[go], at[go]
        return out
