"""Hash tables over numpy arrays: many look-ups at once."""

from __future__ import annotations

import numpy as np

from textloom.llm.words import M3


class Table:
    """Open addressing from unsigned 64-bit keys above 0 to 32-bit values."""

    def __init__(self, missing: int = -1, bits: int = 18):
        self.missing, self.used = missing, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return (key * M3 >> np.uint64(64 - (len(self.keys).bit_length() - 1))).astype(np.int64)

    def get(self, key: np.ndarray) -> np.ndarray:
        slot = self._slots(key)
        at = self.keys[slot]
        out = np.where(at == key, self.values[slot], self.missing)
        todo = np.flatnonzero((at != key) & (at != 0))
        mask = len(self.keys) - 1
        while len(todo):
            slot[todo] = (slot[todo] + 1) & mask
            at = self.keys[slot[todo]]
            hit = at == key[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (at != 0)]
        return out

    def put(self, key: np.ndarray, value: np.ndarray) -> None:
        """Adds keys, distinct and not in the table yet."""
        while 2 * (self.used + len(key)) > len(self.keys):
            keys, values = self.keys, self.values
            self.keys, self.values = np.zeros(2 * len(keys), np.uint64), np.zeros(2 * len(keys), np.int32)
            full = keys != 0
            self._insert(keys[full], values[full])
        self._insert(key, value)
        self.used += len(key)

    def _insert(self, key: np.ndarray, value: np.ndarray) -> None:
        slot, mask = self._slots(key), len(self.keys) - 1
        todo = np.arange(len(key))
        while len(todo):
            free = todo[self.keys[slot[todo]] == 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = key[put], value[put]
            done = np.zeros(len(key), bool)
            done[put] = True
            todo = todo[~done[todo]]
            slot[todo] = (slot[todo] + 1) & mask


class Trie:
    """Byte strings as paths of states; ``values`` is what a string stands for, -1 where none ends."""

    START, DEAD = 0, 1

    def __init__(self) -> None:
        self.moves = Table(self.DEAD)
        self.states, self.values = 2, np.full(1 << 17, -1, np.int32)

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next states; DEAD where there is no transition. The start has its own row for keys, and key 0 is empty."""
        return self.moves.get(((state.astype(np.uint64) + np.uint64(1)) << np.uint64(8)) | byte)

    def learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct strings, all of them byte by byte."""
        size = ends - starts
        state = np.zeros(len(starts), np.int64)
        for i in range(int(size.max(initial=0))):
            live = np.flatnonzero(size > i)
            byte = data[starts[live] + i].astype(np.uint64)
            to = self.step(state[live], byte)
            new = np.flatnonzero(to == self.DEAD)
            if len(new):
                key, inverse = np.unique(((state[live[new]].astype(np.uint64) + np.uint64(1)) << np.uint64(8)) | byte[new], return_inverse=True)
                if self.states + len(key) > len(self.values):
                    more = np.full(2 * (self.states + len(key)), -1, np.int32)
                    more[: len(self.values)] = self.values
                    self.values = more
                ids = np.arange(self.states, self.states + len(key), dtype=np.int32)
                self.moves.put(key, ids)
                self.states += len(key)
                to[new] = ids[inverse]
            state[live] = to
        self.values[state] = values
