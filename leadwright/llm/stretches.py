"""Ids of stretches of text, remembered by hash, for encoders that work on each stretch alone."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from leadwright.llm.grams import BASES, VALUES, mixed, powers

#: Stretches that a worker process remembers, about 60 bytes each, and bytes of the longest that it does.
ROOM, LONGEST = 1 << 19, 64
#: Bytes that are hashed at once.
AT_ONCE = 1 << 18
#: What tells the first stretch of a text from one with the same bytes further on.
HEAD = np.uint64(0x8F1BBCDC5A827999)


class StretchTable:
    """Stretches of bytes and their ids, found by two independent 64-bit hashes, in flat arrays.

    encode gets the stretches that are not remembered, and which of them begin a text, and returns the ids of each as
    bytes of int32. What has no room is encoded again when it is met again. Texts of any length are hashed in parts of
    AT_ONCE bytes, or of one stretch where that is longer.
    """

    def __init__(self, encode: Callable[[list[bytes], list[bool]], list[bytes]], room: int = ROOM):
        self.encode, self.room = encode, room
        self.mask = np.uint64(2 * room - 1)
        self.slots = np.full(2 * room, -1, np.int32)
        self.first, self.second = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)
        self.start, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.pool = np.zeros(4096, np.int32)
        self.count = self.used = 0  # entries, and ids in the pool
        with np.errstate(over="ignore"):
            self.powers = [powers(base, AT_ONCE) for base in BASES]
            self.back = [powers(np.uint64(pow(int(base), -1, 1 << 64)), AT_ONCE) for base in BASES]

    def hashes(self, data: np.ndarray, start: np.ndarray, which: int) -> np.ndarray:
        """The hash of each stretch; a stretch ends where the next starts."""
        n = len(data)
        up, back = self.powers[which], self.back[which]
        with np.errstate(over="ignore"):
            if n > len(up):
                up, back = powers(BASES[which], n), powers(np.uint64(pow(int(BASES[which]), -1, 1 << 64)), n)
            sums = np.add.reduceat(VALUES[which][data] * up[:n], start)
            return mixed(sums * back[start])

    def _find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The entry of each pair of hashes, or -1."""
        entry = self.slots[(first & self.mask).astype(np.int64)]
        entry[(entry < 0) | (self.first[entry] != first) | (self.second[entry] != second)] = -1
        some = np.flatnonzero(entry < 0)
        other = self.slots[((first[some] >> np.uint64(32)) & self.mask).astype(np.int64)]
        other[(other < 0) | (self.first[other] != first[some]) | (self.second[other] != second[some])] = -1
        entry[some] = other
        return entry

    def _add(self, first: np.ndarray, second: np.ndarray, ids: list[bytes], short: np.ndarray) -> np.ndarray:
        """New entries; the short ones are put into free slots while there is room."""
        sizes = np.array([len(x) // 4 for x in ids], np.int32)
        flat = np.frombuffer(b"".join(ids), np.int32)
        n, used = self.count + len(first), self.used + len(flat)
        for name in ("first", "second", "start", "size"):
            if n > len(getattr(self, name)):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros(n, getattr(self, name).dtype)]))
        if used > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(used, np.int32)])
        entry = np.arange(self.count, n, dtype=np.int32)
        self.first[entry], self.second[entry], self.size[entry] = first, second, sizes
        self.start[entry] = self.used + np.cumsum(sizes, dtype=np.int64) - sizes
        self.pool[self.used : used] = flat
        self.count, self.used = n, used
        if n <= self.room:
            left = np.flatnonzero(short)
            for shift in (0, 32):
                slot = ((first[left] >> np.uint64(shift)) & self.mask).astype(np.int64)
                free = np.flatnonzero(self.slots[slot] < 0)
                _, one = np.unique(slot[free], return_index=True)
                self.slots[slot[free[one]]] = entry[left[free[one]]]
                left = np.delete(left, free[one])
        return entry

    def entries(self, data: np.ndarray, start: np.ndarray, head: np.ndarray) -> np.ndarray:
        """The entry of each stretch of these bytes; they hold until forget()."""
        out = np.empty(len(start), np.int64)
        ends = np.append(start[1:], len(data))
        at = 0
        while at < len(start):
            to = max(at + 1, int(np.searchsorted(ends, start[at] + AT_ONCE, "right")))
            out[at:to] = self._entries(data[start[at] : ends[to - 1]], start[at:to] - start[at], head[at:to])
            at = to
        return out

    def _entries(self, data: np.ndarray, start: np.ndarray, head: np.ndarray) -> np.ndarray:
        first, second = self.hashes(data, start, 0), self.hashes(data, start, 1)
        first = np.where(head, first ^ HEAD, first)
        entry = self._find(first, second).astype(np.int64)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            _, one, inverse = np.unique(first[missing], return_index=True, return_inverse=True)
            alike = second[missing[one]][inverse] == second[missing]
            if not alike.all():  # one hash of two stretches: each stands for itself
                one, inverse = np.arange(len(missing)), np.arange(len(missing))
            new = missing[one]
            ends = np.append(start[1:], len(data))
            raw = data.tobytes()
            ids = self.encode([raw[a:b] for a, b in zip(start[new].tolist(), ends[new].tolist())], head[new].tolist())
            entry[missing] = self._add(first[new], second[new], ids, ends[new] - start[new] <= LONGEST)[inverse]
        return entry

    def ids(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the entries in turn, and how many each has."""
        sizes = self.size[entries].astype(np.int64)
        upto = np.cumsum(sizes)
        at = np.repeat(self.start[entries] - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)
        return self.pool[at], sizes

    def forget(self, mark: tuple[int, int]) -> None:
        """Drop the entries that were added since mark() if there is no room for them; call it between batches."""
        if self.count > self.room:
            self.slots[self.slots >= mark[0]] = -1
            self.count, self.used = mark

    def mark(self) -> tuple[int, int]:
        return self.count, self.used
