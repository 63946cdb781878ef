"""Numbers of short byte strings, looked up many at once.

Strings of up to 15 bytes are two machine words: their bytes, and their length in the last
byte. A table with open addressing keeps them; equality is that of the bytes themselves.
Longer strings are kept in a dictionary.
"""

from __future__ import annotations

import numpy as np

WIDTH = 15
EMPTY = -1
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def words_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Two machine words for each string of at most WIDTH bytes; ``data`` has 16 bytes to spare at its end."""
    at_byte = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    out = np.empty((len(starts), 2), np.uint64)
    out[:, 0] = at_byte[starts] & _KEEP[np.minimum(sizes, 8)]
    out[:, 1] = (at_byte[starts + 8] & _KEEP[np.maximum(sizes - 8, 0)]) | (sizes.astype(np.uint64) << np.uint64(56))
    return out


class PieceTable:
    """Strings and their numbers, in the order in which they were added."""

    def __init__(self):
        self.size, self.held = 0, 0
        self.long: dict[bytes, int] = {}
        self._clear(1 << 16)

    def _clear(self, slots: int) -> None:
        self.shift, self.mask = np.uint64(64 - (slots.bit_length() - 1)), slots - 1
        self.keys = np.zeros((slots, 2), np.uint64)
        self.numbers = np.full(slots, EMPTY, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys[:, 0] * _MIX[0]) ^ (keys[:, 1] * _MIX[1])
        mixed ^= mixed >> np.uint64(32)
        return ((mixed * _MIX[0]) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, EMPTY if it is not there."""
        slot, todo = self._slots(keys), np.arange(len(keys))
        out = np.empty(len(keys), np.int32)
        while len(todo):
            out[todo] = found = self.numbers[slot]
            other = self.keys[slot]
            more = (found != EMPTY) & ((other[:, 0] != keys[todo, 0]) | (other[:, 1] != keys[todo, 1]))
            todo, slot = todo[more], (slot[more] + 1) & self.mask
        return out

    def _place(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        slot, todo = self._slots(keys), np.arange(len(keys))
        while len(todo):
            placed = np.zeros(len(todo), bool)
            placed[np.unique(slot, return_index=True)[1]] = True  # one key to a slot
            placed &= self.numbers[slot] == EMPTY
            self.keys[slot[placed]] = keys[todo[placed]]
            self.numbers[slot[placed]] = numbers[todo[placed]]
            todo, slot = todo[~placed], (slot[~placed] + 1) & self.mask

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Give numbers to keys that are distinct and not there yet."""
        while 2 * (self.size + len(keys)) > len(self.numbers):  # at most half full
            used = self.numbers != EMPTY
            old = self.keys[used], self.numbers[used]
            self._clear(2 * len(self.numbers))
            self._place(*old)
        numbers = np.arange(self.size, self.size + len(keys), dtype=np.int32)
        self._place(keys, numbers)
        self.size += len(keys)
        return numbers

    def add_long(self, strings: list[bytes]) -> None:
        """Give numbers to strings of more than WIDTH bytes that are distinct and not there yet."""
        self.long.update(zip(strings, range(self.size, self.size + len(strings))))
        self.size += len(strings)
        self.held += sum(map(len, strings))

    def number(self, joined: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """Numbers of the strings between ``starts`` and ``stops``, and those that are new, in the order of their numbers.

        ``joined`` has 16 bytes to spare at its end.
        """
        data, sizes = np.frombuffer(joined, np.uint8), stops - starts
        numbers, added = np.empty(len(starts), np.int32), []
        at = np.flatnonzero(sizes <= WIDTH)
        keys = words_of(data, starts[at], sizes[at])
        found = self.find(keys)
        new = np.flatnonzero(found == EMPTY)
        if len(new):
            _, first, back = np.unique(keys[new].view("V16").ravel(), return_index=True, return_inverse=True)
            found[new] = self.add(keys[new[first]])[back]
            which = at[new[first]]
            added = [joined[a:b] for a, b in zip(starts[which].tolist(), stops[which].tolist())]
        numbers[at] = found
        at = np.flatnonzero(sizes > WIDTH)
        long = [joined[a:b] for a, b in zip(starts[at].tolist(), stops[at].tolist())]
        if new := list(dict.fromkeys(p for p in long if p not in self.long)):
            self.add_long(new)
            added += new
        numbers[at] = np.fromiter(map(self.long.__getitem__, long), np.int32, len(long))
        return numbers, added


def pieces_of(rows: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Rows joined, where their pieces between spaces and line breaks start and stop, and how many pieces end before each row's end."""
    joined = b"\n".join([*rows, bytes(16)])  # a break after every row, and bytes to read past the last
    data = np.frombuffer(joined, np.uint8)
    breaks = np.flatnonzero((data == 32) | (data == 10))
    starts = np.concatenate([[0], breaks[:-1] + 1])
    some = breaks > starts
    starts, stops = starts[some], breaks[some]
    return joined, starts, stops, np.searchsorted(stops, np.cumsum([len(r) + 1 for r in rows]))


def enlarged(values: np.ndarray, size: int) -> np.ndarray:
    """The values in an array of at least ``size`` entries."""
    if size <= len(values):
        return values
    return np.concatenate([values, np.zeros((max(len(values), size - len(values)), *values.shape[1:]), values.dtype)])
