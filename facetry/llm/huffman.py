"""Canonical length-limited Huffman codes: bits of many symbols at once, with numpy.

Codes are canonical, so the lengths alone describe them. A block of ``BLOCK`` symbols
starts at a checkpoint, the offset of its first bit; blocks decode independently, all
at the same time, one table look-up per symbol.
"""

from __future__ import annotations

import numpy as np

BLOCK = 256


def limit_for(symbols: int) -> int:
    """Longest code allowed: two bits more than equal codes need, at least 12."""
    return max(12, int(max(symbols - 1, 1)).bit_length() + 2)


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal lengths of at most ``limit`` bits for positive counts (package-merge)."""
    n = len(counts)
    if n == 0:
        return np.zeros(0, np.int64)
    if n == 1:
        return np.ones(1, np.int64)
    if n > 2**limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = np.asarray(counts, np.float64)[order]
    merged, is_leaf = leaves, np.ones(n, bool)
    levels = [is_leaf]
    for _ in range(limit - 1):
        m = len(merged) // 2 * 2
        packages = merged[0:m:2] + merged[1:m:2]
        both = np.concatenate([leaves, packages])
        rank = np.argsort(both, kind="stable")
        merged, is_leaf = both[rank], rank < n
        levels.append(is_leaf)
    # Walk back: the cheapest 2n - 2 entries of the last level; each package taken takes two of the level before.
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        chosen = int(is_leaf[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """A code over ids ``0 ..``; ``lengths[i]`` is 0 for ids that have none."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.int64)
        used = np.flatnonzero(self.lengths)
        used = used[np.argsort(self.lengths[used], kind="stable")]
        self.width = int(self.lengths.max(initial=1))
        span = np.int64(1) << (self.width - self.lengths[used])
        first = np.concatenate([[0], np.cumsum(span)])
        if first[-1] > 1 << self.width:
            raise ValueError("the lengths are no prefix code")
        self.codes = np.zeros(len(self.lengths), np.uint64)
        self.codes[used] = (first[:-1] >> (self.width - self.lengths[used])).astype(np.uint64)
        self.table = np.ones(1 << self.width, np.int64)  # unused bit patterns move on by one bit
        self.table[: first[-1]] = np.repeat((used << 8) | self.lengths[used], span)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bits of the ids, and the bit offset of every ``BLOCK``-th of them."""
        size = self.lengths[ids]
        if len(ids) and size.min() == 0:
            raise ValueError("an id without a code")
        end = np.cumsum(size)
        at = end - size
        bits = int(end[-1]) if len(ids) else 0
        words = np.zeros(bits // 64 + 2, np.uint64)
        if bits:
            code, word = self.codes[ids], at >> 6
            shift = 64 - (at & 63) - size
            over = shift < 0
            high = np.where(over, code >> np.maximum(-shift, 0).astype(np.uint64), code << np.maximum(shift, 0).astype(np.uint64))
            last = np.flatnonzero(np.append(word[1:] != word[:-1], True))
            sums = np.cumsum(high)  # bits of a word are disjoint, so their sum is their union; it wraps around
            words[word[last]] = np.diff(sums[last], prepend=np.uint64(0))
            spill = np.flatnonzero(over)
            words[word[spill] + 1] |= code[spill] << (64 + shift[spill]).astype(np.uint64)
        return words.astype(">u8").tobytes()[: (bits + 7) // 8], at[::BLOCK]

    def decode(self, data: list[bytes], offsets: list[np.ndarray], counts: list[int]) -> np.ndarray:
        """The ids of several encoded runs, one after the other."""
        starts, parts, lanes, base = [], [], [], 0
        for run, offset, n in zip(data, offsets, counts):
            blocks = -(-n // BLOCK)
            starts.append(np.asarray(offset[:blocks], np.int64) + base * 8)
            sizes = np.full(blocks, BLOCK, np.int64)
            if blocks:
                sizes[-1] = n - BLOCK * (blocks - 1)
            lanes.append(sizes)
            parts.append(run)
            base += len(run)
        at, sizes = np.concatenate(starts or [np.zeros(0, np.int64)]), np.concatenate(lanes or [np.zeros(0, np.int64)])
        raw = b"".join(parts)
        pad = BLOCK * self.width // 8 + 24
        words = np.frombuffer(raw + bytes(pad + (-len(raw) - pad) % 8), ">u8").astype(np.uint64)
        out = np.empty((BLOCK, len(at)), np.int64)
        top, one = np.uint64(64 - self.width), np.uint64(1)
        for step in range(int(sizes.max(initial=0))):
            word, s = at >> 6, (at & 63).astype(np.uint64)
            seen = ((words[word] << s) | ((words[word + 1] >> one) >> (np.uint64(63) - s))) >> top
            entry = self.table[seen.astype(np.int64)]
            out[step] = entry >> 8
            at = at + (entry & 255)
        return out.T[np.arange(BLOCK)[None, :] < sizes[:, None]]
