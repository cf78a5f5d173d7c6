"""A compressed full-text index over word numbers: wavelet tree, backward search, matching statistics."""

from __future__ import annotations

import numpy as np

#: Windows that one lane of the lock-step search slides over before a new lane starts.
LANE = 256


class WaveletTree:
    """Rank over a sequence of numbers: one bit vector for each binary digit, highest first.

    A level is stored as packed bits and one running count for every 64 of them. Behind each level
    the values with a zero come first and those with a one after them, each in their order.
    """

    def __init__(self, values: np.ndarray, symbols: int):
        self.depth = max(1, int(symbols - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        for level in range(self.depth - 1, -1, -1):
            bit = ((values >> level) & 1).astype(np.uint8)
            padded = np.zeros((len(bit) // 64 + 1) * 64, dtype=np.uint8)
            padded[:len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.zeros(len(words), dtype=np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=counts[1:])
            self.words.append(words)
            self.counts.append(counts)
            self.zeros.append(len(bit) - int(bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])
        self.base = self.walk(np.zeros(symbols, dtype=np.int64), np.arange(symbols))

    def walk(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for level in range(self.depth):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[level][word] + np.bitwise_count(self.words[level][word] & below)
            bit = (symbol >> (self.depth - 1 - level)) & 1
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before ``at``."""
        return self.walk(at, symbol) - self.base[symbol]


class FMIndex:
    """Index of a text of word numbers, sorted as far as ``depth`` words need.

    0 separates passages. ``owner`` gives a number for each place; ``least`` of a group is the smallest
    owner among the places that start with the same ``depth`` words.
    """

    def __init__(self, text: np.ndarray, owner: np.ndarray, depth: int):
        n, self.text, self.depth = len(text), text, depth
        rank, ranks, step = text.astype(np.int64), {1: text.astype(np.int64)}, 1
        order = np.argsort(rank, kind="stable")
        while step <= depth:  # one word more than depth, for the sliding step
            ahead = np.zeros(n, dtype=np.int64)
            ahead[:n - step] = rank[step:] + 1
            key = rank * (n + 2) + ahead
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
            step *= 2
            ranks[step] = rank
        before = text[order - 1]
        symbols = int(text.max(initial=0)) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.tree = WaveletTree(before.astype(np.int64), symbols)
        change, at, left = np.zeros(n, dtype=bool), 0, depth
        while left:
            step = 1 << (left.bit_length() - 1)
            part = np.full(n, -1, dtype=np.int64)
            part[:max(n - at, 0)] = ranks[step][at:]
            change[1:] |= part[order[1:]] != part[order[:-1]]
            at, left = at + step, left - step
        self.group = np.cumsum(change)
        self.starts = np.concatenate([[0], np.flatnonzero(change), [n]]) if n else np.zeros(1, dtype=np.int64)
        self.least = np.minimum.reduceat(owner[order], self.starts[:-1]) if n else owner

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that start with ``symbol`` and go on like the rows low to high: one backward step."""
        both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        start = self.first[symbol]
        return start + both[:len(low)], start + both[len(low):]

    def statistics(self, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Group of every window of ``depth`` words that starts at ``first``, ..., ``first + count - 1``.

        Places stream from right to left, many ranges in lock step. A range begins with ``depth``
        backward steps. Then each step adds the word on the left and lets the last word go: the
        rows found lie in one group of equal ``depth`` words, which is the next window's interval.
        """
        lanes = -(-count // LANE)
        row = np.repeat(np.arange(len(first)), lanes)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = first[row] + nth * LANE
        size = np.minimum(LANE, count[row] - nth * LANE)
        by = np.argsort(-size, kind="stable")
        start, size = start[by], size[by]
        place = start + size - 1
        low, high = np.zeros(len(place), dtype=np.int64), np.full(len(place), len(self.text), dtype=np.int64)
        for back in range(self.depth - 1, -1, -1):
            low, high = self.extend(low, high, self.text[place + back])
        where, groups = [], []
        for step in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -step, side="left"))
            low, high, place = low[:live], high[:live], start[:live] + size[:live] - 1 - step
            if step:
                low, high = self.extend(low, high, self.text[place])
            group = self.group[low]
            where.append(place)
            groups.append(group)
            low, high = self.starts[group], self.starts[group + 1]
        return (np.concatenate(where), np.concatenate(groups)) if where else (start, start)
