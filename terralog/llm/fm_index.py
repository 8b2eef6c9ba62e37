"""A compressed full-text index over word sequences: backward search on a wavelet matrix of the Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np


class Planes:
    """Wavelet matrix of small whole numbers: bit-planes in 64-bit words, each with the ones before every word."""

    def __init__(self, values: np.ndarray):
        self.n, self.size = len(values), int(values.max(initial=0)) + 1
        self.levels = max(1, (self.size - 1).bit_length())
        self.bits, self.before, self.zeros = [], [], []
        for level in reversed(range(self.levels)):
            bit = (values >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            word = np.pad(packed, (0, 8 - len(packed) % 8)).view("<u8")
            ones = np.bitwise_count(word).astype(np.int32)
            self.bits.append(word)
            self.before.append(np.r_[np.int32(0), np.cumsum(ones[:-1], dtype=np.int32)])
            self.zeros.append(self.n - int(ones.sum()))
            values = np.concatenate([values[~bit], values[bit]])
        self.first = self._narrow(np.arange(self.size), np.zeros(self.size, np.int64))

    def _narrow(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where place ``at`` of the sequence comes to lie behind the planes, for the part of each ``value``."""
        for k in range(self.levels):
            word = at >> 6
            ones = self.before[k][word] + np.bitwise_count(self.bits[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(value >> (self.levels - 1 - k) & 1, self.zeros[k] + ones, at - ones)
        return at

    def ranks(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each ``value`` occurs before place ``at``."""
        return self._narrow(value, at) - self.first[value]


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the ``depth`` symbols from them on, equal ones by place; the end counts as least."""
    rank, h, order = symbols.astype(np.int64), 1, np.arange(len(symbols))
    if depth == 1:
        return np.argsort(rank, kind="stable")
    while h < depth:
        shift = min(h, depth - h)
        key = rank * (int(rank.max(initial=0)) + 2)
        key[:-shift] += rank[shift:] + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty_like(rank)
        rank[order] = np.r_[0, np.cumsum(key[1:] != key[:-1])] if len(key) else 0
        h += shift
    return order


class FMIndex:
    """Sequences of symbols from 1 on, joined by 0; patterns of at most ``depth`` symbols can be searched.

    Rows are the places of the joined text in the order of ``depth`` symbols, so the first row of a pattern of that length
    is its earliest place.
    """

    def __init__(self, symbols: np.ndarray, depth: int):
        self.symbols, self.depth = symbols, depth
        self.order = suffix_order(symbols, depth).astype(np.int32)
        self.planes = Planes(symbols[self.order - 1])
        self.less = np.r_[0, np.cumsum(np.bincount(symbols, minlength=self.planes.size))]

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of each pattern with its symbol put before it, from the pattern's own rows."""
        both = self.planes.ranks(np.r_[symbol, symbol], np.r_[lo, hi])
        return self.less[symbol] + both[: len(symbol)], self.less[symbol] + both[len(symbol) :]

    def matches(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of the index's own text: for each place, the length of the longest sequence that ends before
        it and occurs elsewhere too, up to ``depth``; and the earliest place of that of length ``depth`` (else -1)."""
        length, earliest = np.zeros(len(ends), np.int64), np.full(len(ends), -1, np.int64)
        live = np.arange(len(ends))
        last = self.symbols[ends - 1]
        lo, hi = self.less[last], self.less[last + 1]
        for step in range(1, self.depth + 1):
            if step > 1:
                lo, hi = self.extend(self.symbols[ends[live] - step], lo, hi)
            more = hi - lo > 1
            live, lo, hi = live[more], lo[more], hi[more]
            length[live] = step
            if not len(live):
                break
        earliest[live] = self.order[lo]
        return length, earliest


def repeated_windows(symbols: np.ndarray, first: np.ndarray, n_windows: np.ndarray, window: int, stride: int = 16) -> np.ndarray:
    """Starts of the windows of a joined text whose symbols also start at an earlier place of it, in rising order.

    ``first`` and ``n_windows``: of each sequence its first place and its number of windows. A cursor goes over ``stride``
    windows; where the longest match before its place is short, it leaps to the first window that does not hold the
    sequence that was found to be single.
    """
    index, found = FMIndex(symbols, window), []
    parts = -(-n_windows // stride)
    at = np.repeat(first, parts) + stride * (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts))
    stop = np.minimum(at + stride, np.repeat(first + n_windows, parts))
    while len(at):
        length, earliest = index.matches(at + window)
        found.append(at[(length == window) & (earliest < at)])
        at = at + np.where(length == window, 1, window - length)
        live = at < stop
        at, stop = at[live], stop[live]
    return np.sort(np.concatenate([*found, np.zeros(0, np.int64)]))
