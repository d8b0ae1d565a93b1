"""An FM-index over integer symbols, built and searched with numpy, many patterns at a time."""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix order of `s` by prefix doubling; only suffixes that still share a rank are sorted again."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    rank = np.empty(n, np.int64)
    sorted_s = s[order]
    first = np.concatenate(([True], sorted_s[1:] != sorted_s[:-1]))
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    step = 1
    while True:
        last = np.append(first[1:], True)
        open_ = np.flatnonzero(~(first & last))
        if not len(open_):
            return order
        at = order[open_]
        follow = np.where(at + step < n, rank[np.minimum(at + step, n - 1)], -1)
        own = rank[at]
        by = np.lexsort((follow, own))
        at, follow, own = at[by], follow[by], own[by]
        order[open_] = at
        new = np.concatenate(([True], (own[1:] != own[:-1]) | (follow[1:] != follow[:-1])))
        first[open_] = new
        rank[at] = np.maximum.accumulate(np.where(new, open_, 0))
        step *= 2


class _Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.concatenate((bits, np.zeros(-len(bits) % 64 + 64, bits.dtype)))
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w, r = i >> 6, (i & 63).astype(np.uint64)
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << r) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletTree:
    """A levelwise wavelet tree (in matrix layout): symbol rank and access through one bit vector a level."""

    def __init__(self, s: np.ndarray, symbols: int) -> None:
        self.levels: list[tuple[_Bits, int]] = []
        self.depth = max(1, int(symbols - 1).bit_length())
        for shift in range(self.depth - 1, -1, -1):
            bit = (s >> shift & 1).astype(np.uint8)
            self.levels.append((_Bits(bit), int(len(s) - bit.sum())))
            s = np.concatenate((s[bit == 0], s[bit == 1]))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol[k] before position i[k]."""
        lo = np.zeros_like(i)
        for level, (bits, zeros) in enumerate(self.levels):
            one = (symbol >> self.depth - 1 - level & 1).astype(bool)
            a, b = bits.rank1(lo), bits.rank1(i)
            lo, i = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, i - b)
        return i - lo

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at i, its occurrences before i)."""
        symbol, lo = np.zeros_like(i), np.zeros_like(i)
        for bits, zeros in self.levels:
            one = bits.get(i).astype(bool)
            a, b = bits.rank1(lo), bits.rank1(i)
            symbol = symbol << 1 | one
            lo, i = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, i - b)
        return symbol, i - lo


class FMIndex:
    """Counts and locates patterns in `s` (symbols 1..symbols-1; 0 is the end mark, added here)."""

    def __init__(self, s: np.ndarray, symbols: int, sample: int = 8) -> None:
        s = np.append(s, 0).astype(np.int64)
        order = suffix_array(s)
        bwt = s[order - 1]
        self.n = len(s)
        self.tree = WaveletTree(bwt, symbols)
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=symbols), dtype=np.int64)))
        kept = order % sample == 0
        self.kept, self.sampled = _Bits(kept.astype(np.uint8)), order[kept]

    def ranges(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [start, end) of patterns (rows, right-aligned) by backward search."""
        start, end = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        width = patterns.shape[1]
        for k in range(width):
            live = np.flatnonzero((k < lengths) & (start < end))
            if len(live):
                c = patterns[live, width - 1 - k]
                start[live] = self.smaller[c] + self.tree.rank(c, start[live])
                end[live] = self.smaller[c] + self.tree.rank(c, end[live])
        return start, np.maximum(start, end)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back until a sampled suffix."""
        out, at, steps, todo = np.empty(len(rows), np.int64), rows.copy(), 0, np.arange(len(rows))
        while len(todo):
            here = self.kept.get(at).astype(bool)
            out[todo[here]] = self.sampled[self.kept.rank1(at[here])] + steps
            todo, at = todo[~here], at[~here]
            symbol, before = self.tree.access(at)
            at = self.smaller[symbol] + before
            steps += 1
        return out
