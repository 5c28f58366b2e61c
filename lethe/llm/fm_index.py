"""Compressed FM-index over integer sequences: the Burrows-Wheeler transform in a wavelet matrix, and sampled rows.

The index keeps neither the text nor its suffix array: what is searched comes with the question, and the row of a
suffix is found by stepping back to the next sampled place.
"""

from __future__ import annotations

import numpy as np

WORDS = 1024  # of 64 bits, in a superblock of ranks: counts within one fit 16 bits
RATE = 8  # every so many symbols of a row a suffix has its row stored


class Bits:
    """Bit vector with rank in 1.25 bits a bit."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        raw = np.packbits(bits, bitorder="little")
        self.words = np.zeros(n // 64 + 2, np.uint64)
        self.words.view(np.uint8)[: len(raw)] = raw
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words[:-1]), dtype=np.int64)])
        self.blocks = before[::WORDS].copy()
        self.within = (before - np.repeat(self.blocks, WORDS)[: len(before)]).astype(np.uint16)

    def rank1(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.blocks[w // WORDS] + self.within[w] + np.bitwise_count(self.words[w] & low)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.blocks.nbytes + self.within.nbytes


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = (symbols >> shift) & 1 == 1
            self.levels.append((shift, Bits(bit), int(len(bit) - bit.sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        self.base = self._descend(np.arange(sigma), np.zeros(sigma, np.int64)).astype(np.int32)

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank1(i)
            i = np.where((c >> shift) & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each c stands before place i."""
        return self._descend(c, i) - self.base[c]

    def read(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place i and how often it stands before it."""
        c = np.zeros(len(i), np.int64)
        for shift, bits, zeros in self.levels:
            one, ones = bits.at(i), bits.rank1(i)
            c |= one.astype(np.int64) << shift
            i = np.where(one, zeros + ones, i - ones)
        return c, i - self.base[c]

    @property
    def nbytes(self) -> int:
        return self.base.nbytes + sum(bits.nbytes for _, bits, _ in self.levels)


def _suffixes(text: np.ndarray, ends: np.ndarray, longest: int) -> np.ndarray:
    """Suffixes in order by prefix doubling; row ends sort before all symbols and by row."""
    rows, n, step = len(ends), len(text), 1
    order = text + rows
    order[ends] = np.arange(rows)
    while step <= longest:
        second = np.zeros(n, np.int64)
        second[: n - step] = order[step:] + 1
        _, order = np.unique(order * np.int64(order.max(initial=0) + n + 2) + second, return_inverse=True)
        step *= 2
    return np.argsort(order)


class FMIndex:
    """Index of the rows of a ragged integer sequence; a match never crosses rows.

    values: symbols 1..sigma-1, offs: row offsets.
    """

    def __init__(self, values: np.ndarray, offs: np.ndarray, sigma: int):
        rows, sizes = len(offs) - 1, np.diff(offs)
        starts = offs[:-1] + np.arange(rows)  # in the text with row ends
        text = np.zeros(len(values) + rows, np.int64)
        row = np.repeat(np.arange(rows), sizes)
        text[np.arange(len(values)) + row] = values
        suffixes = _suffixes(text, starts + sizes, int(sizes.max(initial=0)))
        row = np.repeat(np.arange(rows), sizes + 1)
        sampled = ((suffixes - starts[row[suffixes]]) % RATE) == 0  # a row's start is, so no step leaves the row
        self.sampled = Bits(sampled)
        self.rows = row[suffixes[sampled]].astype(np.int32)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))]).astype(np.int32)
        self.bwt = WaveletMatrix(text[suffixes - 1], sigma)

    @property
    def nbytes(self) -> int:
        return self.sampled.nbytes + self.rows.nbytes + self.first.nbytes + self.bwt.nbytes

    def matching(self, symbols: np.ndarray, ends: np.ndarray, most: int, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of streamed symbols (0: not in the index) by backward search from each of `ends`.

        Returns how many symbols up to and with each end occur `least` times or more, up to `most`, and the interval
        of suffixes that match that long.  The caller sees to it that `most` symbols stand before each end.
        """
        c = symbols[ends]
        los, his = self.first[c].astype(np.int64), self.first[c + 1].astype(np.int64)
        found = np.zeros(len(ends), np.int64)
        live = np.flatnonzero((c > 0) & (his - los >= least))
        found[live] = 1
        for back in range(1, most):
            if not len(live):
                break
            c = symbols[ends[live] - back]
            lo = self.first[c] + self.bwt.rank(c, los[live])
            hi = self.first[c] + self.bwt.rank(c, his[live])
            on = (c > 0) & (hi - lo >= least)
            live = live[on]
            los[live], his[live], found[live] = lo[on], hi[on], back + 1
        return found, los, his

    def row_of(self, places: np.ndarray) -> np.ndarray:
        """Row of the suffix at each place of the order, by steps back to a sampled one."""
        out = np.empty(len(places), np.int64)
        live, at = np.arange(len(places)), places.astype(np.int64)
        while len(live):
            known = self.sampled.at(at)
            out[live[known]] = self.rows[self.sampled.rank1(at[known])]
            live, at = live[~known], at[~known]
            c, before = self.bwt.read(at)
            at = self.first[c] + before
        return out
