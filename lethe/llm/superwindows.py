"""Super-windows: maximal runs of consecutive fixed-length windows that share one minimizer.

A window of `length` symbols holds length-gram+1 grams; its minimizer is the gram with the
smallest hash, the leftmost of equals.  Equal windows have equal minimizers at equal places,
so dealing runs by the minimizer's hash brings all equal windows together at about
2/(length-gram+2) rows a symbol instead of one.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from .textblocks import Rolling


class Runs(NamedTuple):
    row: np.ndarray  # row of the block
    start: np.ndarray  # first window's start, in symbols of its row
    count: np.ndarray  # number of windows
    key: np.ndarray  # hash of the minimizer
    print: np.ndarray  # hash of all symbols of the run's windows and of the minimizer's place
    place: np.ndarray  # the minimizer's start, in symbols from the run's start


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    m, have = v, 1
    while 2 * have <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def valid_starts(offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and block position of each window's start; windows stay inside their row."""
    count = np.maximum(0, np.diff(offs) - length + 1)
    row = np.repeat(np.arange(len(count)), count)
    before = np.concatenate([[0], np.cumsum(count)])[:-1]
    return row, np.arange(len(row)) - before[row] + offs[:-1][row]


def runs(rolling: Rolling, offs: np.ndarray, length: int, gram: int) -> Runs:
    row, at = valid_starts(offs, length)
    if not len(at):
        e = np.zeros(0, np.int64)
        return Runs(e, e, e, np.zeros(0, np.uint64), np.zeros(0, np.uint64), e)
    grams = rolling.grams(gram)
    bits = np.uint64(max(24, int(len(grams)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    v = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    place = (sliding_least(v, length - gram + 1)[at] & low).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    start, place, row = at[first], place[first], row[first]
    prints = rolling.spans(start, start + count + length - 1) + (place - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return Runs(row, start - offs[row], count, grams[place], prints, place - start)
