"""HyperMinHash sketches: per bucket, the leading-zero count and mantissa bits of the least hash.

Sets are 64-bit hashes.  The top BUCKETS_LOG2 bits pick the bucket; of the rest the sketch keeps the
number of leading zeros and MANTISSA further bits in 16 bits.  0 is an empty bucket.
"""

from __future__ import annotations

import numpy as np

from .textblocks import mix

BUCKETS_LOG2, MANTISSA = 9, 10
BUCKETS = 1 << BUCKETS_LOG2
BAND, BANDS = 4, 32  # registers a band; the bands take the first BAND * BANDS registers
#: Expected share of equal registers of two disjoint sets of equal size, times 2**MANTISSA (a fixed value of the sketch's paper).
COLLISION = 0.169919487159739

_TRIES = np.random.default_rng(977).integers(0, BUCKETS, (48, BAND * BANDS))


def registers(row: np.ndarray, hashes: np.ndarray, rows: int) -> np.ndarray:
    """Sketches of `rows` sets; hashes sorted within each row, rows ascending."""
    out = np.zeros((rows, BUCKETS), np.uint16)
    bucket = (hashes >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)
    cell = row * BUCKETS + bucket
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    least = (hashes[first] << np.uint64(BUCKETS_LOG2)) >> np.uint64(11)  # 53 bits, exact as a double
    _, bits = np.frexp(least.astype(np.float64))
    zeros = 53 - bits
    rest = (least << (zeros + 1).astype(np.uint64)) & np.uint64((1 << 53) - 1)
    out.ravel()[cell[first]] = ((zeros + 1) << MANTISSA) | (rest >> np.uint64(53 - MANTISSA)).astype(np.int64)
    return out


def filled(regs: np.ndarray) -> np.ndarray:
    """The bands' registers; empty ones borrow from all others, tried in an order that is the same for all sets."""
    out = regs[:, : BAND * BANDS].copy()
    for tries in _TRIES:
        row, col = np.nonzero(out == 0)
        if not len(row):
            return out
        out[row, col] = regs[row, tries[col]]
    for row in np.flatnonzero((out == 0).any(1) & regs.any(1)):
        have = np.flatnonzero(regs[row])
        col = np.flatnonzero(out[row] == 0)
        out[row, col] = regs[row, have[np.searchsorted(have, col * (BUCKETS // (BAND * BANDS))) % len(have)]]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """64-bit key of each band of each set."""
    bands = np.ascontiguousarray(filled(regs)).view(np.uint64)
    return mix(bands + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def estimate(one: np.ndarray, n_one: int, many: np.ndarray, n_many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of one set against many, less the collisions to be expected; buckets that either uses."""
    used = ((one > 0) | (many > 0)).sum(1)
    equal = ((one == many) & (one > 0)).sum(1)
    ratio = n_one / np.maximum(n_many, 1)
    expected = COLLISION * 2.0**-MANTISSA * used * 4 * ratio / (1 + ratio) ** 2
    return np.clip((equal - expected) / np.maximum(used, 1), 0, 1), used
