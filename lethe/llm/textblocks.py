"""Vectorised views of Arrow text columns: blocks of bytes, words and rolling hashes.

Every helper works on whole texts.  A block is a run of consecutive rows of one Arrow
batch whose texts hold about BLOCK_BYTES together (a longer text is a block of its own),
so a worker's memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _pow(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        base = np.uint64(_BASE if kind == "up" else _BASE_INV)
        have = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))
        _powers[kind] = have
    return have


class Rolling:
    """Prefix sums from which the hash of any stretch of a symbol sequence follows in O(1)."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * _pow("up", n + 1)[:n], out=self.prefix[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        inv = _pow("down", len(self.prefix))
        return mix((self.prefix[ends] - self.prefix[starts]) * inv[starts])

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all stretches of k symbols."""
        m = len(self.prefix) - k
        if m <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.prefix[k:] - self.prefix[:m]) * _pow("down", len(self.prefix))[:m])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of about `most` bytes."""
    data, offs = text_buffers(column)
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def byte_rolling(data: np.ndarray) -> Rolling:
    return Rolling(_BYTE_CODES[data])


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row offsets (into words) of the runs of non-space bytes.

    Spaces are bytes 0x20 and 0x09-0x0D; a word never crosses a row.
    """
    n = len(data)
    solid = ~_SPACES[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offs[(offs > 0) & (offs < n)]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends, row offsets and 64-bit word hashes."""
    starts, ends, rows = word_bounds(data, offs)
    return starts, ends, rows, byte_rolling(data).spans(starts, ends)


def trimmed_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends, row offsets and hashes after lower-casing A-Z and cutting punctuation off words' ends.

    A word of punctuation alone stays as it is.
    """
    data = lower_ascii(data)
    starts, ends, rows = word_bounds(data, offs)
    solid = ((data >= 97) & (data <= 122)) | (data >= 128) | ((data >= 48) & (data <= 57))
    upto = np.concatenate([[0], np.cumsum(solid)])
    at = np.flatnonzero(solid)
    if len(at):
        some = upto[ends] > upto[starts]
        starts, ends = np.where(some, at[np.minimum(upto[starts], len(at) - 1)], starts), np.where(some, at[np.maximum(upto[ends] - 1, 0)] + 1, ends)
    return starts, ends, rows, byte_rolling(data).spans(starts, ends)
