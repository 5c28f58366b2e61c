"""The compressed FM-index against plain search."""

import numpy as np
import pytest

from lethe.llm import fm_index
from lethe.llm.fm_index import Bits, FMIndex, WaveletMatrix


def ragged(seed, rows, sigma, most):
    r = np.random.default_rng(seed)
    sizes = r.integers(0, most, rows)
    offs = np.concatenate([[0], np.cumsum(sizes)])
    return r.integers(1, sigma, offs[-1]), offs


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 64 * 1024, 64 * 1024 * 3 + 5])
def test_ranks(n):
    bits = np.random.default_rng(n).random(n) < 0.6
    own = Bits(bits)
    at = np.unique(np.append(np.random.default_rng(1).integers(0, n + 1, 500), [0, n]))
    assert own.rank1(at).tolist() == np.concatenate([[0], np.cumsum(bits)])[at].tolist()
    assert own.at(at[at < n]).tolist() == bits[at[at < n]].tolist()


@pytest.mark.parametrize("sigma", [2, 3, 17, 1000])
def test_wavelet_matrix(sigma):
    symbols = np.random.default_rng(sigma).integers(0, sigma, 700)
    w = WaveletMatrix(symbols, sigma)
    c, before = w.read(np.arange(700))
    assert c.tolist() == symbols.tolist()
    assert before.tolist() == [int((symbols[:i] == x).sum()) for i, x in enumerate(symbols)]
    assert w.rank(symbols, np.full(700, 300)).tolist() == [int((symbols[:300] == x).sum()) for x in symbols]


@pytest.mark.parametrize("seed,sigma", [(1, 2), (2, 4), (3, 9), (4, 400)])
def test_search_of_streamed_symbols(seed, sigma):
    """Statistics and rows of another sequence, with symbols that the index doesn't know."""
    values, offs = ragged(seed, 40, sigma, 30)
    index = FMIndex(values, offs, sigma)
    rows = [tuple(values[a:b].tolist()) for a, b in zip(offs[:-1], offs[1:], strict=True)]
    most, r = 6, np.random.default_rng(seed + 50)
    other = np.concatenate([r.integers(0, sigma, 200), values[:200]])
    ends = np.arange(most - 1, len(other))
    for least in (1, 2):
        found, lo, hi = index.matching(other, ends, most, least)
        for e, n, a, b in zip(ends.tolist(), found.tolist(), lo.tolist(), hi.tolist(), strict=True):
            holders = lambda k, e=e: [i for i, row in enumerate(rows) for s in range(len(row) - k + 1) if row[s : s + k] == tuple(other[e - k + 1 : e + 1].tolist())]
            want = next((k for k in range(most, 0, -1) if len(holders(k)) >= least), 0)
            assert n == want
            if n:
                assert sorted(index.row_of(np.arange(a, b)).tolist()) == holders(n)


def test_it_keeps_less_than_the_symbols():
    values, offs = ragged(9, 4000, 3000, 60)
    index = FMIndex(values, offs, 3000)
    bits = 8 * index.nbytes / (len(values) + 4000)
    assert bits < 1.3 * 12 + 32 / fm_index.RATE + 6  # a level each of 12 bits, sampled rows, marks and tables
    assert not any(isinstance(x, np.ndarray) and len(x) >= len(values) // 4 for x in vars(index).values())


def test_empty():
    index = FMIndex(np.zeros(0, np.int64), np.array([0, 0, 0]), 1)
    assert index.matching(np.zeros(3, np.int64), np.array([2]), 3)[0].tolist() == [0]
