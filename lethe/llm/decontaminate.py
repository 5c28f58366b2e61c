"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words over the distinct half passages (HALF words) of the corpus, so that copies
   count once, estimated by mergeable counts of fixed size (about 13% off).
2. Each document's TF-IDF entries on the benchmark's words, the full norms of its half passages, and the sequence
   of the benchmark's words in it with their places are written once.  Words in more than MOST_SHARE of the half passages are stop words, with
   weight 0 but in items with fewer than LEAST_WEIGHTED others, where they keep FLOOR.
3. Randomised SVD of the passages (two neighbouring halves) of all documents and of the benchmark's own,
   distributed: each task multiplies its rows into a sketch of fixed size, Spark sums the sketches.
4. Passages whose cosine to an item's projection on the latent space reaches LEAST_COSINE are candidates.  So that no item
   depends on the rank, those are too whose exact product with it, over the words they share, reaches LEAST_SHARED
   of the smaller one's squared norm; any copy of an item has a passage that reaches half of it.
5. The same task checks its candidates on the written sequences, so no candidate leaves it: an item is found where a
   longest common subsequence around the passage covers enough of it, less where also the item's last words (its
   answer) stand there.

Items are taken in blocks of ITEM_BLOCK, so what is broadcast has a fixed bound; every block meets every row.

Every exact word sequence of an item, of any length, is a candidate of cosine 1 whatever its words weigh.

Defined results: null or empty texts and items match nothing; items of fewer than LEAST_WORDS words are found only as
exact word sequences, as other matches can't be told from chance; rows with null doc_id take no part in `leaks` and are kept by `clean`;
repeated rows count once; ties go to the smaller item; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import written
from .textblocks import Rolling, blocks, text_buffers, trimmed_words

HALF = 16  # words; a passage is two halves
DF_BITS = 16
REGISTERS, CHUNK = 64, 1024  # of each bucket's count, and buckets a row of them
MOST_SHARE = 0.02
LEAST_WEIGHTED, FLOOR = 4, 0.5  # an item's distinct words that aren't stop words, weight of its stop words if there are fewer
RANK, EXTRA = 192, 16
MOST_SQUARE = 5000  # known words up to which a task sums products of word pairs before it multiplies them by the basis
ITEM_WEIGHT = 8.0  # of the benchmark's own passages in the decomposition
ITEM_BLOCK = 4096
LEAST_COSINE = 0.2
LEAST_SHARED = 0.25
LEAST_WORDS = 8
ANSWER = 4  # last words of an item
LEAST_COMMON, LEAST_COMMON_WITH_ANSWER = 0.6, 0.5  # shares of the item's words
ANCHOR = 8  # words by which an exact sequence is looked up


class Items(NamedTuple):
    """A block of benchmark items as words known by number."""

    ids: list[int]
    words: list[list[int]]  # numbers among `known`, 1-based
    known: np.ndarray  # sorted word hashes
    weight: np.ndarray  # idf of each known word, 0 for stop words


def _halves(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of half passages of each row, and the half of each word, counted over all rows."""
    n = np.diff(rows)
    count = -(-n // HALF)
    before = np.cumsum(count) - count
    word = np.arange(rows[-1]) - np.repeat(rows[:-1], n)
    return count, np.repeat(before, n) + word // HALF


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - DF_BITS)).astype(np.int64)


def _distinct(half: np.ndarray, value: np.ndarray, halves: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each half with their counts; halves hold up to HALF words, in order."""
    first = np.searchsorted(half, np.arange(halves))
    table = np.full((halves, HALF), -1, np.int64)
    table[half, np.arange(len(half)) - first[half]] = value
    table.sort(1)
    new = np.ones(table.shape, bool)
    new[:, 1:] = table[:, 1:] != table[:, :-1]
    at = np.flatnonzero(new.ravel())
    count = np.diff(np.append(at, table.size))
    value = table.ravel()[at]
    ok = value >= 0
    return at[ok] // HALF, value[ok], count[ok]


def _counts(regs: np.ndarray) -> np.ndarray:
    """Estimated number of distinct hashes of each row of registers (HyperLogLog, linear counting of few)."""
    raw = 0.709 * REGISTERS**2 / np.exp2(-regs.astype(np.float64)).sum(1)
    empty = (regs == 0).sum(1)
    return np.where((raw <= 2.5 * REGISTERS) & (empty > 0), REGISTERS * np.log(REGISTERS / np.maximum(empty, 1)), raw)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Registers of each bucket, and of all half passages behind the last one, CHUNK buckets a row."""
    regs = np.zeros((1 << DF_BITS) + CHUNK, dtype=(np.uint8, REGISTERS))
    for b in batches:
        for _, _, data, offs in blocks(b.column(0)):
            _, _, rows, hashes = trimmed_words(data, offs)
            count, half = _halves(rows)
            halves = int(count.sum())
            if not halves:
                continue
            first = np.searchsorted(half, np.arange(halves + 1))
            own = Rolling(hashes).spans(first[:-1], first[1:])
            slot = (own & np.uint64(REGISTERS - 1)).astype(np.int64)
            _, bits = np.frexp((own >> np.uint64(12)).astype(np.float64))
            rank = np.minimum(53 - bits, 53).astype(np.uint8)
            h, value, _ = _distinct(half, _bucket(hashes), halves)
            flat = regs.reshape(-1)
            np.maximum.at(flat, value * REGISTERS + slot[h], rank[h])
            np.maximum.at(flat, (1 << DF_BITS) * REGISTERS + slot, rank)
    chunks = regs.reshape(-1, CHUNK * REGISTERS)
    at = np.flatnonzero(chunks.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([chunks[i].tobytes() for i in at], pa.binary())], names=["chunk", "regs"])


def _highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    most: dict[int, np.ndarray] = {}
    for b in batches:
        for k, part in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            x = np.frombuffer(part.as_buffer(), np.uint8)
            most[k] = np.maximum(most[k], x) if k in most else x
    yield pa.RecordBatch.from_arrays([pa.array(list(most), pa.int64()), pa.array([x.tobytes() for x in most.values()], pa.binary())], names=["chunk", "regs"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """idf by bucket over all distinct half passages of docs (text), 0 for stop words; a table of fixed size."""
    of = "chunk long, regs binary"
    df = np.zeros((1 << DF_BITS) + CHUNK)
    for r in docs.select("text").mapInArrow(_frequencies, of).repartition("chunk").mapInArrow(_highest, of).toLocalIterator():
        df[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = _counts(np.frombuffer(bytes(r["regs"]), np.uint8).reshape(CHUNK, REGISTERS))
    df, total = df[: 1 << DF_BITS], df[1 << DF_BITS]
    idf = np.log((total + 1) / (df + 0.5))
    idf[df > max(MOST_SHARE * total, 4)] = 0
    return np.maximum(idf, 0)


def floored(rows: list[tuple[int, str]], idf: np.ndarray) -> np.ndarray:
    """idf in which the stop words of items with fewer than LEAST_WEIGHTED other words weigh FLOOR."""
    items, out = items_of(rows, idf), idf.copy()
    for words in items.words:
        own = np.unique(np.array(words, np.int64)) - 1
        if LEAST_WORDS <= len(words) and (items.weight[own] > 0).sum() < min(LEAST_WEIGHTED, len(own)):
            bucket = _bucket(items.known[own])
            out[bucket] = np.maximum(out[bucket], FLOOR)
    return out


def items_of(rows: list[tuple[int, str]], idf: np.ndarray) -> Items:
    _, _, offs, hashes = trimmed_words(*text_buffers(pa.array([t for _, t in rows], pa.large_string())))
    known, number = np.unique(hashes, return_inverse=True)
    words = [(number[a:b] + 1).tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)]
    return Items([i for i, _ in rows], words, known, idf[_bucket(known)])


class _Sequences(NamedTuple):
    """The items' word sequences, by the hash of an anchor of at most ANCHOR of their words."""

    tables: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]  # words of the anchors, their sorted hashes, items, filter of 16 bits
    at: np.ndarray  # first word of each item's anchor
    size: np.ndarray
    whole: np.ndarray


def sequences(items: Items) -> _Sequences:
    size = np.array([len(w) for w in items.words], np.int64)
    offs = np.concatenate([[0], np.cumsum(size)])
    rolling = Rolling(items.known[np.concatenate([np.array(w, np.int64) for w in items.words]) - 1] if offs[-1] else np.zeros(0, np.uint64))
    at, tables = np.zeros(len(size), np.int64), []
    for k in range(1, ANCHOR + 1):
        own = np.flatnonzero(np.minimum(size, ANCHOR) == k)
        if not len(own):
            continue
        # The anchor is the stretch that the fewest items hold, so a common phrase doesn't bring up all of them.
        count = size[own] - k + 1
        row = np.repeat(np.arange(len(own)), count)
        start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        _, number, n = np.unique(rolling.spans(offs[own][row] + start, offs[own][row] + start + k), return_inverse=True, return_counts=True)
        best = np.lexsort((start, n[number], row))[np.cumsum(count) - count]
        at[own] = start[best]
        key = rolling.spans(offs[own] + at[own], offs[own] + at[own] + k)
        order = np.argsort(key, kind="stable")
        some = np.zeros(1 << 16, bool)
        some[(key >> np.uint64(48)).astype(np.int64)] = True
        tables.append((k, key[order], own[order], some))
    return _Sequences(tables, at, size, rolling.spans(offs[:-1], offs[1:]))


def exact(seq: _Sequences, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, word) of the first exact sequence of each item in each row, in order of row."""
    rolling, found = Rolling(hashes), [np.zeros((3, 0), np.int64)]
    for k, keys, items, some in seq.tables:
        grams = rolling.grams(k)
        near = np.flatnonzero(some[(grams >> np.uint64(48)).astype(np.int64)])
        lo = np.searchsorted(keys, grams[near], "left")
        n = np.searchsorted(keys, grams[near], "right") - lo
        item = items[np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)]
        start = np.repeat(near, n) - seq.at[item]
        row = np.searchsorted(rows, np.repeat(near, n), "right") - 1
        ok = (start >= rows[row]) & (start + seq.size[item] <= rows[row + 1])
        item, start, row = item[ok], start[ok], row[ok]
        ok = rolling.spans(start, start + seq.size[item]) == seq.whole[item]
        found.append(np.stack([row[ok], item[ok], (start - rows[row])[ok]]))
    row, item, word = np.concatenate(found, 1)
    order = np.lexsort((word, item, row))
    row, item, word = row[order], item[order], word[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
    return row[new], item[new], word[new]


# Ragged rows as packed 4-byte numbers: norms and weights are floats, the others integers.  `gaps` are the words from one
# benchmark word to the next, `words` their numbers, 1-based.
_RAGGED = ("norms", "halves", "terms", "weights", "items", "places", "gaps", "words")
_TERMS = "doc long, " + ", ".join(f"{c} binary" for c in _RAGGED)


def _packed(offs: np.ndarray, values: np.ndarray, kind: str) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer((4 * offs).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values, kind))])


def _unpacked(b: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and values of a packed column."""
    c = b.column(b.schema.names.index(name))
    _, offs, data = c.buffers()
    offs = np.frombuffer(offs, np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return (offs - offs[0]) // 4, np.frombuffer(raw.tobytes(), "<f4" if name in ("norms", "weights") else "<i4")


def _terms(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, idf = shared.value
        seq = sequences(items)
        for b in batches:
            for i, j, data, offs in blocks(b.column(1)):
                _, _, rows, hashes = trimmed_words(data, offs)
                count, half = _halves(rows)
                ends = np.concatenate([[0], np.cumsum(count)])
                bucket = _bucket(hashes)
                h, value, n = _distinct(half, bucket, int(ends[-1]))
                norms = np.bincount(h, weights=(n * idf[value]) ** 2, minlength=int(ends[-1]))
                at = np.minimum(np.searchsorted(items.known, hashes), len(items.known) - 1)
                known = np.flatnonzero(items.known[at] == hashes)
                own = known[items.weight[at[known]] > 0]
                h, term, n = _distinct(half[own], at[own], int(ends[-1])) if len(own) else (np.zeros(0, np.int64),) * 3
                row = np.searchsorted(ends, h, "right") - 1
                entries = np.searchsorted(row, np.arange(j - i + 1))
                same, item, word = exact(seq, hashes, rows)
                hits = np.searchsorted(same, np.arange(j - i + 1))
                of_row = np.searchsorted(known, rows)
                gaps = np.diff(known, prepend=0)
                begins = of_row[:-1][np.diff(of_row) > 0]
                gaps[begins] = known[begins] - rows[:-1][np.diff(of_row) > 0]
                out = pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), _packed(ends, norms, "<f4"), _packed(entries, h - ends[row], "<i4"), _packed(entries, term, "<i4"), _packed(entries, n * items.weight[term], "<f4"), _packed(hits, item, "<i4"), _packed(hits, word, "<i4"), _packed(of_row, gaps, "<i4"), _packed(of_row, at[known] + 1, "<i4")],
                    names=["doc", *_RAGGED],
                )
                yield out.filter(pa.array((np.diff(entries) > 0) | (np.diff(hits) > 0)))

    return of


class _Passages(NamedTuple):
    """Passages of some rows that hold a benchmark word: sparse vectors over the known words."""

    row: np.ndarray
    half: np.ndarray  # first half
    norm: np.ndarray
    offs: np.ndarray
    terms: np.ndarray
    weights: np.ndarray


def _passages(b: pa.RecordBatch) -> _Passages:
    first, sq = _unpacked(b, "norms")
    size, sq = np.diff(first), sq.astype(np.float64)
    offs, own = _unpacked(b, "halves")
    row, own = np.repeat(np.arange(len(b)), np.diff(offs)), own.astype(np.int64)
    t, w = _unpacked(b, "terms")[1], _unpacked(b, "weights")[1]
    start = first[:-1][row]
    # A half is in the passage that it begins and in the one before; the last half begins one only if it is alone.
    begins = (own < size[row] - 1) | (size[row] == 1)
    follows = own > 0
    row2 = np.concatenate([row[begins], row[follows]])
    half2 = np.concatenate([own[begins], own[follows] - 1])
    key = np.concatenate([(start + own)[begins], (start + own - 1)[follows]])
    t2, w2 = np.concatenate([t[begins], t[follows]]), np.concatenate([w[begins], w[follows]])
    o = np.argsort(key, kind="stable")
    key, new = key[o], np.ones(len(o), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    nxt = np.where(half2[o][at] + 1 < size[row2[o][at]], sq[np.minimum(key[at] + 1, len(sq) - 1)], 0)
    return _Passages(row2[o][at], half2[o][at], np.sqrt(sq[key[at]] + nxt), np.append(at, len(o)), t2[o], w2[o])


def _product(p: _Passages, matrix: np.ndarray) -> np.ndarray:
    """Rows of the unit passage vectors times the matrix, added up word by word, the longest passages first."""
    size = np.diff(p.offs)
    order = np.argsort(-size, kind="stable")
    size, start = size[order], p.offs[:-1][order]
    out = np.zeros((len(order), matrix.shape[1]), matrix.dtype)
    for k in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -k, "left"))
        at = start[:live] + k
        out[:live] += matrix[p.terms[at]] * p.weights[at, None]
    out /= np.maximum(p.norm[order], 1e-9)[:, None].astype(matrix.dtype)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return out[back]


def _gram_product(p: _Passages, matrix: np.ndarray, out: np.ndarray) -> None:
    """out += A'(A matrix) over these passages."""
    y = _product(p, matrix)
    owner = np.repeat(np.arange(len(p.row)), np.diff(p.offs))
    o = np.argsort(p.terms, kind="stable")
    terms = p.terms[o]
    for lo in range(0, len(o), 1 << 16):
        part = slice(lo, lo + (1 << 16))
        t = terms[part]
        at = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        out[t[at]] += np.add.reduceat(y[owner[o[part]]] * (p.weights[o[part]] / np.maximum(p.norm, 1e-9)[owner[o[part]]])[:, None].astype(y.dtype), at, 0)


class _Pairs(NamedTuple):
    """Half passages of some rows that hold a benchmark word, in order, and the norms of the passages they are in."""

    offs: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    follows: np.ndarray  # place of the next half of the same row, or the number of halves (an empty one)
    begun: np.ndarray  # 1 / squared norm of the passage that the half begins, 0 if it begins none
    ended: np.ndarray  # the same of the passage before, which it ends


def _pairs(b: pa.RecordBatch) -> _Pairs:
    first, sq = _unpacked(b, "norms")
    sq = sq.astype(np.float64)
    offs, halves = _unpacked(b, "halves")
    row = np.repeat(np.arange(len(b)), np.diff(offs))
    entry = first[:-1][row] + halves
    last = np.zeros(len(sq) + 1, bool)
    last[first[1:][np.diff(first) > 0] - 1] = True
    both = sq + np.append(sq[1:], 0) * ~last[:-1]
    alone = np.zeros(len(sq), bool)
    alone[first[:-1][np.diff(first) == 1]] = True
    begun = np.where(last[:-1] & ~alone, 0, 1 / np.maximum(both, 1e-18))
    ended = np.concatenate([[0], begun[:-1] * ~last[:-2]]) if len(sq) else begun
    half, start = np.unique(entry, return_index=True)
    at = np.minimum(np.searchsorted(half, half + 1), max(len(half) - 1, 0))
    follows = np.where((half[at] == half + 1) & ~last[half], at, len(half))
    return _Pairs(np.append(start, len(entry)), _unpacked(b, "terms")[1].astype(np.int64), _unpacked(b, "weights")[1], follows, begun[half], ended[half])


def _square(p: _Pairs, out: np.ndarray) -> None:
    """out + out' += A'A over these passages: products of the words of each half and of neighbouring halves."""
    count = np.append(np.diff(p.offs), 0)
    owner = np.repeat(np.arange(len(p.follows)), count[:-1])
    for other, scale in ((np.arange(len(p.follows)), (p.begun + p.ended) / 2), (p.follows, p.begun)):
        n = count[other][owner]
        for lo in range(0, len(owner), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            m = n[part]
            left = np.repeat(np.arange(lo, lo + len(m)), m)
            right = np.arange(len(left)) + np.repeat(p.offs[other[owner[part]]] - (np.cumsum(m) - m), m)
            product = p.weights[left] * p.weights[right] * scale[owner[left]].astype(np.float32)
            np.add.at(out.reshape(-1), p.terms[left] * len(out) + p.terms[right], product)


def _sketch(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = shared.value
        out = np.zeros_like(matrix)
        square = np.zeros((len(matrix),) * 2, np.float32) if len(matrix) <= MOST_SQUARE else None
        for b in batches:
            for i in range(0, len(b), 200):
                if square is None:
                    _gram_product(_passages(b.slice(i, 200)), matrix, out)
                else:
                    _square(_pairs(b.slice(i, 200)), square)
        if square is not None:
            out = square @ matrix + square.T @ matrix
        at = np.flatnonzero(out.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([out[i].tobytes() for i in at], pa.binary())], names=["term", "part"])

    return of


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for t, part in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            x = np.frombuffer(part.as_buffer(), np.float32)
            sums[t] = sums[t] + x if t in sums else x
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["term", "part"])


def item_passages(items: Items) -> _Passages:
    """Each item as one passage."""
    row, terms, weights, offs = [], [], [], [0]
    for words in items.words:
        t, n = np.unique(np.array(words, np.int64) - 1, return_counts=True)
        w = n * items.weight[t] if len(t) else n
        keep = w > 0
        terms.append(t[keep])
        weights.append(w[keep])
        offs.append(offs[-1] + int(keep.sum()))
    t, w = np.concatenate(terms).astype(np.int64), np.concatenate(weights).astype(np.float32)
    offs = np.array(offs)
    row = np.flatnonzero(np.diff(offs))
    norm = np.sqrt(np.add.reduceat(w.astype(np.float64) ** 2, offs[row])) if len(row) else np.zeros(0)
    return _Passages(row, np.zeros(len(row), np.int64), norm, np.append(offs[row], len(t)), t, w)


def latent_space(terms: DataFrame, items: Items, own: _Passages, rank: int = RANK, seed: int = 5) -> np.ndarray:
    """Known words x rank: leading right singular vectors of the passages in terms and the weighted items.

    Only sketches of (words of an item block) x (rank + EXTRA) numbers meet in the driver.
    """
    spark = terms.sparkSession
    size = len(items.known)
    width = min(size, rank + EXTRA, len(own.row) + EXTRA)
    basis = np.random.default_rng(seed).normal(size=(size, width)).astype(np.float32)
    for last in (False, True):
        shared = spark.sparkContext.broadcast(basis)
        summed = terms.mapInArrow(_sketch(shared), "term long, part binary").repartition("term").mapInArrow(_add, "term long, part binary")
        total = np.zeros_like(basis)
        for r in summed.toLocalIterator():
            total[r["term"]] += np.frombuffer(bytes(r["part"]), np.float32)
        mine = np.zeros_like(basis)
        _gram_product(own, basis, mine)
        total += ITEM_WEIGHT**2 * mine
        if last:
            value, vector = np.linalg.eigh((basis.T @ total).astype(np.float64))
            top = np.argsort(-value)[: min(rank, width)]
            return (basis @ vector[:, top]).astype(np.float32)
        basis, _ = np.linalg.qr(total)
        basis = np.ascontiguousarray(basis, np.float32)
    raise AssertionError


def _part(p: _Passages, part: np.ndarray) -> _Passages:
    """Some of the passages."""
    counts = np.diff(p.offs)[part]
    at = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(p.offs[:-1][part], counts)
    return _Passages(p.row[part], p.half[part], p.norm[part], np.concatenate([[0], np.cumsum(counts)]), p.terms[at], p.weights[at])


class _Postings(NamedTuple):
    """The items' passages by word."""

    offs: np.ndarray
    item: np.ndarray  # place among the items' passages
    weights: np.ndarray
    most: np.ndarray  # highest weight of each word
    squares: np.ndarray  # squared norm of each item
    norm: np.ndarray


def postings(own: _Passages, size: int) -> _Postings:
    order = np.argsort(own.terms, kind="stable")
    most = np.zeros(size)
    np.maximum.at(most, own.terms, own.weights)
    return _Postings(np.searchsorted(own.terms[order], np.arange(size + 1)), np.repeat(np.arange(len(own.row)), np.diff(own.offs))[order], own.weights[order].astype(np.float64), most, own.norm**2, own.norm)


def shared_words(p: _Passages, by: _Postings) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(passage, item, cosine) of the pairs whose product reaches LEAST_SHARED of the smaller squared norm."""
    if not len(p.row) or not len(by.squares):
        return
    square = p.norm**2
    bound = np.add.reduceat(p.weights * by.most[p.terms], p.offs[:-1])
    near = np.flatnonzero(bound >= 0.999 * LEAST_SHARED * np.minimum(square, by.squares.min()))
    for k in range(0, len(near), 1024):
        part = near[k : k + 1024]
        sub = _part(p, part)
        n = (by.offs[1:] - by.offs[:-1])[sub.terms]
        entry = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(entry)) + np.repeat(by.offs[:-1][sub.terms] - (np.cumsum(n) - n), n)
        owner = np.repeat(np.arange(len(part)), np.diff(sub.offs))[entry]
        pair, number = np.unique(owner * len(by.squares) + by.item[at], return_inverse=True)
        product = np.bincount(number, weights=sub.weights[entry] * by.weights[at], minlength=len(pair))
        x, y = pair // len(by.squares), pair % len(by.squares)
        ok = product >= 0.999 * LEAST_SHARED * np.minimum(square[part][x], by.squares[y])
        x, y = x[ok], y[ok]
        yield part[x], y, np.minimum(product[ok] / np.maximum(p.norm[part][x] * by.norm[y], 1e-9), 1.0)


def _near(b: pa.RecordBatch, space: np.ndarray, latent: np.ndarray, item_rows: np.ndarray, by: _Postings) -> Iterator[tuple]:
    """(row, half, item, cosine) of the candidates of some rows."""
    offs, item = _unpacked(b, "items")
    yield np.repeat(np.arange(len(b)), np.diff(offs)), _unpacked(b, "places")[1] // HALF, item, np.ones(len(item))
    p = _passages(b)
    # The latent vector is a projection of the part on benchmark words, so this bound leaves none out.
    mass = np.sqrt(np.add.reduceat(p.weights.astype(np.float64) ** 2, p.offs[:-1])) if len(p.row) else np.zeros(0)
    near = np.flatnonzero(1.001 * mass >= LEAST_COSINE * p.norm)
    for k in range(0, len(near), 4096):
        sub = _part(p, near[k : k + 4096])
        cosine = _product(sub, space) @ latent.T
        x, y = np.nonzero(cosine >= LEAST_COSINE)
        yield sub.row[x], sub.half[x], item_rows[y], cosine[x, y]
    for x, y, cosine in shared_words(p, by):
        yield p.row[x], p.half[x], item_rows[y], cosine


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & where.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _holds(words: list[int], part: list[int]) -> bool:
    n = len(part)
    return any(words[i : i + n] == part for i in range(len(words) - n + 1))


KEPT_CHECKS = 20_000  # comparisons that a task remembers, as copies of a passage give the same ones


def _check(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of the written terms -> confirmed (doc, item), with the best evidence."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, *nearness = shared.value
        kept: dict[tuple[int, bytes], tuple[float, bool]] = {}

        def compare(number: int, part: np.ndarray) -> tuple[float, bool]:
            """Share of the item's words in the longest common subsequence, and whether its answer stands there."""
            key = number, part.tobytes()
            if key not in kept:
                if len(kept) >= KEPT_CHECKS:
                    kept.clear()
                item, words = items.words[number], part.tolist()
                if len(item) < LEAST_WORDS and not _holds(words, item):
                    kept[key] = 0.0, False
                else:
                    kept[key] = common_subsequence(item, [w for w in words if w]) / len(item), _holds(words, item[-ANSWER:])
            return kept[key]

        for b in batches:
            out = []
            for i in range(0, len(b), 200):
                rows = b.slice(i, 200)
                row, half, item, cosine = (np.concatenate(x) for x in zip(*_near(rows, *nearness), strict=True))
                o = np.lexsort((-cosine, item, half, row))
                row, half, item, cosine = row[o], half[o], item[o], cosine[o]
                new = np.ones(len(o), bool)
                new[1:] = (row[1:] != row[:-1]) | (half[1:] != half[:-1]) | (item[1:] != item[:-1])
                at = np.flatnonzero(new)
                offs, gaps = _unpacked(rows, "gaps")
                words = _unpacked(rows, "words")[1]
                own, dense = -1, np.zeros(0, np.int32)
                best: dict[tuple[int, int], dict] = {}
                for r, h, k, c in zip(row[at].tolist(), half[at].tolist(), item[at].tolist(), cosine[at].tolist(), strict=True):
                    if r != own:
                        own, place = r, np.cumsum(gaps[offs[r] : offs[r + 1]])
                        dense = np.zeros(int(place[-1]) + 1 if len(place) else 0, np.int32)
                        dense[place] = words[offs[r] : offs[r + 1]]
                    size = len(items.words[k])
                    lo = max(0, h * HALF - size)
                    share, answer = compare(k, dense[lo : (h + 2) * HALF + size])
                    if share >= LEAST_COMMON or (answer and share >= LEAST_COMMON_WITH_ANSWER):
                        found = {"doc_id": rows.column(0)[r].as_py(), "item_id": items.ids[k], "cosine": c, "common": share, "answer": answer, "word": lo}
                        last = best.get((r, k))
                        if last is None or (share, c, -lo) > (last["common"], last["cosine"], -last["word"]):
                            best[r, k] = found
                out += best.values()
            yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("common", pa.float64()), ("answer", pa.bool_()), ("word", pa.int32())]))

    return of


_LEAKS = "doc_id long, item_id long, cosine double, common double, answer boolean, word int"


def _item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    rows = []
    for r in benchmark.where("text is not null and item_id is not null").orderBy("item_id", "text").toLocalIterator():
        rows.append((r["item_id"], r["text"]))
        if len(rows) == ITEM_BLOCK:
            yield rows
            rows = []
    if rows:
        yield rows


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, cosine, common, answer, word): items found in a document and where (first word looked at)."""
    spark: SparkSession = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null and text is not null")
    bench = benchmark.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    idf, found = None, spark.createDataFrame([], _LEAKS)
    for rows in _item_blocks(bench):
        idf = inverse_frequencies(own) if idf is None else idf
        weights = floored(rows, idf)
        items = items_of(rows, weights)
        passages = item_passages(items)
        if not any(items.words):
            continue
        terms = written(own.mapInArrow(_terms(spark.sparkContext.broadcast((items, weights))), _TERMS), "terms")
        space = latent_space(terms, items, passages) if len(passages.row) else np.zeros((len(items.known), 1), np.float32)
        latent = _product(passages, space)
        latent /= np.maximum(np.linalg.norm(latent, axis=1), 1e-9)[:, None]
        shared = spark.sparkContext.broadcast((items, space, latent, passages.row, postings(passages, len(items.known))))
        found = found.unionByName(terms.mapInArrow(_check(shared), _LEAKS))
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("common", "cosine", "answer", "word")).alias("best")).select("doc_id", "item_id", "best.cosine", "best.common", "best.answer", "best.word")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item was found, with all their columns."""
    return docs.join(leaks(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti")
