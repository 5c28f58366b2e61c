"""Byte-level BPE encoding and decoding.

A text is split by the vocabulary's pattern; each split piece is merged on its own.  A segment tree
over a piece's byte positions holds the leftmost pair of least rank; a merge is three point updates,
for the pair and its live neighbours.  Trees of equal size are kept as the rows of one array, so one
step merges a pair in each of many pieces.

Pieces that repeat are merged once per task batch or taken from a bounded cache.

Defined results: a null or empty text has no ids; ids outside the vocabulary are an error; repeated
rows are encoded alike.  Special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblocks import mix

CACHE_ENTRIES = 300_000
FAR = np.int64(1) << 40  # beyond any rank
ROWS = 1 << 14  # trees merged together


def load_ranks(path: str) -> dict[bytes, int]:
    """Lines of base64 bytes and rank, read on the driver; a vocabulary's size doesn't depend on the data."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def rust_spaces(pattern: str) -> str:
    """The pattern with Unicode's White_Space for \\s, which in Python also takes U+001C to U+001F."""
    inner = regex.sub(r"\\s", r"\\p{White_Space}", pattern)
    return regex.sub(r"\\S", r"\\P{White_Space}", inner)


class PairRanks:
    """Hash table from pairs of token numbers to the rank of their joined bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        size = 1 << max(4, int(4 * len(keys)).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys = np.full(size, ~np.uint64(0))
        self.ranks = np.full(size, FAR)
        todo, at = np.arange(len(keys)), mix(keys) & self.mask
        rank = np.array(rank, np.int64)
        while len(todo):
            free = self.keys[at[todo]] == ~np.uint64(0)
            self.keys[at[todo[free]]] = keys[todo[free]]  # of several, one stays
            own = self.keys[at[todo]] == keys[todo]
            self.ranks[at[todo[own]]] = rank[todo[own]]
            todo = todo[~own]
            at[todo] = (at[todo] + np.uint64(1)) & self.mask

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = mix(keys) & self.mask
        out = np.full(len(keys), FAR)
        todo = np.arange(len(keys))
        while len(todo):
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (found != ~np.uint64(0))]
            at[todo] = (at[todo] + np.uint64(1)) & self.mask
        return out


def merge(pieces: list[bytes], singles: np.ndarray, pairs: PairRanks) -> list[np.ndarray]:
    """Token numbers of each piece; pieces are of at most `size` bytes each, a power of two."""
    n = len(pieces)
    sizes = np.fromiter(map(len, pieces), np.int64, n)
    size = 1 << max(1, int(sizes.max() - 1).bit_length())
    token = np.zeros((n, size), np.int64)
    row = np.repeat(np.arange(n), sizes)
    col = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    token[row, col] = singles[np.frombuffer(b"".join(pieces), np.uint8)]
    place = np.arange(size)
    after = np.broadcast_to(place + 1, (n, size)).copy()
    before = np.broadcast_to(place - 1, (n, size)).copy()
    live = place < sizes[:, None]
    far = FAR * size
    tree = np.full((n, 2 * size), far + size)
    r, c = np.nonzero(live[:, 1:])
    rank = pairs.get(token[r, c], token[r, c + 1])
    tree[r, size + c] = rank * size + c  # least rank first, then leftmost
    step = size
    while step > 1:
        half = step // 2
        tree[:, half:step] = np.minimum(tree[:, step : 2 * step : 2], tree[:, step + 1 : 2 * step : 2])
        step = half

    def update(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        node = at + size
        tree[rows, node] = value
        while size > 1 and node[0] > 1:
            node >>= 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    rows = np.flatnonzero(tree[:, 1] < far)
    while len(rows):
        best = tree[rows, 1]
        at = best % size
        gone = after[rows, at]
        token[rows, at] = best // size
        nxt = after[rows, gone]
        after[rows, at] = nxt
        inner = nxt < sizes[rows]
        before[rows[inner], nxt[inner]] = at[inner]
        live[rows, gone] = False
        update(rows, gone.copy(), np.full(len(rows), far + size))
        value = np.full(len(rows), far + size)
        value[inner] = pairs.get(token[rows[inner], at[inner]], token[rows[inner], nxt[inner]]) * size + at[inner]
        update(rows, at.copy(), value)
        prev = before[rows, at]
        has = prev >= 0
        if has.any():
            r, p = rows[has], prev[has]
            update(r, p.copy(), pairs.get(token[r, p], token[r, at[has]]) * size + p)
        rows = rows[tree[rows, 1] < far]
    flat = token[live]
    return np.split(flat, np.cumsum(live.sum(1))[:-1])


class Encoder:
    """Encodes texts; made once per worker and vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(rust_spaces(pattern)).findall
        self.singles = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.pairs = PairRanks(ranks)
        self.first: dict[str, bytes] = {}  # words at a line's start
        self.later: dict[str, bytes] = {}  # words after a space

    def pieces(self, wanted: list[bytes]) -> dict[bytes, bytes]:
        """Ids, as 32-bit numbers, of each distinct piece."""
        out, rest = {}, {}
        for p in wanted:
            whole = self.ranks.get(p)
            if whole is not None:
                out[p] = whole.to_bytes(4, "little")
            else:
                rest.setdefault(max(1, (len(p) - 1).bit_length()), []).append(p)
        for bits, own in rest.items():
            most = max(1, min(ROWS, (1 << 21) >> bits))
            for i in range(0, len(own), most):
                part = own[i : i + most]
                for p, ids in zip(part, merge(part, self.singles, self.pairs), strict=True):
                    out[p] = ids.astype("<u4").tobytes()
        return out

    def learn(self, first: set[str], later: set[str]) -> None:
        """Puts the words that aren't there yet into the caches."""
        if len(self.first) + len(self.later) > CACHE_ENTRIES:
            self.first.clear()
            self.later.clear()
        jobs = [(self.first, w, [p.encode() for p in self.find(w)]) for w in first if w not in self.first]
        jobs += [(self.later, w, [p.encode() for p in self.find(" " + w)]) for w in later if w not in self.later]
        ids = self.pieces(list({p for _, _, own in jobs for p in own}))
        for cache, w, own in jobs:
            cache[w] = b"".join([ids[p] for p in own])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as little-endian 32-bit numbers.

        Where single spaces and line feeds stand between words, no piece crosses the start of a space or a line
        feed, so words are looked up one by one; other texts are split by the pattern as a whole.
        """
        split: list[list[list[str]] | None] = []
        first, later, odd = {""}, set(), {}
        for k, t in enumerate(texts):
            if t and t.replace("\n", " ") == " ".join(t.split()):
                lines = [line.split(" ") for line in t.split("\n")]
                for line in lines:
                    first.add(line[0])
                    later.update(line)
                split.append(lines)
            else:
                split.append(None)
                odd[k] = [p.encode() for p in self.find(t)]
        self.learn(first - {""}, later)
        ids = self.pieces(list({p for own in odd.values() for p in own}))
        feed = self.ranks[b"\n"].to_bytes(4, "little")
        out = []
        for k, lines in enumerate(split):
            if lines is None:
                out.append(b"".join([ids[p] for p in odd[k]]))
                continue
            parts: list[bytes] = []
            for line in lines:
                parts.append(self.first[line[0]])
                parts.extend(map(self.later.__getitem__, line[1:]))
                parts.append(feed)
            out.append(b"".join(parts[:-1]))
        return out


_encoders: dict[tuple, Encoder] = {}


def _encode(shared, pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for b in batches:
            if encoder is None:
                ranks = shared.value
                key = (len(ranks), pattern)
                if key not in _encoders:
                    _encoders.clear()
                    _encoders[key] = Encoder(ranks, pattern)
                encoder = _encoders[key]
            column, i = b.column(1), 0
            sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
            upto = np.cumsum(sizes)
            while i < len(column):
                j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + (1 << 21))))
                own = encoder.encode([t or "" for t in column.slice(i, j - i).to_pylist()])
                values = pa.array(np.frombuffer(b"".join(own), np.int32))
                offs = pa.array(np.concatenate([[0], np.cumsum([len(x) // 4 for x in own])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(offs, values)], names=["doc_id", "ids"])
                i = j

    return of


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): token ids of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_encode(shared, pattern), "doc_id long, ids array<int>")


def _decode(shared, digest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = {i: b for b, i in shared.value.items()}
        numbers = {i: str(i) for i in vocabulary}
        for b in batches:
            lists = b.column(1)
            values, offs = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            out, spelled, held, at = [], [], 0, 0
            for i in range(len(lists)):
                ids = values[offs[i] : offs[i + 1]].tolist() if lists[i].is_valid else []
                raw = b"".join(map(vocabulary.__getitem__, ids))
                out.append(hashlib.sha256(raw).hexdigest() if digest else raw)
                if digest:
                    spelled.append(hashlib.sha256(" ".join(map(numbers.__getitem__, ids)).encode()).hexdigest())
                held += len(raw)
                if i + 1 == len(lists) or held > 1 << 23:
                    cols = {"doc_id": b.column(0).slice(at, i + 1 - at)}
                    if digest:
                        cols |= {"n_tokens": pa.array(np.diff(offs[at : i + 2]).astype(np.int64)), "ids_sha256": pa.array(spelled), "decoded_sha256": pa.array(out)}
                    else:
                        cols["decoded"] = pa.array(out, pa.binary())
                    yield pa.RecordBatch.from_pydict(cols)
                    out, spelled, held, at = [], [], 0, i + 1

    return of


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, decoded): the bytes of each id list."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    return encoded.select("doc_id", "ids").mapInArrow(_decode(shared, False), "doc_id long, decoded binary")


def digests(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): hashes of the ids and of what they decode to."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    return encoded.select("doc_id", "ids").mapInArrow(_decode(shared, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
