"""Windows of fixed length that occur earlier in the corpus, found without emitting each window.

1. Each task turns its texts into super-windows (see superwindows.py).  Equal runs of one batch
   are reduced to the earliest; the others are repeats already.  Runs are dealt by minimizer.
2. Each task drops the minimizers met once.  Of equal runs the earliest is passed on with its text, the others
   as copies of it without text.
3. The runs' symbols are fetched, dealt and sorted by minimizer, and cut into shards of about SHARD_BYTES between
   minimizers.  A resolver (a suffix sort or an FM-index) over a shard finds the earliest equal of every window; by it
   the windows of runs and of their copies are judged.

A minimizer with more than HOT distinct runs is never gathered: its windows are dealt one by
one by their whole content, again reduced to the earliest of each batch, and its copies are repeats already.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .superwindows import runs
from .textblocks import Rolling, blocks, byte_rolling, mix, words

HOT = 4096  # distinct runs of one minimizer in one task's input
HOT_IN_BATCH = 256  # the same in one batch
SHARD_BYTES = 1 << 22

_RUNS = "kind byte, key long, print long, doc long, start int, count int, place int"
_SETTLED = "kind byte, key long, alike int, doc long, start int, count int, place int"
_PIECES = "key long, alike int, doc long, start int, count int, place int, seg binary"
_REPEATS = "doc long, start int, count int"
REPEAT, RUN, HOT_RUN, MARK, COPY = range(5)
LONE, DONE = -1, -2  # in place of a run's number: a window of its own, a repeat


class Unit(NamedTuple):
    """What a symbol is: bytes, or words by hash."""

    words: bool
    length: int
    gram: int
    within: bool  # an earlier start in the same document counts as earlier


class Pieces(NamedTuple):
    """Runs of one task with their symbols, sorted by (doc, start)."""

    key: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    count: np.ndarray
    place: np.ndarray
    seg: list[bytes]


def _batch(schema_of: list[tuple[str, pa.DataType]], **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := cols[n], pa.Array) else pa.array(c, t) for n, t in schema_of], names=[n for n, _ in schema_of])


_T_RUNS = [("kind", pa.int8()), ("key", pa.int64()), ("print", pa.int64()), ("doc", pa.int64()), ("start", pa.int32()), ("count", pa.int32()), ("place", pa.int32())]
_T_SETTLED = [("alike", pa.int32()) if x[0] == "print" else x for x in _T_RUNS]
_T_PIECES = [("key", pa.int64()), ("alike", pa.int32()), ("doc", pa.int64()), ("start", pa.int32()), ("count", pa.int32()), ("place", pa.int32()), ("seg", pa.binary())]
_T_REPEATS = [("doc", pa.int64()), ("start", pa.int32()), ("count", pa.int32())]


def _starts(mask_new: np.ndarray) -> np.ndarray:
    """Index of the first row of each row's group."""
    first = np.flatnonzero(mask_new)
    return first[np.cumsum(mask_new) - 1]


def _later(doc: np.ndarray, start: np.ndarray, first: np.ndarray, within: bool) -> np.ndarray:
    """Rows that come after the first row of their group; a repeated input row is not later than itself."""
    later = doc > doc[first]
    return later | ((doc == doc[first]) & (start > start[first])) if within else later


def _find_runs(unit: Unit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            parts = []
            for i, _, data, offs in blocks(batch.column(1)):
                if unit.words:
                    _, _, offs, hashes = words(data, offs)
                    rolling = Rolling(hashes)
                else:
                    rolling = byte_rolling(data)
                r = runs(rolling, offs, unit.length, unit.gram)
                parts.append((ids[r.row + i], r.start, r.count, r.key.view(np.int64), r.print.view(np.int64), r.place))
            if not parts:
                continue
            doc, start, count, key, prints, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            o = np.lexsort((start, doc, prints, key))
            doc, start, count, key, prints, place = (x[o] for x in (doc, start, count, key, prints, place))
            new_key = np.ones(len(o), bool)
            new_key[1:] = key[1:] != key[:-1]
            new = new_key.copy()
            new[1:] |= prints[1:] != prints[:-1]
            kind = np.full(len(o), RUN, np.int8)
            kind[_later(doc, start, _starts(new), unit.within)] = REPEAT
            group = np.cumsum(new_key) - 1
            many = np.bincount(group, weights=new & (kind == RUN), minlength=1) > HOT_IN_BATCH
            hot = many[group] & (kind == RUN) if len(o) else np.zeros(0, bool)
            marks = np.flatnonzero(hot & new_key)
            kind[hot] = HOT_RUN
            dealt = np.where(kind == RUN, key, mix(doc.view(np.uint64) if doc.dtype == np.int64 else doc.astype(np.int64).view(np.uint64)).view(np.int64))
            yield _batch(_T_RUNS, kind=kind, key=dealt, print=prints, doc=doc, start=start, count=count, place=place)
            if len(marks):
                yield _batch(_T_RUNS, kind=np.full(len(marks), MARK, np.int8), key=key[marks], print=prints[marks], doc=doc[marks], start=start[marks], count=count[marks], place=place[marks])

    return of


def _settle(unit: Unit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
            own = cols[0] >= 0
            away = (cols[0] == REPEAT) | (cols[0] == HOT_RUN)
            if away.any():
                yield _batch(_T_SETTLED, alike=np.zeros(int(away.sum()), np.int32), **{n: cols[i][away] for n, i in (("kind", 0), ("key", 1), ("doc", 3), ("start", 4), ("count", 5), ("place", 6))})
            own &= ~away
            parts.append([c[own] for c in cols])
        if not parts:
            return
        kind, key, prints, doc, start, count, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        o = np.lexsort((start, doc, prints, key))
        kind, key, prints, doc, start, count, place = (x[o] for x in (kind, key, prints, doc, start, count, place))
        new_key = np.ones(len(o), bool)
        new_key[1:] = key[1:] != key[:-1]
        new = new_key.copy()
        new[1:] |= prints[1:] != prints[:-1]
        later = _later(doc, start, _starts(new), unit.within)
        group = np.cumsum(new_key) - 1
        distinct = np.bincount(group, weights=new, minlength=1)
        marked = np.bincount(group, weights=kind == MARK, minlength=1) > 0
        hot = marked | (distinct > HOT)
        several = (distinct > 1) | marked | (np.bincount(group, weights=later, minlength=1) > 0)
        out = np.full(len(o), -1, np.int8)
        number = np.cumsum(new)
        if len(o):
            out[several[group]] = RUN
            out[later] = COPY
            out[hot[group] & (out == RUN)] = HOT_RUN
            out[hot[group] & (out == COPY)] = REPEAT
            out[kind == MARK] = -1
            number -= number[_starts(new_key)]
        keep = out >= 0
        yield _batch(_T_SETTLED, kind=out[keep], key=key[keep], alike=number[keep].astype(np.int32), doc=doc[keep], start=start[keep], count=count[keep], place=place[keep])

    return of


def _symbols(unit: Unit, text: str) -> Callable[[int, int], bytes]:
    raw = text.encode()
    if not unit.words:
        return lambda a, b: raw[a:b]
    own = raw.split()
    return lambda a, b: b" ".join(own[a:b])


def _fetch(unit: Unit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (doc, text, runs) become pieces; windows of hot runs become pieces of their own."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists = b.column(0).to_pylist(), b.column(2)
            flat = lists.flatten()
            sizes = np.diff(lists.offsets.to_numpy())
            key, alike, start, count, place, hot = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("key", "alike", "start", "count", "place", "hot"))
            out: list[tuple] = []
            least: dict[bytes, tuple[int, int]] = {}
            at = 0
            for doc, text, n in zip(ids, b.column(1), sizes, strict=True):
                cut = _symbols(unit, text.as_py() or "")
                for x in range(at, at + n):
                    s, c = int(start[x]), int(count[x])
                    if not hot[x]:
                        out.append((int(key[x]), doc, s, c, int(place[x]), cut(s, s + c + unit.length - 1), int(alike[x])))
                        continue
                    for w in range(s, s + c):
                        seg = cut(w, w + unit.length)
                        seen = least.get(seg)
                        if seen is None:
                            least[seg] = (doc, w)
                        elif (doc, w) < seen:
                            least[seg] = (doc, w)
                            out.append((hash(seen), *seen, 1, 0, None) if unit.within or seen[0] > doc else (None, *seen, 1, 0, seg))
                        elif (doc, w) > seen:
                            out.append((hash((doc, w)), doc, w, 1, 0, None) if unit.within or doc > seen[0] else (None, doc, w, 1, 0, seg))
                at += n
            out += [(None, doc, w, 1, 0, seg) for seg, (doc, w) in least.items()]
            segs = [o[5] for o in out]
            lone = [i for i, o in enumerate(out) if o[0] is None]
            keys = [o[0] for o in out]
            if lone:
                joined = pa.array([segs[i] for i in lone], pa.binary())
                offs = np.frombuffer(joined.buffers()[1], np.int32)[: len(lone) + 1].astype(np.int64)
                hashes = byte_rolling(np.frombuffer(joined.buffers()[2], np.uint8)[: offs[-1]]).spans(offs[:-1], offs[1:]).view(np.int64)
                for i, h in zip(lone, hashes.tolist(), strict=True):
                    keys[i] = h
            numbers = [o[6] if len(o) > 6 else LONE if o[5] is not None else DONE for o in out]
            yield _batch(_T_PIECES, key=keys, alike=numbers, doc=[o[1] for o in out], start=[o[2] for o in out], count=[o[3] for o in out], place=[o[4] for o in out], seg=segs)

    return of


def _spans(doc: np.ndarray, start: np.ndarray, count: np.ndarray, late: np.ndarray) -> pa.RecordBatch:
    """Runs of late windows; late holds a flag of each window of each row."""
    row = np.repeat(np.arange(len(count)), count)
    window = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = np.flatnonzero(late)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
    first = at[new]
    return _batch(_T_REPEATS, doc=doc[row[first]], start=(start[row[first]] + window[first]).astype(np.int32), count=np.diff(np.append(np.flatnonzero(new), len(at))).astype(np.int32))


def _behind(unit: Unit, doc: np.ndarray, start: np.ndarray, count: np.ndarray, first_doc: np.ndarray, first_start: np.ndarray) -> np.ndarray:
    """Of each window of the rows whether its earliest equal comes before it."""
    own = np.repeat(doc, count)
    late = own > first_doc
    if unit.within:
        window = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        late |= (own == first_doc) & (np.repeat(start, count) + window > first_start)
    return late


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """A task's rows in order of key, cut between keys."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size < most or not b.num_rows:
            continue
        key = b.column(0).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(key, key[-1], "left"))
        if cut or (len(held) > 1 and held[-2].num_rows and held[-2].column(0)[-1].as_py() != key[0]):
            yield [*held[:-1], b.slice(0, cut)]
            held = [b.slice(cut)]
            size = held[0].nbytes
    if held:
        yield held


def _resolve(unit: Unit, resolver: Callable[[Pieces, Unit], tuple[np.ndarray, np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """resolver: document and start of the earliest equal of each window of each piece."""

    def judged(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, copies, segs = [], [], []
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            bare = b.column(6).is_null().to_numpy(zero_copy_only=False)
            done = bare & (cols[1] == DONE)
            if done.any():
                yield _batch(_T_REPEATS, doc=cols[2][done], start=cols[3][done], count=cols[4][done])
            parts.append([c[~bare] for c in cols])
            copies.append([c[bare & ~done] for c in cols[:5]])
            segs += b.column(6).drop_null().to_pylist()
        if not segs:
            return
        key, alike, doc, start, count, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        o = np.lexsort((start, doc))
        pieces = Pieces(key[o], doc[o], start[o].astype(np.int64), count[o].astype(np.int64), place[o].astype(np.int64), [segs[i] for i in o])
        alike = alike[o]
        first_doc, first_start = resolver(pieces, unit)
        yield _spans(pieces.doc, pieces.start, pieces.count, _behind(unit, pieces.doc, pieces.start, pieces.count, first_doc, first_start))
        key, number, doc, start, count = (np.concatenate(x) for x in zip(*copies, strict=True))
        if not len(key):
            return
        # Copies find the piece of their minimizer and number; its windows' earliest equals are theirs too.
        n = len(alike)
        both, numbers = np.concatenate([pieces.key, key]), np.concatenate([alike, number])
        o = np.lexsort((np.arange(len(both)), numbers, both))
        new = np.ones(len(o), bool)
        new[1:] = (both[o][1:] != both[o][:-1]) | (numbers[o][1:] != numbers[o][:-1])
        piece = np.empty(len(o), np.int64)
        piece[o] = o[_starts(new)]
        piece = piece[n:]
        before = np.cumsum(pieces.count) - pieces.count
        count = count.astype(np.int64)
        for lo in range(0, len(piece), 1 << 16):
            p, c = piece[lo : lo + (1 << 16)], count[lo : lo + (1 << 16)]
            at = np.repeat(before[p] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
            d, s = doc[lo : lo + (1 << 16)], start[lo : lo + (1 << 16)].astype(np.int64)
            yield _spans(d, s, c, _behind(unit, d, s, c, first_doc[at], first_start[at]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, SHARD_BYTES):
            yield from judged(shard)

    return of


def repeated_windows(docs: DataFrame, unit: Unit, resolver: Callable) -> DataFrame:
    """docs (doc, body) -> runs of window starts (doc, start, count) that repeat an earlier window.

    Rows whose doc is null take no part.  Repeated input rows are one occurrence.
    """
    docs = docs.where("doc is not null").select("doc", "body")
    found = docs.mapInArrow(_find_runs(unit), _RUNS).repartition("key").mapInArrow(_settle(unit), _SETTLED)
    settled = written(found, "runs")
    wanted = settled.where(F.col("kind").isin(RUN, HOT_RUN)).groupBy("doc").agg(F.collect_list(F.struct("key", "alike", "start", "count", "place", (F.col("kind") == HOT_RUN).alias("hot"))).alias("runs"))
    pieces = docs.join(wanted, "doc").select("doc", "body", "runs").mapInArrow(_fetch(unit), _PIECES)
    copies = settled.where(F.col("kind") == COPY).select("key", "alike", "doc", "start", "count", "place", F.lit(None).cast("binary").alias("seg"))
    resolved = pieces.unionByName(copies).repartition("key").sortWithinPartitions("key").mapInArrow(_resolve(unit, resolver), _REPEATS)
    return settled.where(F.col("kind") == REPEAT).select("doc", "start", "count").unionByName(resolved)
