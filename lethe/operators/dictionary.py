"""Dictionary matching: known values, catalog values, blacklists and custom phrases in text.

A substring join has no equi key.  A dictionary whose size is checked to be small enough is broadcast as one
multi-pattern automaton, which each task runs over its texts once and resolves overlaps there: no shuffle, no join.
A larger one is cut into a few such parts, a pass each.  Beyond MOST_PASSES parts each value is looked up by the one of its
grams that the texts have most seldom, of more than half its length, so that few values share one; texts give the grams that
pass a filter with what stands around them, Catalyst joins by gram and compares the whole value.

Lower case, where it is asked for, is taken character by character where that keeps the length, so places hold for the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed import TOKEN_SHAPE
from ..functions.spans import outside, resolve, token_spans
from ..functions.storage import materialized
from ..functions.sweep import FOUND, cuts, uncut, union_of

MOST_CHARACTERS = 1_000_000  # of the values in one automaton, which takes up to 100 bytes for each
MOST_PASSES = 8
GRAMS = (8, 4, 2, 1)  # characters of the grams by which values of at least that length are found
LONG_GRAMS = (64, 32, 16)  # those of longer values: many values of a large dictionary share their short grams
COUNTERS = 1 << 20  # in which the texts' grams of a size are counted
CHUNK = 1 << 15  # characters that are hashed at a time, whose arrays stay in a core's cache
MOST_FILTER_BITS = 1 << 31
PIECE = 1 << 18  # bytes of the pieces in which tasks hand over counts and filters
_BLOCK = 8 * PIECE  # bits of a piece; all bits of a gram lie in one
_SIZES = LONG_GRAMS + GRAMS
_HITS = 50_000  # rows of an output batch
_WORD, _TOKEN = re.compile(r"\w"), re.compile(TOKEN_SHAPE)


def folded(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low.replace("\u03c2", "\u03c3")


def folded_column(text: Column) -> Column:
    """folded() inside the JVM."""
    each = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(F.char_length(F.lower(c)) == F.char_length(c), F.lower(c)).otherwise(c)), "")
    return F.translate(F.when(F.char_length(F.lower(text)) == F.char_length(text), F.lower(text)).otherwise(each), "\u03c2", "\u03c3")


def _longest_first(hits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Hits (start, end, value) that don't meet, the longest first, then the earliest, then the least value."""
    kept: list[tuple[int, int, str]] = []
    for hit in sorted(hits, key=lambda h: (h[0] - h[1], h[0], h[2])):
        at = bisect_left(kept, hit)
        if (at == 0 or kept[at - 1][1] <= hit[0]) and (at == len(kept) or kept[at][0] >= hit[1]):
            kept.insert(at, hit)
    return kept


def _scan(shared, any_case: bool, resolved: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, text, values to skip in lower case, spans not to cut) to hits (id, start, end, value, spelled); resolved: those that stay, outside tokens."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        needles: dict[str, list[tuple[str, bool]]] = {}
        for value, whole in shared.value:
            needles.setdefault(folded(value) if any_case else value, []).append((value, whole))
        automaton = ahocorasick.Automaton()
        for needle, own in needles.items():
            automaton.add_word(needle, (len(needle), own))
        if not needles:
            return
        automaton.make_automaton()

        def hits_of(text: str, skip: frozenset[str], guarded: tuple[list[int], list[int]]) -> list[tuple[int, int, str]]:
            hits = []
            for last, (size, own) in automaton.iter(folded(text) if any_case else text):
                end = last + 1
                start, inner = end - size, None
                for value, whole in own:
                    if whole:
                        if inner is None:
                            inner = (start > 0 and _WORD.match(text[start - 1])) or (end < len(text) and _WORD.match(text[end]))
                        if inner:
                            continue
                    if guarded[0] and cuts(start, end, *guarded):
                        continue
                    if not skip or value.lower() not in skip:
                        hits.append((start, end, value))
            if resolved and hits:
                tokens = [m.span() for m in _TOKEN.finditer(text)] if "[" in text else []
                hits = _longest_first([h for h in hits if not any(a < h[1] and z > h[0] for a, z in tokens)] if tokens else hits)
            return hits

        for b in batches:
            kind, rows = b.schema.field(0).type, []

            def batch() -> pa.RecordBatch:
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind, pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["id", "start", "end", "value", "spelled"])

            for i, text, skip, guarded in zip(b.column(0), b.column(1), b.column(2), b.column(3), strict=True):
                text = text.as_py()
                if text:
                    key = i.as_py()
                    rows += [(key, s, e, v, text[s:e]) for s, e, v in hits_of(text, frozenset(skip.as_py() or ()), union_of([(g["start"], g["end"]) for g in guarded.as_py() or ()]))]
                if len(rows) >= _HITS:
                    yield batch()
                    rows = []
            if rows:
                yield batch()

    return of


def _found(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str, any_case: bool = False, resolved: bool = False, skip_col: str | None = None, guard_col: str | None = None) -> DataFrame:
    """(id, start, end, value, spelled) of terms (value, whole) in texts; resolved: longest first, outside tokens, without overlaps.

    guard_col: spans of each text that no hit cuts; hits that cover one stay.
    """
    own = materialized(terms.where("value <> ''").groupBy("value").agg(F.bool_and("whole").alias("whole")), "terms")
    size = own.agg(F.coalesce(F.sum(F.char_length("value")), F.lit(0))).first()[0]
    passes = max(1, -(-size // MOST_CHARACTERS))
    if passes > MOST_PASSES:
        found = _by_grams(docs, own, id_col, text_col, any_case)
        if skip_col:
            skipped = docs.select(id_col, F.col(skip_col).alias("_skip")).where(F.size("_skip") > 0)
            found = found.join(skipped, id_col, "left").where(F.col("_skip").isNull() | ~F.array_contains("_skip", F.lower("value"))).drop("_skip")
        return _resolved(docs, found, id_col, text_col, guard_col) if resolved else found
    skip = (F.col(skip_col) if skip_col else F.lit(None)).cast("array<string>").alias("skip")
    guard = (F.transform(guard_col, lambda g: F.struct(g["start"].alias("start"), g["end"].alias("end"))) if guard_col else F.lit(None).cast("array<struct<start:int,end:int>>")).alias("guard")
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), skip, guard)
    of = f"id {docs.schema[id_col].dataType.simpleString()}, start int, end int, value string, spelled string"
    out = None
    for k in range(passes):
        part = own if passes == 1 else own.where(F.pmod(F.xxhash64("value"), F.lit(passes)) == k)
        shared = docs.sparkSession.sparkContext.broadcast([(r["value"], r["whole"]) for r in part.collect()])
        one = texts.mapInArrow(_scan(shared, any_case, resolved and passes == 1), of)
        out = one if out is None else out.unionByName(one)
    out = out.withColumnRenamed("id", id_col)
    return _resolved(docs, out, id_col, text_col, guard_col) if resolved and passes > 1 else out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def gram_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all grams of `size` code points, a power of two: each of two halves."""
    return next(h for _, h in _hashes(codes, [size]))


def _hashes(codes: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """gram_hashes of several sizes, which grow."""
    h, step = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1
    for size in sizes:
        while step < size:
            wider = h[: max(len(h) - step, 0)] * np.uint64(0xD6E8FEB86659FD93)
            wider += h[step:]
            wider ^= wider >> np.uint64(29)
            h, step = wider, 2 * step
        out = h * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        yield size, out


def _sizes_of(lengths: np.ndarray) -> np.ndarray:
    """Characters of the grams by which values of these lengths are found."""
    sizes = np.array(_SIZES[::-1], np.int32)
    return sizes[np.searchsorted(sizes, lengths, "right") - 1]


def _pieces(arrays: np.ndarray, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """An array as rows (piece, part) of PIECE bytes, without those that are all zero."""
    flat = arrays.reshape(-1).view(np.uint8)
    at = [i for i in range(0, len(flat), PIECE) if flat[i : i + PIECE].any()]
    yield pa.RecordBatch.from_arrays([pa.array([i // PIECE for i in at], pa.int64()), pa.array([flat[i : i + PIECE].tobytes() for i in at], kind)], names=["piece", "part"])


def _merged(kind: type, merge: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            for i, part in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(part.as_buffer(), kind)
                parts[i] = merge(parts[i], x) if i in parts else x
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([x.tobytes() for x in parts.values()], pa.binary())], names=["piece", "part"])

    return of


def _together(pieces: DataFrame, kind: type, merge: Callable, size: int) -> np.ndarray:
    """The pieces of all tasks merged by Spark, piece by piece, and put together."""
    return _assembled(pieces.repartition("piece").mapInArrow(_merged(kind, merge), "piece long, part binary"), kind, size)


def _assembled(pieces: DataFrame, kind: type, size: int) -> np.ndarray:
    """Pieces put together: `size` numbers, whatever the data are.  They are written first, as the driver asks for one partition after another."""
    out = np.zeros(size, kind)
    flat = out.view(np.uint8)
    for r in materialized(pieces, "pieces").toLocalIterator():
        flat[r["piece"] * PIECE : r["piece"] * PIECE + len(r["part"])] = np.frombuffer(bytes(r["part"]), np.uint8)
    return out


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """First and last (exclusive) of texts that have together about CHUNK characters, one text at least."""
    first = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > CHUNK:
            yield first, i
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def _count_grams(sizes: list[int], any_case: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(sizes), COUNTERS), np.uint32)
        for b in batches:
            texts = b.column(0).to_pylist()
            for first, last in _chunks(texts):
                whole = "".join(texts[first:last])  # grams across two texts count too, which matters little
                for k, (_, h) in enumerate(_hashes(code_points(folded(whole) if any_case else whole), sizes)):
                    np.add.at(counts[k], (h & np.uint64(COUNTERS - 1)).view(np.int64), np.uint32(1))
        yield from _pieces(counts, pa.binary())

    return of


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts one after another, and the texts' places in them."""
    return code_points("".join(texts)), np.cumsum([0, *map(len, texts)])


def _anchor(shared, sizes: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (needle, ...) to (gram, size, offset, ...): the needle's gram that texts have most seldom, the first of equals."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value.reshape(len(sizes), COUNTERS)
        for b in batches:
            needles = b.column(0).to_pylist()
            gram, offset = np.zeros(len(needles), np.uint64), np.zeros(len(needles), np.int32)
            own = _sizes_of(np.array([len(n) for n in needles], np.int64))
            for k, size in enumerate(sizes):
                every = np.flatnonzero(own == size)
                texts = [needles[i] for i in every.tolist()]
                for first, last in _chunks(texts):
                    mine = every[first:last]
                    codes, offs = _joined(texts[first:last])
                    h = gram_hashes(codes, size)
                    at = np.arange(len(h), dtype=np.uint64)
                    seldom = counts[k].take((h & np.uint64(COUNTERS - 1)).view(np.int64)).astype(np.uint64)
                    across = np.zeros(len(codes) + 1, np.int8)  # grams across two needles start in the last size - 1 characters of one
                    across[offs[1:] - size + 1] += 1
                    across[offs[1:]] -= 1
                    seldom[np.cumsum(across[: len(h)]) > 0] = np.uint64(0xFFFFFFFF)
                    best = (np.minimum.reduceat((seldom << np.uint64(32)) | at, offs[:-1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
                    gram[mine], offset[mine] = h[best], best - offs[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(own), pa.array(offset), *b.columns], names=["gram", "size", "offset", *b.schema.names])

    return of


Layout = dict[int, tuple[int, int]]  # of each size of grams the first bit and the number of bits, a power of two, in the filter
_SHIFTS = (0, 7, 13, 23)  # of a gram's four bits


def _bit(h: np.ndarray, first: int, bits: int, shift: int) -> np.ndarray:
    """Place of one of a gram's bits, which lie in one block."""
    inside = min(bits, _BLOCK)
    block = (h >> np.uint64(54)) & np.uint64(bits // inside - 1)
    return np.uint64(first) + block * np.uint64(inside) + (((h >> np.uint64(shift)) * np.uint64(0x94D049BB133111EB) >> np.uint64(20)) & np.uint64(inside - 1))


def _piece(layout: Layout) -> Column:
    """The piece of the filter that holds a gram's bits."""
    out = F.lit(None).cast("long")
    for size, (first, bits) in layout.items():
        out = F.when(F.col("size") == size, first // _BLOCK + F.shiftrightunsigned("gram", 54).bitwiseAND(F.lit(max(bits // _BLOCK, 1) - 1))).otherwise(out)
    return out


def _fill(layout: Layout) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (piece, gram, size), whole pieces in order, to the pieces of the filter."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part = None, np.zeros(0, np.uint8)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["piece", "part"])

        for b in batches:
            pieces, h, own = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy()
            ends = np.flatnonzero(np.diff(pieces)) + 1
            for start, end in zip([0, *ends.tolist()], [*ends.tolist(), len(pieces)], strict=True):
                if start == end:
                    continue
                if pieces[start] != now:
                    if now is not None:
                        yield done()
                    now, part = int(pieces[start]), np.zeros(PIECE, np.uint8)
                for size in np.unique(own[start:end]).tolist():
                    mine = h[start:end][own[start:end] == size]
                    for at in (_bit(mine, *layout[size], s) & np.uint64(_BLOCK - 1) for s in _SHIFTS):
                        np.bitwise_or.at(part, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        if now is not None:
            yield done()

    return of


def _seek(shared, layout: Layout, any_case: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, text) to (id, gram, at, lead, around, spelled) of the grams that the filter lets through.

    around: the text from `lead` characters before the gram, a gram's length at most, to a gram's length behind it; spelled:
    the same as the text has it, null if no case is folded.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            plain = b.column(1).to_pylist()
            texts = [folded(t) for t in plain] if any_case else plain
            places: list[tuple[np.ndarray, ...]] = []
            around: list[str] = []
            spelled: list[str | None] = []

            def found() -> pa.RecordBatch:
                row, gram, at, lead = (np.concatenate(x) for x in zip(*places, strict=True))
                columns = [pa.array(gram.view(np.int64)), pa.array(at.astype(np.int32)), pa.array(lead.astype(np.int32)), pa.array(around, pa.string()), pa.array(spelled, pa.string())]
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), *columns], names=["id", "gram", "at", "lead", "around", "spelled"])

            for first, last in _chunks(texts):
                codes, offs = _joined(texts[first:last])
                whole, own = "".join(texts[first:last]), "".join(plain[first:last])
                for size, h in _hashes(codes, sorted(layout)):
                    at = None
                    for shift in _SHIFTS:  # most grams are gone after the first bit
                        x = _bit(h if at is None else h[at], *layout[size], shift)
                        some = np.flatnonzero(bits.take((x >> np.uint64(3)).view(np.int64)) >> (x & np.uint64(7)).astype(np.uint8) & 1)
                        at = some if at is None else at[some]
                    row = np.searchsorted(offs, at, "right") - 1
                    inside = at + size <= offs[row + 1]
                    at, row = at[inside], row[inside]
                    for k in range(0, len(at), _HITS):
                        some, text = at[k : k + _HITS], row[k : k + _HITS]
                        lead = np.minimum(some - offs[text], size)
                        places.append((text + first, h[some], some - offs[text], lead))
                        ends = zip((some - lead).tolist(), np.minimum(some + 2 * size, offs[text + 1]).tolist(), strict=True)
                        seen = [slice(*x) for x in ends]
                        around += [whole[x] for x in seen]
                        spelled += [own[x] if any_case else None for x in seen]
                        if len(around) >= _HITS:
                            yield found()
                            places, around, spelled = [], [], []
            if places:
                yield found()

    return of


@F.arrow_udf(T.BooleanType())
def _in_word(characters: pa.Array) -> pa.Array:
    """Whether one of the characters belongs to a word."""
    return pa.array([bool(_WORD.search(c)) for c in characters.to_pylist()], pa.bool_())


def _verify(any_case: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, text, hits) to (id, start, end, value, spelled) of the hits that the text has."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, text, hits in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                own = folded(text) if any_case else text
                for h in hits.as_py():
                    start, end = h["start"], h["start"] + len(h["needle"])
                    if own[start:end] != h["needle"] or (h["whole"] and ((start and _WORD.match(text[start - 1])) or (end < len(text) and _WORD.match(text[end])))):
                        continue
                    rows.append((key, start, end, h["value"], text[start:end]))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (b.schema.field(0).type, pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["id", "start", "end", "value", "spelled"])

    return of


def filter_bits(grams: int) -> int:
    """Size of the filter of dictionary grams: 16 to 32 bits for each, MOST_FILTER_BITS at most (then more grams pass in vain)."""
    return min(MOST_FILTER_BITS, max(1 << 16, 1 << (16 * grams).bit_length()))


def filter_layout(grams: dict[int, int]) -> Layout:
    """The filter's parts for the grams of each size, by their numbers, together twice filter_bits at most; the largest first, so
    that each lies at a multiple of its own size."""
    every = max(1, sum(grams.values()))
    share = {size: max(1 << 16, 1 << (filter_bits(every) * n // every - 1).bit_length()) for size, n in grams.items()}
    out, first = {}, 0
    for size in sorted(share, key=lambda s: (-share[s], s)):
        out[size] = first, share[size]
        first += share[size]
    return out


def candidate_grams(docs: DataFrame, terms: DataFrame, any_case: bool) -> tuple[DataFrame, DataFrame]:
    """Grams of docs (id, text) that may belong to a value (as of _seek), and the values' anchors (gram, size, offset, needle, whole, value)."""
    spark = docs.sparkSession
    own = terms.select((folded_column(F.col("value")) if any_case else F.col("value")).alias("needle"), *(["value"] if any_case else []), "whole")
    lengths = own.select(F.least(F.char_length("needle"), F.lit(_SIZES[0])).alias("n")).distinct().collect()
    sizes = sorted(set(_sizes_of(np.array([r["n"] for r in lengths], np.int64)).tolist()))
    counts = _together(docs.select("text").mapInArrow(_count_grams(sizes, any_case), "piece long, part binary"), np.uint32, np.add, len(sizes) * COUNTERS)
    shared = spark.sparkContext.broadcast(counts)
    anchors = materialized(own.mapInArrow(_anchor(shared, sizes), "gram long, size int, offset int, needle string, " + ("value string, " if any_case else "") + "whole boolean"), "anchors")
    anchors = anchors if any_case else anchors.withColumn("value", F.col("needle"))
    layout = filter_layout({r["size"]: r["count"] for r in anchors.groupBy("size").count().collect()})
    filled = anchors.select(_piece(layout).alias("piece"), "gram", "size").repartition("piece").sortWithinPartitions("piece").mapInArrow(_fill(layout), "piece long, part binary")
    bits = spark.sparkContext.broadcast(_assembled(filled, np.uint8, -(-sum(n for _, n in layout.values()) // _BLOCK) * PIECE))
    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(_seek(bits, layout, any_case), f"id {kind}, gram long, at int, lead int, around string, spelled string"), anchors


def _by_grams(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str, any_case: bool) -> DataFrame:
    """A dictionary of any size: each value is anchored at the gram that the texts have most seldom, by counts of all their
    grams; a bit filter of the anchors lets few of the texts' grams through, which Catalyst joins to the values that stand
    around them.  Values too long to be seen there are compared by their texts.  Counts and filter have a bounded size."""
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    grams, anchors = candidate_grams(texts, terms, any_case)
    length, inner = F.char_length("needle"), F.col("lead") - F.col("offset")
    far = length >= 2 * _SIZES[0]
    hits = grams.join(anchors, "gram").withColumn("start", F.col("at") - F.col("offset")).where("start >= 0").where(far | (F.substring("around", inner + 1, length) == F.col("needle")))
    kinds = terms.agg(F.max(F.char_length("value")) >= 2 * _SIZES[0], F.bool_or("whole")).first()
    if kinds[0]:
        hits = materialized(hits, "hits")
    near = hits.where(~far)
    spelled = F.col("spelled") if any_case else F.col("around")
    if kinds[1]:
        ends = F.concat(F.when(inner > 0, F.substring(spelled, inner, F.lit(1))).otherwise(""), F.substring(spelled, inner + length + 1, F.lit(1)))
        near = near.where(~F.col("whole") | ~_in_word(ends))
    found = near.select("id", "start", (F.col("start") + length).alias("end"), "value", F.substring(spelled, inner + 1, length).alias("spelled"))
    if kinds[0]:
        per_doc = hits.where(far).groupBy(F.col("id").alias("_id")).agg(F.collect_set(F.struct("start", "value", "whole", "needle")).alias("hits"))
        joined = texts.join(per_doc, F.col("id").eqNullSafe(F.col("_id"))).select("id", "text", "hits")
        kind = docs.schema[id_col].dataType.simpleString()
        found = found.unionByName(joined.mapInArrow(_verify(any_case), f"id {kind}, start int, end int, value string, spelled string"))
    return found.withColumnRenamed("id", id_col)


def occurrences_by_grams(docs: DataFrame, values: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_words: bool = False, any_case: bool = False) -> DataFrame:
    """occurrences() by the way for dictionaries beyond MOST_PASSES automatons, at any size."""
    terms = materialized(values.where("value <> ''").select("value", F.lit(whole_words).alias("whole")).distinct(), "terms")
    return _by_grams(docs, terms, id_col, text_col, any_case).drop("spelled")


def occurrences(docs: DataFrame, values: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_words: bool = False, any_case: bool = False) -> DataFrame:
    """(id, start, end, value): every place of every distinct value that isn't empty.

    whole_words: no word character next to the value.  any_case: by lower case; value is then the dictionary's.
    """
    return _found(docs, values.select("value", F.lit(whole_words).alias("whole")), id_col, text_col, any_case).drop("spelled")


def matches(docs: DataFrame, values: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_words: bool = False, any_case: bool = False) -> DataFrame:
    """Occurrences that don't meet, longest first and never inside tokens."""
    return _found(docs, values.select("value", F.lit(whole_words).alias("whole")), id_col, text_col, any_case, resolved=True).drop("spelled")


def known_values(docs: DataFrame, values: DataFrame, excluded: DataFrame | None = None, short: int = 5, id_col: str = "doc_id", text_col: str = "text", skip_col: str | None = None, guard_col: str | None = None) -> DataFrame:
    """Places of known values (value): durable ones, those shorter than `short` as whole words only.

    P12: none of `excluded` (value, any case), and none of those in a text's own array skip_col (lower case).
    guard_col: a text's spans of which no value takes a part only.
    """
    own = values.where(F.char_length(F.trim("value")) >= 2).select("value").distinct()
    if excluded is not None:
        own = own.join(excluded.select(F.lower("value").alias("_x")).distinct(), F.lower("value") == F.col("_x"), "left_anti")
    terms = own.select("value", (F.char_length("value") < short).alias("whole"))
    return _found(docs, terms, id_col, text_col, resolved=True, skip_col=skip_col, guard_col=guard_col).drop("spelled")


def _resolved(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, guard_col: str | None = None) -> DataFrame:
    """The hits of each text that stay.  One that is alone in a text without tokens and guarded spans does, without being handed to the functions on lists."""
    tokens = docs.where(F.contains(F.col(text_col), F.lit("["))).select(id_col, token_spans(F.col(text_col)).alias("_tokens"))
    spans = found.groupBy(id_col).agg(F.collect_list(F.struct("start", "end", F.col("value").alias("label"), F.lit(9).alias("stage"), F.col("spelled").alias("value"))).alias("_spans")).join(tokens, id_col, "left")
    own, alone = F.col("_spans"), (F.size("_spans") == 1) & F.col("_tokens").isNull()
    if guard_col:
        spans = spans.join(docs.where(F.size(guard_col) > 0).select(id_col, F.col(guard_col).alias("_guard")), id_col, "left")
        own, alone = uncut(own, F.coalesce("_guard", F.array().cast(FOUND))), alone & F.col("_guard").isNull()
    spans = materialized(spans, "spans")
    free = outside(own, F.coalesce("_tokens", F.array().cast(FOUND)))
    kept = spans.where(~alone).select(id_col, F.explode(resolve(free, "length")).alias("s"))
    kept = kept.unionByName(spans.where(alone).select(id_col, F.get("_spans", F.lit(0)).alias("s")))
    return kept.select(id_col, "s.start", "s.end", F.col("s.label").alias("value"), F.col("s.value").alias("spelled"))


def custom_values(docs: DataFrame, values: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Places of given phrases as they are; phrases that don't occur give no row."""
    return matches(docs, values, id_col, text_col).withColumn("label", F.lit("SENSITIVE"))


def blacklist_hits(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, term, value): whole words in any case, with the text's own spelling."""
    found = _found(docs, terms.select(F.col("term").alias("value"), F.lit(True).alias("whole")), id_col, text_col, any_case=True, resolved=True)
    return found.select(id_col, "start", "end", F.col("value").alias("term"), F.col("spelled").alias("value"))


def value_counts(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """How often each value stands in each text."""
    return found.groupBy(id_col, "value").agg(F.count("*").alias("n"))


def rank_longest(values: DataFrame) -> DataFrame:
    """K5: values with their place when the longest come first, ties by value; null has none.

    Values are dealt by ranges of length and value, and counts of the ranges before give the offsets, so values of one
    length don't meet in one task.
    """
    sized = values.where("value is not null").select("value", F.char_length("value").alias("size")).distinct()
    ranged = materialized(sized.repartitionByRange(F.desc("size"), F.asc("value")).withColumn("part", F.spark_partition_id()), "ranked")
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = ranged.withColumn("place", F.row_number().over(W.partitionBy("part").orderBy(F.desc("size"), "value")))
    return own.join(before, "part").select("value", (F.col("before") + F.col("place")).alias("rank"))
