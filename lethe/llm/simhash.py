"""SimHash near-dedup over a hierarchical Hamming index in Gray order.

1. Each text gets a 64-bit fingerprint: bit by bit the majority of the XXH64 of its word shingles.  Equal fingerprints
   have one representative, the smallest document.
2. Two fingerprints that differ in at most 3 bits agree on at least one of 4 disjoint sets of bits.  Representatives are
   dealt once for each set, by the bits' values, so a link's ends meet in a group.
3. A group of more than GROUP members is dealt again by 4 sets of the bits that its members don't share yet, until all
   groups are small.  Members are distinct, so a group whose members share all but a few bits can't be large.
4. A task builds a Gray-order index over its groups, searches it for each member, and gives for each component
   of a group the links of its members to the smallest one: fewer than the group has members.  Components of these links
   are those of all links.

Defined results: a null or empty text, or one without words, has fingerprint zero and is linked like any other; fewer
words than `size` make one shingle; rows with null doc_id are their own component (null); repeated rows (same id) get
the same result if their texts are equal, and are linked by each of their texts if not; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .gray_index import GrayIndex, gray_rank, least_members
from .scratch import written
from .textblocks import blocks, lower_ascii, word_bounds

SIZE = 3
SEED = 42
BITS_APART = 3
GROUP = 1024  # members that are searched together
_SHINGLES = 1 << 18  # hashed at once

#: The bits of a byte spread over the bytes of a 64-bit word, first bit in the lowest byte.
_SPREAD = sum(((np.arange(256, dtype=np.uint64) >> np.uint64(i)) & np.uint64(1)) << np.uint64(8 * i) for i in range(8))


def joined_words(data: np.ndarray, offs: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """A block's words in lower case, each followed by one space; their starts and ends; row offsets into the words."""
    starts, ends, rows = word_bounds(data, offs)
    sizes = ends - starts
    upto = np.cumsum(sizes)
    at = upto - sizes + np.arange(len(sizes))
    out = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
    letter = np.arange(int(sizes.sum()))
    out[letter + np.repeat(np.arange(len(sizes)), sizes)] = lower_ascii(data)[letter + np.repeat(starts - upto + sizes, sizes)]
    return out.tobytes(), at, at + sizes, rows


def bit_sums(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in each stretch of hashes: bytes of up to 255 hashes are added up side by side."""
    count = np.diff(bounds)
    some = np.flatnonzero(count)
    out = np.zeros((len(count), 64), np.int64)
    if not len(some):
        return out
    parts = -(-count[some] // 255)
    first = np.repeat(bounds[some], parts) + 255 * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    each = hashes.view(np.uint8).reshape(-1, 8)
    sums = np.stack([np.add.reduceat(_SPREAD[each[:, i]], first) for i in range(8)], axis=1)
    out[some] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 64), np.cumsum(parts) - parts, axis=0, dtype=np.int64)
    return out


def fingerprints(data: np.ndarray, offs: np.ndarray, size: int = SIZE) -> np.ndarray:
    """64-bit fingerprints of a block's texts."""
    text, starts, ends, rows = joined_words(data, offs)
    words = np.diff(rows)
    count = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    row = np.repeat(np.arange(len(words)), count)
    first = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + rows[:-1][row]
    last = first + np.minimum(words, size)[row] - 1
    view, digest = memoryview(text), xxhash.xxh64_intdigest
    sums = np.zeros((len(words), 64), np.int64)
    bounds = np.concatenate([[0], np.cumsum(count)])
    for lo in range(0, len(row), _SHINGLES):
        hi = min(lo + _SHINGLES, len(row))
        spans = zip(starts[first[lo:hi]].tolist(), ends[last[lo:hi]].tolist(), strict=True)
        hashes = np.fromiter((digest(view[s:e], SEED) for s, e in spans), np.uint64, hi - lo)
        sums += bit_sums(hashes, np.clip(bounds, lo, hi) - lo)
    bits = (2 * sums > count[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def _prints(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in blocks(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(fingerprints(data, offs, size).view(np.int64))], names=["doc", "print"])

    return of


def quarters(mask: int, parts: int) -> list[int]:
    """The bits of a mask in `parts` disjoint sets of about equal size."""
    bits = [i for i in range(64) if mask >> i & 1]
    cut = [len(bits) * k // parts for k in range(parts + 1)]
    return [sum(1 << i for i in bits[a:z]) for a, z in zip(cut[:-1], cut[1:], strict=True)]


def _deal(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, free, print, doc) to one row for each set of the free bits: the key of its values and the bits then left."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, free, prints = (b.column(i).to_numpy().astype(np.int64).view(np.uint64) for i in range(3))
            for k in range(most + 1):
                taken = np.zeros(len(free), np.uint64)
                for mask in np.unique(free):
                    taken[free == mask] = quarters(int(mask), most + 1)[k]
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (key, taken, prints & taken, free & ~taken)] + [b.column(2), b.column(3)], names=["key", "taken", "value", "free", "print", "doc"])

    return of


def dealt(members: DataFrame, most: int) -> DataFrame:
    """members (key, free, print, doc) dealt by sets of their free bits; a key that two groups share by chance only makes one of them larger."""
    rows = members.select("key", "free", "print", "doc").mapInArrow(_deal(most), "key long, taken long, value long, free long, print long, doc long")
    return rows.select(F.xxhash64("key", "taken", "value").alias("key"), "free", "print", "doc")


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that end where a key ends, of rows in order of key."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1], "left"))
        if cut or (held and held[-1].column(0)[0].as_py() != key[0]):
            yield pa.concat_batches([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.concat_batches(held)


def _link(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, print, doc) in order of key to the links (a, b) of each group's components."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _whole_groups(batches):
            key, codes, doc = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy()
            order = np.lexsort([gray_rank(codes), key])
            key, codes, doc = key[order], codes[order], doc[order]
            bounds = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            near = GrayIndex(codes, bounds).pairs(most)
            least = doc[least_members(len(doc), *near, doc)]
            linked = least != doc
            if linked.any():
                yield pa.RecordBatch.from_arrays([pa.array(least[linked]), pa.array(doc[linked])], names=["a", "b"])

    return of


def links(firsts: DataFrame, most: int = BITS_APART, group: int = GROUP) -> DataFrame:
    """firsts (print, doc), prints distinct, to links (a, b) of documents, with the components of all links."""
    members, found = firsts.select(F.lit(0).cast("long").alias("key"), F.lit(-1).cast("long").alias("free"), "print", "doc"), []
    while True:
        rows = dealt(members, most)
        sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        sized = rows.join(sizes, "key")
        small = sized.where((F.col("n") <= group) | (F.bit_count("free") <= most)).select("key", "print", "doc")
        found.append(small.repartition("key").sortWithinPartitions("key").mapInArrow(_link(most), "a long, b long"))
        members = written(sized.where((F.col("n") > group) & (F.bit_count("free") > most)).select("key", "free", "print", "doc"), "members")
        if not members.limit(1).count():
            return reduce(DataFrame.unionByName, found).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, most: int = BITS_APART) -> DataFrame:
    """(doc, print, component) of each row: fingerprint, and the smallest document reachable over links."""
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    prints = written(own.mapInArrow(_prints(size), "doc long, print long"), "prints")
    firsts = written(prints.where("doc is not null").groupBy("print").agg(F.min("doc").alias("doc")), "firsts")
    # Documents whose rows have several texts link their fingerprints.
    several = prints.where("doc is not null").groupBy("doc").agg(F.min("print").alias("lo"), F.max("print").alias("hi")).where("lo < hi").select("doc")
    bridges = prints.join(several, "doc").join(firsts.withColumnRenamed("doc", "first"), "print").where("doc <> first").select(F.col("first").alias("a"), F.col("doc").alias("b"))
    labels = components(links(firsts, most).unionByName(bridges))
    by_print = prints.join(firsts.withColumnRenamed("doc", "first"), "print", "left")
    found = by_print.join(labels.withColumnRenamed("node", "first"), "first", "left")
    return found.select("doc", "print", F.when(F.col("doc").isNotNull(), F.coalesce("label", "first")).alias("component"))


def hex_digits(prints: Column) -> Column:
    return F.lower(F.lpad(F.hex(prints), 16, "0"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that are the smallest of their component; rows without doc_id stay."""
    gone = near_duplicates(docs).where("doc <> component").select(F.col("doc").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti")
