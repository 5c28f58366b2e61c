"""MinHash near-dedup by HyperMinHash: banded compressed registers propose, estimates sift, full sets confirm.

1. Each text becomes its set of distinct word shingles, a sketch and band keys.  Equal sets have one
   representative, the smallest document.
2. Each representative is first confirmed against the smallest document of its band buckets, one pair a
   document.  Links make components.
3. In buckets that still hold several components, the collision-corrected estimate picks the documents that may
   reach the threshold with one of another component (4 standard deviations of the estimate below it).
4. For those, the exact intersections of a bucket's full sets are counted by products of 0/1 matrices, which gives
   the links that join components: fewer than the bucket has members, however many pairs are alike.  Pairs inside
   one component need no test, as they can't change it.

In steps 3 and 4 a bucket of more than BLOCK members is cut into blocks by a hash of the document, those of its largest
component apart from all others; a block of that component and a block of others, or two blocks of others, are a group of
their own, dealt like a bucket.  A task holds one group at a time, so its memory is bounded by two blocks.

A link of similarity s is missed when no band of 4 registers agrees, at s = 0.75 about once in 2e5 links of large
sets.  Sets of up to FEW shingles, whose bands borrow registers, also have keys for the set itself and for the set less
each shingle, by which all links whose union has up to 7 shingles are found.

Defined results: a null or empty text, or one without words, has an empty set, is linked with nothing and is
its own component; fewer words than `size` make one shingle; rows with null doc_id are their own component (null);
repeated rows (same id) get the same result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hyperminhash as hmh
from .components import components
from .scratch import written
from .textblocks import Rolling, blocks, lower_ascii, mix, words

SIZE = 5
SIMILAR, OF = 75, 100  # a link: OF * intersection >= SIMILAR * union
DEVIATIONS = 4
FEW = 8
BLOCK = 512  # members of a bucket that are compared as one


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct shingles, sorted by both."""
    _, _, rows, hashes = words(lower_ascii(data), offs)
    rolling = Rolling(hashes)
    grams = rolling.grams(size)
    count = np.maximum(0, np.diff(rows) - size + 1)
    row = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + rows[:-1][row]
    short = np.flatnonzero((np.diff(rows) > 0) & (count == 0))
    row = np.concatenate([row, short])
    value = np.concatenate([grams[at], rolling.spans(rows[short], rows[short + 1])])
    o = np.lexsort((value, row))
    row, value = row[o], value[o]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    return (upto[bounds[1:]] - upto[bounds[:-1]]).view(np.int64)


def few_keys(row: np.ndarray, value: np.ndarray, bounds: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of each set of 3 to FEW shingles, and of those of 4 or more without one of them; sums of mixed shingles."""
    n = np.diff(bounds)
    whole = np.flatnonzero((n >= 3) & (n <= FEW))
    less = np.flatnonzero((n[row] >= 4) & (n[row] <= FEW)) if len(row) else np.zeros(0, np.int64)
    own = np.concatenate([sums[whole], sums[row[less]] - mix(value[less])])
    return np.concatenate([whole, row[less]]), mix(own ^ np.uint64(0x2545F4914F6CDD1D))


def _sketch(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in blocks(b.column(1)):
                row, value = shingle_sets(data, offs, size)
                bounds = np.searchsorted(row, np.arange(j - i + 1))
                keys = hmh.band_keys(hmh.registers(row, value, j - i)).view(np.int64)
                sums = _sums(mix(value), bounds)
                few, more = few_keys(row, value, bounds, sums.view(np.uint64))
                owner = np.concatenate([np.repeat(np.arange(j - i), hmh.BANDS), few])
                order = np.argsort(owner, kind="stable")
                keys = np.concatenate([keys.ravel(), more.view(np.int64)])[order]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[order], np.arange(j - i + 1)).astype(np.int32)), pa.array(keys))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(np.diff(bounds)), pa.array(sums), pa.array(_sums(mix(value ^ np.uint64(0x5851F42D4C957F2D)), bounds)), lists],
                    names=["doc", "n", "p1", "p2", "keys"],
                )

    return of


def _sets(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in blocks(b.column(1)):
                row, value = shingle_sets(data, offs, size)
                bounds = np.searchsorted(row, np.arange(j - i + 1))
                regs = hmh.registers(row, value, j - i)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(np.diff(bounds)), pa.array([r.tobytes() for r in regs], pa.binary()), pa.array([value[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())],
                    names=["doc", "n", "regs", "items"],
                )

    return of


def _confirm(similar: int, of_: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            linked = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if similar * max(len(x), len(y)) > of_ * min(len(x), len(y)):
                    linked.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(of_ * both >= similar * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return of


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each key, one after another, of a task's rows in order of key."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        while b.num_rows:
            key = b.column(0).to_numpy(zero_copy_only=False)
            if held and held[0].column(0)[0].as_py() != key[0]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            end = int(np.searchsorted(key, key[0], "right"))
            held.append(b.slice(0, end))
            b = b.slice(end)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _flag(similar: int, of_: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, doc, label, side, n, regs) in order of key -> (key, doc, label) of those that an estimate leaves a partner of another label.

    Where both sides occur, partners are of the other side.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = similar / of_
        for t in _groups(batches):
            names, number = np.unique(t["label"].to_numpy(), return_inverse=True)
            if len(names) < 2:
                continue
            r = np.frombuffer(b"".join(t["regs"].to_pylist()), np.uint16).reshape(-1, hmh.BUCKETS)
            side, sizes, found = t["side"].to_numpy(), t["n"].to_numpy(), np.zeros(t.num_rows, bool)
            largest = np.bincount(number).argmax()
            for i in np.flatnonzero(number != largest):
                fit = (number != number[i]) & ~(found & found[i]) & (of_ * np.minimum(sizes, sizes[i]) >= similar * np.maximum(sizes, sizes[i]))
                other = np.flatnonzero(fit & (side != side[i]) if side.any() else fit)
                near, used = hmh.estimate(r[i], sizes[i], r[other], sizes[other])
                hit = other[near >= least - DEVIATIONS * np.sqrt(least * (1 - least) / np.maximum(used, 1))]
                found[hit] = True
                found[i] |= len(hit) > 0
                if found.all():
                    break
            if found.any():
                yield from t.select(["key", "doc", "label"]).filter(pa.array(found)).combine_chunks().to_batches()

    return of


CELLS = 1 << 22  # of the dense matrices that count intersections


def intersections(sets: list[np.ndarray], rows: slice) -> np.ndarray:
    """Exact sizes of the intersections of some of the sets with all of them, by products of dense 0/1 matrices."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(x) for x in sets])
    _, item, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[item] > 1
    owner, item = owner[shared], (np.cumsum(count > 1) - 1)[item[shared]]
    order = np.argsort(item, kind="stable")
    owner, item = owner[order], item[order]
    out = np.zeros((len(range(*rows.indices(m))), m), np.float32)
    top = int(item[-1]) + 1 if len(item) else 0
    width = max(1, min(CELLS // m, top))
    for lo in range(0, top, width):
        part = slice(*np.searchsorted(item, [lo, lo + width]))
        dense = np.zeros((m, width), np.float32)
        dense[owner[part], item[part] - lo] = 1
        out += dense[rows] @ dense.T
    return out


def _link(similar: int, of_: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, doc, label, items) in order of key -> links (a, b) that join different labels of a group, one a join at most."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            t = t.sort_by("doc")
            doc, (names, number) = t["doc"].to_numpy(), np.unique(t["label"].to_numpy(), return_inverse=True)
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["items"].combine_chunks()]
            sizes = np.array([len(x) for x in sets])
            root, out = np.arange(len(names)), []
            step = max(1, CELLS // len(sets))
            for lo in range(0, len(sets), step):
                if (root == root[0]).all():
                    break
                both = intersections(sets, slice(lo, lo + step))
                linked = of_ * both >= similar * (sizes[lo : lo + step, None] + sizes[None, :] - both)
                for i, row in enumerate(linked, lo):
                    near = np.flatnonzero(row & (root[number] != root[number[i]]))
                    for r, k in zip(*np.unique(root[number[near]], return_index=True), strict=True):
                        a, z = int(doc[i]), int(doc[near[k]])
                        out.append((min(a, z), max(a, z)))
                        root[root == r] = root[number[i]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([z for _, z in out], pa.int64())], names=["a", "b"])

    return of


def dealt_groups(named: DataFrame) -> DataFrame:
    """Rows (key, doc, label) of buckets to the groups (key, doc, label, side) in which they are compared.

    A bucket of up to BLOCK members of several components is a group.  A larger one is split into its largest component
    and all others, each in blocks: a group is a block of the one and a block of the other, or two blocks of others.
    Members of the largest component never meet each other, so a bucket of copies with a few other members deals about
    one row for each of its members.
    """
    labels = named.groupBy("key", "label").agg(F.count("*").alias("n"))
    most = F.max(F.struct("n", F.col("label")))
    several = labels.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("labels"), most.alias("m")).where("labels > 1")
    several = several.select("key", "n", F.col("m.label").alias("main"), F.ceil(F.col("m.n") / F.lit(BLOCK)).cast("int").alias("inside"), F.ceil((F.col("n") - F.col("m.n")) / F.lit(BLOCK)).cast("int").alias("outside"))
    own = named.join(several, "key")
    hot, main = F.col("n") > BLOCK, F.col("label") == F.col("main")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    block = F.pmod(F.xxhash64("doc"), F.when(main, F.col("inside")).otherwise(F.col("outside"))).cast("int")
    own = own.withColumn("block", block)
    small = own.where(~hot).select("key", "doc", "label", F.lit(0).alias("side"))
    across = own.where(hot).withColumn("other", F.explode(upto(F.when(main, F.col("outside")).otherwise(F.col("inside")))))
    pair = F.when(main, F.xxhash64("key", F.lit(1), "block", "other")).otherwise(F.xxhash64("key", F.lit(1), "other", "block"))
    across = across.select(pair.alias("key"), "doc", "label", (~main).cast("int").alias("side"))
    others = own.where(hot & ~main).withColumn("other", F.explode(upto(F.col("outside"))))
    others = others.select(F.xxhash64("key", F.lit(2), F.least("block", "other"), F.greatest("block", "other")).alias("key"), "doc", "label", (F.col("block") > F.col("other")).cast("int").alias("side"))
    return small.unionByName(across).unionByName(others)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, similar: int = SIMILAR, of: int = OF) -> DataFrame:
    """(doc, n, component) of each row: set size and the smallest document reachable over links."""
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    sketches = written(own.mapInArrow(_sketch(size), "doc long, n long, p1 long, p2 long, keys array<long>"), "sketches")
    full = sketches.where("n > 0 and doc is not null")
    firsts = written(full.groupBy("p1", "p2", "n").agg(F.min("doc").alias("first")), "firsts")

    bands = full.join(firsts.select(F.col("first").alias("doc")), "doc", "left_semi").select("doc", F.explode("keys").alias("key")).distinct()
    least = bands.groupBy("key").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("key", "least")
    members = written(bands.join(least, "key"), "members")
    items = written(own.join(members.select("doc").distinct(), "doc", "left_semi").select("doc", "text").mapInArrow(_sets(size), "doc long, n long, regs binary, items binary"), "items")

    def confirmed(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(items.select(F.col("doc").alias("a"), F.col("items").alias("x")), "a")
        with_b = with_a.join(items.select(F.col("doc").alias("b"), F.col("items").alias("y")), "b")
        return written(with_b.select("a", "b", "x", "y").mapInArrow(_confirm(similar, of), "a long, b long, linked boolean"), "tested")

    tested = confirmed(members.where("doc > least").groupBy("doc").agg(F.min("least").alias("a")).select("a", F.col("doc").alias("b")))
    labels = components(tested.where("linked"))
    named = members.select("key", "doc").join(labels, F.col("doc") == F.col("node"), "left").select("key", "doc", F.coalesce("label", "doc").alias("label"))
    rows = dealt_groups(named).join(items.select("doc", "n", "regs"), "doc").select("key", "doc", "label", "side", "n", "regs")
    flagged = written(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_flag(similar, of), "key long, doc long, label long"), "flagged")
    found = flagged.join(items.select("doc", "items"), "doc").select("key", "doc", "label", "items").repartition("key").sortWithinPartitions("key")
    links = found.mapInArrow(_link(similar, of), "a long, b long").distinct()
    star = labels.select(F.col("label").alias("a"), F.col("node").alias("b")).where("a <> b")
    labels = components(star.unionByName(links))
    by_set = sketches.select("doc", "n", "p1", "p2").join(firsts, ["p1", "p2", "n"], "left")
    return by_set.join(labels.withColumnRenamed("node", "first"), "first", "left").select("doc", "n", F.when(F.col("n") > 0, F.coalesce("label", "first")).otherwise(F.col("doc")).alias("component"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that are the smallest of their component; rows without doc_id stay."""
    gone = near_duplicates(docs).where("doc <> component").select(F.col("doc").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti")
