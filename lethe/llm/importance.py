"""Resampling towards a target distribution by hashed features, with CRCs computed on matrices of equal-length features.

A block's distinct features are grouped by their length in bytes.  A group is a two-dimensional uint8 array, one
column a feature; all its CRCs are updated together, row of bytes by row of bytes, and the buckets are scattered back
to the features' places.  Features of more than LONG bytes, whose groups would hold a feature or two, have their CRC
taken one by one.

Two passes read the texts, none shuffles them: the first adds up each task's counts in one array of BUCKETS numbers, the
second sums up the gains of each document's buckets.  What the driver sees are the BUCKETS counts.  Drawn documents are
numbered by a range partition over (score, id), the counts of its partitions and their prefix sums.

Defined results: a null text or one without words has no features and weight 0; a null id has no score and is never
drawn; repeated rows are drawn and ranked one by one; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import written
from .textblocks import blocks, word_bounds

BUCKETS = 10_000
LONGEST = 1  # words of a feature
SCALE = 1000
SEED = "2024"
LEAST_WORDS = 20
SHARE = 10  # per cent of the documents of LEAST_WORDS words that are drawn
LONG = 64  # bytes

_POLYNOMIAL = 0xEDB88320  # fixed value: CRC-32, reflected
#: Word bytes in lower case, all others as spaces.
_FOLD = np.full(256, 32, np.uint8)
for _a, _z, _shift in ((48, 58, 0), (65, 91, 32), (97, 123, 0), (128, 256, 0)):
    _FOLD[_a:_z] = np.arange(_a, _z) + _shift


def _byte_crcs() -> np.ndarray:
    """CRC step of each byte value, by eight shifts."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(_POLYNOMIAL), c >> 1)
    return c


_STEP = _byte_crcs()


def matrix_crcs(m: np.ndarray) -> np.ndarray:
    """CRC-32 of each column of a uint8 matrix."""
    crc = np.full(m.shape[1], 0xFFFFFFFF, np.uint32)
    for row in m:
        crc = _STEP[(crc ^ row) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
    return ~crc


def distinct_columns(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct columns, and for each column the number of its equal."""
    packed = []
    for lo in range(0, max(len(m), 1), 8):
        word = np.zeros(m.shape[1], np.uint64)
        for row in m[lo : lo + 8]:
            word = (word << np.uint64(8)) | row
        packed.append(word)
    order = np.lexsort(packed)
    new = np.ones(len(order), bool)
    new[1:] = np.any([p[order[1:]] != p[order[:-1]] for p in packed], axis=0)
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse


def crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each stretch of bytes."""
    out, sizes = np.empty(len(starts), np.uint32), ends - starts
    order = np.argsort(sizes, kind="stable")
    lengths, first = np.unique(sizes[order], return_index=True)
    for length, own in zip(lengths.tolist(), np.split(order, first[1:]), strict=True):
        if length > LONG:
            out[own] = [zlib.crc32(data[s : s + length]) for s in starts[own]]
            continue
        m = data[starts[own] + np.arange(length)[:, None]]
        distinct, inverse = distinct_columns(m)
        out[own] = matrix_crcs(m[:, distinct])[inverse]
    return out


def features(data: np.ndarray, offs: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(CRC of each feature in order of row, row offsets into them, words of each row) of a block's texts."""
    data = _FOLD[data]
    starts, ends, rows = word_bounds(data, offs)
    words = np.diff(rows)
    if longest > 1:  # words side by side with one space between
        sizes = ends - starts
        at = np.cumsum(sizes + 1) - sizes - 1
        joined = np.full(int((sizes + 1).sum()), 32, np.uint8)
        joined[np.repeat(at - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))] = data[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]
        data, starts, ends = joined, at, at + sizes
    row = np.repeat(np.arange(len(words)), words)
    found = []
    for size in range(1, min(longest, int(words.max(initial=0))) + 1):
        first = np.flatnonzero(np.arange(len(starts)) + size <= rows[1:][row])
        found.append((row[first], crcs(data, starts[first], ends[first + size - 1])))
    of_row = np.concatenate([r for r, _ in found]) if found else np.zeros(0, np.int64)
    order = np.argsort(of_row, kind="stable")
    return np.concatenate([c for _, c in found])[order] if found else np.zeros(0, np.uint32), np.searchsorted(of_row[order], np.arange(len(words) + 1)), words


def _counts(buckets: int, longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, data, offs in blocks(b.column(0)):
                total += np.bincount(features(data, offs, longest)[0] % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    return of


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n) of all features of all texts."""
    return texts.select(text_col).mapInArrow(_counts(buckets, longest), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket from the counts (bucket, n) of corpus and target; the driver gets one row a bucket."""
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).alias("t")).unionByName(target.select("bucket", F.lit(0).alias("s"), F.col("n").alias("t")))
    rows = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for r in rows:
        s[r.bucket], t[r.bucket] = r.s, r.t
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(SCALE * math.log((x + 1.0) * all_s / ((y + 1.0) * all_t))) for x, y in zip(t.tolist(), s.tolist(), strict=True)], np.int64)


def _weigh(shared, longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for b in batches:
            for i, j, data, offs in blocks(b.column(1)):
                found, rows, words = features(data, offs, longest)
                upto = np.concatenate([[0], np.cumsum(gain[found % np.uint32(len(gain))])])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(words), pa.array(np.diff(rows)), pa.array(upto[rows[1:]] - upto[rows[:-1]])], names=["doc", "n_words", "n_features", "weight"])

    return of


def noise(doc: Column, seed: str = SEED) -> Column:
    """The document's own Gumbel noise, scaled and rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def drawn(scored: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored (doc, n_words, score, ...) with rank 1, 2, ... of the highest scores, ties to the smaller doc; null for the others."""
    fit = F.coalesce((F.col("n_words") >= least_words) & F.col("score").isNotNull(), F.lit(False))
    most = scored.where(fit).count() * share // 100
    by = [F.desc("score"), F.asc("doc")]
    ranged = written(scored.where(fit).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("at", 33)  # the id holds the partition and the row's place in it
    sizes = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a partition
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = ranged.withColumn("part", part).join(F.broadcast(before), "part").withColumn("rank", F.when(rank <= most, rank))
    return ranked.select(*scored.columns, "rank").unionByName(scored.where(~fit).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST, share: int = SHARE, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """(doc, n_words, n_features, weight, score, rank) of each document: log weight, score with noise, place among the drawn."""
    gain = gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_col, buckets, longest), buckets)
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    weighed = own.mapInArrow(_weigh(shared, longest), "doc long, n_words long, n_features long, weight long")
    return drawn(written(weighed.withColumn("score", F.col("weight") + noise(F.col("doc"), seed)), "scored"), share, least_words)


def selected(docs: DataFrame, ranks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is drawn."""
    return docs.join(ranks.where("rank is not null").select(F.col("doc").alias(id_col)).distinct(), id_col, "left_semi")
