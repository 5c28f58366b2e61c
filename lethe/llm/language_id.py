"""Language ID by bit-sliced Bloom filters of byte n-grams.

Row r of the filter table is a bit mask: bit l says that slot r is set in language l's Bloom
filter; more than WORD languages take further columns of masks.  The rows of an n-gram's slots, ANDed, are all languages that contain it.  A text's
language is the one with the most n-grams, each language's count corrected for the false
positives that its filter's fill predicts.

Defined results: `und` with score 0 where text is null or has no letter; a text whose n-grams no
language holds gets the most frequent training language with score 0; ties go to the language
that sorts first; without any training row every text is `und`.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .textblocks import blocks, mix

GRAM = 4  # bytes, of lower-cased letters with single spaces at word ends
SLOTS_LOG2, HASHES = 18, 3
GRAMS_PER_LANGUAGE = 20_000  # most frequent ones; at least LEAST_COUNT training texts hold each, if the language has FEW_TEXTS
LEAST_COUNT, FEW_TEXTS = 2, 300
FIT_ROWS = 4_000  # expected distinct training texts a language: the documented bound of the fit
WORD = 64  # bits of a mask

UNDETERMINED = "und"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


class Filters(NamedTuple):
    languages: list[str]
    table: np.ndarray  # slot -> mask, or masks of WORD languages each
    false_rate: np.ndarray  # by language
    default: int


def gram_codes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit codes of the 4-byte grams of each row and the rows' offsets into them.

    Grams of two spaces or more in a row are left out, so digits and marks don't count.
    """
    folded = _FOLD[data]
    n = len(folded) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
    wide = folded.astype(np.uint32)
    codes = (wide[:n] << np.uint32(24)) | (wide[1 : n + 1] << np.uint32(16)) | (wide[2 : n + 2] << np.uint32(8)) | wide[3 : n + 3]
    gap = (folded[:-1] == 32) & (folded[1:] == 32)
    use = ~(gap[:n] | gap[1 : n + 1] | gap[2 : n + 2])
    for back in range(1, GRAM):  # grams that would cross rows
        at = offs[1:-1] - back
        use[at[(at >= 0) & (at < n)]] = False
    at = np.flatnonzero(use)
    return codes[at], np.searchsorted(at, offs)


def _slots(codes: np.ndarray) -> list[np.ndarray]:
    h = mix(codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    return [((h >> np.uint64(20 * i)) & np.uint64((1 << SLOTS_LOG2) - 1)).astype(np.int64) for i in range(HASHES)]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        langs = np.array(b.column(0).to_pylist(), object)
        for i, j, data, offs in blocks(b.column(1)):
            codes, rows = gram_codes(data, offs)
            row = np.repeat(np.arange(j - i), np.diff(rows))
            pairs = np.unique((row.astype(np.uint64) << np.uint64(32)) | codes)
            row, codes = (pairs >> np.uint64(32)).astype(np.int64), pairs & np.uint64(0xFFFFFFFF)
            own = langs[i:j]
            for lang in sorted(set(own)):
                gram, n = np.unique(codes[own[row] == lang], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, gram) -> the grams of each language of a batch in one row."""
    for b in batches:
        own, grams = np.array(b.column(0).to_pylist(), object), b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        names = sorted(set(own))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([grams[own == lang].tobytes() for lang in names], pa.binary())], names=["lang", "grams"])


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", rows: int = FIT_ROWS) -> Filters:
    """Filters from the rows of `labelled` with a language, on a sample of about `rows` distinct texts of each language.

    Copies of a text count once.  The text of the least hash is always in the sample, so each language is learned.
    """
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).withColumn("hash", F.xxhash64("text"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("hash", 0.02).alias("texts"), F.min("hash").alias("first")).orderBy(F.desc("n"), "lang").collect()
    counts = [(r["lang"], r["n"]) for r in sizes]
    if not counts:
        return Filters([], np.zeros(1 << SLOTS_LOG2, np.uint8), np.zeros(0), 0)
    shares = F.broadcast(labelled.sparkSession.createDataFrame([(r["lang"], int(1_000_000 * min(1.0, rows / r["texts"])), r["first"], 1 if r["texts"] < FEW_TEXTS else LEAST_COUNT) for r in sizes], "lang string, share long, first long, least int"))
    drawn = (F.pmod("hash", F.lit(1_000_000)) < F.col("share")) | (F.col("hash") == F.col("first"))
    sample = known.join(shares, "lang").where(drawn).dropDuplicates(["lang", "hash"]).select("lang", "text")
    counted = sample.mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = counted.join(shares, "lang").where(F.col("n") >= F.col("least"))
    best = grams.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("place") <= GRAMS_PER_LANGUAGE)
    languages = sorted(lang for lang, _ in counts)
    number = {lang: i for i, lang in enumerate(languages)}
    width = next((t for t, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(languages) <= n), np.uint64)
    table = np.zeros((1 << SLOTS_LOG2, -(-len(languages) // WORD)), width)
    for r in best.select("lang", "gram").mapInArrow(_packed, "lang string, grams binary").toLocalIterator():
        column, bit = divmod(number[r["lang"]], WORD)
        for slot in _slots(np.frombuffer(bytes(r["grams"]), np.int64)):
            table[slot, column] |= width(1 << bit)
    fill = np.array([((table[:, i // WORD] >> width(i % WORD)) & width(1)).mean() for i in range(len(languages))])
    table = table[:, 0].copy() if table.shape[1] == 1 else table
    return Filters(languages, table, np.minimum(fill**HASHES, 0.999), languages.index(counts[0][0]))


def decide(filters: Filters, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language number and score of each row."""
    codes, rows = gram_codes(data, offs)
    n = np.diff(rows)
    if not len(codes):
        return np.full(len(n), filters.default), np.zeros(len(n))
    a, b, c = _slots(codes)
    table = filters.table.reshape(len(filters.table), -1)
    hits = np.zeros((len(filters.languages), len(n)))
    for lang in range(len(filters.languages)):
        column, bit = divmod(lang, WORD)
        if not bit:
            mask = table[a, column] & table[b, column] & table[c, column]
        upto = np.concatenate([[0], np.cumsum((mask >> mask.dtype.type(bit)) & mask.dtype.type(1), dtype=np.int64)])
        hits[lang] = upto[rows[1:]] - upto[rows[:-1]]
    true = np.maximum(0, (hits - n * filters.false_rate[:, None]) / (1 - filters.false_rate[:, None]))
    total = true.sum(0)
    best = np.where(total > 0, true.argmax(0), filters.default)
    return best, np.where(total > 0, true.max(0) / np.maximum(total, 1e-9), 0.0)


def _has_letter(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    folded = _FOLD[data]
    upto = np.concatenate([[0], np.cumsum((folded >= 97) & (folded <= 122), dtype=np.int64)])
    found = upto[offs[1:]] > upto[offs[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def _predict(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: Filters = shared.value
        names = np.array([*filters.languages, UNDETERMINED], object)
        for b in batches:
            langs, scores = [], []
            for _, _, data, offs in blocks(b.column(1)):
                letter = _has_letter(data, offs)
                if filters.languages:
                    best, score = decide(filters, data, offs)
                else:
                    best, score, letter = np.zeros(len(letter), np.int64), np.zeros(len(letter)), np.zeros(len(letter), bool)
                langs.append(names[np.where(letter, best, len(names) - 1)])
                scores.append(np.where(letter, score, 0.0))
            if langs:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(langs), pa.string()), pa.array(np.concatenate(scores), pa.float64())], names=["doc_id", "lang_pred", "score"])

    return of


def predict(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each whole text; the filters' size is fixed, so they are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")
