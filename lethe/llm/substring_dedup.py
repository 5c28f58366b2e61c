"""Substring dedup: word windows that also start in an earlier document are cut out.

Shards are made by minimizer (repeats.py), each gets a compressed FM-index of its runs (transform and sampled rows
only), and the runs that documents sent to the shard are streamed against it by backward search: the interval of each
13-word match gives the smallest document that holds it.

Defined results: a null or empty text has no words and keeps nothing; a text with fewer words than
`length` is kept whole; rows with null doc_id are returned whole and never count as earlier;
repeated rows (same id) are one occurrence, so all keep the same; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cutting import cut
from .fm_index import FMIndex
from .repeats import Pieces, Unit, repeated_windows
from .textblocks import words

LENGTH, GRAM = 13, 5
STREAMED = 1 << 17  # windows searched at a time


def fm_resolver(pieces: Pieces, unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of each piece the smallest document that holds its words, by backward search; the start is not looked at."""
    joined = pa.array(pieces.seg, pa.large_binary())
    _, offs, data = joined.buffers()
    offs = np.frombuffer(offs, np.int64)[: len(joined) + 1]
    _, _, rows, hashes = words(np.frombuffer(data, np.uint8)[: offs[-1]], offs)
    distinct, values = np.unique(hashes, return_inverse=True)
    symbols = values + 1
    index = FMIndex(symbols, rows, len(distinct) + 1)
    del hashes, values
    piece = np.repeat(np.arange(len(pieces.count)), pieces.count)
    window = np.arange(len(piece)) - np.repeat(np.cumsum(pieces.count) - pieces.count, pieces.count)
    least_doc = pieces.doc[piece]
    for i in range(0, len(piece), STREAMED):
        part = slice(i, i + STREAMED)
        ends = rows[:-1][piece[part]] + window[part] + unit.length - 1
        found, lo, hi = index.matching(symbols, ends, unit.length, least=2)  # its own piece is one
        full = np.flatnonzero(found >= unit.length)
        if not len(full):
            continue
        lows, first, which = np.unique(lo[full], return_index=True, return_inverse=True)
        sizes = hi[full][first] - lows
        before = np.cumsum(sizes) - sizes
        places = np.arange(int(sizes.sum())) - np.repeat(before - lows, sizes)
        least_doc[i + full] = np.minimum.reduceat(pieces.doc[index.row_of(places)], before)[which]
    return least_doc, np.zeros(len(piece), np.int64)


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc, n, spans, kept): words of each text, removed word spans [start, end), and the words kept, joined by one space."""
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("body"))
    unit = Unit(True, length, gram, False)
    return cut(own, repeated_windows(own, unit, fm_resolver), unit)
