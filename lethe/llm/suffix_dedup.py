"""Suffix-array dedup: bytes covered by a 100-byte string that starts earlier in the corpus are cut out.

Runs of strings are dealt by minimizer (repeats.py).  Around one minimizer, the contexts to its
right and, mirrored, to its left are put in order by deep-shallow sorting (deep_shallow.py).  Two
strings that reach a symbols to the left are equal where both orders keep them together: common
left context of a and common right context of length-a.

Defined results: a null or empty text has no bytes; a text shorter than `length` is kept whole; rows with
null doc_id are returned whole and never count as earlier; repeated rows (same id) are one occurrence, so all
keep the same; other columns are ignored.  Kept bytes may end inside a UTF-8 character: they are binary.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cutting import cut
from .deep_shallow import sort
from .repeats import Pieces, Unit, repeated_windows

LENGTH, GRAM = 100, 48


def suffix_resolver(pieces: Pieces, unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """Document and start of the earliest equal of each window of each piece."""
    n, length = len(pieces.key), unit.length
    right = [s[p:] for s, p in zip(pieces.seg, pieces.place.tolist(), strict=True)]
    left = [s[:p][::-1] for s, p in zip(pieces.seg, pieces.place.tolist(), strict=True)]
    by_right, common_right = sort(pieces.key, right, max(map(len, right)))
    by_left, common_left = sort(pieces.key, left, max(map(len, left)))
    before = np.cumsum(pieces.count) - pieces.count
    first_doc, first_start = np.empty(int(pieces.count.sum()), np.int64), np.empty(int(pieces.count.sum()), np.int64)
    first_at = pieces.start + pieces.place
    for reach in range(int(pieces.place.max()) + 1):
        own = np.flatnonzero((pieces.place >= reach) & (reach > pieces.place - pieces.count))
        if not len(own):
            continue
        same_left, same_right = np.empty(n, np.int64), np.empty(n, np.int64)
        same_left[by_left] = np.cumsum(common_left < reach)
        same_right[by_right] = np.cumsum(common_right < length - reach)
        _, first, which = np.unique(same_left[own] * (n + 1) + same_right[own], return_index=True, return_inverse=True)
        earliest = own[first][which]  # pieces stand in order of (doc, start)
        at = before[own] + pieces.place[own] - reach
        first_doc[at], first_start[at] = pieces.doc[earliest], first_at[earliest] - reach
    return first_doc, first_start


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc, n, spans, kept): bytes of each text, removed byte spans [start, end), and the bytes kept."""
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("body"))
    unit = Unit(False, length, gram, True)
    return cut(own, repeated_windows(own, unit, suffix_resolver), unit)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents (doc_id, text, n_chars, others) with repeated bytes cut out of their texts; broken characters at the cuts go too, null texts stay null."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    own = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").alias("body"), F.struct(F.col("text").isNull().alias("none"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(others)]).alias("rest"))
    unit = Unit(False, LENGTH, GRAM, True)
    found = cut(own, repeated_windows(own, unit, suffix_resolver), unit)
    whole = F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "\ufffd", "")
    text = found.select(F.col("doc").alias("doc_id"), F.when(~F.col("rest.none"), whole).alias("text"), *[F.col(f"rest.c{i}").alias(c) for i, c in enumerate(others)])
    return text.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)
