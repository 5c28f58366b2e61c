"""Removal of the stretches that repeated windows cover."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .repeats import Unit

_CUT = "doc long, n long, spans array<struct<start:int,end:int>>, kept binary"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])


def covered(start: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches [start, end) that the windows cover."""
    o = np.argsort(start, kind="stable")
    start, end = start[o], (start + count + length - 1)[o]
    reach = np.maximum.accumulate(end)
    new = np.ones(len(o), bool)
    new[1:] = start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return start[first], reach[np.append(first[1:], len(o)) - 1]


def _cut(unit: Unit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            sizes[lists.is_null().to_numpy(zero_copy_only=False)] = 0
            flat = lists.flatten()
            starts, counts = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "count"))
            at, ns, spans, kept = 0, [], [], []
            for text, size in zip(b.column(1), sizes, strict=True):
                raw = (text.as_py() or "").encode()
                own = raw.split() if unit.words else raw
                ns.append(len(own))
                if not size:
                    spans.append([])
                    kept.append(b" ".join(own) if unit.words else raw)
                    continue
                lo, hi = covered(starts[at : at + size], counts[at : at + size], unit.length)
                at += size
                change = np.zeros(len(own) + 1, np.int8)
                change[lo] += 1
                change[hi] -= 1
                stay = np.cumsum(change[:-1]) == 0
                kept.append(b" ".join(compress(own, stay.tolist())) if unit.words else np.frombuffer(raw, np.uint8)[stay].tobytes())
                spans.append([{"start": x, "end": y} for x, y in zip(lo.tolist(), hi.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int64()), pa.array(spans, pa.list_(_SPAN)), pa.array(kept, pa.binary()), *b.columns[3:]], names=["doc", "n", "spans", "kept", *b.schema.names[3:]])

    return of


def cut(docs: DataFrame, repeats: DataFrame, unit: Unit) -> DataFrame:
    """docs (doc, body, and `rest` if it is there) without the symbols that the windows of repeats (doc, start, count) cover."""
    per_doc = repeats.groupBy("doc").agg(F.collect_list(F.struct("start", "count")).alias("windows"))
    rest = [f for f in docs.schema if f.name == "rest"]
    schema = T._parse_datatype_string(_CUT)
    # Rows without doc are no side of the join, so its exchange of texts is the one that repeated_windows reads too.
    joined = docs.where("doc is not null").join(per_doc, "doc", "left").select("doc", "body", "windows", *[f.name for f in rest])
    others = docs.where("doc is null").select("doc", "body", F.lit(None).cast(per_doc.schema["windows"].dataType).alias("windows"), *[f.name for f in rest])
    return joined.unionByName(others).mapInArrow(_cut(unit), T.StructType([*schema, *rest]))


def digest(result: DataFrame, n: str, spans: str | None = None) -> DataFrame:
    """doc_id, counts and the hash of what is kept."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    cols = [F.col("doc").alias("doc_id"), F.col("n").alias(n), removed.alias("n_removed")]
    if spans:
        cols.append(F.size("spans").cast("long").alias(spans))
    return result.select(*cols, F.sha2("kept", 256).alias("kept_sha256"))
