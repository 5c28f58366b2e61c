"""Fill-in-middle transformation by secondary sort.

A text is cut into lines.  Its prefix, middle and suffix leave the mapper as pieces of whole lines, keyed by the
document and the piece's place in the output; markers are pieces of their own.  A repartition by document with a sort
within partitions brings a document's pieces together in order of output, so a task feeds them one by one to a digest and
never holds a document.  To restore, the pieces of the output are keyed by the place that the markers before them give,
and sorted again; a document's pieces stay in their partition, so this second sort has no exchange.

A document's key is the hash of its id and text with the number of the mapper's partition; copies within that partition
share the key, and their pieces are told apart by counting, as equal keys have equal pieces.

Defined results: a null text counts as empty; an empty text, or one that holds a marker, is `plain` (output is the text);
a null id draws its numbers from an empty id; repeated rows (same id) each give a row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
SEED = 7
RATE, SPM_RATE = 100, 50  # per cent of documents that are transformed, and of those the ones with the suffix first
PIECE = 1 << 16  # characters of a piece, about

#: Places of the three parts in the text.
_PART = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
#: Parts in the order of the output.
_ORDER = {PSM: (PREFIX, SUFFIX, MIDDLE), SPM: (SUFFIX, PREFIX, MIDDLE)}
_LINE_END = re.compile("\n")

BATCH_CHARACTERS, BATCH_ROWS = 1 << 20, 2000  # of the batches between Spark and Python

_FACTS = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]
#: Pieces: document (key, part), part of the text where it counts, place; the row of place 0 has the facts of the document.
_PIECES = pa.schema([("key", pa.binary()), ("part", pa.int32()), ("section", pa.int32()), ("place", pa.int32()), ("piece", pa.string()), *_FACTS, ("copies", pa.int64())])
_PIECES_SQL = "key binary, part int, section int, place int, piece string, doc_id long, n long, form string, prefix_chars long, middle_chars long, copies long"
_ROWS = pa.schema([*_FACTS, ("output_sha256", pa.string()), ("restored_sha256", pa.string())])
_ROWS_SQL = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
_OUTPUT = pa.schema([("doc_id", pa.int64()), ("form", pa.string()), ("place", pa.int32()), ("copies", pa.int64()), ("piece", pa.string())])
_OUTPUT_SQL = "doc_id long, form string, place int, copies long, piece string"
_NO_FACTS = (None,) * len(_FACTS)
_HEAD = -1  # section of a document's row before the second sort


def line_ends(text: str) -> list[int]:
    """Ends of the lines; the last may lack its line break."""
    ends = [m.end() for m in _LINE_END.finditer(text)]
    return ends if not text or text.endswith("\n") else [*ends, len(text)]


def plan(doc_id: int | None, text: str, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, int, int]:
    """(lines, form, end of the prefix, end of the middle) of a text, by the document's own numbers."""
    ends = line_ends(text)
    drawn = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(drawn[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(m in text for m in _PART) or h[2] % 100 >= rate:
        return len(ends), PLAIN, 0, 0
    first, second = sorted((h[0] % (len(ends) + 1), h[1] % (len(ends) + 1)))
    at = [0, *ends]
    return len(ends), SPM if h[3] % 100 < spm_rate else PSM, at[first], at[second]


def pieces(text: str, start: int, end: int, size: int = PIECE) -> Iterator[str]:
    """text[start:end] in stretches of about `size` characters that end with a line; a longer line is cut."""
    while start < end:
        stop = text.find("\n", start + size - 1, min(end, start + 2 * size)) + 1 if end - start > size else end
        stop = stop or min(end, start + size)
        yield text[start:stop]
        start = stop


def output_pieces(text: str, form: str, prefix: int, middle: int) -> Iterator[str]:
    """The output's pieces in its order, markers among them."""
    if form == PLAIN:
        yield from pieces(text, 0, len(text))
        return
    bounds = {PREFIX: (0, prefix), MIDDLE: (prefix, middle), SUFFIX: (middle, len(text))}
    for marker in _ORDER[form]:
        yield marker
        yield from pieces(text, *bounds[marker])


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded size."""
    held, characters, at = [], 0, schema.get_field_index("piece")

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        characters += len(row[at] or "") if at >= 0 else 0
        if len(held) >= BATCH_ROWS or characters >= BATCH_CHARACTERS:
            yield batch()
            held, characters = [], 0
    if held:
        yield batch()


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns], strict=True)


def _mapped(of: Callable[[Iterator[tuple]], Iterator[tuple]], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    return lambda batches: _batched(of(_rows_of(batches)), schema)


def _emit(seed: int, rate: int, spm_rate: int) -> Callable[[Iterator[tuple]], Iterator[tuple]]:
    """Rows (doc_id, text) to pieces in order of output."""

    def of(rows: Iterator[tuple]) -> Iterator[tuple]:
        part = TaskContext.get().partitionId()
        for doc_id, text in rows:
            text = text or ""
            n, form, prefix, middle = plan(doc_id, text, seed, rate, spm_rate)
            key = hashlib.md5(f"{doc_id}:{text}".encode()).digest()
            chars = (None, None) if form == PLAIN else (prefix, middle - prefix)
            yield key, part, 0, 0, None, doc_id, n, form, *chars, 1
            for place, piece in enumerate(output_pieces(text, form, prefix, middle), 1):
                yield key, part, 0, place, piece, *_NO_FACTS, 1

    return of


def _in_order(rows: Iterator[tuple]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Of each document its row, with the number of its copies, and its pieces once each; rows sorted by document and place."""
    for _, own in groupby(rows, itemgetter(0, 1)):
        places = ((next(same), 1 + sum(1 for _ in same)) for _, same in groupby(own, itemgetter(3)))
        (*head, _), copies = next(places)
        yield (*head, copies), (row for row, _ in places)


def _assemble(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Pieces in order of output to the same pieces keyed by their place in the text, and each document's row with its output's digest."""
    for head, own in _in_order(rows):
        digest, section = hashlib.sha256(), 0
        for key, part, _, place, piece, *_ in own:
            digest.update(piece.encode())
            if head[7] != PLAIN and piece in _PART:
                section = _PART[piece]
            else:
                yield key, part, section, place, piece, *_NO_FACTS, 1
        yield *head[:2], _HEAD, 0, digest.hexdigest(), *head[5:]


def _restore(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Pieces in order of the text to the documents' rows."""
    for _, own in groupby(rows, itemgetter(0, 1)):
        *_, output, doc_id, n, form, prefix, middle, copies = next(own)
        digest = hashlib.sha256()
        for row in own:
            digest.update(row[4].encode())
        for _ in range(copies):
            yield doc_id, n, form, prefix, middle, output, digest.hexdigest()


def _outputs(rows: Iterator[tuple]) -> Iterator[tuple]:
    for head, own in _in_order(rows):
        for row in own:
            yield head[5], head[7], row[3], head[-1], row[4]


def sorted_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """Pieces of the outputs, a document's together and in order."""
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    emitted = own.mapInArrow(_mapped(_emit(seed, rate, spm_rate), _PIECES), _PIECES_SQL)
    return emitted.repartition("key", "part").sortWithinPartitions("key", "part", "place")


def fill_middle(docs: DataFrame, **options) -> DataFrame:
    """A row (doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of each document; options as of sorted_pieces."""
    assembled = sorted_pieces(docs, **options).mapInArrow(_mapped(_assemble, _PIECES), _PIECES_SQL)
    return assembled.sortWithinPartitions("key", "part", "section", "place").mapInArrow(_mapped(_restore, _ROWS), _ROWS_SQL)


def outputs(docs: DataFrame, **options) -> DataFrame:
    """The transformed texts as pieces: (doc_id, form, place, copies, piece), places from 1 in order of the output; options as of sorted_pieces."""
    return sorted_pieces(docs, **options).mapInArrow(_mapped(_outputs, _OUTPUT), _OUTPUT_SQL)
