"""Token-id files in patched frame-of-reference blocks.

A block of BLOCK ids keeps its least id and, for each id, the difference to it, packed at a width that a
chosen share of the differences fits; the others' high bits stand in an exception list.  A file starts
with a header and the byte offset of each block, so any block can be read alone.

Files are rows of a table (shard, part, file), written by Spark, in ascending order of document id.

Defined results: a null or empty text is the end id alone; documents with null id come first; repeated ids
keep both documents, in any order; no documents give no file.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import new_path
from .textblocks import text_buffers

MAGIC = b"PFR1"
BLOCK = 1024
SHARE = 0.95  # of a block's differences that the packed width must hold
FILE_IDS = 1 << 20  # ids after which a file is closed
SLICE_BYTES = 1 << 22  # of text, encoded together
CACHE_WORDS = 500_000
DECODED = 128  # blocks read together


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """The blocks of some ids; those of one length and width are packed together."""
    full = len(ids) // BLOCK
    parts = [ids[: full * BLOCK].reshape(full, BLOCK)] + ([ids[None, full * BLOCK :]] if len(ids) % BLOCK else [])
    out: list[bytes] = []
    for rows in parts:
        if not len(rows):
            continue
        n = rows.shape[1]
        least = rows.min(1)
        diff = (rows - least[:, None]).astype(np.uint32)
        _, width = np.frexp(np.partition(diff, int(SHARE * (n - 1)), 1)[:, int(SHARE * (n - 1))].astype(np.float64))
        made: list[bytes] = [b""] * len(rows)
        for w in np.unique(width).tolist():
            own = np.flatnonzero(width == w)
            d = diff[own]
            high = (d.astype(np.uint64) >> np.uint64(w)).astype(np.uint32)
            octets = np.ascontiguousarray(d.astype("<u4")).view(np.uint8).reshape(len(own), n, 4)[:, :, : -(-w // 8)]
            bits = np.unpackbits(octets, axis=2, bitorder="little")[:, :, :w] if w else np.zeros((len(own), n, 0), np.uint8)
            packed = np.packbits(bits.reshape(len(own), n * w), axis=1, bitorder="little")
            row, place = np.nonzero(high)
            ends = np.searchsorted(row, np.arange(len(own) + 1))
            place, over = place.astype("<u2"), high[row, place].astype("<u4")
            for k, i in enumerate(own.tolist()):
                a, z = int(ends[k]), int(ends[k + 1])
                made[i] = struct.pack("<IHBH", int(least[i]), n, w, z - a) + packed[k].tobytes() + place[a:z].tobytes() + over[a:z].tobytes()
        out += made
    return out


def decode_blocks(raw: bytes, at: list[int]) -> np.ndarray:
    """The ids of the blocks that start at the places `at`, one after another; blocks of one length and width are read together."""
    heads = [struct.unpack_from("<IHBH", raw, x) for x in at]
    made: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(at)
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, (_, n, w, _) in enumerate(heads):
        kinds.setdefault((n, w), []).append(i)
    for (n, w), own in kinds.items():
        size = -(-n * w // 8)
        wide = np.zeros((len(own), n, 32), np.uint8)
        if w:
            packed = np.stack([np.frombuffer(raw, np.uint8, size, at[i] + 9) for i in own])
            wide[:, :, :w] = np.unpackbits(packed, axis=1, bitorder="little")[:, : n * w].reshape(len(own), n, w)
        diff = np.packbits(wide.reshape(len(own), n * 32), axis=1, bitorder="little").view("<u4").astype(np.uint32)
        for k, i in enumerate(own):
            least, _, _, over = heads[i]
            place = np.frombuffer(raw, "<u2", over, at[i] + 9 + size)
            high = np.frombuffer(raw, "<u4", over, at[i] + 9 + size + 2 * over)
            diff[k, place] |= (high.astype(np.uint64) << np.uint64(w)).astype(np.uint32)
            made[i] = diff[k] + np.uint32(least)
    return np.concatenate(made) if made else np.zeros(0, np.uint32)


def encode_ids(ids: np.ndarray) -> bytes:
    """A file: magic, number of ids and blocks, block offsets, blocks."""
    blocks = encode_blocks(ids)
    index = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    return MAGIC + struct.pack("<QI", len(ids), len(blocks)) + index.tobytes() + b"".join(blocks)


def block_count(raw: bytes) -> int:
    return struct.unpack_from("<QI", raw, 4)[1]


def _starts(raw: bytes) -> list[int]:
    if raw[:4] != MAGIC:
        raise ValueError("not a token file")
    n = block_count(raw)
    return (np.frombuffer(raw, "<u8", n, 16) + np.uint64(16 + 8 * (n + 1))).tolist()


def read_block(raw: bytes, k: int) -> np.ndarray:
    """Block k alone, by the index."""
    starts = _starts(raw)
    if not 0 <= k < len(starts):
        raise IndexError(k)
    return decode_blocks(raw, starts[k : k + 1])


def decode_ids(raw: bytes) -> np.ndarray:
    starts = _starts(raw)
    parts = [decode_blocks(raw, starts[i : i + DECODED]) for i in range(0, len(starts), DECODED)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


class Words:
    """A word-level tokenizers file and the ids of the words met so far: a word's ids are a stretch of `pool`."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.offs, self.pool = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def add(self, fresh: pa.Array, ids: list[list[int]]) -> None:
        self.known = pa.concat_arrays([self.known, fresh])
        self.offs = np.append(self.offs, self.offs[-1] + np.cumsum([len(x) for x in ids]))
        self.pool = np.append(self.pool, np.array([i for x in ids for i in x], np.uint32))


_words: dict[str, Words] = {}
# Fixed value: the split pattern of the tokenizer's file.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+").findall


def _byte_letters() -> list[str]:
    """Byte-level tokenizers' letter for each byte: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


_LETTERS = _byte_letters()


def _load(model: str) -> Words:
    if model not in _words:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        own = json.loads(model)
        steps = [x["type"] for x in own["normalizer"]["normalizers"]], [x["type"] for x in own["pre_tokenizer"]["pretokenizers"]]
        if steps != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]):
            raise ValueError(f"a tokenizer of other steps: {steps}")
        _words.clear()
        _words[model] = Words(Tokenizer.from_str(model))
    return _words[model]


def _learn(words: Words, fresh: pa.Array) -> None:
    """Ids of words: normalised and split as the tokenizer does it, each distinct piece merged by the library's model."""
    out, merge = [], words.tokenizer.model.tokenize
    pieces: dict[str, list[int]] = {}
    for w in fresh.to_pylist():
        if w.isascii():
            if w.isalpha():
                out.append([t.id for t in merge(w.lower())])
                continue
            low = w.lower()
        else:
            low = unicodedata.normalize("NFC", w).replace("\u03a3", "\u03c3").lower()
        if "<|" in w or not w.isprintable():
            out.append(words.tokenizer.encode(w, add_special_tokens=False).ids)
            continue
        own = [low] if low.isalpha() else _SPLIT(low)
        for p in own:
            if p not in pieces:
                spelled = p if p.isascii() else "".join([_LETTERS[b] for b in p.encode()])
                pieces[p] = [t.id for t in merge(spelled)]
        out.append(pieces[own[0]] if len(own) == 1 else [i for p in own for i in pieces[p]])
    words.add(fresh, out)


# Kinds of bytes: white space, letters, digits, other ASCII, parts of other characters.
_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[128:] = 4


def _is(data: np.ndarray, at: np.ndarray, letters: bytes) -> np.ndarray:
    """Whether `letters` follow each place, in either case."""
    out = np.ones(len(at), bool)
    for k, c in enumerate(letters):
        i = np.minimum(at + k, len(data) - 1)
        out &= (at + k < len(data)) & (data[i] | np.uint8(32) == c)
    return out


def pieces_of(data: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Stretches of the texts that the tokenizer never joins, and the row offsets into them.

    Cut at ASCII white space and, as the split pattern does, between ASCII letters, digits and others, short forms like
    's together.  Next to other characters nothing is cut, nor in words with a mark of special tokens.
    """
    kind = _KIND[data]
    solid = kind > 0
    edge = np.zeros(len(data), bool)
    edge[offs[:-1][offs[:-1] < len(data)]] = True
    first = solid.copy()
    before, own = kind[:-1], kind[1:]
    first[1:] &= (before == 0) | edge[1:] | ((before < 4) & (own < 4) & ((before != own) | (own == 2)))
    # An apostrophe that begins a piece takes a short form's letters; behind another character that is left open.
    marks = np.flatnonzero((data == 39) & solid)
    if len(marks):
        joined = (marks > 0) & (kind[marks - 1] == 4) & ~edge[marks]
        after = np.minimum(marks + 1, len(data) - 1)
        first[after[joined & (marks + 1 < len(data)) & ~edge[after] & solid[after]]] = False
        begins = marks[first[marks]]
        row = np.searchsorted(offs, begins, "right")
        for form in (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"):  # fixed values: the short forms of the split pattern
            last = begins + len(form)
            hit = last[_is(data, begins + 1, form) & (np.searchsorted(offs, last, "right") == row)]
            nxt = np.minimum(hit + 1, len(data) - 1)
            # An accent behind the short form's last letter would change it, so then nothing is cut.
            first[hit - len(form) + 1] = False
            first[nxt[(nxt > hit) & (kind[nxt] == 1)]] = True
    special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
    for i in special.tolist():
        lo = i
        while lo and solid[lo - 1] and not edge[lo]:
            lo -= 1
        hi = i + 1
        while hi < len(data) and solid[hi] and not edge[hi]:
            hi += 1
        first[lo + 1 : hi] = False
    starts = np.flatnonzero(first)
    place = np.concatenate([[0], np.cumsum(solid)])
    bounds = np.append(place[starts], place[-1]).astype(np.int64)
    letters = data[solid]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)]), np.searchsorted(starts, offs)


def encode_texts(model: str, texts: pa.Array | list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another and their offsets, as the tokenizers library gives them, `end` after each.

    Only the distinct pieces of a call meet Python; the texts are places in their list.
    """
    words = _load(model)
    data, offs = text_buffers(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts)
    pieces, rows = pieces_of(data, offs)
    coded = pieces.dictionary_encode()
    distinct = coded.dictionary.cast(pa.large_string())
    if len(words.known) > CACHE_WORDS:
        words.forget()
    at = pc.fill_null(pc.index_in(distinct, words.known), -1).to_numpy().astype(np.int64)
    fresh = np.flatnonzero(at < 0)
    if len(fresh):
        at[fresh] = len(words.known) + np.arange(len(fresh))
        _learn(words, distinct.take(pa.array(fresh)))
    own = at[coded.indices.to_numpy()]
    size = words.offs[own + 1] - words.offs[own]
    upto = np.concatenate([[0], np.cumsum(size)])
    ids = words.pool[np.repeat(words.offs[own] - upto[:-1], size) + np.arange(upto[-1])]
    offs = upto[rows]
    if end is None:
        return ids, offs
    return np.insert(ids, offs[1:], np.uint32(end)), offs + np.arange(len(offs))


_FILES = "shard int, part int, n_docs long, n_ids long, docs binary, sizes binary, file binary"
_NO_ID = np.iinfo(np.int64).min


def _write(shared, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, part = TaskContext.get().partitionId(), 0
        docs: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def closed() -> pa.RecordBatch:
            nonlocal part, docs, ids, sizes, held
            own, all_ids = np.concatenate(docs).astype("<i8"), np.concatenate(ids)
            row = {"shard": shard, "part": part, "n_docs": len(own), "n_ids": len(all_ids), "docs": own.tobytes(), "sizes": encode_ids(np.concatenate(sizes).astype(np.uint32)), "file": encode_ids(all_ids)}
            part, docs, ids, sizes, held = part + 1, [], [], [], 0
            return pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("docs", pa.binary()), ("sizes", pa.binary()), ("file", pa.binary())]))

        for b in batches:
            upto = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False))
            i = 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + SLICE_BYTES)))
                own = b.slice(i, j - i)
                made, offs = encode_texts(shared.value, pc.fill_null(own.column(1), ""), end_id)
                docs.append(pc.fill_null(own.column(0), _NO_ID).to_numpy(zero_copy_only=False))
                ids.append(made)
                sizes.append(np.diff(offs))
                held += len(made)
                i = j
                if held >= FILE_IDS:
                    yield closed()
        if docs:
            yield closed()

    return of


def write_tokens(docs: DataFrame, model: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the table of token files at `path`; model: the tokenizer's JSON."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    own.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(_write(shared, end_id), _FILES).write.parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            (row,) = b.slice(i, 1).to_pylist()
            docs, sizes, ids = np.frombuffer(row["docs"], "<i8"), decode_ids(row["sizes"]).astype(np.int64), decode_ids(row["file"])
            offs = np.concatenate([[0], np.cumsum(sizes)])
            raw = ids.astype("<u4").tobytes()
            n = len(docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["shard"]] * n, pa.int32()), pa.array([row["part"]] * n, pa.int32()), pa.array(docs, mask=docs == _NO_ID), pa.array(offs[:-1]), pa.array(sizes), pa.array([zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], pa.int64())],
                names=["shard", "part", "doc_id", "own_start", "n_tokens", "ids_crc32"],
            )


def read_tokens(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files' contents.

    Only a shard's and a file's counts meet: files are ordered in their shard, then shards, of which there are as many as partitions.
    """
    counts = files.select("shard", "part", "n_ids")
    shards = counts.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = counts.withColumn("inside", F.coalesce(F.sum("n_ids").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    starts = within.join(shards, "shard").select("shard", "part", (F.col("before") + F.col("inside")).alias("base"))
    own = files.select("shard", "part", "docs", "sizes", "file").mapInArrow(_documents, "shard int, part int, doc_id long, own_start long, n_tokens long, ids_crc32 long")
    return own.join(starts, ["shard", "part"]).select("doc_id", (F.col("base") + F.col("own_start")).alias("start"), "n_tokens", "ids_crc32")


def tokenized(docs: DataFrame, model: str, end_id: int, path: str | None = None) -> DataFrame:
    """Writes the files (under the shared folder unless `path` is given) and reads them back."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_tokens(docs, model, end_id, path)
    return read_tokens(spark.read.parquet(path))
