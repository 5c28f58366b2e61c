"""TIFF columns: image directories are walked, strips and tiles decoded, one row comes out per page.

Read: both byte orders, 8-bit samples, strips and tiles, no compression, PackBits, LZW and deflate,
horizontal predictor.  Write: the same, greyscale, several pages.

Defined results: null or empty content has no page; a file or page that can't be decoded gives a row
with null pixels and the reason in `error`, pages before it stay; repeated rows give repeated pages.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the TIFF 6.0 format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION = 256, 257, 258, 259, 262, 270
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}

SAMPLES_A_ROW = 576
PAGE_ROWS = 128
TILE = 192, 16
STRIP_ROWS = 16
MOST_PAGES = 1 << 20


def packbits(row: bytes) -> bytes:
    """One row packed: literal runs of up to 128 bytes, repeats of three or more."""
    a = np.frombuffer(row, np.uint8)
    n = len(a)
    edges = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1], [True]])) if n else np.zeros(1, np.int64)
    sizes = np.diff(edges)
    out, literal = bytearray(), 0

    def flush(end: int) -> None:
        for i in range(literal, end, 128):
            part = row[i : min(i + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for k in np.flatnonzero(sizes >= 3):
        start, size = int(edges[k]), int(sizes[k])
        flush(start)
        literal = start + size
        while size:
            part = min(size, 128)
            out += bytes([(257 - part) & 255 if part > 1 else 0, row[start]])
            size -= part
    flush(n)
    return bytes(out)


def packbits_rows(block: np.ndarray) -> bytes:
    """Each row packed on its own; rows without a repeat are laid out together."""
    n = block.shape[1]
    if n < 3:
        return b"".join(packbits(r.tobytes()) for r in block)
    same = block[:, 1:] == block[:, :-1]
    plain = ~(same[:, 1:] & same[:, :-1]).any(1)
    parts = -(-n // 128)
    rows = np.empty((int(plain.sum()), n + parts), np.uint8)
    for k in range(parts):
        a, b = 128 * k, min(n, 128 * (k + 1))
        rows[:, a + k] = b - a - 1
        rows[:, a + k + 1 : b + k + 1] = block[plain, a:b]
    if plain.all():
        return rows.tobytes()
    laid = iter(rows)
    return b"".join(next(laid).tobytes() if p else packbits(r.tobytes()) for p, r in zip(plain, block, strict=True))


def unpackbits(data: bytes, size: int) -> bytes:
    out, at, made = [], 0, 0
    while made < size and at < len(data):
        head = data[at]
        if head < 128:
            out.append(data[at + 1 : at + 2 + head])
            at += head + 2
            made += head + 1
        elif head > 128:
            out.append(data[at + 1 : at + 2] * (257 - head))
            at += 2
            made += 257 - head
        else:
            at += 1
    return b"".join(out)


def _widths(codes: int) -> np.ndarray:
    """Bits of the codes after a clear code: 9 to 12, one early change of width."""
    made = 258 + np.arange(codes)
    return 9 + (made >= 512) + (made >= 1024) + (made >= 2048)


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; a clear code before the table is full."""
    codes, table, word, nxt = [256], {}, -1, 258
    for c in data:
        if word < 0:
            word = c
            continue
        longer = word << 8 | c
        known = table.get(longer)
        if known is not None:
            word = known
            continue
        codes.append(word)
        table[longer] = nxt
        nxt += 1
        if nxt == 4095:
            codes.append(256)
            table.clear()
            nxt = 258
        word = c
    codes += [word, 257] if word >= 0 else [257]
    c = np.array(codes, np.uint32)
    clears = np.flatnonzero(c == 256)
    w = np.concatenate([[9], *[_widths(n) for n in np.diff(np.append(clears, len(c) - 1))]])
    bits = (c[:, None] >> np.arange(11, -1, -1, dtype=np.uint32)) & 1
    return np.packbits(bits[np.arange(12) >= (12 - w)[:, None]].astype(np.uint8)).tobytes()


_SINGLE = [bytes([i]) for i in range(256)] + [b"", b""]
_AT_ONCE = 4096  # codes read together


def unlzw(data: bytes) -> bytes:
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    out: list[bytes] = []
    table, before, since, at = _SINGLE.copy(), b"", 0, 0
    while at + 9 <= len(bits):
        ends = at + np.cumsum(_widths(since + _AT_ONCE)[since:])
        ends = ends[ends <= len(bits)]
        if not len(ends):
            break
        starts = np.concatenate([[at], ends[:-1]])
        places = starts[:, None] + np.arange(12)
        taken = np.where(places < ends[:, None], bits[np.minimum(places, len(bits) - 1)], 0).astype(np.int64) @ (1 << np.arange(11, -1, -1))
        codes = taken >> (12 - (ends - starts))
        stops = np.flatnonzero((codes == 256) | (codes == 257))
        n = int(stops[0]) if len(stops) else len(codes)
        for code in codes[:n].tolist():
            if not before:
                if code > 255:
                    raise ValueError("LZW code beyond the table")
                word = table[code]
            elif code < len(table):
                word = table[code]
                table.append(before + word[:1])
            elif code == len(table):
                word = before + before[:1]
                table.append(word)
            else:
                raise ValueError("LZW code beyond the table")
            out.append(word)
            before = word
        if not len(stops):
            since, at = since + n, int(ends[-1])
        elif codes[n] == 257:
            break
        else:
            table, before, since, at = _SINGLE.copy(), b"", 0, int(ends[n])
    return b"".join(out)


def _decode(data: bytes, compression: int, size: int) -> bytes:
    if compression == PACKBITS:
        out = unpackbits(data, size)
    elif compression == LZW:
        out = unlzw(data)
    elif compression in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompress(data)
    elif compression == NONE:
        out = data
    else:
        raise ValueError(f"compression {compression}")
    if len(out) < size:
        raise ValueError("strip or tile is short")
    return out[:size]


def _encode(block: np.ndarray, compression: int, predictor: int) -> bytes:
    if predictor == 2:
        block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], 1)
    if compression == PACKBITS:
        return packbits_rows(block)
    if compression == LZW:
        return lzw(block.tobytes())
    return zlib.compress(block.tobytes(), 1) if compression == DEFLATE else block.tobytes()


def write(pages: list[np.ndarray], layouts: list[tuple[int, int, bool]], description: str = "") -> bytes:
    """A little-endian TIFF of 8-bit grey pages; layouts: compression, predictor, tiled."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for image, (compression, predictor, tiled) in zip(pages, layouts, strict=True):
        height, width = image.shape
        if tiled:
            tw, th = TILE
            full = np.zeros((-(-height // th) * th, -(-width // tw) * tw), np.uint8)
            full[:height, :width] = image
            parts = [full[y : y + th, x : x + tw] for y in range(0, full.shape[0], th) for x in range(0, full.shape[1], tw)]
        else:
            parts = [image[y : y + STRIP_ROWS] for y in range(0, height, STRIP_ROWS)]
        offsets, sizes = [], []
        for p in parts:
            data = _encode(p, compression, predictor)
            offsets.append(len(out))
            sizes.append(len(data))
            out += data + b"\0" * (len(data) & 1)
        note = description.encode() + b"\0"
        tags = {WIDTH: (4, [width]), HEIGHT: (4, [height]), BITS: (3, [8]), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [1]), DESCRIPTION: (2, note), SAMPLES: (3, [1]), PREDICTOR: (3, [predictor])}
        tags |= {TILE_WIDTH: (4, [TILE[0]]), TILE_HEIGHT: (4, [TILE[1]]), TILE_OFFSETS: (4, offsets), TILE_BYTES: (4, sizes)} if tiled else {STRIP_OFFSETS: (4, offsets), ROWS_PER_STRIP: (4, [STRIP_ROWS]), STRIP_BYTES: (4, sizes)}
        entries = b""
        for tag, (kind, values) in sorted(tags.items()):
            raw = values if kind == 2 else struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(raw) > 4:
                field = struct.pack("<I", len(out))
                out += raw + b"\0" * (len(raw) & 1)
            else:
                field = raw.ljust(4, b"\0")
            entries += struct.pack("<HHI", tag, kind, len(values)) + field
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + entries + b"\0\0\0\0"
        link = len(out) - 4
    return bytes(out)


def _directories(raw: bytes) -> Iterator[tuple[str, dict]]:
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack(order + "H", raw[2:4])[0] != 42:
        raise ValueError("not a TIFF")
    at, seen = struct.unpack(order + "I", raw[4:8])[0], set()
    while at:
        if at in seen or len(seen) >= MOST_PAGES:
            raise ValueError("directories form a circle")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", raw, at)
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * i)
            size = TYPE_SIZES.get(kind, 1) * count
            place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", raw, at + 10 + 12 * i)[0]
            if place + size > len(raw):
                raise ValueError(f"tag {tag} lies beyond the file")
            if kind in (3, 4):
                tags[tag] = np.frombuffer(raw, order + ("u2" if kind == 3 else "u4"), count, place).tolist()
            else:
                tags[tag] = raw[place : place + size]
        yield order, tags
        (at,) = struct.unpack_from(order + "I", raw, at + 2 + 12 * n)


def _pixels(raw: bytes, tags: dict) -> np.ndarray:
    width, height = tags[WIDTH][0], tags[HEIGHT][0]
    samples, compression, predictor = tags.get(SAMPLES, [1])[0], tags.get(COMPRESSION, [1])[0], tags.get(PREDICTOR, [1])[0]
    if set(tags.get(BITS, [8])) != {8}:
        raise ValueError("samples are not of 8 bits")
    tiled = TILE_OFFSETS in tags
    if tiled:
        w, h = tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]
    else:
        w, h = width, min(tags.get(ROWS_PER_STRIP, [height])[0], height)
    across, down = -(-width // w), -(-height // h)
    offsets, sizes = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_BYTES])
    image = np.zeros((down * h, across * w, samples), np.uint8)
    for k, (offset, size) in enumerate(zip(offsets, sizes, strict=True)):
        y, x = k // across * h, k % across * w
        rows = h if tiled else min(h, height - y)
        block = np.frombuffer(_decode(raw[offset : offset + size], compression, rows * w * samples), np.uint8).reshape(rows, w, samples)
        image[y : y + rows, x : x + w] = np.cumsum(block, 1, dtype=np.uint8) if predictor == 2 else block
    return image[:height, :width]


_PAGES = "id long, page int, last boolean, width int, height int, samples int, compression int, predictor int, note string, pixels binary, media_bytes long, media_sha256 string, error string"
_PAGE_TYPES = pa.schema([("id", pa.int64()), ("page", pa.int32()), ("last", pa.bool_()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("compression", pa.int32()), ("predictor", pa.int32()), ("note", pa.string()), ("pixels", pa.binary()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("error", pa.string())])


def read_pages(raw: bytes) -> Iterator[dict]:
    """Each page's size, layout and pixels; a page or file that can't be read ends with an error."""
    page = 0
    try:
        for _, tags in _directories(raw):
            image = _pixels(raw, tags)
            yield {"page": page, "width": image.shape[1], "height": image.shape[0], "samples": image.shape[2], "compression": tags.get(COMPRESSION, [1])[0], "predictor": tags.get(PREDICTOR, [1])[0], "note": tags.get(DESCRIPTION, b"").rstrip(b"\0").decode("utf-8", "replace"), "pixels": image.tobytes(), "error": None}
            page += 1
    except (ValueError, KeyError, IndexError, struct.error, zlib.error, MemoryError) as e:
        yield {"page": page, "width": None, "height": None, "samples": None, "compression": None, "predictor": None, "note": None, "pixels": None, "error": f"{type(e).__name__}: {e}"[:200]}


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, held = [], 0
        for i, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            raw = content.as_py()
            if not raw:
                continue
            first = {"id": i, "media_bytes": len(raw), "media_sha256": hashlib.sha256(raw).hexdigest()}
            before = None
            for page in read_pages(raw):
                if before:
                    rows.append(before | {"last": False})
                before = first | page
                held += len(page["pixels"] or b"")
            if before:
                rows.append(before | {"last": True})
            if held > 1 << 22:
                yield pa.RecordBatch.from_pylist(rows, _PAGE_TYPES)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _PAGE_TYPES)


def tiff_pages(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """One row per page of each TIFF, with its pixels; the pages of a file stay together and in order."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(content_col).alias("content")).mapInArrow(_read, _PAGES)


#: Compression, predictor and tiling of the pages by turns: each decoder reads a third of them.
LAYOUTS = [(DEFLATE, 2, True), (PACKBITS, 1, False), (LZW, 2, False), (DEFLATE, 2, False), (PACKBITS, 1, True), (LZW, 1, False)]


def text_image(text: str | None) -> bytes:
    """The text's UTF-8 bytes as a grey image of rows of 576 samples, filled up with 255, in pages of PAGE_ROWS rows."""
    raw = (text or "").encode()
    rows = max(1, -(-len(raw) // SAMPLES_A_ROW))
    image = np.frombuffer(raw.ljust(rows * SAMPLES_A_ROW, b"\xff"), np.uint8).reshape(rows, SAMPLES_A_ROW)
    turn = zlib.crc32(raw)
    pages = [image[y : y + PAGE_ROWS] for y in range(0, rows, PAGE_ROWS)]
    return write(pages, [LAYOUTS[(turn + k) % len(LAYOUTS)] for k in range(len(pages))], str(len(raw)))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, out, at, held = b.column(0), [], 0, 0
        for i, text in enumerate(b.column(1)):
            out.append(text_image(text.as_py()))
            held += len(out[-1])
            if held > 1 << 22 or i + 1 == len(ids):
                yield pa.RecordBatch.from_arrays([ids[at : i + 1], pa.array(out, pa.binary())], names=["id", "content"])
                out, at, held = [], i + 1, 0


def text_images(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, content): each text stored losslessly as a TIFF."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_store, "id long, content binary")


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    types = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_pages", pa.int32())])
    for b in batches:
        out = []
        for page in b.to_pylist():
            held.append(page)
            if not page["last"]:
                continue
            first = {"doc_id": page["id"], "media_bytes": page["media_bytes"], "media_sha256": page["media_sha256"], "n_pages": len(held)}
            if page["error"]:
                out.append(first | {"feature": f"unreadable: {page['error']}"})
                held = []
                continue
            payload = b"".join(p["pixels"] for p in held)
            a = np.frombuffer(payload, np.uint8)
            seen = np.bincount(a, minlength=256)
            p = seen[seen > 0] / max(len(a), 1)
            note, samples = held[0]["note"], max(held[0]["width"] * held[0]["samples"], 1)
            out.append(first | {"n_bytes": int(note) if note.isascii() and note.isdigit() else len(a), "payload_bytes": len(a), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]), "feature": f"{len(held)} pages;{len(a) // samples} rows;mean {a.mean() if len(a) else 0:.3f};entropy {-(p * np.log2(p)).sum():.3f}"})
            held = []
        yield pa.RecordBatch.from_pylist(out, types)


def page_digests(pages: DataFrame) -> DataFrame:
    """One row per file: hashes and features of the samples read back; of a file with a page that can't be read, the reason.

    n_bytes is the number that the first page's description gives, else the number of samples.
    """
    return pages.mapInArrow(_features, _DIGEST)
