import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from lethe.llm import tiff


@pytest.mark.parametrize("alphabet", [1, 2, 5, 256])
@pytest.mark.parametrize("size", [0, 1, 2, 3, 128, 129, 576, 9000, 40000])
def test_coders(alphabet, size):
    r = random.Random(size + alphabet)
    data = bytes(r.randrange(alphabet) for _ in range(size))
    assert tiff.unlzw(tiff.lzw(data)) == data
    assert tiff.unpackbits(tiff.packbits(data), size) == data
    block = np.frombuffer(data[: size // 3 * 3], np.uint8).reshape(3, -1)
    assert tiff.unpackbits(tiff.packbits_rows(block), block.size) == block.tobytes()


def test_fixed_packbits():
    # The example of the format's description.
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert tiff.unpackbits(packed, 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")


@pytest.mark.parametrize("tiled", [False, True])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
def test_layouts(compression, predictor, tiled):
    image = np.random.default_rng(7).integers(0, 9, (37, 401)).astype(np.uint8)
    pages = list(tiff.read_pages(tiff.write([image, image[:5]], [(compression, predictor, tiled)] * 2, "x")))
    assert [p["error"] for p in pages] == [None, None]
    assert pages[0]["pixels"] == image.tobytes() and pages[1]["pixels"] == image[:5].tobytes()


def test_big_endian_rgb():
    px = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    tags = [(256, 3, 1, 3), (257, 3, 1, 2), (258, 3, 3, None), (259, 3, 1, 1), (273, 4, 1, 8), (277, 3, 1, 3), (278, 3, 1, 2), (279, 4, 1, 18)]
    body = struct.pack(">2sHI", b"MM", 42, 26) + px.tobytes()
    extra = 26 + 2 + 12 * len(tags) + 4
    entries = b"".join(struct.pack(">HHI", t, k, n) + (struct.pack(">I", extra) if v is None else struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, n, v in tags)
    raw = body + struct.pack(">H", len(tags)) + entries + b"\0" * 4 + struct.pack(">HHH", 8, 8, 8)
    (page,) = tiff.read_pages(raw)
    assert page["samples"] == 3 and page["pixels"] == px.tobytes()


def test_broken(spark):
    good = tiff.write([np.zeros((4, 4), np.uint8)] * 2, [(tiff.DEFLATE, 1, False)] * 2)
    circle = bytearray(good)
    circle[-4:] = circle[4:8]
    df = spark.createDataFrame([(1, None), (2, b""), (3, b"junk"), (4, good[:20]), (5, bytes(circle)), (6, good), (6, good), (None, good)], "k long, c binary")
    rows = tiff.tiff_pages(df, "k", "c").collect()
    by = {k: [r for r in rows if r.id == k] for k in (1, 2, 3, 4, 5, 6, None)}
    assert not by[1] and not by[2] and by[3][0].error and by[4][0].error
    assert [bool(r.error) for r in by[5]] == [False, False, True] and len(by[6]) == 4 and len(by[None]) == 2
    assert tiff.tiff_pages(df.limit(0), "k", "c").count() == 0


def test_digests_of_broken_files(spark):
    good = tiff.write([np.zeros((4, 4), np.uint8)] * 2, [(tiff.DEFLATE, 1, False)] * 2, "about")
    df = spark.createDataFrame([(3, b"junk"), (4, good[:20]), (6, good)], "k long, c binary")
    rows = {r.doc_id: r for r in tiff.page_digests(tiff.tiff_pages(df, "k", "c")).collect()}
    assert rows[3].feature.startswith("unreadable: ") and rows[3].payload_sha256 is None and rows[4].n_bytes is None
    assert (rows[6].n_bytes, rows[6].payload_bytes, rows[6].n_pages) == (32, 32, 2)


@pytest.mark.parametrize("n", [0, 1, 253, 254, 3838, 9000, 70000])
def test_lzw_lengths(n):
    for raw in (np.random.default_rng(n).integers(0, 256, n).astype(np.uint8).tobytes(), b"ab" * (n // 2), bytes(n)):
        assert tiff.unlzw(tiff.lzw(raw)) == raw


def test_turns_reach_every_decoder():
    raw = "some words of text " * 40_000
    seen = {(p["compression"], p["predictor"]) for p in tiff.read_pages(tiff.text_image(raw))}
    assert seen == {(tiff.DEFLATE, 2), (tiff.PACKBITS, 1), (tiff.LZW, 2), (tiff.LZW, 1)}


def test_query(docs_of):
    texts = [None, "", "a", "é" * 288, "x" * 577, "word " * 60000, "***" * 500, "a"]
    rows = {r.doc_id: r for r in tiff.page_digests(tiff.tiff_pages(tiff.text_images(docs_of(texts)), "id", "content")).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        full = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        stored = tiff.text_image(t)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert rows[2][1:] == rows[7][1:] and rows[5].n_pages > 1
