import sys
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lethe.llm import token_file as T

MODEL = open(P.path("word_bpe_49k.json"), encoding="utf-8").read()
TOKENIZER = Tokenizer.from_str(MODEL)


def encoded(texts):
    ids, offs = T.encode_texts(MODEL, texts)
    return [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)]


def plain(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("ids", [[], [0], [2**32 - 1], [5] * 3000, list(range(5000)), [1] * 2000 + [4_000_000_000] + [7] * 10, [0, 2**32 - 1] * 700])
def test_round_trip(ids):
    a = np.array(ids, np.uint32)
    raw = T.encode_ids(a)
    assert T.decode_ids(raw).tolist() == ids
    for k in range(T.block_count(raw)):
        assert T.read_block(raw, k).tolist() == ids[k * T.BLOCK : (k + 1) * T.BLOCK]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=3000))
def test_random_round_trip(ids):
    assert T.decode_ids(T.encode_ids(np.array(ids, np.uint32))).tolist() == ids


def test_exceptions_keep_blocks_small():
    ids = np.full(1024, 3, np.uint32)
    ids[::100] = 40_000
    assert len(T.encode_blocks(ids)[0]) < 1024 * 16 // 8 / 4


def test_bad_file():
    with pytest.raises(ValueError):
        T.decode_ids(b"nope" * 9)
    with pytest.raises(IndexError):
        T.read_block(T.encode_ids(np.arange(9)), 1)


def test_all_spaces():
    spaces = [chr(i) for i in range(sys.maxunicode) if chr(i).isspace()]
    texts = [f"ab{s}cd{s}{s}é" for s in [*spaces, "​"]] + ["It's  WE'LL Σας ΟΔΟΣ", "é́ 1234", "", "\U0001f600x", "e ́x"]
    assert encoded(texts) == [plain(t) for t in texts]


def test_many_words():
    texts = [" ".join(f"w{i}x{'é' * (i % 3)}" for i in range(10_000)), "<|endoftext|> <|x|>", "<|startoftext|>a b<|endoftext|>", "a\x01b \x7f ctl\x00", "ΑΣ ΑΣΑ İstanbul ẞ ǅ ﬁ Å ½ ² ٣ ⅷ", "x__y it'S 'tis o'll'd"]
    assert encoded(texts) == [plain(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=5))
def test_any_text(texts):
    assert encoded(texts) == [plain(t) for t in texts]


def test_whole_table():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    assert encoded(texts) == [plain(t) for t in texts]


def test_files(spark, docs_of, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "FILE_IDS", 40)
    monkeypatch.setattr(T, "SLICE_BYTES", 10)
    texts = ["one two", None, "", "three " * 100, "Vier fünf", "one two", "x"]
    ids = [7, 3, 5, -2, 11, 9, 100]
    got = T.tokenized(docs_of(texts, ids).repartition(3), MODEL, 2, str(tmp_path / "t")).collect()
    start, want = 0, []
    for i, t in sorted(zip(ids, texts, strict=True)):
        own = np.array([*plain(t), 2], "<u4")
        want.append((i, start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    assert sorted(map(tuple, got)) == sorted(want)
    assert spark.read.parquet(str(tmp_path / "t")).count() > 1


def test_edges(spark, docs_of, tmp_path):
    assert T.tokenized(docs_of([]), MODEL, 2, str(tmp_path / "e")).count() == 0
    got = sorted(map(tuple, T.tokenized(docs_of(["a", "b", "c"], [4, 4, None]), MODEL, 2, str(tmp_path / "n")).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 4, 4] and [r[1] for r in got] == [0, 2, 4]
