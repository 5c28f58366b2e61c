import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lethe.llm import byte_bpe

RANKS = byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = byte_bpe.Encoder(RANKS, P.PATTERN)


def ids(raw):
    import numpy as np

    return np.frombuffer(raw, "<u4").tolist()


HARD = ["", " ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "x\x1cy \x1d z", "it's we'LL don't", "Été größer ñandú", "\U0001f600\U0001f600 ok", "zz" * 3000, "1234 567", "tab\tq", "a\xa0b   c", "<|endoftext|> x", "é " * 9, "\r\n a\r\nb", "日本語のテキスト。", "--- *** ---", "a\x85b", "​ zero"]


def test_hard():
    for t, got in zip(HARD, ENCODER.encode(HARD), strict=True):
        assert ids(got) == TIKTOKEN.encode_ordinary(t), t


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab's lt\n\t.,1é́ñ \x1c☃")), max_size=40), max_size=6))
def test_random(texts):
    assert [ids(x) for x in ENCODER.encode(texts)] == [TIKTOKEN.encode_ordinary(t) for t in texts]


def test_query(docs_of):
    texts = [*HARD, None, HARD[9]]
    encoded = byte_bpe.encode(docs_of(texts), RANKS, P.PATTERN)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.digests(encoded, RANKS).collect()}
    for i, t in enumerate(texts):
        want = TIKTOKEN.encode_ordinary(t or "")
        assert got[i] == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(encoded, RANKS).collect()} == {i: (t or "").encode() for i, t in enumerate(texts)}


def test_empty(docs_of):
    assert byte_bpe.digests(byte_bpe.encode(docs_of([]), RANKS, P.PATTERN), RANKS).count() == 0


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_ENTRIES", 3)
    e = byte_bpe.Encoder(RANKS, P.PATTERN)
    for t in ["aa bb cc dd", "ee ff gg", "aa bb"]:
        assert ids(e.encode([t])[0]) == TIKTOKEN.encode_ordinary(t)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 8, 9, 300])
def test_merge_sizes(size):
    piece = bytes(i * 37 % 256 for i in range(size))
    t = "é" * size
    assert ids(ENCODER.pieces([t.encode()])[t.encode()]) == TIKTOKEN.encode_ordinary(t)
    assert b"".join(next(k for k, v in RANKS.items() if v == i) for i in ids(ENCODER.pieces([piece])[piece])) == piece
