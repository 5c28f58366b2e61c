import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lethe.llm import importance as imp

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def buckets_of(text, longest=1, buckets=10000):
    w = words_of(text)
    runs = [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]
    return [zlib.crc32(r.encode()) % buckets for r in runs]


def brute(rows, target, longest=1, buckets=10000, share=10):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(buckets_of(text, longest, buckets))
    for text in target:
        t.update(buckets_of(text, longest, buckets))
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for i, text in rows:
        own = buckets_of(text, longest, buckets)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in own)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(own), weight, score, None, len(words_of(text))])
    fit = sorted((r for r in out if r[5] >= 20 and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for rank, r in enumerate(fit[: len(fit) * share // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in out]


def corpus(seed, n=150):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(200)] + ["Straße", "日本語", "x" * 70, "é" * 40, "a1b2", "Q"]
    texts = [None, "", " .,-", "a", "A\x00b\x7fc", "z" * 200_000]
    return texts + ["".join(r.choice(vocab) + r.choice([" ", "-", "\n", ". "]) for _ in range(r.randint(1, 80))) for _ in range(n)]


@pytest.mark.parametrize(("seed", "longest", "buckets", "share"), [(1, 1, 10000, 10), (2, 1, 10000, 50), (3, 3, 97, 100)])
def test_against_brute_force(spark, docs_of, seed, longest, buckets, share):
    texts = corpus(seed)
    ids = random.Random(seed).sample(range(-50, 5000), len(texts))
    target = corpus(seed + 10, 20)
    got = imp.resample(docs_of(texts, ids).repartition(3), spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, buckets=buckets, share=share)
    got = [(r.doc, r.n_features, r.weight, r.score, r.rank) for r in got.collect()]
    assert sorted(got) == sorted(brute(list(zip(ids, texts, strict=True)), target, longest, buckets, share))


def test_crcs():
    r = np.random.default_rng(3)
    data = r.integers(0, 4, 5000).astype(np.uint8)
    starts = r.integers(0, 4000, 700)
    ends = starts + r.integers(0, 90, 700)
    assert imp.crcs(data, starts, ends).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]


@pytest.mark.parametrize("length", [1, 7, 8, 9, 20])
def test_distinct_columns(length):
    m = np.random.default_rng(length).integers(0, 2, (length, 300)).astype(np.uint8)
    distinct, inverse = imp.distinct_columns(m)
    assert (m[:, distinct][:, inverse] == m).all()
    assert len(distinct) == len({c.tobytes() for c in m.T})


def test_edges(spark, docs_of):
    none = spark.createDataFrame([], "text string")
    assert imp.resample(docs_of([]), none).count() == 0
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(4, text), (4, text), (None, text), (7, text), (8, "few words")]
    got = imp.resample(docs_of([t for _, t in rows], [i for i, _ in rows]), none, share=100)
    got = [(r.doc, r.n_features, r.weight, r.score, r.rank) for r in got.collect()]
    assert sorted(got, key=str) == sorted(brute(rows, [], share=100), key=str)


def test_selected(spark, docs_of):
    texts, ids = corpus(5, 60), list(range(66))
    docs = docs_of(texts, ids)
    ranks = imp.resample(docs, docs.limit(5), share=30)
    kept = imp.selected(docs, ranks)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc for r in ranks.where("rank is not null").collect()}
