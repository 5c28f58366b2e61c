"""Substring and suffix-array dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest

from lethe.llm import repeats
from lethe.llm.cutting import digest
from lethe.llm.deep_shallow import sort
from lethe.llm.substring_dedup import remove_repeated_words
from lethe.llm.suffix_dedup import remove_repeated_bytes


def brute_words(texts, length):
    owner, out = {}, []
    split = [(t or "").encode().split() for t in texts]
    for i, w in enumerate(split):
        for s in range(len(w) - length + 1):
            owner.setdefault(tuple(w[s : s + length]), i)
    for i, w in enumerate(split):
        gone = set()
        for s in range(len(w) - length + 1):
            if owner[tuple(w[s : s + length])] < i:
                gone.update(range(s, s + length))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def brute_bytes(texts, length):
    seen, out = set(), []
    for i, t in enumerate(texts):
        raw, gone = (t or "").encode(), set()
        for s in range(len(raw) - length + 1):
            x = raw[s : s + length]
            if x in seen:
                gone.update(range(s, s + length))
            seen.add(x)
        kept = bytes(b for j, b in enumerate(raw) if j not in gone)
        spans = sum(j - 1 not in gone for j in gone)
        out.append((i, len(raw), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    vocab = ["a", "bé", "cc", "dd d", "e", "\U0001f600x", "ggg", "hh", "in", "j"] + [f"w{i}" for i in range(40)]
    passage = [r.choice(vocab) for _ in range(60)]
    line = " ".join(r.choice(vocab) for _ in range(30))
    texts = [None, "", " \t\n", "a", "x " * 400, "x " * 400, "z" * 700, "z" * 650 + "y\0\0" * 60]
    for i in range(60):
        w = [r.choice(vocab) for _ in range(r.randint(1, 120))]
        if i % 3 == 0:
            w[r.randint(0, len(w)) : 0] = passage[r.randint(0, 20) : r.randint(30, 60)]
        if i % 4 == 0:
            w = w + [line, "q", line]
        texts.append(r.choice([" ", "  ", "\n"]).join(w))
    texts += [r.choice(texts[8:]) for _ in range(8)]
    for _ in range(20):
        w = r.choice(texts[8:60]).split(" ")
        w[r.randrange(len(w))] = "edit"
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("shard", [1, 2000])
@pytest.mark.parametrize("remove", [remove_repeated_words, remove_repeated_bytes])
def test_small_shards(spark, docs_of, remove, shard, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD_BYTES", shard)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    texts = corpus(3)
    words = remove is remove_repeated_words
    got = digest(remove(docs_of(texts).repartition(3)), "n", None if words else "n_spans").collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == (brute_words(texts, 13) if words else brute_bytes(texts, 100))


@pytest.mark.parametrize("hot", [False, True])
def test_words(spark, docs_of, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(repeats, "HOT", 2)
        monkeypatch.setattr(repeats, "HOT_IN_BATCH", 2)
    texts = corpus(1)
    got = digest(remove_repeated_words(docs_of(texts).repartition(5)), "n_words").collect()
    assert sorted(map(tuple, got)) == brute_words(texts, 13)


@pytest.mark.parametrize("hot", [False, True])
def test_bytes(spark, docs_of, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(repeats, "HOT", 2)
        monkeypatch.setattr(repeats, "HOT_IN_BATCH", 2)
    texts = corpus(2)
    got = digest(remove_repeated_bytes(docs_of(texts).repartition(5)), "n_bytes", "n_spans").collect()
    assert sorted(map(tuple, got)) == brute_bytes(texts, 100)


@pytest.mark.parametrize("remove", [remove_repeated_words, remove_repeated_bytes])
def test_edges(spark, docs_of, remove):
    assert remove(docs_of([])).count() == 0
    long = " ".join(f"w{i}" for i in range(200))
    got = remove(docs_of([long, long, long], [5, 5, None])).collect()
    assert len(got) == 3 and all(not r.spans for r in got)
    got = {r.doc: bytes(r.kept) for r in remove(docs_of([long, long], [-3, 2])).collect()}
    assert got == {-3: long.encode(), 2: b""}


def test_documents_without_repeats(spark):
    from lethe.llm.suffix_dedup import without_repeats

    long = "".join(f"{i:03d}é" for i in range(60))
    rows = [(1, long, 5, "a", "b"), (2, "x" + long, 6, None, "c"), (3, None, None, "d", None), (4, "", 0, "e", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, _ string, none string")
    got = {r.doc_id: r for r in without_repeats(df).collect()}
    assert without_repeats(df).columns == df.columns
    assert got[1].text == long and got[2].text == "x" and got[2].n_chars == 1 and got[3].text is None and got[4].text == ""
    assert [got[i]["_"] for i in (1, 2, 3, 4)] == ["a", None, "d", "e"] and got[2]["none"] == "c"


@pytest.mark.parametrize("contexts", [[b"", b""], [b"", b"", b""], [b"", b"a"], [b"a", b""]])
def test_empty_contexts_are_sorted(contexts):
    order, common = sort(np.zeros(len(contexts), np.int64), contexts, max(map(len, contexts)))
    assert [contexts[i] for i in order] == sorted(contexts) and common.tolist() == [-1] + [0] * (len(contexts) - 1)


@pytest.mark.parametrize("remove", [remove_repeated_words, remove_repeated_bytes])
@pytest.mark.parametrize("hot", [False, True])
def test_shards_of_one_minimizer(spark, docs_of, remove, hot, monkeypatch):
    """A shard may hold two pieces alone, with nothing to the left of their minimizer."""
    monkeypatch.setattr(repeats, "SHARD_BYTES", 1)
    if hot:
        monkeypatch.setattr(repeats, "HOT", 2)
        monkeypatch.setattr(repeats, "HOT_IN_BATCH", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    texts = corpus(4)
    words = remove is remove_repeated_words
    got = digest(remove(docs_of(texts).repartition(3)), "n", None if words else "n_spans").collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == (brute_words(texts, 13) if words else brute_bytes(texts, 100))
