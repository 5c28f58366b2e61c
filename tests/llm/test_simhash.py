import random

import numpy as np
import pytest
import xxhash

from lethe.llm import simhash
from lethe.llm.gray_index import GrayIndex, gray_rank, least_members


def print_of(text):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(nodes, linked):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in linked:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def brute(rows):
    """rows (id, fingerprint): documents are linked by any of their fingerprints."""
    ids = {i for i, _ in rows if i is not None}
    own = [(i, p) for i, p in rows if i is not None]
    linked = [(a, b) for k, (a, p) in enumerate(own) for b, q in own[:k] if (p ^ q).bit_count() <= 3]
    least = components_of(ids, linked)
    return [(i, p, least.get(i)) for i, p in rows]


def corpus(seed, families=15):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    texts = [None, "", " \n", "a", "A", "a b", "A\tb", "É b c", "é b c", "a b c d", "one two\nthree"]
    for _ in range(families):
        base = [r.choice(vocab) for _ in range(r.choice([2, 3, 9, 40, 400, 900]))]
        texts.append(" ".join(base))
        for _ in range(r.choice([1, 3, 12])):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 60))):
                w[r.randrange(len(w))] = r.choice(vocab)
            texts.append(r.choice([" ", "\t "]).join(w).upper() if r.random() < 0.3 else " ".join(w))
    return texts


@pytest.mark.parametrize(("seed", "group"), [(1, simhash.GROUP), (2, 4)])
def test_against_brute_force(docs_of, monkeypatch, seed, group):
    monkeypatch.setattr(simhash.links, "__defaults__", (simhash.BITS_APART, group))
    texts = corpus(seed)
    ids = random.Random(seed).sample(range(-50, 5000), len(texts))
    got = simhash.near_duplicates(docs_of(texts, ids).repartition(4)).collect()
    want = brute([(i, print_of(t)) for i, t in zip(ids, texts, strict=True)])
    assert sorted((r.doc, r.print % 2**64, r.component) for r in got) == sorted(want)
    assert len({c for *_, c in want}) < len(want) - 10


@pytest.mark.parametrize(("seed", "group"), [(3, 1024), (4, 16)])
def test_links_of_crowded_fingerprints(spark, seed, group):
    # Fingerprints around a few centres, most of them alike in most bits: groups are dealt again and again.
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(3)]
    codes = {0}
    while len(codes) < 700:
        c = r.choice(centres)
        for _ in range(r.randint(0, 9)):
            c ^= 1 << r.randrange(64)
        codes.add(c)
    rows = list(enumerate(codes))
    firsts = spark.createDataFrame([(c - 2**64 if c >> 63 else c, i) for i, c in rows], "print long, doc long")
    found = [(r.a, r.b) for r in simhash.links(firsts, 3, group).collect()]
    got = components_of(range(len(rows)), found)
    want = components_of(range(len(rows)), [(a, b) for a, p in rows for b, q in rows[:a] if (p ^ q).bit_count() <= 3])
    assert got == want and len(found) < 64 * len(rows)


@pytest.mark.parametrize("seed", range(4))
def test_index(seed):
    r = np.random.default_rng(seed)
    codes = np.unique(r.integers(0, 1 << 63, 4, dtype=np.uint64)[r.integers(0, 4, 900)] ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (4, 900)).astype(np.uint64), axis=0))
    group = r.integers(0, 5, len(codes)) ** 2
    order = np.lexsort([gray_rank(codes), group])
    codes, group = codes[order], group[order]
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(codes)]])
    a, b = GrayIndex(codes, bounds).pairs(3)
    near = (np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3) & (group[:, None] == group[None, :])
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True) if i < j]


def test_index_prunes(monkeypatch):
    # A group of random codes with 28 equal bits, as it is after two rounds: most groups are left above their members.
    r = np.random.default_rng(7)
    codes = np.unique(r.integers(0, 1 << 36, 1000, dtype=np.uint64))
    codes = codes[np.argsort(gray_rank(codes))]
    seen = []
    count = np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: seen.append(len(x)) or count(x))
    GrayIndex(codes, np.array([0, len(codes)])).pairs(3)
    assert seen[-1] < 0.45 * len(codes) ** 2 / 2


def test_gray_rank():
    for n in [0, 1, 2, 3, 200, 2**63 + 5, 2**64 - 1]:
        assert gray_rank(np.array([n ^ (n >> 1)], np.uint64))[0] == n


def test_least_members():
    got = least_members(6, np.array([0, 1, 4]), np.array([1, 3, 5]), np.array([9, 8, 7, 2, 5, 5]))
    assert got.tolist() == [3, 3, 2, 3, 4, 4]


def test_bit_sums():
    r = np.random.default_rng(1)
    hashes = r.integers(0, 1 << 63, 2000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    bounds = np.array([0, 0, 1, 255, 511, 511, 1900, 2000])
    got = simhash.bit_sums(hashes, bounds)
    want = [[sum(int(h) >> b & 1 for h in hashes[x:y]) for b in range(64)] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
    assert got.tolist() == want


def test_quarters():
    for mask in (2**64 - 1, 0b1011, 0, 2**63 + 5):
        parts = simhash.quarters(mask, 4)
        assert sum(parts) == mask and all(p & q == 0 for i, p in enumerate(parts) for q in parts[:i])


def test_edges(docs_of):
    assert simhash.near_duplicates(docs_of([])).count() == 0
    rows = [("x y z w", 4), ("x y z w", 4), ("x Y z w", 9), (None, 2), ("", 8), ("p q", None), ("p q", None), ("r s t", 11), ("r s t", 30), ("x y z w", 30)]
    got = simhash.near_duplicates(docs_of([t for t, _ in rows], [i for _, i in rows])).collect()
    want = brute([(i, print_of(t)) for t, i in rows])
    assert sorted(((r.doc, r.print % 2**64, r.component) for r in got), key=str) == sorted(want, key=str)
    assert {r.doc: r.component for r in got}[11] == 4


def test_long_text(docs_of):
    text = " ".join(f"w{i % 977}" for i in range(300_000))
    got = simhash.near_duplicates(docs_of([text, "short"])).collect()
    assert {r.doc: r.print % 2**64 for r in got} == {0: print_of(text), 1: print_of("short")}


def test_one_of_each(docs_of):
    docs = docs_of(["a b c d", "A b c d", "e f g", None, "a b c d"], [5, 3, 7, 9, None])
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(map(str, [r.doc_id for r in kept.collect()])) == ["3", "7", "9", "None"]
