import random

import numpy as np
import pytest

from lethe.llm import hyperminhash as hmh
from lethe.llm import near_dup


def sets_of(texts):
    out = []
    for t in texts:
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute(texts, ids=None):
    ids = ids or list(range(len(texts)))
    sets, up = sets_of(texts), list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i in range(len(texts)):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return [(ids[i], len(sets[i]), least[root(i)]) for i in range(len(texts))]


def corpus(seed, families=12):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    line = [r.choice(vocab) for _ in range(12)]
    texts = [None, "", " \n", "a", "A", "a b c d", "a B c d", "É b c d e", "é b c d e", "a b c d e f", "a b c d e f"]
    for f in range(families):
        base = [r.choice(vocab) for _ in range(r.choice([6, 9, 15, 40, 120, 400]))]
        if f % 3 == 0:
            base[0:0] = line
        texts.append(" ".join(base))
        for _ in range(r.choice([1, 3, 25])):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = r.choice(vocab)
            texts.append(r.choice([" ", "\t"]).join(w).upper() if r.random() < 0.3 else " ".join(w))
        if f % 2:  # a chain: each step is near, the ends are not
            w = list(base)
            for _ in range(8):
                w = w[max(1, len(w) // 14) :] + [r.choice(vocab) for _ in range(max(1, len(w) // 14))]
                texts.append(" ".join(w))
    return texts


def test_estimate():
    r = np.random.default_rng(5)
    for jac in (0.5, 0.75, 0.9):
        errors = []
        for _ in range(60):
            n = 600
            common = int(n * jac)
            u = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            a = np.sort(np.concatenate([u[:common], u[common::2]]))
            b = np.sort(np.concatenate([u[:common], u[common + 1 :: 2]]))
            ra, rb = (hmh.registers(np.zeros(len(x), np.int64), x, 1) for x in (a, b))
            errors.append(hmh.estimate(ra[0], len(a), rb, np.array([len(b)]))[0][0] - common / n)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


@pytest.mark.parametrize(("seed", "block"), [(1, near_dup.BLOCK), (2, near_dup.BLOCK), (1, 3)])
def test_against_brute_force(docs_of, monkeypatch, seed, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    texts = corpus(seed)
    r = random.Random(seed)
    ids = r.sample(range(-50, 5000), len(texts))
    got = near_dup.near_duplicates(docs_of(texts, ids).repartition(4)).collect()
    assert sorted(map(tuple, got)) == sorted(brute(texts, ids))


def test_few_shingles(docs_of):
    r = random.Random(9)
    texts = []
    for i in range(400):  # sets of 3 and 4, and of 6 and 7, that differ by one shingle
        w = [f"w{i}x{k}" for k in range(r.choice([8, 11]))]
        texts += [" ".join(w), " ".join(w[:-1])]
    got = near_dup.near_duplicates(docs_of(texts, list(range(len(texts))))).collect()
    assert {r.doc: r.component for r in got} == {i: i - i % 2 for i in range(len(texts))}


def test_hot_bucket(docs_of, monkeypatch):
    # Many documents share a template and stay apart, some of them are near: the buckets of the template's bands are cut into blocks.
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    r = random.Random(4)
    template = [f"t{i}" for i in range(120)]
    texts = []
    for i in range(60):
        own = [f"d{i}x{k}" for k in range(70)]
        texts.append(" ".join(template + own))
        if i % 5 == 0:
            texts.append(" ".join(template + own[: r.randint(60, 69)]))
    ids = list(range(len(texts)))
    got = near_dup.near_duplicates(docs_of(texts, ids).repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(brute(texts, ids))


def test_dealt_rows_of_a_hot_bucket(spark, monkeypatch):
    # A component of 5000 and 6 other members: a row for each member and block, not for each two blocks.
    monkeypatch.setattr(near_dup, "BLOCK", 50)
    rows = [(7, i, 0) for i in range(5000)] + [(7, 10_000 + i, 10_000 + i // 2) for i in range(6)] + [(8, 1, 1), (8, 2, 2), (9, 3, 3), (9, 4, 3)]
    got = near_dup.dealt_groups(spark.createDataFrame(rows, "key long, doc long, label long")).collect()
    assert len(got) == 5000 + 6 * 100 + 6 + 2
    groups = {}
    for r in got:
        groups.setdefault(r.key, []).append(r)
    met = {(a.doc, b.doc) for g in groups.values() for a in g for b in g if a.label != b.label and (a.side != b.side or not any(x.side for x in g))}
    label = {d: n for _, d, n in rows}
    want = {(a, b) for k in (7, 8) for _, a, _ in [r for r in rows if r[0] == k] for b in ([d for q, d, _ in rows if q == k] if a >= 10_000 or k == 8 else range(10_000, 10_006)) if label[a] != label[b]}
    assert met == want and max(map(len, groups.values())) < 120


def test_edges(docs_of):
    assert near_dup.near_duplicates(docs_of([])).count() == 0
    got = near_dup.near_duplicates(docs_of(["x y z w v", "x y z w v", "x y z w v", None, "p q"], [4, 4, 9, 2, None])).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(4, 1, 4), (4, 1, 4), (9, 1, 4), (2, 0, 2), (None, 1, None)], key=str)


@pytest.mark.parametrize("cells", [64, 1 << 22])
def test_intersections(monkeypatch, cells):
    monkeypatch.setattr(near_dup, "CELLS", cells)
    r = np.random.default_rng(8)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 40)).astype(np.uint64)) for _ in range(13)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets[3:9]]
    got = near_dup.intersections(sets, slice(3, 9))
    # An item of one set alone isn't counted in the set's intersection with itself, which no link needs.
    same = np.eye(13, dtype=bool)[3:9]
    assert (got[~same] == np.array(want)[~same]).all()
    assert near_dup.intersections([np.array([1], np.uint64), np.array([2], np.uint64)], slice(0, 2)).sum() == 0
