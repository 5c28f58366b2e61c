import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lethe.llm import decontaminate as D


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=80), st.lists(st.integers(0, 4), max_size=80))
def test_common_subsequence(a, b):
    assert D.common_subsequence(a, b) == slow_lcs(a, b)


def bench(seed, n=30):
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(4000)]
    common = ["the", "of", "and"]
    text = lambda k: [r.choice(common) if r.random() < 0.3 else r.choice(vocab) for _ in range(k)]
    return r, text, [text(r.randint(15, 55)) for _ in range(n)]


def test_exact_and_paraphrased(spark, docs_of):
    r, text, items = bench(3)
    texts, want = [None, "", "one two", "the of and " * 200], set()
    for i, item in enumerate(items):
        for change in (0.0, 0.15, 0.25):
            w = list(item)
            for k in r.sample(range(len(w)), int(change * len(w))):
                w[k] = r.choice(["swapped", w[k] + "ish", "the"])
            want.add((len(texts), i))
            texts.append(" ".join([*text(r.randint(0, 200)), *w, *text(r.randint(0, 90))]).title())
    for _ in range(80):
        texts.append(" ".join(text(r.randint(1, 400))))
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(900, None), (901, ""), (902, "too short")], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in D.leaks(docs_of(texts).repartition(4), table).collect()}
    assert len(want & got) >= 0.95 * len(want) and not got - want
    kept = {x.doc_id for x in D.clean(docs_of(texts), table).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in got}


def test_blocks_of_items(spark, docs_of, monkeypatch):
    monkeypatch.setattr(D, "ITEM_BLOCK", 7)
    r, text, items = bench(5, 20)
    texts = [" ".join([*text(50), *w, *text(50)]) for w in items]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in D.leaks(docs_of(texts), table).collect()}
    assert got >= {(i, i) for i in range(20)}


def test_edges(spark, docs_of):
    empty = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p")], "item_id long, text string")
    assert D.leaks(docs_of(["a"]), empty).count() == 0 and D.leaks(docs_of([]), some).count() == 0
    text = "a b c d e f g h i j k l m n o p"
    got = D.leaks(docs_of([text, text, text, text + " q " * 50], [1, 1, None, 4]), some)
    assert sorted((x.doc_id, x.item_id) for x in got.collect()) == [(1, 1), (4, 1)]


@pytest.mark.parametrize("n", [0, 1, 16, 17, 40])
def test_distinct_counts(n):
    values = np.random.default_rng(n).integers(0, 5, n)
    half = np.arange(n) // D.HALF
    h, v, c = D._distinct(half, values, -(-n // D.HALF))
    want = [(k, x, int((values[half == k] == x).sum())) for k in range(-(-n // D.HALF)) for x in sorted(set(values[half == k]))]
    assert list(zip(h.tolist(), v.tolist(), c.tolist(), strict=True)) == want


def terms_of(spark, docs_of, texts, items):
    table = docs_of(texts).selectExpr("doc_id", "text")
    idf = D.inverse_frequencies(table)
    own = D.items_of(list(enumerate(items)), idf)
    shared = spark.sparkContext.broadcast((own, idf))
    return own, table.mapInArrow(D._terms(shared), D._TERMS)


def test_decomposition_of_all_rows(spark, docs_of, monkeypatch):
    r, text, items = bench(11)
    words = [w for i in items for w in i]
    texts = [" ".join(r.choice(words) if r.random() < 0.5 else r.choice(text(1)) for _ in range(r.randint(1, 90))) for _ in range(6000)]
    own, terms = terms_of(spark, docs_of, texts, [" ".join(i) for i in items])
    parts = terms.toArrow().combine_chunks().to_batches()
    whole = np.zeros((len(own.known),) * 2)
    for b in parts:
        for i in range(0, len(b), 200):
            p = D._passages(b.slice(i, 200))
            dense = np.zeros((len(p.row), len(own.known)))
            np.add.at(dense, (np.repeat(np.arange(len(p.row)), np.diff(p.offs)), p.terms), p.weights)
            dense /= np.maximum(p.norm, 1e-9)[:, None]
            whole += dense.T @ dense
    fit, fitted = D.latent_space, []
    monkeypatch.setattr(D, "latent_space", lambda terms, *rest: (fitted.append(terms.count()), fit(terms, *rest))[1])
    D.leaks(docs_of(texts), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")).count()
    assert fitted == [terms.count()] and fitted[0] > 4000
    monkeypatch.undo()
    seen = []
    monkeypatch.setattr(D, "_gram_product", lambda p, m, out: None)  # of the items alone
    monkeypatch.setattr(np.linalg, "qr", lambda x, qr=np.linalg.qr: (seen.append(x.copy()), qr(x))[1])
    D.latent_space(terms, own, D.item_passages(own))
    basis = np.random.default_rng(5).normal(size=seen[0].shape).astype(np.float32)
    assert np.allclose(seen[0], whole @ basis, rtol=1e-3, atol=1e-3 * np.abs(whole).max())


def test_many_more_items_than_the_rank(spark, docs_of, monkeypatch):
    fit = D.latent_space
    monkeypatch.setattr(D, "latent_space", lambda *args: fit(*args, rank=8))
    r = random.Random(21)
    vocab = [f"v{i}" for i in range(9000)]
    text = lambda k: [r.choice(vocab) for _ in range(k)]
    items = [text(r.randint(15, 58)) for _ in range(900)]
    texts, want = [], set()
    for i, item in enumerate(items[::3]):
        w = list(item)
        for k in r.sample(range(len(w)), len(w) // 5) if i % 2 else []:
            w[k] = "swapped"
        texts.append(" ".join([*text(r.randint(0, 40)), *w, *text(r.randint(0, 40))]))
        want.add((i, 3 * i))
    texts += [" ".join(text(r.randint(20, 200))) for _ in range(300)]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in D.leaks(docs_of(texts), table).collect()}
    assert got == want


def test_long_and_short_items(spark, docs_of):
    r, text, _ = bench(31, 0)
    items = [text(n) for n in (161, 300, 900, 3000)] + [["alpha"], ["beta", "gamma"], [f"s{i}" for i in range(7)], ["the", "of", "and", "of"]]
    texts = [" ".join([*text(r.randint(0, 60)), *i, *text(r.randint(0, 60))]) for i in items]
    changed = [w if r.random() < 0.8 else "swapped" for w in items[2]]
    texts += [" ".join([*text(30), *changed, *text(30)]), "s0 s1 s2 s3 s4 s5 x s6", "gamma beta", "alphas", None]
    texts += ["Beta,\n(GAMMA)"]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in D.leaks(docs_of(texts), table).collect()}
    n = len(items)
    want = {(i, i) for i in range(n)} | {(n, 2), (n + 5, 5)}
    assert {x for x in got if x[1] != 7} == {x for x in want if x[1] != 7} and (7, 7) in got
    only = spark.createDataFrame([(1, "beta gamma")], "item_id long, text string")
    assert {x.doc_id for x in D.leaks(docs_of(["beta gamma"] * 20), only).collect()} == set(range(20))


def test_item_in_a_third_of_all_rows(spark, docs_of):
    r = random.Random(41)
    vocab = [f"v{i}" for i in range(6000)]
    text = lambda k: [r.choice(vocab) for _ in range(k)]
    item, texts, want = text(40), [], set()
    for i in range(600):
        if i % 3 == 0:
            want.add(i)
            w = ["swapped" if i % 2 and r.random() < 0.15 else x for x in item]
            texts.append(" ".join([*text(r.randint(20, 60)), *w, *text(r.randint(20, 60))]))
        else:
            texts.append(" ".join(text(100)))
    table = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {x.doc_id for x in D.leaks(docs_of(texts).repartition(4), table).collect()} == want


def test_copies_count_once_and_stop_words_keep_a_weight(spark, docs_of):
    r = random.Random(43)
    vocab = [f"v{i}" for i in range(3000)]
    texts = ["p q r s"] * 300 + [" ".join(["aa", "bb", "cc", "dd", "ee", *[r.choice(vocab) for _ in range(11)]]) for _ in range(600)]
    docs = docs_of(texts).select("text")
    idf = D.inverse_frequencies(docs)
    rows = [(1, "aa bb cc dd ee dd cc bb aa ee"), (2, "p q r s")]
    items = D.items_of(rows, idf)
    weight = lambda items, i: [items.weight[x - 1] for x in items.words[i]]
    assert not any(weight(items, 0)) and min(weight(items, 1)) > 3
    assert min(weight(D.items_of(rows, D.floored(rows, idf)), 0)) == D.FLOOR
    n = 5000
    regs = np.zeros((1, D.REGISTERS), np.uint8)
    h = np.random.default_rng(1).integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
    np.maximum.at(regs[0], ((h >> np.uint64(2)) & np.uint64(63)).astype(int), (53 - np.frexp((h >> np.uint64(12)).astype(float))[1]).astype(np.uint8))
    assert abs(D._counts(regs)[0] - n) < 0.4 * n


def holds(words, part):
    return any(words[i : i + len(part)] == part for i in range(len(words) - len(part) + 1))


def all_passages(texts, items):
    """Pairs whose check holds on some passage, without any search for candidates."""
    out = set()
    known = {w for i in items for w in i}
    for d, text in enumerate(texts):
        words = [w if w in known else None for w in text]  # other words match nothing
        for k, item in enumerate(items):
            if not set(words) & set(item):
                continue
            for h in range(-(-len(words) // D.HALF)):
                part = words[max(0, h * D.HALF - len(item)) : (h + 2) * D.HALF + len(item)]
                share = slow_lcs(item, part) / len(item)
                if share >= D.LEAST_COMMON or (share >= D.LEAST_COMMON_WITH_ANSWER and holds(part, item[-D.ANSWER :])):
                    out.add((d, k))
                    break
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_all_links_are_found(spark, docs_of, seed):
    """Items with no, some and most words changed, moved or left out, around both thresholds."""
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(2500)]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [text(r.randint(10, 45)) for _ in range(14)]
    texts = [text(r.randint(1, 120)) for _ in range(25)]
    for item in items:
        for change in (0, 0.2, 0.3, 0.38, 0.42, 0.46, 0.55):
            w = list(item)
            for i in r.sample(range(len(w)), round(change * len(w))):
                w[i] = r.choice([f"other{r.randrange(900)}", r.choice(item), ""])
            if r.random() < 0.4:
                w = w[: -D.ANSWER] + item[-D.ANSWER :]
            texts.append([*text(r.randint(0, 60)), *filter(None, w), *text(r.randint(0, 60))])
    want = all_passages(texts, items)
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in D.leaks(docs_of([" ".join(t) for t in texts]).repartition(3), table).collect()}
    assert len(want) > 40 and got == want
