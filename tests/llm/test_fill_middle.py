import hashlib
import random
import re

import pytest

from lethe.llm import fill_middle as fm


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    drawn = sha(f"7:{'' if doc_id is None else doc_id}")
    h = [int(drawn[i * 8 : i * 8 + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc_id, len(lines), "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    spm = h[3] % 100 < 50
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, len(lines), "spm" if spm else "psm", len(p), len(m), sha(out), sha(text)


def corpus(seed):
    r = random.Random(seed)
    words = ["a", "é", "日本", "x\r", "", " ", " ", "<P", "S>", "𝒳"]
    texts = [None, "", "\n", "\n\n", "one", "one\n", "has <S> inside\nx", "y" * 500, "z\n" * 300]
    texts += ["".join(r.choice(words) + r.choice(["", " ", "\n"]) for _ in range(r.randint(1, 90))) for _ in range(60)]
    return texts


@pytest.mark.parametrize(("seed", "piece"), [(1, fm.PIECE), (2, 3), (3, 40)])
def test_against_plain_version(docs_of, monkeypatch, seed, piece):
    texts = corpus(seed)
    monkeypatch.setattr(fm.pieces, "__defaults__", (piece,))
    ids = random.Random(seed).sample(range(-50, 5000), len(texts))
    got = fm.fill_middle(docs_of(texts, ids).repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(expected(i, t) for i, t in zip(ids, texts, strict=True))


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_pieces(size):
    for text in filter(None, corpus(5)):
        cut = list(fm.pieces(text, 0, len(text), size))
        assert "".join(cut) == text and all(cut) and max(map(len, cut)) <= 2 * size


def test_outputs(docs_of):
    texts = corpus(4)
    ids = list(range(len(texts)))
    got = fm.outputs(docs_of(texts, ids)).orderBy("doc_id", "place").collect()
    whole = {i: "" for i in ids}
    for r in got:
        whole[r.doc_id] += r.piece
    assert {i: sha(t) for i, t in whole.items()} == {i: expected(i, t)[5] for i, t in zip(ids, texts, strict=True)}


def test_second_sort_moves_nothing(docs_of):
    plan = fm.fill_middle(docs_of(["a\nb"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 2


def test_edges(docs_of):
    assert fm.fill_middle(docs_of([])).count() == 0
    rows = [("a\nb\nc", 4), ("a\nb\nc", 4), ("other\n", 4), (None, None), ("q\nr", None), ("q\nr", None)]
    got = fm.fill_middle(docs_of([t for t, _ in rows], [i for _, i in rows]).coalesce(1)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((expected(i, t) for t, i in rows), key=str)
