import random

import numpy as np
import pyarrow as pa
import pytest

from lethe.llm import toxicity as T
from lethe.llm.textblocks import text_buffers


def corpus(n, seed):
    r = random.Random(seed)
    vocab = [f"{a}{b}{c}" for a in "bdf" for b in "aeiou" for c in ("l", "rn", "st", "mo")]
    texts, labels = [], []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.randint(5, 150))]
        bad = i % 3 == 0
        for _ in range(r.randint(2, 5) if bad else 0):
            w.insert(r.randint(0, len(w)), r.choice(["Gronk!", "zzug", "xorbi" + r.choice(vocab)]))
        texts.append(" ".join(w))
        labels.append(int(bad))
    return texts, np.array(labels)


@pytest.fixture(scope="module")
def model():
    return T.train(*corpus(240, 1))


def all_scores(model, texts):
    return T.score(model, *text_buffers(pa.array(texts, pa.string())))


def test_held_out(model):
    texts, labels = corpus(150, 2)
    s = all_scores(model, texts)
    assert ((s >= T.THRESHOLD) == labels).mean() > 0.95
    assert all_scores(model, ["bal best " * 20 + "xorbinew bal"])[0] >= T.THRESHOLD  # a word not met, by its letters


def test_gradients():
    rng = np.random.default_rng(3)
    m = T.train(*corpus(60, 4))
    p = {k: rng.normal(0, 0.4, x.shape).astype(np.float64) for k, x in m.p.items()}
    data, offs = text_buffers(pa.array(["bal gronk dest x", "zzug bal", "", "fust " * 40]))
    number, rows, v = T.tokens(data, offs)
    row, start, size = T.windows(rows)
    word, gram = T._inputs(m, v)
    label = np.array([1.0, 0, 1, 0, 1])[: len(row)]
    batch = number, start, size

    def loss():
        s, _ = T._forward(p, T._vectors(p, word, gram, v.offs), number, start, size)
        s = np.clip(s.astype(np.float64), 1e-9, 1 - 1e-9)
        return -(label * np.log(s) + (1 - label) * np.log(1 - s)).mean()

    g = T._gradients(p, batch, label, word, gram, v.offs)
    for k in ("out", "att", "uf", "ub", "wf", "wb", "cf", "cb", "words", "grams"):
        flat, gf = p[k].reshape(-1), np.asarray(g[k]).reshape(-1)
        for i in np.argsort(-np.abs(gf))[:3]:
            was, step = flat[i], 1e-2
            flat[i] = was + step
            up = loss()
            flat[i] = was - step
            down = loss()
            flat[i] = was
            assert abs((up - down) / (2 * step) - gf[i]) < 2e-3 + 0.05 * abs(gf[i]), (k, i)


def test_windows_cover_and_overlap():
    rows = np.array([0, 0, 1, 33, 33 + 100])
    row, start, size = T.windows(rows)
    for k in range(4):
        own = row == k
        seen = set()
        for s, n in zip(start[own], size[own], strict=True):
            seen.update(range(s, s + n))
        assert seen == set(range(rows[k], rows[k + 1])) and own.any()
    own = row == 3
    assert (start[own][:-1] + size[own][:-1] > start[own][1:]).all()


def test_score_does_not_depend_on_neighbours(model):
    texts, _ = corpus(30, 5)
    texts += ["", "a", "!!", "x" * 5000, "bal " * 3000]
    together = all_scores(model, texts)
    alone = np.array([all_scores(model, [t])[0] for t in texts])
    assert np.allclose(together, alone, atol=1e-5) and (together >= 0).all() and (together <= 1).all()


def test_edges(docs_of, model):
    got = {r.doc_id: r.score for r in T.scores(docs_of([None, "", "gronk gronk", "gronk gronk"]), model).collect()}
    assert got[0] == got[1] and got[2] == got[3] and len(got) == 4
    assert T.scores(docs_of([]), model).count() == 0
    assert {r.score for r in T.scores(docs_of(["a", None]), None).collect()} == {0.0}
    assert T.train([], np.array([])) is None and T.train(["a"], np.array([1])) is None


def test_words_inside_text_without_spaces(model):
    clean = "belmodustfirn" * 40
    inside = [clean[:at] + "xorbi" + clean[at:] for at in (0, 19, 100, 255, 400, len(clean))]
    s = all_scores(model, [clean, *inside])
    assert s[0] < T.THRESHOLD and (s[1:] >= T.THRESHOLD).all()


@pytest.mark.parametrize("n", [1, 40, 41, 60, 61, 1000])
def test_pieces_cover_long_words(n):
    text = bytes(np.random.default_rng(n).integers(97, 123, n, dtype=np.uint8)).decode()
    number, rows, v = T.tokens(*text_buffers(pa.array([text, "a b"])))
    assert rows.tolist() == [0, len(number) - 2, len(number)]
    every = {text[i : i + 6] for i in range(n - 5)}
    seen = set(v.grams.tolist())
    for g in every:
        assert T.mix(T.byte_rolling(np.frombuffer(g.encode(), np.uint8)).grams(6) + np.uint64(6))[0] in seen


def test_against_a_plain_loop(model):
    """Scores against a word-by-word forward pass in plain Python loops."""
    texts, _ = corpus(12, 5)
    texts += ["", "one", None, "gronk " * 100]
    p = model.p
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def run(vectors, side):
        h, out, hid = np.zeros(T.HIDDEN), [], T.HIDDEN
        for v in vectors:
            x, g = v @ p["w" + side] + p["c" + side], h @ p["u" + side]
            z, r = sigmoid(x[:hid] + g[:hid]), sigmoid(x[hid : 2 * hid] + g[hid : 2 * hid])
            h = (1 - z) * np.tanh(x[2 * hid :] + r * g[2 * hid :]) + z * h
            out.append(h)
        return out

    got = all_scores(model, texts)
    for text, score in zip(texts, got, strict=True):
        number, _, v = T.tokens(*text_buffers(pa.array([text], pa.string())))
        word, gram = T._inputs(model, v)
        vectors = []
        for i in number:
            known = [p["grams"][g] for g in gram[v.offs[i] : v.offs[i + 1]] if g]
            vectors.append(p["words"][word[i]] + (np.mean(known, 0) if known else p["grams"][0]))
        best = 0.0
        for s in range(0, max(1, len(vectors)), T.STRIDE):
            part = vectors[s : s + T.WINDOW]
            if s and s - T.STRIDE + T.WINDOW >= len(vectors):
                break
            h = [np.concatenate(x) for x in zip(run(part, "f"), run(part[::-1], "b")[::-1], strict=True)]
            if h:
                a = np.exp([x @ p["att"] for x in h])
                best = max(best, sigmoid(sum(w * x for w, x in zip(a / a.sum(), h, strict=True)) @ p["out"] + p["bias"]))
        if len(vectors):
            assert abs(best - score) < 1e-4
