"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is the sum of a word vector and the mean of its known character-gram vectors.  Words and grams that go
with label 1 beyond chance have vectors of their own; all other words share HASHED context vectors by their hash, so
the recurrence sees the words around too.  Two gated recurrent passes run over each window of WINDOW words,
attention pools their states and a logistic unit scores the window.  Windows overlap and cover every text;
a text's score is its highest window's.

Training takes a sample of labelled rows whose size is a documented bound (FIT_ROWS), collected
to the driver.  All windows of a positive text with a listed word or gram start as positive; after a first
phase those that score low are dropped, since a positive text need not be toxic throughout, and the
highest windows of negative texts are drawn more often.

Defined results: a null or empty text is one window without words; without training rows of both labels
every score is 0; repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblocks import blocks, byte_rolling, lower_ascii, mix, word_bounds

WINDOW, STRIDE = 32, 24  # words
GRAMS = 4, 5, 6  # bytes, with a mark on each side of the word
WORDS_KEPT, GRAMS_KEPT = 2048, 4096
LEAST_G, LEAST_ODDS = 36.0, 25.0  # what makes a word or gram go with label 1 beyond chance
HASHED, CONTEXT_DECAY = 1024, 1e-3  # context vectors and what holds them small, so that ordinary words alone don't decide
DIM, HIDDEN = 16, 8
FIT_ROWS = 600, 1200  # of labels 1 and 0: the documented bound of the fit
FIT_WINDOWS = 40_000  # windows of the sample that training sees
STEPS, BATCH, RATE = 180, 96, 0.02
THRESHOLD = 0.7
_LONGEST, _STEP = 40, 20  # bytes of a word; a longer one is cut into pieces of so many bytes, one each _STEP bytes


class Model(NamedTuple):
    words: np.ndarray  # sorted hashes
    grams: np.ndarray
    p: dict[str, np.ndarray]


class Vocabulary(NamedTuple):
    """Distinct words of some texts: their hashes and their grams' hashes as ragged rows."""

    hashes: np.ndarray
    grams: np.ndarray
    offs: np.ndarray


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, Vocabulary]:
    """Each word's number among the distinct words, word offsets of the rows, and the distinct words.

    Punctuation at a word's ends is cut off; a word of punctuation alone stays as it is.  A word over _LONGEST bytes
    gives overlapping pieces that are words of their own and cover all of it.
    """
    data = lower_ascii(data)
    starts, ends, rows = word_bounds(data, offs)
    solid = ((data >= 97) & (data <= 122)) | (data >= 128) | ((data >= 48) & (data <= 57))
    upto = np.concatenate([[0], np.cumsum(solid)])
    at = np.flatnonzero(solid)
    some = upto[ends] > upto[starts]
    if len(at):
        first, last = at[np.minimum(upto[starts], len(at) - 1)], at[np.maximum(upto[ends] - 1, 0)] + 1
        starts, ends = np.where(some, first, starts), np.where(some, last, ends)
    pieces = 1 + np.maximum(0, -(-(ends - starts - _LONGEST) // _STEP))
    upto = np.concatenate([[0], np.cumsum(pieces)])
    word = np.repeat(np.arange(len(pieces)), pieces)
    starts = starts[word] + (np.arange(len(word)) - upto[word]) * _STEP
    ends, rows = np.minimum(ends[word], starts + _LONGEST), upto[rows]
    rolling = byte_rolling(data)
    hashes = rolling.spans(starts, ends)
    distinct, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    s, e = starts[first], ends[first]
    size = e - s
    marked = np.empty(int((size + 2).sum()), np.uint8)
    bounds = np.concatenate([[0], np.cumsum(size + 2)])
    row = np.repeat(np.arange(len(size)), size + 2)
    col = np.arange(len(marked)) - bounds[:-1][row]
    inner = (col > 0) & (col <= size[row])
    source = s[row] + col - 1
    marked[:] = 1
    marked[inner] = data[source[inner]]
    marks = byte_rolling(marked)
    parts, owners = [marks.spans(bounds[:-1], bounds[1:])], [np.arange(len(size))]  # the whole word, so that each has one
    for n in GRAMS:
        g = marks.grams(n)
        ok = np.arange(len(g)) + n <= bounds[1:][row[: len(g)]]
        parts.append(mix(g[ok] + np.uint64(n)))
        owners.append(row[: len(g)][ok])
    grams, owner = np.concatenate(parts), np.concatenate(owners)
    o = np.argsort(owner, kind="stable")
    return number, rows, Vocabulary(distinct, grams[o], np.searchsorted(owner[o], np.arange(len(distinct) + 1)))


def windows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and length of each window; each row has one at least."""
    n = np.diff(rows)
    count = 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE))
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, rows[:-1][row] + k * STRIDE, np.minimum(WINDOW, n[row] - k * STRIDE)


def _find(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """1-based place in a sorted list, 0 if absent."""
    at = np.searchsorted(known, hashes)
    at[at == len(known)] = 0
    return np.where(known[at] == hashes, at + 1, 0) if len(known) else np.zeros(len(hashes), np.int64)


def _inputs(model: Model, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the word vectors, the HASHED context vectors first, and of the gram vectors."""
    listed = _find(model.words, v.hashes)
    context = (mix(v.hashes) % np.uint64(HASHED)).astype(np.int64)
    return np.where(listed > 0, HASHED - 1 + listed, context), _find(model.grams, v.grams)


def _known(gram: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and words of the known grams, and how many each word has."""
    at = np.flatnonzero(gram)
    owner = np.searchsorted(offs, at, "right") - 1
    return at, owner, np.bincount(owner, minlength=len(offs) - 1)


def _vectors(p: dict, word: np.ndarray, gram: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Word vector plus mean vector of the known grams, or the shared vector where none is known."""
    at, owner, count = _known(gram, offs)
    total = np.zeros((len(word), DIM), p["grams"].dtype)
    np.add.at(total, owner, p["grams"][gram[at]])
    return p["words"][word] + np.where(count[:, None] > 0, total / np.maximum(count, 1).astype(total.dtype)[:, None], p["grams"][0])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


def _pass(inputs: np.ndarray, u: np.ndarray, at: np.ndarray, live: list[int], steps: range, keep: bool):
    """States of one direction; windows stand longest first, live[t] of them reach word t."""
    n, hidden = at.shape[0], u.shape[0]
    states = np.zeros((at.shape[1], n, hidden), np.float32)
    h = np.zeros((n, hidden), np.float32)
    trace = []
    for t in steps:
        k = live[t]
        if not k:
            continue
        x, before = inputs[at[:k, t]], h[:k]
        g = before @ u
        zr = _sigmoid(x[:, : 2 * hidden] + g[:, : 2 * hidden])
        z, r = zr[:, :hidden], zr[:, hidden:]
        new = np.tanh(x[:, 2 * hidden :] + r * g[:, 2 * hidden :])
        after = new + z * (before - new)
        if keep:
            trace.append((t, k, before.copy(), z, r, new, g[:, 2 * hidden :]))
        h[:k] = after
        states[t, :k] = after
    return states, trace


def _layout(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    order = np.argsort(-size, kind="stable")
    at = start[order][:, None] + np.minimum(np.arange(WINDOW), np.maximum(size[order] - 1, 0)[:, None])
    live = [int(np.searchsorted(-size[order], -t, "left")) for t in range(WINDOW)]
    return order, at, live


def _forward(p: dict, vectors: np.ndarray, number: np.ndarray, start: np.ndarray, size: np.ndarray, keep: bool = False):
    order, at, live = _layout(start, size)
    word = number[np.minimum(at, max(len(number) - 1, 0))] if len(number) else np.zeros_like(at)
    states, traces = [], []
    for side, steps in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
        inputs = (vectors @ p["w" + side] + p["c" + side]).astype(np.float32)
        s, trace = _pass(inputs, p["u" + side], word, live, steps, keep)
        states.append(s)
        traces.append(trace)
    h = np.concatenate(states, 2)  # word, window, state
    e = h @ p["att"]
    e[np.arange(WINDOW)[:, None] >= size[order][None, :]] = -1e9
    a = np.exp(e - e.max(0))
    a /= a.sum(0)
    pooled = (a[:, :, None] * h).sum(0)
    score = _sigmoid(pooled @ p["out"] + p["bias"])
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return score[back], (order, word, h, a, pooled, score, traces)


def score(model: Model, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Score of each row: the highest of its windows."""
    number, rows, v = tokens(data, offs)
    row, start, size = windows(rows)
    vectors = _vectors(model.p, *_inputs(model, v), v.offs) if len(v.hashes) else np.zeros((1, DIM), np.float32)
    s, _ = _forward(model.p, vectors.astype(np.float32), number, start, size)
    return np.maximum.reduceat(s, np.searchsorted(row, np.arange(len(rows) - 1)))


def _gradients(p: dict, batch, label: np.ndarray, word: np.ndarray, gram: np.ndarray, offs: np.ndarray) -> dict:
    number, start, size = batch
    used, local = np.unique(number, return_inverse=True)
    counts = np.diff(offs)[used]
    own = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(offs[:-1][used], counts)
    local_offs = np.concatenate([[0], np.cumsum(counts)])
    vectors = _vectors(p, word[used], gram[own], local_offs)
    s, (order, at, h, a, pooled, ordered, traces) = _forward(p, vectors, local, start, size, True)
    g = {}
    d = ((ordered - label[order]) / len(label)).astype(np.float32)
    g["out"], g["bias"] = pooled.T @ d, d.sum()
    dpool = d[:, None] * p["out"]
    da = (h * dpool).sum(2)
    de = a * (da - (a * da).sum(0))
    g["att"] = np.einsum("tn,tnh->h", de, h)
    dh_all = a[:, :, None] * dpool + de[:, :, None] * p["att"]
    dvec = np.zeros_like(vectors)
    for i, (side, trace) in enumerate(zip("fb", traces, strict=True)):
        hid = p["u" + side].shape[0]
        dstate = dh_all[:, :, i * hid : (i + 1) * hid]
        du, dw = np.zeros_like(p["u" + side]), np.zeros_like(p["w" + side])
        dc, carry = np.zeros_like(p["c" + side]), np.zeros((len(order), hid), np.float32)
        for t, k, before, z, r, new, gn in reversed(trace):
            dh = carry[:k] + dstate[t, :k]
            dn = dh * (1 - z) * (1 - new * new)
            dz = dh * (before - new) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            dx = np.concatenate([dz, dr, dn], 1)
            dg = np.concatenate([dz, dr, dn * r], 1)
            du += before.T @ dg
            carry[:k] = dh * z + dg @ p["u" + side].T
            dw += vectors[at[:k, t]].T @ dx
            dc += dx.sum(0)
            np.add.at(dvec, at[:k, t], dx @ p["w" + side].T)
        g["u" + side], g["w" + side], g["c" + side] = du, dw, dc
    g["words"], g["grams"] = np.zeros_like(p["words"]), np.zeros_like(p["grams"])
    np.add.at(g["words"], word[used], dvec)
    at, owner, count = _known(gram[own], local_offs)
    np.add.at(g["grams"], gram[own][at], dvec[owner] / count[owner].astype(dvec.dtype)[:, None])
    g["grams"][0] += dvec[count == 0].sum(0)
    return g


def _chosen(hashes: np.ndarray, positive: np.ndarray, total: np.ndarray, share: float, keep: int) -> np.ndarray:
    """The hashes most associated with label 1, sorted; share: of all counted occurrences that have it."""
    negative = total - positive
    g = 2 * (positive * np.log(np.maximum(positive, 1e-9) / np.maximum(total * share, 1e-9)) + negative * np.log(np.maximum(negative, 1e-9) / np.maximum(total * (1 - share), 1e-9)))
    odds = (positive + 0.5) / (negative + 0.5) * (1 - share) / share
    g[odds < LEAST_ODDS] = 0
    best = np.lexsort((hashes, -g))[:keep]
    return np.sort(hashes[best[g[best] >= LEAST_G]])


def _all_tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, Vocabulary]:
    """tokens() of many texts, block by block, with one list of distinct words."""
    numbers, rows, parts, base, words = [], [np.zeros(1, np.int64)], [], 0, 0
    for _, _, data, offs in blocks(pa.array(texts, pa.large_string())):
        number, r, v = tokens(data, offs)
        numbers.append(number + base)
        rows.append(r[1:] + words)
        parts.append(v)
        base, words = base + len(v.hashes), words + len(number)
    distinct, first, which = np.unique(np.concatenate([v.hashes for v in parts]), return_index=True, return_inverse=True)
    sizes = np.concatenate([np.diff(v.offs) for v in parts])
    at = np.concatenate([[0], np.cumsum(sizes)])
    own = np.arange(int(sizes[first].sum())) - np.repeat(np.cumsum(sizes[first]) - sizes[first], sizes[first]) + np.repeat(at[first], sizes[first])
    grams = np.concatenate([v.grams for v in parts])[own]
    return which[np.concatenate(numbers)], np.concatenate(rows), Vocabulary(distinct, grams, np.concatenate([[0], np.cumsum(sizes[first])]))


def train(texts: list[str], labels: np.ndarray, seed: int = 17) -> Model | None:
    """A model from labelled texts; None unless both labels occur."""
    labels = np.asarray(labels, np.float64)
    if not len(labels) or labels.min() == labels.max():
        return None
    rng = np.random.default_rng(seed)
    number, rows, v = _all_tokens(texts)
    # An occurrence counts once for the word before it, under each label, so copies of a text count as one text.
    label_of = np.repeat(labels, np.diff(rows))
    before = np.concatenate([np.zeros(1, np.uint64), v.hashes[number][:-1]])[: len(number)]
    _, once = np.unique(mix(v.hashes[number] ^ mix(before)) ^ label_of.astype(np.uint64), return_index=True)
    share = min(max(float(label_of[once].mean()) if len(once) else 0.5, 1e-6), 1 - 1e-6)
    positive = np.bincount(number[once], weights=label_of[once], minlength=len(v.hashes))
    total = np.bincount(number[once], minlength=len(v.hashes))
    words_kept = _chosen(v.hashes, positive, total, share, WORDS_KEPT)
    distinct, which = np.unique(v.grams, return_inverse=True)
    owner = np.repeat(np.arange(len(v.hashes)), np.diff(v.offs))
    grams_kept = _chosen(distinct, np.bincount(which, weights=positive[owner], minlength=len(distinct)), np.bincount(which, weights=total[owner], minlength=len(distinct)), share, GRAMS_KEPT)
    del label_of, before, once, which, owner

    def weights(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    p = {"words": weights(HASHED + len(words_kept), DIM, scale=0.1), "grams": weights(len(grams_kept) + 1, DIM, scale=0.1), "att": weights(2 * HIDDEN, scale=0.3), "out": weights(2 * HIDDEN, scale=0.3), "bias": np.zeros((), np.float32)}
    for side in "fb":
        p |= {"w" + side: weights(DIM, 3 * HIDDEN, scale=0.4), "u" + side: weights(HIDDEN, 3 * HIDDEN, scale=0.3), "c" + side: np.zeros(3 * HIDDEN, np.float32)}
    model = Model(words_kept, grams_kept, p)
    word, gram = _inputs(model, v)
    row, start, size = windows(rows)
    target = labels[row].astype(np.float32)
    seen = np.concatenate([[0], np.cumsum(((word >= HASHED) | (_known(gram, v.offs)[2] > 0))[number])])
    telling = seen[start + size] > seen[start]
    sampled = rng.permutation(len(row))[:FIT_WINDOWS]
    ones, zeros = sampled[(target[sampled] == 1) & telling[sampled]], sampled[target[sampled] == 0]
    hard = zeros[telling[zeros]]
    first, second = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    for step in range(1, STEPS + 1):
        if step in (STEPS // 3, 2 * STEPS // 3):
            vectors = _vectors(p, word, gram, v.offs)
            every = np.concatenate([_forward(p, vectors, number, start[i : i + 8192], size[i : i + 8192])[0] for i in range(0, len(row), 8192)])
            top = np.maximum.reduceat(every, np.searchsorted(row, np.arange(len(texts))))
            ones = np.flatnonzero((target == 1) & telling & (every >= np.maximum(0.5, 0.6 * top[row])))
            hard = zeros[np.argsort(-every[zeros], kind="stable")[: max(200, len(zeros) // 20)]]
        if not len(ones) or not len(zeros):
            break
        pick = np.concatenate([rng.choice(ones, BATCH // 2), rng.choice(zeros, BATCH // 4), rng.choice(hard if len(hard) else zeros, BATCH // 4)])
        at = np.concatenate([np.arange(s, s + n) for s, n in zip(start[pick], size[pick], strict=True)]) if size[pick].any() else np.zeros(1, np.int64)
        local = np.concatenate([[0], np.cumsum(size[pick])])[:-1]
        g = _gradients(p, (number[at], local, size[pick]), target[pick], word, gram, v.offs)
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for k, x in p.items():
            grad = g[k] + np.float32(1e-5) * x
            if k == "words":
                grad[:HASHED] += np.float32(CONTEXT_DECAY) * x[:HASHED]
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.99 * second[k] + 0.01 * grad * grad
            p[k] = (x - rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, rows: tuple[int, int] = FIT_ROWS) -> Model | None:
    """Model from docs (doc_id, text) with labels (doc_id, label 0 or 1), on a sample of about `rows` of labels 1 and 0.

    The sample is drawn from the labels by the hash of doc_id, so only its few rows are joined to the texts.
    """
    known = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    share = F.when(F.col("label") == 1, F.lit(int(1e6 * min(1.0, rows[0] / counts[1])))).otherwise(F.lit(int(1e6 * min(1.0, rows[1] / counts[0]))))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").select("text", "label").toPandas().sort_values(["text", "label"], kind="stable")
    return train(sample["text"].tolist(), sample["label"].to_numpy())


def _score(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            out = [score(model, data, offs) if model else np.zeros(len(offs) - 1) for _, _, data, offs in blocks(b.column(1))]
            if out:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out).astype(np.float64))], names=["doc_id", "score"])

    return of


def scores(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each whole text; the model's size is fixed, so it is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_score(shared), "doc_id long, score double")


def _keep(shared, text: int, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            found = [score(model, data, offs) if model else np.zeros(len(offs) - 1) for _, _, data, offs in blocks(b.column(text))]
            if found:
                yield b.filter(pa.array(np.concatenate(found) < threshold))

    return of


def below(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_keep(shared, docs.columns.index(text_col), threshold), docs.schema)
