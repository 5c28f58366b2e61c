import numpy as np

from lethe.llm import language_id as L
from lethe.llm.textblocks import text_buffers


def test_grams_stay_in_rows():
    import pyarrow as pa

    texts = ["Abc de", "", "x1", None, "ÉÉ 12 ab"]
    data, offs = text_buffers(pa.array(texts))
    codes, rows = L.gram_codes(data, offs)
    for i, t in enumerate(texts):
        folded = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in (t or "").encode())
        want = [int.from_bytes(folded[k : k + 4], "big") for k in range(len(folded) - 3) if b"  " not in folded[k : k + 4]]
        assert codes[rows[i] : rows[i + 1]].tolist() == want


def test_masks_hold_each_language(spark):
    rows = [("aaaa bbbb", "p"), ("aaaa cccc", "q"), ("aaaa bbbb", "p"), ("aaaa cccc", "q"), ("zz", None), (None, "p")]
    f = L.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert f.languages == ["p", "q"]
    a, b, c = L._slots(np.array([int.from_bytes(w, "big") for w in (b"aaaa", b"bbbb", b"cccc")]))
    assert (f.table[a] & f.table[b] & f.table[c]).tolist() == [3, 1, 2]


def test_predictions(spark, docs_of):
    train = [("the rain and the wind over hills", "en"), ("der regen und der wind über hügel", "de")] * 5
    f = L.fit(spark.createDataFrame(train, "text string, lang string"))
    texts = [None, "", "12 ** \n", "The RAIN over the hills", "Über DER hügel", "日本", "qqqq xxxx", "wind " * 50000]
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(docs_of(texts), f).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0)
    assert got[3][0] == "en" and got[4][0] == "de"
    assert got[5] == got[6] == ("de", 0.0)  # no gram known: the most frequent language, ties by name
    assert all(0 <= s <= 1 for _, s in got.values())
    assert L.predict(docs_of([]), f).count() == 0
    none = L.fit(docs_of([]).select("text", "lang"))
    assert {r.lang_pred for r in L.predict(docs_of(texts), none).collect()} == {"und"}


def test_held_out(spark):
    from lethe.llm.queries import op1_language_id

    d = "/root/testdata/sf0.001"
    got = op1_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert got and np.mean([r.lang == r.lang_pred for r in got]) > 0.95


def test_more_languages_than_bits(spark, docs_of):
    r = np.random.default_rng(6)
    words = {f"l{i:03d}": ["".join(map(chr, r.integers(97, 123, 9))) for _ in range(8)] for i in range(150)}
    f = L.fit(spark.createDataFrame([(" ".join(w), lang) for lang, w in words.items() for _ in range(3)], "text string, lang string"))
    assert f.languages == sorted(words) and f.table.shape == (1 << L.SLOTS_LOG2, 3)
    got = L.predict(docs_of([" ".join(reversed(w)) for w in words.values()]), f).orderBy("doc_id").collect()
    assert [x.lang_pred for x in got] == list(words)


def test_against_exact_sets(spark):
    """The corrected counts against exact sets of grams, on a whole table: the same language but for near ties."""
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    rows = [(r["text"], r["lang"]) for r in t if r["text"] and r["lang"]]
    f = L.fit(spark.createDataFrame(rows, "text string, lang string"))

    def grams(text):
        folded = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in text.encode())
        return [folded[k : k + 4] for k in range(len(folded) - 3) if b"  " not in folded[k : k + 4]]

    counts = {lang: {} for lang in f.languages}
    for text, lang in rows:
        for g in set(grams(text)):
            counts[lang][g] = counts[lang].get(g, 0) + 1
    exact = {lang: {g for g, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: L.GRAMS_PER_LANGUAGE] if n >= L.LEAST_COUNT} for lang, c in counts.items()}
    for text, _ in rows:
        own = grams(text)
        want = [sum(g in exact[lang] for g in own) for lang in f.languages]
        best, _ = L.decide(f, *text_buffers(__import__("pyarrow").array([text])))
        assert want[best[0]] >= 0.98 * max(want) - 1


def test_no_language_is_lost(spark, docs_of):
    # One text of a language; copies of one text beyond the sample's size, whatever its hash is.
    polish = [f"w szczebrzeszynie chrząszcz brzmi w trzcinie {i}" for i in range(3)]
    for text in polish:
        rows = [(text, "pl")] * 3000 + [(f"the rain and the wind over hills {i}", "en") for i in range(30)] + [("det regner over fjellet", "no")]
        f = L.fit(spark.createDataFrame(rows, "text string, lang string").repartition(3), rows=50)
        got = {r.doc_id: r.lang_pred for r in L.predict(docs_of([text, "chrząszcz brzmi", "det regner", "the wind"]), f).collect()}
        assert got == {0: "pl", 1: "pl", 2: "no", 3: "en"}
