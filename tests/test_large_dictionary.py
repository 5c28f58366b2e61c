"""Dictionaries beyond the automaton: the gram path against the plain one, its rows and its skew."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lethe.operators import dictionary as D


@pytest.fixture()
def grams_only(monkeypatch):
    monkeypatch.setattr(D, "MOST_CHARACTERS", 1)
    monkeypatch.setattr(D, "MOST_PASSES", 0)


def corpus(seed, n=60):
    r = random.Random(seed)
    words = ["the", "of", "and", "Ann Lee", "ann lee", "é", "日本", "x", "ab", "abc", "abcd", "Straße", "İstanbul", "𝒳y", "[A_1_abcdef]", "long value of several words"]
    texts = [None, "", "x"] + [r.choice(["", " "]).join(r.choice(words) for _ in range(r.randint(1, 40))) for _ in range(n)]
    values = ["x", "ab", "abc", "abcd", "Ann Lee", "é", "日本", "of and", "the of and the", "long value of several words", "İstanbul", "𝒳y", "never met", "Straße x", ""]
    return texts, values


@pytest.mark.parametrize(("any_case", "whole"), [(False, False), (True, True), (True, False)])
def test_same_as_the_automaton(spark, monkeypatch, any_case, whole):
    texts, values = corpus(1)
    docs = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    terms = spark.createDataFrame([(v,) for v in values], "value string")
    show = lambda df: sorted(map(str, df.collect()))
    want = show(D._found(docs, terms.select("value", F.lit(whole).alias("whole")), "doc_id", "text", any_case))
    monkeypatch.setattr(D, "MOST_CHARACTERS", 1)
    monkeypatch.setattr(D, "MOST_PASSES", 0)
    got = show(D._found(docs, terms.select("value", F.lit(whole).alias("whole")), "doc_id", "text", any_case))
    assert sorted(set(got)) == sorted(set(want)) and len(want) > 100


def test_few_rows_and_no_hot_gram(spark, grams_only):
    # Texts of common words; values of common words too, and many that share their beginning.
    r = random.Random(3)
    common = ["the", "of", "and", "to", "in", "that", "was", "for"]
    texts = [" ".join(r.choice(common) if r.random() < 0.6 else f"w{r.randrange(3000)}" for _ in range(400)) for _ in range(200)]
    values = [f"Customer#{i:09d}" for i in range(5000)] + ["the of and the of in to"]
    texts[5] += " Customer#000000042 and the of and the of in to"
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    terms = spark.createDataFrame([(v, False) for v in values], "value string, whole boolean")
    grams, _ = D.candidate_grams(docs, terms, False)
    rows = grams.groupBy("gram").count().collect()
    assert sum(x["count"] for x in rows) < sum(map(len, texts)) / 100 and max(x["count"] for x in rows) < 100
    got = D.occurrences(docs, terms.select("value"), "id").collect()
    want = {(i, t.find(v), v) for i, t in enumerate(texts) for v in (values[42], values[-1]) if v in t}
    assert {(x.id, x.start, x.value) for x in got} >= want and {x.value for x in got} <= {values[42], values[-1]}


def test_gram_hashes():
    codes = D.code_points("abcabcab日")
    for size in D.GRAMS:
        h = D.gram_hashes(codes, size)
        assert len(h) == len(codes) - size + 1
        grams = [tuple(codes[i : i + size]) for i in range(len(h))]
        assert len(set(h.tolist())) == len(set(grams)) and all((h[i] == h[j]) == (grams[i] == grams[j]) for i in range(len(h)) for j in range(len(h)))
    assert len(D.gram_hashes(np.zeros(0, np.uint64), 4)) == 0
    assert D.filter_bits(0) == 1 << 16 and D.filter_bits(1 << 40) == D.MOST_FILTER_BITS


def test_values_that_share_their_short_grams(spark):
    # Each part of eight characters stood in a dozen values and as many texts, all of whose pairs were compared.
    r = random.Random(5)
    values = sorted({"".join(f"{r.randrange(12):04d}" for _ in range(4)) for _ in range(2000)})
    docs = spark.createDataFrame([(i, f"Order of {v}, see there") for i, v in enumerate(values)], "id long, text string")
    terms = spark.createDataFrame([(v, False) for v in values], "value string, whole boolean")
    grams, anchors = D.candidate_grams(docs, terms, False)
    assert grams.join(anchors, "gram").count() < 2 * len(values)
    got = D.occurrences_by_grams(docs, terms.select("value"), "id").collect()
    assert {(x.id, x.start, x.value) for x in got} == {(i, 9, v) for i, v in enumerate(values)} and len(got) == len(values)


@pytest.mark.parametrize("whole", [False, True])
def test_values_of_all_lengths(spark, grams_only, whole):
    # Up to and beyond what stands around a gram, at both ends of a text and next to word characters.
    r = random.Random(7)
    letters = "ab 日𝒳."
    values = sorted({"".join(r.choice(letters) for _ in range(n)) for n in (1, 2, 3, 7, 8, 15, 16, 17, 31, 32, 33, 63, 64, 65, 127, 128, 129, 300)})
    texts = [f"{a}{v}{z}" for v in values for a, z in (("", ""), ("x", ""), (" ", " "), ("é.", "²"), ("w " * 70, " w" * 70))]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(x.id, x.start, x.end, x.value) for x in D.occurrences(docs, spark.createDataFrame([(v,) for v in values], "value string"), "id", whole_words=whole).collect()}
    want = set()
    for i, t in enumerate(texts):
        for v in values:
            at = t.find(v)
            while at >= 0:
                if not whole or not any(D._WORD.match(c) for c in t[max(0, at - 1) : at] + t[at + len(v) : at + len(v) + 1]):
                    want.add((i, at, at + len(v), v))
                at = t.find(v, at + 1)
    assert got == want


def test_filter_layout():
    layout = D.filter_layout({8: 10, 16: 40_000_000, 64: 3_000_000})
    assert list(layout)[0] == 16 and all(first % bits == 0 and bits >= 8 * n for (first, bits), n in zip(layout.values(), (40_000_000, 3_000_000, 10), strict=True))
    assert sum(bits for _, bits in layout.values()) <= 2 * D.filter_bits(43_000_010) + 3 * (1 << 16)
    h = np.arange(1, 1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for first, bits in layout.values():
        places = [D._bit(h, first, bits, s) for s in D._SHIFTS]
        assert all((p >= first).all() and (p < first + bits).all() and (p // D._BLOCK == places[0] // D._BLOCK).all() for p in places)


def test_hits_alone_in_a_text_skip_the_lists(spark, grams_only, monkeypatch):
    monkeypatch.setattr(D, "resolve", lambda spans, order: F.raise_error(F.lit("a list of one")).cast(D.FOUND))
    docs = spark.createDataFrame([(i, f"Order of Customer#{i:09d}") for i in range(50)], "id long, text string")
    values = spark.createDataFrame([(f"Customer#{i:09d}",) for i in range(0, 50, 2)], "value string")
    assert sorted(tuple(x) for x in D.known_values(docs, values, id_col="id").select("id", "start").collect()) == [(i, 9) for i in range(0, 50, 2)]


def test_known_values_as_by_the_automaton(spark, monkeypatch):
    # One hit, several that meet, hits in tokens and hits that take a part of a guarded span.
    texts = ["Ann Lee", "Ann Lee and Lee Hill", "[Ann Lee_1_abcdef] [ANN_1_abcdef] Ann Lee", "[ Ann Lee", "[ANN_1_abcdef]", "xAnn Leex", None]
    docs = spark.createDataFrame([(i, t, [(4, 9)] if i == 3 else None) for i, t in enumerate(texts)], "doc_id long, text string, guard array<struct<start:int,end:int>>")
    docs = docs.withColumn("guard", F.transform("guard", lambda g: F.struct(g["start"].alias("start"), g["end"].alias("end"), F.lit("X").alias("label"), F.lit(1).alias("stage"), F.lit("x").alias("value"))))
    values = spark.createDataFrame([("Ann Lee",), ("Lee and Lee",), ("Lee Hill",), ("ANN",), ("Lee",)], "value string")
    show = lambda: sorted(map(str, D.known_values(docs, values, guard_col="guard").collect()))
    want = show()
    monkeypatch.setattr(D, "MOST_CHARACTERS", 1)
    monkeypatch.setattr(D, "MOST_PASSES", 0)
    assert show() == want and len(want) > 4
