"""Linear sweeps against plain versions, and rows that share an id."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lethe.functions import fixed, sweep
from lethe.operators import catalog, detect, dictionary, payloads, sanitize, tokens


def meet(a, b):
    return a[0] < b[1] and a[1] > b[0]


def random_spans(r, n):
    out = []
    for _ in range(n):
        start = r.randrange(60)
        out.append((start, start + r.randint(1, 12), r.choice("AB"), r.randint(0, 3), None))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_sweeps(seed):
    r = random.Random(seed)
    spans, blocked = random_spans(r, r.randint(0, 25)), random_spans(r, r.randint(0, 6))
    assert sorted(sweep.outer(spans)) == sorted(s for s in spans if not any(o[0] <= s[0] and o[1] >= s[1] and o[1] - o[0] > s[1] - s[0] for o in spans))
    there = sweep.union_of(blocked)
    assert [sweep.meets(s[0], s[1], *there) for s in spans] == [any(meet(s, b) for b in blocked) for s in spans]

    def plain(key):
        kept = []
        for s in sorted(spans, key=key):
            if not any(meet(s, k) for k in kept):
                kept.append(s)
        return sorted(k[:2] for k in kept)

    assert [s[:2] for s in sweep._in_stages(spans)] == plain(lambda s: (s[3], s[0], -s[1]))
    assert [s[:2] for s in sweep._longest(spans)] == plain(lambda s: (s[0] - s[1], s[0], s[3]))
    assert [s[:2] for s in sweep._last(spans)] == plain(lambda s: (-s[0], -s[1]))


@pytest.mark.parametrize("seed", range(20))
def test_secrets(seed):
    r = random.Random(seed)
    parts = ["a.b@x.com", "é@y.org", "@", "x@", "ſ@k.io", "A@B.CO-", "m@n.co.uk.", "password = hunter22", "PASSWORD:x", "ſecret: abcdefg", "api-key=abcdefgh1", "toKen: '12345678", "sk-" + "a" * 25, "ghp_" + "x" * 36, "glpat-" + "b" * 20, "xoxb-1", "xoxz", "AKIA" + "A1" * 8, "-----BEGIN RSA PRIVATE KEY-----", " ", "\n", ".", "word", "=", "[EMAIL_ADDRESS_1_abcdef]"]
    text = "".join(r.choice(parts) + r.choice(["", " "]) for _ in range(60))
    want = []
    for p, label in fixed.SECRET_PATTERNS:
        want += [(m.start(), m.end(), label) for m in re.finditer(p.replace("(?iU)", "(?i)"), text)]
    want = [w for w in want if not any(o[0] <= w[0] and o[1] >= w[1] and o[1] - o[0] > w[1] - w[0] for o in want)]
    assert sorted(s[:3] for s in sweep.secrets(text)) == sorted(want)


def test_many_matches_in_one_text():
    text = " ".join(f"user{i}@mail{i}.example.org" for i in range(20_000))
    began = time.time()
    found = sweep.secrets_outside_tokens(text)
    kept = sweep._in_stages([(*s, None) for s in found])
    out = sweep.spliced(text, [(s[0], s[1], "x") for s in kept])
    assert len(found) == len(kept) == 20_000 and out == " ".join("x" * 20_000) and time.time() - began < 2


def test_many_matches_in_a_frame(spark):
    one = spark.createDataFrame([(1, " ".join(f"u{i}@example.org" for i in range(20_000)))], "doc_id long, text string")
    out, table = sanitize.tokenize(one)
    row = out.first()
    assert len(row.tokens) == 20_000 and "@" not in row.sanitized
    assert tokens.restore(out.select("doc_id", F.col("sanitized").alias("text")), table).first().text == one.first().text


TWICE = [(1, "mail a@b.org of Ann Lee"), (1, "y c@d.org zz, x Ann Lee"), (1, "y c@d.org zz, x Ann Lee"), (None, "n e@f.org"), (2, None), (2, "")]


def frame(spark, rows=TWICE):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_repeated_ids_tokenize_and_restore(spark):
    out, table = sanitize.tokenize(frame(spark))
    assert sorted(r.value for r in table.collect()) == ["a@b.org", "c@d.org", "e@f.org"]
    rows = out.collect()
    assert len(rows) == len(TWICE) and not any("@" in (r.sanitized or "") for r in rows)
    back = tokens.restore(out.select("doc_id", F.col("sanitized").alias("text")), table)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(TWICE, key=str)


def test_repeated_ids_with_all_stages(spark):
    d = frame(spark)
    lists = {"blacklist": spark.createDataFrame([("zz",)], "term string"), "custom": spark.createDataFrame([("Ann Lee",)], "value string")}
    entities = spark.createDataFrame([(1, 0, 4, "IBAN")], "doc_id long, start int, end int, label string")
    out, table = sanitize.tokenize(d, entities=entities, **lists)
    texts = [r.sanitized for r in out.collect() if r.sanitized]
    assert len(texts) == 4 and not any(w in t for t in texts for w in ("@", "Ann Lee", "zz"))
    back = tokens.restore(out.select("doc_id", F.col("sanitized").alias("text")), table)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(TWICE, key=str)


def test_repeated_ids_known_values_and_catalog(spark):
    known = spark.createDataFrame([("[P_1_abcdef]", "Ann Lee", "P")], "token string, value string, label string")
    got = sanitize.retokenize_known(frame(spark), known).collect()
    assert sorted(r.text for r in got if r.text) == sorted(t.replace("Ann Lee", "[P_1_abcdef]") for _, t in TWICE if t)
    entries = spark.createDataFrame([("e1", "EMAIL_ADDRESS", "Ann Lee", "[CATALOG_X_abcdef0123]")], "entry_id string, category string, value string, token string")
    decided = catalog.decisions(frame(spark), entries, None, None)
    got = catalog.enforce(frame(spark), decided).collect()
    assert sorted(r.sanitized for r in got if r.sanitized) == sorted(t.replace("Ann Lee", "[CATALOG_X_abcdef0123]") for _, t in TWICE if t)


def test_repeated_ids_verifiers(spark):
    def verifier(texts):
        return texts.where(F.contains("text", F.lit("Ann"))).select("doc_id", (F.instr("text", "Ann") - 1).cast("int").alias("start"), (F.instr("text", "Ann") + 6).cast("int").alias("end"), F.lit("person").alias("label"))

    out, table = sanitize.tokenize(frame(spark), verifiers=[verifier])
    assert not any("Ann" in (r.sanitized or "") for r in out.collect())
    assert {r.value for r in table.collect()} == {"a@b.org", "c@d.org", "e@f.org", "Ann Lee"}


def test_repeated_ids_residuals(spark):
    rows = [(1, "has [P_1_abcdef]"), (1, "has Ann Lee"), (1, "has Ann Lee")]
    known = spark.createDataFrame([("[P_1_abcdef]", "Ann Lee", "P")], "token string, value string, label string")
    got = [(r.doc_id, r.live, r.unknown, r.raw_values) for r in sanitize.residual_tokens(frame(spark, rows), known).collect()]
    assert sorted(got) == [(1, 0, 0, 1), (1, 0, 0, 1), (1, 1, 0, 0)]


def test_token_with_two_values(spark):
    known = spark.createDataFrame([("[P_1_abcdef]", "b", "P"), ("[P_1_abcdef]", "a", "P")], "token string, value string, label string")
    assert tokens.restore(frame(spark, [(1, "x [P_1_abcdef]"), (1, "x [P_1_abcdef]")]), known).collect()[0].text == "x a"


def test_one_character_terms(spark):
    d = frame(spark, [(1, "李 and x, xx")])
    terms = spark.createDataFrame([("x",)], "term string")
    phrases = spark.createDataFrame([("李",)], "value string")
    assert [(r.start, r.end) for r in dictionary.blacklist_hits(d, terms).collect()] == [(6, 7)]
    assert [(r.start, r.end) for r in dictionary.custom_values(d, phrases).collect()] == [(0, 1)]
    out, table = sanitize.tokenize(d, custom=phrases, blacklist=terms)
    assert out.first().sanitized.endswith("], xx") and "李" not in out.first().sanitized
    assert tokens.restore(out.select("doc_id", F.col("sanitized").alias("text")), table).first().text == "李 and x, xx"
    _, kept = sanitize.sanitize(d, spark.createDataFrame([], "token string, value string, label string"), custom=phrases)
    assert kept.count() == 0  # what isn't durable is no known value


def test_one_character_terms_by_grams(spark, monkeypatch):
    monkeypatch.setattr(dictionary, "MOST_CHARACTERS", 1)
    monkeypatch.setattr(dictionary, "MOST_PASSES", 1)
    d = frame(spark, [(1, "李 and x, xx"), (2, "none")])
    got = dictionary.occurrences(d, spark.createDataFrame([("x",), ("李",), ("and",), ("none",)], "value string")).collect()
    assert sorted((r.doc_id, r.start, r.value) for r in got) == [(1, 0, "李"), (1, 2, "and"), (1, 6, "x"), (1, 9, "x"), (1, 10, "x"), (2, 0, "none")]


def test_payloads_with_halves_of_surrogates(spark):
    rows = [(1, '{"content": "cut \\ud83d"}'), (1, '{"content": "mail a@b.org"}'), (1, '{"content": "\\ud83d\\ude00 c@d.org"}'), (2, '{"k\\ud83d": {"text": "x"}}')]
    p = spark.createDataFrame(rows, "id long, payload string")
    assert sorted(r.text for r in payloads.text_paths(p).collect()) == sorted(["cut �", "mail a@b.org", "\U0001f600 c@d.org", "x"])
    out = payloads.sanitize_payloads(p, lambda t: sanitize.tokenize(t)[0]).collect()
    assert len(out) == 4 and rows[0][1] in [r.payload for r in out] and not any("@" in r.payload for r in out)


def test_deep_payload():
    deep = '{"content":' * 10_000 + '"x"' + "}" * 10_000
    (path, key, *_, text), = payloads.strings(deep)
    assert path == "$" + ".content" * 10_000 and (key, text) == ("content", "x")


def test_prescan_of_secrets(spark):
    got = detect.secret_matches(frame(spark)).collect()
    assert sorted((str(r.doc_id), r.value) for r in got) == sorted([("1", "a@b.org"), ("1", "c@d.org"), ("1", "c@d.org"), ("None", "e@f.org")])
