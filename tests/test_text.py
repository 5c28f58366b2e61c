"""Scalar rules and span arithmetic, against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from lethe.functions import fixed, spans, text
from lethe.operators import detect


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("r")).first().r


@pytest.mark.parametrize("v", ["", "no", "mail a.b@x.com, then c@y.org.", "\U0001f600 é a@b.io \u0001x\u0002 token = \"abcdefghij\"", "password=hunter22 secret: xyzzy99 sk-" + "a" * 24, "AKIA" + "A1" * 8 + " ghp_" + "x" * 36, "token=[EMAIL_ADDRESS_1_abcdef] a@b.co"])
def test_secret_spans(spark, v):
    got = one(spark, v, spans.secret_spans(F.col("v")))
    want = []
    for p, label in fixed.SECRET_PATTERNS:
        want += [(m.start(), m.end(), label) for m in re.finditer(p.replace("(?iU)", "(?i)"), v)]
    want = [w for w in want if not any(o[0] <= w[0] and o[1] >= w[1] and o[1] - o[0] > w[1] - w[0] for o in want)]
    assert sorted((s.start, s.end, s.label) for s in got) == sorted(want)


@pytest.mark.parametrize(
    ("v", "escaped", "cleaned"),
    [
        ("plain", [], "plain"),
        ("ask Smith~.", ["ask", "ask smith", "smith"], "ask Smith."),
        ('("Smith~")', ["smith"], '("Smith")'),
        ("call Jan Willem de Vries~ now", ["call", "call jan willem de vries", "de", "de vries", "jan", "jan willem de vries", "vries", "willem", "willem de vries"], "call Jan Willem de Vries now"),
    ],
)
def test_escapes(spark, v, escaped, cleaned):
    assert one(spark, v, text.escapes(F.col("v"))) == escaped
    assert one(spark, v, text.without_escape_marks(F.col("v"))) == cleaned


@pytest.mark.parametrize("n", [0, 1, 1499, 1500, 1501, 2850, 2851, 9000])
def test_windows(spark, n):
    v = "".join(chr(97 + i % 26) for i in range(n))
    got = one(spark, v, text.windows(F.col("v")))
    assert all(v[w.start : w.start + len(w.text)] == w.text and len(w.text) <= 1500 for w in got)
    assert {i for w in got for i in range(w.start, w.start + len(w.text))} == set(range(n))
    assert [w.start for w in got] == [1350 * k for k in range(len(got))]


@pytest.mark.parametrize("v", ["", "a", "a\n", "a\n\nb\r\nc", "x y\x0bz\n\n"])
def test_lines(spark, v):
    assert one(spark, v, text.lines(F.col("v"))) == v.splitlines()


@pytest.mark.parametrize(("v", "want"), [("a@b.com", "EMAIL"), ("192.168.1.15", "IP"), ("Ada", "IP"), ("NL91 ABNA 0417 1643 00", "IBAN"), ("4111 1111 1111 1111", "CREDIT_CARD"), ("+31 6 1234 5678", "PHONE"), ("Jan Jansen", "PERSON"), ("a.b(c)+", "PERSON"), (" ", "VALUE")])
def test_term_kind(spark, v, want):
    assert one(spark, v, detect.term_kind(F.col("v"))) == want


@pytest.mark.parametrize(
    ("label", "value", "mode", "want"),
    [("email address", "a@b.c", "relaxed", True), ("person", "Jan", "balanced", False), ("person", "Jan Jansen", "balanced", True), ("person", "Jan", "strict", True), ("organization", "Acme Corp", "relaxed", False), ("username", "jj", "balanced", True), ("medical", "flu", "relaxed", False), ("medical", "flu", "balanced", True)],
)
def test_modes(spark, label, value, mode, want):
    assert one(spark, value, detect.in_mode(F.lit(label), F.col("v"), mode)) is want


def test_plausible_and_allowed(spark):
    assert one(spark, "E-mail", detect.plausible(F.lit("email address"), F.col("v"))) is True
    assert one(spark, " Emails ", detect.plausible(F.lit("email address"), F.col("v"))) is False
    assert one(spark, "Jan", detect.plausible(F.lit("person"), F.col("v"))) is False
    names = ["GitHub", "*.local", "project structure"]
    for v, want in (("github", True), ("My GitHub org", True), ("structure", True), ("db.LOCAL", True), ("Jan", False)):
        assert one(spark, v, detect.allowed(F.col("v"), names)) is want


@pytest.mark.parametrize(("v", "want"), [("user@x.com", "u***@x.com"), ("ab", "**"), ("abc", "ab***"), ("abcdefghijklmnop", "ab********"), ("", "")])
def test_mask(spark, v, want):
    assert one(spark, v, text.mask_catalog(F.col("v"))) == want


def test_small_rules(spark):
    assert one(spark, "  Straße\t X ", text.normalize_value(F.col("v"))) == "strasse x"
    assert one(spark, "Jan", text.mask_status(F.col("v"))) == "J**" and one(spark, "Jan Jansen", text.mask_preview(F.col("v"))) == "J*** (10)"
    assert one(spark, "fail a@b.com token: abc 0612345678", text.sanitize_error(F.col("v"))) == "fail [EMAIL] token=[REDACTED][PHONE]"
    assert one(spark, "[PERSON_12_ab12cd]", text.token_label(F.col("v"))) == "PERSON" and one(spark, "[PERSON_12_ab12cd]", text.token_ordinal(F.col("v"))) == 12
    assert one(spark, "[CATALOG_EMAIL_ADDRESS_ab12cd34ef]", text.token_label(F.col("v"))) == "CATALOG_EMAIL_ADDRESS"
    assert one(spark, "Malcolm X", text.balanced_name(F.col("v"))) is None and one(spark, "Jan  Jansen", text.balanced_name(F.col("v"))) == "Jansen"
    assert tuple(one(spark, "Bietje de Bakker", text.first_name_parts(F.col("v")))) == ("Bietje", "de Bakker")
    assert one(spark, "/a/.env", detect.blocked_path(F.col("v"), [])) and one(spark, "/a/x.txt", detect.blocked_path(F.col("v"), ["*.txt"])) and one(spark, "/a/x.py", detect.blocked_path(F.col("v"), ["*.txt"])) is None


def test_verifier_spans(spark):
    made = F.expr("array(named_struct('start',0,'end',3,'label','A','stage',6), named_struct('start',0,'end',8,'label','B','stage',6), named_struct('start',9,'end',9,'label','C','stage',6), named_struct('start',20,'end',30,'label','D','stage',6))")
    got = one(spark, "Jan Jansen and also [PERSON_1_abcdef]", detect.verifier_spans(made, spans.no_spans(), F.col("v"), []))
    assert [(s.start, s.end) for s in got] == [(0, 8)]
    made = F.expr("array(named_struct('start',0,'end',10,'label','A','stage',6), named_struct('start',5,'end',15,'label','B','stage',6))")
    got = one(spark, "some words that are long", detect.verifier_spans(made, spans.no_spans(), F.col("v"), []))
    assert [(s.start, s.end) for s in got] == [(5, 15)]  # the later one stays
