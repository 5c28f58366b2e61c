"""Chained restoring by doubling and allow-lists as tables, against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lethe.functions.fixed import TOKEN_SHAPE
from lethe.operators import detect, sanitize, tokens

TOKEN = re.compile(TOKEN_SHAPE)


def token(i):
    return f"[T_{i}_abcdef]"


def one_by_one(known):
    """Ten rounds, each of which restores what the last one has left."""
    out = dict(known)
    for _ in range(tokens.ROUNDS):
        out = {t: TOKEN.sub(lambda m: known.get(m.group(), m.group()), v) for t, v in out.items()}
    return out


@pytest.mark.parametrize("length", [1, 2, 5, 10, 11, 12, 14])
def test_chains(spark, length):
    known = {token(i): f"{i} {token(i + 1)}" for i in range(length)} | {token(length): "end"}
    got = {r.token: r.value for r in tokens.chained(spark.createDataFrame(list(known.items()), "token string, value string")).collect()}
    assert got == one_by_one(known)


def test_trees_cycles_and_unknown_tokens(spark):
    r = random.Random(4)
    known = {token(i): " ".join([str(i), *[token(r.randrange(i + 1, i + 4)) for _ in range(r.randint(0, 2))]]) for i in range(12)}
    known |= {token(50): f"a {token(51)}", token(51): f"b {token(50)}", token(60): token(60), token(70): "[U_1_abcdef] x"}
    got = {r.token: r.value for r in tokens.chained(spark.createDataFrame(list(known.items()), "token string, value string")).collect()}
    assert got == one_by_one(known)


def test_allow_list_as_a_table(spark):
    r = random.Random(2)
    parts = ["ann", "Lee", "bo", "x", "Corp", " ", "de", "é"]
    names = sorted({"".join(r.choice(parts) for _ in range(r.randint(1, 4))).strip() for _ in range(30)} - {""}) + ["Dr*son", "q?z"]
    values = sorted({"".join(r.choice(parts) for _ in range(r.randint(1, 5))) for _ in range(80)}) + ["Dr Wilson", "qaz", "nothing", "zzz"]
    v = spark.createDataFrame([(x,) for x in values], "value string")
    want = {r.value.lower() for r in v.where(detect.allowed(F.col("value"), names)).collect()}
    assert {r.value for r in detect.allowed_values(v, spark.createDataFrame([(n,) for n in names], "name string")).collect()} == want


def test_long_allow_list(spark):
    names = spark.range(100_000).select(F.concat(F.lit("Person "), F.sha2(F.col("id").cast("string"), 256)).alias("name"))
    sha = names.where("name is not null").limit(1).first().name
    d = spark.createDataFrame([(1, f"of {sha} and Someone Else")], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 3, 3 + len(sha), "PERSON"), (1, 8 + len(sha), 20 + len(sha), "PERSON")], "doc_id long, start int, end int, label string")
    out, _ = sanitize.tokenize(d, entities=spans, names=names, mode="strict")
    assert sha in out.first().sanitized and "Someone" not in out.first().sanitized
    out, _ = sanitize.tokenize(d, verifiers=[lambda texts: spans.select(F.lit(texts.first().doc_id).alias("doc_id"), "start", "end", "label")], names=names)
    assert sha in out.first().sanitized and "Someone" not in out.first().sanitized
