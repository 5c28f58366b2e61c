"""The rule detector: whole texts, values that come with the spans."""

import re

from lethe.functions import fixed, sweep
from lethe.operators import detect
from lethe.plans import flows, registry  # noqa: F401  (flows registers its queries)


def test_values_come_without_a_join_of_texts(spark, capsys):
    registry.QUERIES["shaped_entities"].run(spark, "/root/testdata/sf0.001").explain()
    assert "Join" not in capsys.readouterr().out


def test_numbers_at_edges_of_windows(spark):
    step = fixed.WINDOW - fixed.OVERLAP
    texts = ["x" * (at - 3) + " . " + number + " end" * 300 for number in ("74.42.69.78", "NL10BANK0123456789", "4000 1111 2222 3333", "+31 (20) 1234567") for at in (*range(step - 20, step + 3), *range(fixed.WINDOW - 20, fixed.WINDOW + 3))]
    texts.append("y " * 600 + "4000 1111 2222 3333 " * 40 + "z")  # a run of numbers longer than the windows' overlap
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.start, r.end, r.label, r.value) for r in detect.entity_values(docs, ceiling=None).collect())
    want = sorted((i, m.start(), m.end(), label, m.group()) for i, t in enumerate(texts) for p, label in fixed.RULE_PATTERNS for m in re.finditer(p, t, re.ASCII))
    assert got == want and len(got) > len(texts)


def test_rules_as_the_jvm_has_them():
    found = lambda text: [m[:3] for m in sweep.rules(text)]
    assert found("\u06610.0.0.1") == [(1, 9 - 1, "IP_ADDRESS")]  # an Arabic digit is none
    assert found("\u00e9NL10BANK0123456789") == [] and found("\u00e9+31 20 123456") == [(1, 14, "PHONE_NUMBER")]
