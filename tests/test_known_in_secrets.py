"""Known values that are parts of secrets, and entries that stand at several places."""

import pytest

from lethe.functions.value_store import ValueStore
from lethe.operators import dictionary, sanitize
from lethe.plans import stores
from lethe.streaming import holdback

DOC = "doc_id long, text string"


@pytest.mark.parametrize("by", ["automaton", "passes", "grams"])
def test_a_part_of_a_secret_does_not_hide_it(spark, tmp_path, monkeypatch, by):
    if by != "automaton":
        monkeypatch.setattr(dictionary, "MOST_CHARACTERS", 8)
        monkeypatch.setattr(dictionary, "MOST_PASSES", 1000 if by == "passes" else 0)
    store, got = ValueStore(spark, str(tmp_path / "known")), {}
    run = holdback.sanitize_batch(store, lambda df, _: got.update({r.doc_id: r for r in df.collect()}))
    for i, text in enumerate(["mail nrc.33@mail8.example.com", "mail ennrc.33@mail8.example.com and nrc.33@mail8.example.com", "again ennrc.33@mail8.example.com"]):
        run(spark.createDataFrame([(i, text)], DOC), i)
    assert {r.value for r in store.read().collect()} == {"nrc.33@mail8.example.com", "ennrc.33@mail8.example.com"}
    one = got[0].sanitized.split()[1]
    assert got[1].sanitized.split()[3] == one != got[1].sanitized.split()[1] == got[2].sanitized.split()[1]


def test_shorter_values_beside_a_secret_stay_known(spark):
    known = spark.createDataFrame([("[PERSON_1_aaaaaa]", "Jan Jansen x", "PERSON"), ("[PERSON_2_bbbbbb]", "Jan Jansen", "PERSON")], "token string, value string, label string")
    out, _ = sanitize.sanitize(spark.createDataFrame([(1, "Jan Jansen x@mail.com"), (2, "Jan Jansen x")], DOC), known)
    texts = {r.doc_id: r.sanitized for r in out.collect()}
    assert texts[1].startswith("[PERSON_2_bbbbbb] [EMAIL_ADDRESS_1_") and texts[2] == "[PERSON_1_aaaaaa]"


def test_an_entry_at_several_places_counts_once(spark, tmp_path):
    spark.createDataFrame([(0, "One item."), (1, "Other item.")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(7, "One item. One item. x"), (8, "Other item. One item. One item.")], DOC).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.matches, r.changed) for r in stores.enforcement(spark, str(tmp_path)).collect()}
    assert got == {7: (1, False), 8: (2, True)}
