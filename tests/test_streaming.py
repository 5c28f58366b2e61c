import random
import time

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from lethe.functions.value_store import ValueStore
from lethe.streaming import holdback as H


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("a[]PERSON_1f \n"), max_size=60), st.lists(st.integers(0, 60), max_size=6), st.randoms())
def test_any_cut_gives_the_whole_text(text, cuts, rnd):
    cuts = sorted({0, len(text), *[c for c in cuts if c < len(text)]})
    pieces = [(i, text[a:b], i == len(cuts) - 2) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    rnd.shuffle(pieces)
    out, held, ready, waiting = [], "", 0, {}
    for p in pieces:  # each in a batch of its own, in any order
        new, held, ready, waiting = H.release([p], held, ready, waiting)
        out += new
    assert "".join(t for _, t in out) == text and not held and not waiting


def test_token_is_never_cut():
    out, held, *_ = H.release([(0, "hi [PERS", False), (1, "ON_1_ab", False), (2, "cdef] x", False)], "", 0, {})
    assert [t for _, t in out] == ["hi ", "[PERSON_1_abcdef] x"] and held == ""
    assert H.safe_split("a [" + "A" * 300)[1] == ""


def test_stream_restores_tokens(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    known = spark.createDataFrame([("[PERSON_1_abcdef]", "Jan", "PERSON")], "token string, value string, label string")
    source = tmp_path / "in"
    source.mkdir()
    schema = "stream_key string, seq long, delta string, is_end boolean"
    parts = [[("a", 0, "hi [PERS", False), ("b", 0, "x", False)], [("a", 2, "cdef]!", True)], [("a", 1, "ON_1_ab", False), ("b", 1, "[y", True)]]
    for i, rows in enumerate(parts):
        pd.DataFrame(rows, columns=["stream_key", "seq", "delta", "is_end"]).to_json(source / f"{i}.json", orient="records", lines=True)
    out = []
    stream = H.hold_back(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source)))
    q = stream.writeStream.foreachBatch(H.restore_batch(known, lambda df, _: out.extend(df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    end = time.time() + 90
    while sum(len(r.text) for r in out) < 10 and time.time() < end and q.isActive:
        time.sleep(0.3)
    q.stop()
    whole = {k: "".join(r.text for r in sorted(out, key=lambda r: r.seq) if r.stream_key == k) for k in "ab"}
    assert whole == {"a": "hi Jan!", "b": "x[y"}


def test_batches_learn_values(spark, tmp_path):
    store, got = ValueStore(spark, str(tmp_path / "known")), []
    run = H.sanitize_batch(store, lambda df, _: got.append(df.first().sanitized))
    for i, text in enumerate(["mail a@b.com", "again a@b.com and c@d.org", "a@b.com"]):
        run(spark.createDataFrame([(0, text)], "doc_id long, text string"), i)
    assert store.read().count() == 2 and got[0].split()[1] == got[1].split()[1] == got[2]


def test_tables_are_held_back_as_streams_are(spark):
    r = random.Random(6)
    rows, want = [], {}
    for key in range(40):
        pieces = [r.choice(["[", "AB", "PERSON_1_abcdef]", "x [", "]", "", "[A_1_ab", "y z", "A" * 90, "[[", "0f"]) for _ in range(r.randint(0, 25))]
        seqs = [q for q in range(len(pieces)) if key % 5 or q != 7]  # some streams have a gap
        chunks = [(q, pieces[q], r.random() < 0.08) for q in seqs]
        rows += [(str(key), *c) for c in chunks]
        out, held, _, _ = H.release(chunks, "", 0, {})
        out += [(max(seqs) + 1, held)] if held else []
        want |= {(str(key), q): t for q, t in out}
    got = H.hold_back(spark.createDataFrame(rows, "stream_key string, seq long, delta string, is_end boolean").repartition(3)).collect()
    assert {(x.stream_key, x.seq): x.text for x in got} == want and len(got) == len(want)
