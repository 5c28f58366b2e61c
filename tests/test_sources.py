"""Paged sources read to their end, and streams that never say that they end."""

import time

import pandas as pd
import pytest

from lethe.sources import readers
from lethe.streaming import holdback as H

PAGES = 23


def _fetcher():
    """A function of a function, so that tasks get it by value."""

    def fetch(page):
        return [(10 * page + i, f"n{page % 3}") for i in range(3)] if page < PAGES else []

    return fetch


fetch = _fetcher()


@pytest.fixture(scope="module", autouse=True)
def sources(spark):
    spark.dataSource.register(readers.paged_source("pages_unknown", "id int, name string", fetch))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@pytest.mark.parametrize("options", [{}, {"tasks": "3"}, {"tasks": "50"}, {"pages": str(PAGES), "each": "4"}])
def test_pages_are_read_to_the_end(spark, options):
    got = sorted(map(tuple, spark.read.format("pages_unknown").options(**options).load().collect()))
    assert got == sorted(r for p in range(PAGES) for r in fetch(p))


def test_first_page(spark):
    assert spark.read.format("pages_unknown").options(first="20", tasks="2").load().count() == 9


def test_pages_as_a_stream(spark, tmp_path):
    got = []
    q = spark.readStream.format("pages_unknown").option("each", "7").load().writeStream.foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(got) == sorted(r for p in range(PAGES) for r in fetch(p))


def _json(folder, name, rows, columns):
    pd.DataFrame(rows, columns=columns).to_json(folder / f"{name}.json", orient="records", lines=True)


def _wait(q, done):
    end = time.time() + 60
    while not done() and time.time() < end and q.isActive:
        time.sleep(0.3)
    q.stop()
    assert done(), q.exception()


def test_stream_without_end_comes_out(spark, tmp_path):
    source, out = tmp_path / "in", []
    source.mkdir()
    _json(source, "0", [("a", 0, "hi [PERS", False), ("a", 2, "late", False), ("b", 0, "x", True)], ["stream_key", "seq", "delta", "is_end"])
    stream = H.hold_back(spark.readStream.schema("stream_key string, seq long, delta string, is_end boolean").json(str(source)), idle_seconds=2)
    q = stream.writeStream.foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    _wait(q, lambda: len(out) >= 4)
    assert sorted(out) == [("a", 0, "[PERS"), ("a", 0, "hi "), ("a", 2, "late"), ("b", 0, "x")]


def test_usage_of_a_stream_without_end(spark, tmp_path):
    source, out = tmp_path / "in", []
    source.mkdir()
    rows = [("a", 0, '{"usage":{"n":1}}', False), ("a", 1, '{"usage":{"n":2}}', False), ("a", 2, "{}", False), ("b", 0, '{"usage":{"n":5}}', False), ("b", 1, None, True), ("c", 0, "{}", True)]
    _json(source, "0", rows, ["stream_id", "seq", "data", "is_end"])
    stream = H.last_usage(spark.readStream.schema("stream_id string, seq long, data string, is_end boolean").json(str(source)), idle_seconds=2)
    q = stream.writeStream.foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    _wait(q, lambda: len(out) >= 2)
    assert sorted(out) == [("a", '{"n":2}'), ("b", '{"n":5}')]


def test_flush():
    assert H.flush("[A", 3, {5: ("x", False), 4: ("", False), 7: ("y", True)}) == ([(2, "[A"), (5, "x"), (7, "y")], 8)
    assert H.flush("", 0, {}) == ([], 0)
