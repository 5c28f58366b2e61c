"""The store of known values: what is written, several writers, readers' pins, erasure down to the files."""

import threading
from pathlib import Path

from pyspark.sql import functions as F

from lethe.functions.storage import Snapshots, materialized, scratch_folder
from lethe.functions.value_store import SCHEMA, ValueStore
from lethe.operators import catalog


def rows(spark, first, n):
    return spark.range(first, first + n).select(F.concat(F.lit("[P_"), "id", F.lit("_abcdef]")).alias("token"), F.concat(F.lit("value "), "id").alias("value"), F.lit("P").alias("label"))


def written(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))


def test_bytes_follow_the_batch(spark, tmp_path):
    store = ValueStore(spark, str(tmp_path / "s"), buckets=8, most_deltas=3)
    store.append(rows(spark, 0, 1_000_000))
    store.compact(full=True)
    store.vacuum(least_age=0)
    base = written(tmp_path)
    store.append(rows(spark, 999_990, 40))  # ten are known
    assert store.read().count() == 1_000_030 and written(tmp_path) - base < base / 100
    for k in range(4):  # more deltas than stay unmerged
        store.append(rows(spark, 2_000_000 + 10 * k, 10))
    parts = store.parts()
    assert len([p for p in parts if p["bucket"] is None]) <= 3 and len([p for p in parts if p["bucket"] is not None]) == 8
    assert store.read().count() == 1_000_070 == store.read().distinct().count() and written(tmp_path) - base < base / 50
    near = store.near(spark.createDataFrame([("value 5",)], "value string"))
    assert near.where("value = 'value 5'").count() == 1 and near.count() < 300_000


def test_two_writers(spark, tmp_path):
    path = str(tmp_path / "s")
    writers = [threading.Thread(target=lambda k=k: [ValueStore(spark, path).append(rows(spark, 100 * k + 10 * i, 10)) for i in range(3)]) for k in range(2)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert ValueStore(spark, path).read().count() == 60


def test_a_version_that_was_not_written_to_its_end(spark, tmp_path):
    store = ValueStore(spark, str(tmp_path / "s"))
    store.append(rows(spark, 0, 3))
    (tmp_path / "s/log" / f"{store.generation() + 1:012d}").write_text("[{")
    assert store.read().count() == 3
    store.append(rows(spark, 3, 3))
    assert store.read().count() == 6


def holds(spark, path, text):
    """Whether a file below path holds the bytes, packed or in Parquet's columns."""
    for f in Path(path).rglob("*"):
        if f.is_file() and text.encode() in f.read_bytes():
            return True
        if f.suffix == ".parquet" and spark.read.parquet(str(f)).where(" or ".join(f"`{c}` like '%{text}%'" for c, t in spark.read.parquet(str(f)).dtypes if t == "string") or "false").count():
            return True
    return False


def test_erased_values_are_in_no_file(spark, tmp_path):
    spark.conf.set("spark.sql.parquet.compression.codec", "uncompressed")
    try:
        store = ValueStore(spark, str(tmp_path / "s"), buckets=4)
        store.append(rows(spark, 0, 100))
        store.compact(full=True)
        first = store.generation()
        store.append(spark.createDataFrame([("[P_99_bbbbbb]", "value 99", "P"), ("[P_500_abcdef]", "value 500", "P")], SCHEMA))
        table = Snapshots(spark, str(tmp_path / "t"))
        for n in (5, 20):
            table.commit(rows(spark, 95, n))
        held = materialized(store.read(), "spans")
        assert held.count() == 102 and holds(spark, scratch_folder(spark), "value 99")
        with store.pin(first):
            assert store.erase("value 99") > 0
            assert store.read(first).count() == 99 and holds(spark, tmp_path, "value 99")  # planned anew, a reader has no hit; its files stay
        done = catalog.erase_everywhere("value 99", store, {"findings": (table, F.col("value") == "value 99")})
        assert done == {"findings": 2, "waiting_parts": 0}
        assert not holds(spark, tmp_path, "value 99") and not Path(scratch_folder(spark)).exists()
        assert store.read().count() == 100 and store.read(first).count() == 99
        assert [table.read(v).count() for v in table.versions()] == [4, 19]
    finally:
        spark.conf.unset("spark.sql.parquet.compression.codec")


def test_vacuum_keeps_what_readers_hold(spark, tmp_path):
    store = ValueStore(spark, str(tmp_path / "s"))
    for k in range(3):
        store.append(rows(spark, 10 * k, 10))
    store.compact(full=True)
    with store.pin(2) as version:
        store.vacuum(least_age=0)
        assert store.read(version).count() == 20 and store.versions() == [2, 4]
    assert store.vacuum(least_age=0) > 0 and store.versions() == [4] and store.read().count() == 30


def test_snapshots_vacuum(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"))
    for n in (1, 2, 3):
        table.commit(spark.range(n))
    with table.pin(1):
        assert table.vacuum() == [2] and table.versions() == [1, 3]
    assert table.vacuum() == [1] and table.read().count() == 3


def test_empty_store(spark, tmp_path):
    store = ValueStore(spark, str(tmp_path / "s"))
    assert store.read().count() == 0 and store.erase("x") == 0 and store.vacuum() == 0
    assert store.append(rows(spark, 0, 0)) == 0
