"""Known values as a log of small parts over a base in hash buckets.

    log/<version>       the parts that make up a version
    parts/<id>[/...]    a delta: what one writer added; or a base: one folder a bucket of hashed values
    pins/<id>           a version that a reader holds
    doomed/<id>         a part that holds an erased value, to be deleted when no reader holds a version

Adding values writes a delta of their size.  Deltas are merged when they are many: with each other while they are small
against the base, with the base when they aren't, so each value is rewritten a logarithmic number of times.  A version is
claimed by creating its log file, which fails if another writer has it; the writer then goes on from that version.
A base's files carry Parquet's own Bloom filters on value, which spare erase() most of a bucket.  Looking values up reads the
deltas and the buckets asked for.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Files, Pinned

SCHEMA = "token string, value string, label string"
BUCKETS = 64
MOST_DELTAS = 8
SMALL = 4  # deltas of less than the base's rows over this are merged with each other only


class ValueStore(Pinned):
    """Known values (token, value, label); any number of writers and readers."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, most_deltas: int = MOST_DELTAS):
        self.spark, self.path, self.buckets, self.most_deltas = spark, path.rstrip("/"), buckets, most_deltas
        self.files = Files(spark, self.path)

    def versions(self) -> list[int]:
        return [int(n) for n in self.files.names("log") if n.isdigit() and self.files.get(f"log/{n}") is not None]

    def generation(self) -> int:
        return max(self.versions(), default=0)

    def parts(self, version: int | None = None) -> list[dict]:
        """Parts {path, bucket, rows} of a version; deltas have no bucket."""
        version = self.generation() if version is None else version
        return self.files.get(f"log/{version:012d}") or []

    def bucket(self, value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The values of a version; of some buckets only where they are given (deltas hold more)."""
        return self._table([p for p in self.parts(version) if buckets is None or p["bucket"] is None or p["bucket"] in buckets])

    def _table(self, parts: list[dict]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{p['path']}" for p in parts])

    def near(self, values: DataFrame) -> DataFrame:
        """Known rows of the buckets that `values` (value) fall into; the driver gets the buckets' numbers."""
        asked = [r[0] for r in values.select(self.bucket(F.col("value"))).distinct().collect()]
        return self.read(buckets=asked)

    def _write(self, rows: DataFrame, base: bool = False) -> list[dict]:
        """Rows as a delta, or as the parts of a base."""
        name = f"parts/{uuid.uuid4().hex}"
        rows = rows.select("token", "value", "label")
        if base:
            rows = rows.withColumn("bucket", self.bucket(F.col("value"))).repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "value")
            filters = {"parquet.bloom.filter.enabled#value": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
            rows.write.options(**filters).partitionBy("bucket").parquet(f"{self.path}/{name}")
        else:
            rows.write.parquet(f"{self.path}/{name}")
        written = self.spark.read.schema(SCHEMA + ", bucket int" * base).parquet(f"{self.path}/{name}")
        if not base:
            n = written.count()
            return [{"path": name, "bucket": None, "rows": n}] if n else []
        sizes = {r.bucket: r.n for r in written.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
        return [{"path": f"{name}/bucket={b}", "bucket": b, "rows": n} for b, n in sorted(sizes.items())]

    def _commit(self, change: Callable[[list[dict]], list[dict]]) -> int:
        """The next version, from the parts of the newest; tried again where another writer has taken it."""
        while True:
            last = max((int(n) for n in self.files.names("log") if n.isdigit()), default=0)
            parts = self.parts(self.generation())
            if self.files.put(f"log/{last + 1:012d}", change(parts)):
                return last + 1

    def append(self, rows: DataFrame) -> int:
        """Adds the rows (token, value, label) that aren't there yet and merges deltas where they are many; gives the version.

        Two writers may give a value two tokens, both of which can be restored; a token that foreign rows give two values
        is restored to the least.
        """
        own = rows.select("token", "value", "label").distinct()
        fresh = self._write(own.join(self.near(own), ["token", "value"], "left_anti"))
        version = self._commit(lambda parts: parts + fresh) if fresh else self.generation()
        deltas = [p for p in self.parts() if p["bucket"] is None]
        return self.compact() if len(deltas) > self.most_deltas else version

    def compact(self, full: bool = False) -> int:
        """Merges the deltas with each other, or with the base where they have grown or where that is asked for."""
        before = self.parts()
        deltas, base = [p for p in before if p["bucket"] is None], [p for p in before if p["bucket"] is not None]
        whole = full or SMALL * sum(p["rows"] for p in deltas) >= sum(p["rows"] for p in base)
        merged = before if whole else deltas
        new = self._write(self._table(merged).distinct(), base=whole)
        gone = {p["path"] for p in merged}
        return self._commit(lambda parts: [p for p in parts if p["path"] not in gone] + new)

    def erase(self, value: str) -> int:
        """Takes a value out of every version; gives the number of its parts that wait for readers' pins.

        Parts that hold the value are written anew without it, all versions are led to the new parts, and the old ones are
        deleted as soon as no reader holds a version.
        """
        bucket = self.spark.range(1).select(self.bucket(F.lit(value))).first()[0]
        moved: dict[str, list[dict]] = {}
        while True:
            every = {p["path"]: p for v in self.versions() for p in self.parts(v)}
            mine = [p for path, p in every.items() if path not in moved and p["bucket"] in (None, bucket)]
            holding = [p for p in mine if self._table([p]).where(F.col("value") == value).limit(1).count()]
            if not holding:
                break
            for p in holding:
                kept = self._write(self._table([p]).where(F.col("value") != value))
                moved[p["path"]] = [k | {"bucket": p["bucket"]} for k in kept]
                self.files.put(f"doomed/{uuid.uuid4().hex}", p["path"])
            led = lambda parts: [q for p in parts for q in moved.get(p["path"], [p])]
            newest = self._commit(led)
            for v in self.versions():
                if v != newest:
                    self.files.put(f"log/{v:012d}", led(self.parts(v)), overwrite=True)
        return self.sweep_doomed()

    def sweep_doomed(self) -> int:
        """Deletes the parts of erased values if no reader holds a version; gives how many are left."""
        names = self.files.names("doomed")
        if self.pinned():
            return len(names)
        for n in names:
            self.files.delete(self.files.get(f"doomed/{n}"))
            self.files.delete(f"doomed/{n}")
        return 0

    def vacuum(self, keep: int = 1, least_age: float = 3600) -> int:
        """Deletes old versions that no reader holds, and parts that no version has; gives the number of deleted parts.

        Parts younger than least_age seconds stay, since a writer may be about to commit them.
        """
        self.sweep_doomed()
        versions, held = self.versions(), self.pinned()
        for v in versions[: len(versions) - keep]:
            if v not in held:
                self.files.delete(f"log/{v:012d}")
        used = {p["path"].split("/")[1] for v in self.versions() for p in self.parts(v)}
        waiting = {self.files.get(f"doomed/{n}").split("/")[1] for n in self.files.names("doomed")}
        gone = [n for n in self.files.names("parts") if n not in used | waiting and self.files.age(f"parts/{n}") >= least_age]
        for n in gone:
            self.files.delete(f"parts/{n}")
        return len(gone)
