"""Tables that change: snapshots, scratch tables, files of the store they lie in."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_GROUP = 128 << 20  # bytes that writers put into one row group, which one task reads


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.  Only a local session (tests) may leave it unset; it then gets a folder in /tmp."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    """The application's own folder of scratch tables."""
    return f"{shared_folder(spark)}/lethe-{spark.sparkContext.applicationId}"


def materialized(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back."""
    path = f"{scratch_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Deletes the application's scratch tables, which hold plain values; frames that read them can't be used any more."""
    Files(spark, scratch_folder(spark)).delete("")


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores where it is smaller than a row group a core, since one task reads a row group; larger tables stay as they lie."""
    size, cores = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size < cores * ROW_GROUP else df


class Files:
    """The files below a path, in whatever store Hadoop reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def names(self, folder: str = "") -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def age(self, name: str) -> float:
        """Seconds since a file or folder was changed."""
        return (self.jvm.System.currentTimeMillis() - self.fs.getFileStatus(self._at(name)).getModificationTime()) / 1000

    def put(self, name: str, value: object, overwrite: bool = False) -> bool:
        """Writes a small JSON file; False if it is there already."""
        if not overwrite and self.exists(name):
            return False
        try:
            out = self.fs.create(self._at(name), overwrite)
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        return True

    def get(self, name: str) -> object | None:
        """A JSON file's content; None if it isn't there or was not written to its end."""
        if not self.exists(name):
            return None
        stream = self.fs.open(self._at(name))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)

    def rename(self, old: str, new: str) -> None:
        self.fs.rename(self._at(old), self._at(new))


class Pinned:
    """Versions that readers hold: files in pins/ name them, and vacuum() keeps what they need."""

    files: Files

    @contextmanager
    def pin(self, version: int) -> Iterator[int]:
        name = f"pins/{uuid.uuid4().hex}"
        self.files.put(name, version)
        try:
            yield version
        finally:
            self.files.delete(name)

    def pinned(self) -> set[int]:
        return {v for n in self.files.names("pins") if (v := self.files.get(f"pins/{n}")) is not None}


class Snapshots(Pinned):
    """A table as versions v=1, v=2, ... below one path; one writer, any number of readers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Files(spark, self.path)

    def versions(self) -> list[int]:
        return sorted(int(n[2:]) for n in self.files.names() if n.startswith("v=") and self.files.exists(f"{n}/_SUCCESS"))

    def generation(self) -> int:
        return max(self.versions(), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v={self.generation() if version is None else version}")

    def commit(self, df: DataFrame, version: int | None = None) -> int:
        """Writes the next version, or the given one (a micro-batch's id), anew if a failed run left it."""
        version = self.generation() + 1 if version is None else version
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")
        return version

    def erase(self, hit: Column) -> int:
        """Rewrites each version that holds rows that `hit` is true for, without them; gives the number of rewritten versions.

        Readers of such a version must plan anew.
        """
        done = 0
        for v in self.versions():
            own = self.read(v)
            if own.where(hit).limit(1).count():
                new = f"new-{uuid.uuid4().hex}"
                own.where(~F.coalesce(hit, F.lit(False))).write.parquet(f"{self.path}/{new}")
                self.files.delete(f"v={v}")
                self.files.rename(new, f"v={v}")
                done += 1
        return done

    def vacuum(self, keep: int = 1) -> list[int]:
        """Deletes all but the newest versions and those that readers hold."""
        held, versions = self.pinned(), self.versions()
        gone = [v for v in versions[: len(versions) - keep] if v not in held]
        for v in gone:
            self.files.delete(f"v={v}")
        return gone
