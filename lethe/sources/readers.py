"""Readers: field hints, term lists, performance logs, labelled corpora, source files, response chunks, paged APIs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from ..operators.loc import SKIPPED, SKIPPED_ENDINGS


def fields(tables: dict[str, DataFrame]) -> DataFrame:
    """(collection, field, kind, pii) of tables, by field names."""
    spark = next(iter(tables.values())).sparkSession
    rows = spark.createDataFrame([(t, f.name) for t, df in sorted(tables.items()) for f in df.schema], "collection string, field string")
    n = F.lower("field")
    has = lambda *w: F.greatest(*[F.contains(n, F.lit(x)).cast("int") for x in w], F.lit(0)) == 1
    kind = F.when(has("email"), "email").when(has("phone", "mobile"), "phone").when(has("account") | F.endswith(n, F.lit("_id")) | (n == "id"), "identifier")
    name = n.isin("first_name", "last_name", "name", "full_name") | F.endswith(n, F.lit("_name"))
    place = has("address", "street", "city", "zip")
    pii = F.when(has("email"), "email").when(has("phone", "mobile"), "phone").when(name, "person").when(place, "address").when(kind == "identifier", "identifier").otherwise("")
    return rows.select("collection", "field", F.when(name & ~has("email", "phone", "mobile"), "text").when(place & ~has("email", "phone", "mobile"), "text").otherwise(F.coalesce(kind, F.lit("text"))).alias("kind"), pii.alias("pii"))


def term_list(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(term) of text files, # comments and blanks out; of equal terms the first file's stays."""
    out = None
    for i, p in enumerate(paths):
        one = spark.read.text(p).select(F.trim(F.split_part("value", F.lit("#"), F.lit(1))).alias("term"), F.lit(i).alias("file")).where("term <> ''")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("term").agg(F.min("file").alias("file"))


def perf_events(spark: SparkSession, path: str, schema: str, last: int | None = None, order: str = "ts") -> DataFrame:
    """JSON lines of a performance log, malformed ones out; the last ones by time if asked."""
    rows = spark.read.text(path).where(F.try_parse_json("value").isNotNull()).select(F.from_json("value", schema).alias("e")).select("e.*")
    return rows if last is None else rows.orderBy(F.desc(order)).limit(last)


def labelled_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(text, expected, and the columns of partition folders) of JSON lines; blanks and # lines are skipped, a line without its fields is an error that shows it."""
    rows = spark.read.text(path).where(~F.trim("value").rlike("^(#.*)?$"))
    folders = [c for c in rows.columns if c != "value"]
    parsed = rows.select("value", F.from_json("value", "text string, expected array<string>").alias("r"), *folders)
    bad = F.raise_error(F.concat(F.lit("labelled corpus: a line lacks text or expected: "), F.left("value", F.lit(80))))
    ok = F.col("r.text").isNotNull() & F.col("r.expected").isNotNull()
    return parsed.select(F.when(ok, F.col("r.text")).otherwise(bad).alias("text"), F.when(ok, F.col("r.expected")).otherwise(bad.cast("array<string>")).alias("expected"), *folders)


def source_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of files outside build and dependency folders, without NUL bytes, as UTF-8."""
    return counted_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def counted_files(files: DataFrame) -> DataFrame:
    """S12 over rows (path, content)."""
    inside = F.exists(F.split("path", "/"), lambda p: p.isin(SKIPPED))
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    ending = F.exists(F.array(*map(F.lit, SKIPPED_ENDINGS)), lambda e: F.endswith(name, e))
    return files.where(~inside & ~ending).where(~F.contains(F.col("content"), F.lit(b"\0"))).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def response_chunks(lines: DataFrame) -> DataFrame:
    """Lines (stream_id, seq, line) of event streams: `data: ` lines as (data, is_end); others pass through in `other`."""
    body = F.substring("line", 7, 2147483647)
    data = F.startswith("line", F.lit("data: "))
    end = data & (F.trim(body) == "[DONE]")
    json = data & ~end & F.try_parse_json(body).isNotNull()
    return lines.select("stream_id", "seq", F.when(json, body).alias("data"), end.alias("is_end"), F.when(~json & ~end, F.col("line")).alias("other"))


def final_usage(chunks: DataFrame) -> DataFrame:
    """Of each stream the last usage that isn't empty."""
    usage = F.get_json_object("data", "$.usage")
    return chunks.where(usage.isNotNull() & (usage != "{}")).groupBy("stream_id").agg(F.max_by(usage, "seq").alias("usage"))


class _Pages(InputPartition):
    """Pages first, first + step, ..., before `end` or up to the first empty one."""

    def __init__(self, first: int, step: int, end: int | None):
        self.first, self.step, self.end = first, step, end


class _PageReader(DataSourceReader):
    def __init__(self, fetch: Callable, options: dict):
        self.fetch, self.options = fetch, options

    def partitions(self) -> list[InputPartition]:
        first, each = int(self.options.get("first", "0")), int(self.options.get("each", "10"))
        if "pages" in self.options:
            end = first + int(self.options["pages"])
            return [_Pages(i, 1, min(i + each, end)) for i in range(first, end, each)]
        tasks = int(self.options.get("tasks", "8"))
        return [_Pages(first + i, tasks, None) for i in range(tasks)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        page = partition.first
        while partition.end is None or page < partition.end:
            rows = list(self.fetch(page))
            if not rows and partition.end is None:
                return
            yield from rows
            page += partition.step


class _PageStream(SimpleDataSourceStreamReader):
    """New pages of a source that grows; the offset is the first page not yet read.  Pages don't change once the next one has rows."""

    def __init__(self, fetch: Callable, options: dict):
        self.fetch, self.first, self.most = fetch, int(options.get("first", "0")), int(options.get("each", "10"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"page": self.first}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, page = [], start["page"]
        while page < start["page"] + self.most and (own := list(self.fetch(page))):
            rows += own
            page += 1
        return iter(rows), {"page": page}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        for page in range(start["page"], end["page"]):
            yield from self.fetch(page)


def paged_source(name: str, columns: StructType | str, fetch: Callable[[int], list[tuple]]) -> type[DataSource]:
    """A data source of pages; fetch(page) gives its rows, on an executor, and reads secrets from its environment.

    Without further options pages are read up to the first empty one, by `tasks` tasks (8) that take turns.
    Options: first (page, 0), pages (how many, where that is known) and each (pages a partition, or a micro-batch; 10).
    As a stream it gives new pages.  Filters are Spark's work: what a Python source is told of them holds, in this
    version of Spark, for all later uses of the same frame, which then lack rows.
    """

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self):
            return columns

        def reader(self, schema):
            return _PageReader(fetch, self.options)

        def simpleStreamReader(self, schema):  # noqa: N802
            return _PageStream(fetch, self.options)

    return Paged


def first_of(df: DataFrame, by: str, order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(order))).where("_n = 1").drop("_n")
