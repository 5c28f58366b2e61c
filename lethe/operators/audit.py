"""Analytics over audit events: usage, latency, performance, tails, timing, retention."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.storage import Files

USAGE = ["input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens"]


def recent(events: DataFrame, now: Column, days: int | None = None, session: str | None = None, time_col: str = "ts") -> DataFrame:
    """Events of the last days, of one session."""
    out = events if days is None else events.where(F.col(time_col) >= now - F.make_interval(days=F.lit(days)))
    return out if session is None else out.where(F.col("session_id") == session)


def _once(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), for which value is computed once however often it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def normalized_usage(payload: Column) -> Column:
    """four counters from a usage object in either vendor's names; null if all are zero."""
    return _once(_once(payload, _counters), lambda u: F.when(sum((u[c] for c in USAGE[1:]), u[USAGE[0]]) > 0, u))


def _counters(payload: Column) -> Column:
    get = lambda *names: F.coalesce(*[F.get_json_object(payload, f"$.{n}").cast("long") for n in names], F.lit(0))
    return F.struct(get("input_tokens", "prompt_tokens").alias("input_tokens"), get("output_tokens", "completion_tokens").alias("output_tokens"), get("cache_creation_input_tokens").alias("cache_creation_tokens"), get("cache_read_input_tokens", "prompt_tokens_details.cached_tokens").alias("cache_read_tokens"))


def admitted_usage(message: Column) -> Column:
    """the usage object of a message that counts: a delta only with its stop reason, a start as it is, else the message's own."""

    def of(m: Column) -> Column:
        get = lambda path: F.get_json_object(m, path)
        delta = F.when(get("$.delta.stop_reason").isNotNull(), get("$.usage"))
        return F.when(get("$.type") == "message_delta", delta).when(get("$.type") == "message_start", get("$.message.usage")).otherwise(get("$.usage"))

    return _once(message, of)


def usage_summary(turns: DataFrame, by: str = "session_id") -> DataFrame:
    """A2: sums of the four counters, turns, total and cache hit ratio by session, with a row of null session for all."""
    sums = [F.sum(c).alias(c) for c in USAGE]
    out = turns.rollup(by).agg(*sums, F.count("*").alias("turns"), F.grouping(by).alias("_all")).where(F.col(by).isNotNull() | (F.col("_all") == 1)).drop("_all")
    read = F.col("cache_read_tokens")
    return out.withColumn("total", sum((F.col(c) for c in USAGE[1:]), F.col(USAGE[0]))).withColumn("hit_ratio", read / F.greatest(F.lit(1), F.col("input_tokens") + F.col("cache_creation_tokens") + read))


def legacy_usage(responses: DataFrame) -> DataFrame:
    """A3: cumulative usage of a session's responses counts with its highest value, field by field."""
    return responses.groupBy("session_id").agg(*[F.max(c).alias(c) for c in USAGE])


def top_sessions(summary: DataFrame, n: int = 5, by: str = "session_id") -> DataFrame:
    """K2: the sessions with the most tokens; ties by session."""
    return summary.where(F.col(by).isNotNull()).orderBy(F.desc("total"), by).limit(n)


def top(df: DataFrame, measure: str, n: int = 10, tie: str | None = None) -> DataFrame:
    """K3, K4, K7: rows with the highest measure."""
    return df.orderBy(F.desc(measure), *([tie] if tie else [])).limit(n)


def percentile_place(n: Column, q: float, rule: str) -> Column:
    """0-based place of a percentile in n sorted values, by three rules.

    floor: int(n*q); capped: the same, n-1 at most; nearest: int(n*q)-1, 0 at least.
    """
    at = F.floor(n * F.lit(q)).cast("long")
    return {"floor": at, "capped": F.least(n - 1, at), "nearest": F.greatest(F.lit(0), F.least(n - 1, at - 1))}[rule]


def percentiles(df: DataFrame, by: list[str], value: str, quantiles: dict[str, float], rule: str = "capped") -> DataFrame:
    """Exact percentiles of large groups: values are counted, sorted within (group, range of values), and
    the value whose rank covers the place is taken; no group is gathered in one row."""
    return percentiles_of_counts(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n")), by, value, quantiles, rule)


def percentiles_of_counts(counts: DataFrame, by: list[str], value: str, quantiles: dict[str, float], rule: str = "capped") -> DataFrame:
    """The same from how often (n) each value of a group occurs."""
    bucket = counts.withColumn("_b", F.floor(F.log2(F.abs(value) + 1) * 8) * F.signum(value))
    offsets = bucket.groupBy(*by, "_b").agg(F.sum("n").alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("n").over(W.partitionBy(*by))).drop("n")
    ranked = bucket.join(offsets, [*by, "_b"]).withColumn("_to", F.col("_before") + F.sum("n").over(W.partitionBy(*by, "_b").orderBy(value)))
    out = []
    for name, q in quantiles.items():
        place = percentile_place(F.col("_all"), q, rule)
        out.append(F.max(F.when((place < F.col("_to")) & (place >= F.col("_to") - F.col("n")), F.col(value))).alias(name))
    return ranked.groupBy(*by).agg(*out)


class DailyCounts:
    """A2, A4, A6 kept up to date: how often each value of a group occurs on each day, in a folder a day.

    New events add a file of their counts, so percentiles, means and sums over any days are exact without the events;
    compact() merges a day's files, drop_before() is what G3 does to events.  One writer a day and source of events.
    """

    def __init__(self, spark: SparkSession, path: str, by: list[str], value: str):
        self.spark, self.path, self.by, self.value = spark, path.rstrip("/"), by, value
        self.files = Files(spark, self.path)

    def add(self, events: DataFrame, time_col: str = "ts") -> None:
        counts = events.where(F.col(self.value).isNotNull()).groupBy(*self.by, self.value, F.to_date(time_col).alias("day")).agg(F.count("*").alias("n"))
        counts.write.mode("append").partitionBy("day").parquet(self.path)

    def days(self) -> list[str]:
        return [n[4:] for n in self.files.names() if n.startswith("day=")]

    def compact(self, day: str) -> None:
        """One file of a day's counts in place of its deltas."""
        at = f"day={day}"
        whole = self.spark.read.parquet(f"{self.path}/{at}").groupBy(*self.by, self.value).agg(F.sum("n").alias("n"))
        whole.write.parquet(f"{self.path}/_new-{day}")
        self.files.delete(at)
        self.files.rename(f"_new-{day}", at)

    def drop_before(self, day: str) -> None:
        for d in self.days():
            if d < day:
                self.files.delete(f"day={d}")

    def counts(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """(by, value, n) over the days first to last."""
        days = [d for d in self.days() if (first or d) <= d <= (last or d)]
        rows = self.spark.read.parquet(*[f"{self.path}/day={d}" for d in days]) if days else self.spark.read.parquet(self.path).where("false")
        return rows.groupBy(*self.by, self.value).agg(F.sum("n").alias("n"))

    def summary(self, quantiles: dict[str, float], first: str | None = None, last: str | None = None, rule: str = "capped") -> DataFrame:
        """n, sum, mean, least, highest and percentiles of each group over the days."""
        counts, v = self.counts(first, last), F.col(self.value)
        plain = counts.groupBy(*self.by).agg(F.sum("n").alias("n"), F.sum(v * F.col("n")).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"))
        return plain.withColumn("avg", F.col("sum") / F.col("n")).join(percentiles_of_counts(counts, self.by, self.value, quantiles, rule), self.by)


def latency_summary(turns: DataFrame, by: list[str] | None = None, value: str = "ms") -> DataFrame:
    """A4: n, mean, percentiles, least and highest latency by source."""
    keys = by or ["source"]
    plain = turns.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"))
    return plain.join(percentiles(turns, keys, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}), keys)


def latency_by_type(turns: DataFrame, value: str = "ms") -> DataFrame:
    """A5: latency by source and turn type, of sources with more than one type."""
    several = turns.groupBy("source").agg(F.count_distinct("turn_type").alias("n")).where("n > 1").select("source")
    return latency_summary(turns.join(several, "source", "left_semi"), ["source", "turn_type"], value)


def output_speed(turns: DataFrame) -> DataFrame:
    """Output tokens a second by source: mean, median, least, highest."""
    speed = turns.where("ms > 0").select("source", (F.col("output_tokens") / (F.col("ms") / 1000)).alias("speed"))
    plain = speed.groupBy("source").agg(F.avg("speed").alias("avg"), F.min("speed").alias("min"), F.max("speed").alias("max"))
    return plain.join(percentiles(speed, ["source"], "speed", {"p50": 0.5}), "source")


def perf_summary(events: DataFrame) -> DataFrame:
    """By event: count, wall time mean and p95, CPU mean and highest, texts and characters."""
    plain = events.groupBy("event").agg(F.count("*").alias("n"), F.avg("wall_ms").alias("wall_avg"), F.avg("cpu_ms").alias("cpu_avg"), F.max("cpu_ms").alias("cpu_max"), F.sum("text_count").alias("texts"), F.sum("text_chars").alias("chars"))
    return plain.join(percentiles(events, ["event"], "wall_ms", {"wall_p95": 0.95}), "event", "left")


def frequencies(events: DataFrame) -> DataFrame:
    """Counts of cache_result and of the entries of the map cache_counts, by event and key."""
    single = events.where("cache_result is not null").select("event", F.col("cache_result").alias("key"), F.lit(1).cast("long").alias("n"))
    several = events.select("event", F.explode("cache_counts").alias("key", "n"))
    return single.unionByName(several).groupBy("event", "key").agg(F.sum("n").alias("n"))


def tail(events: DataFrame, n: int, order: list[str]) -> DataFrame:
    """K1: the last n events, oldest first."""
    return events.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def prune(events: DataFrame, now: Column, days: int, time_col: str = "ts") -> DataFrame:
    """Events of the last days."""
    return events.where(F.col(time_col) >= now - F.make_interval(days=F.lit(days)))


def forget_term(events: DataFrame, term: str, columns: list[str]) -> DataFrame:
    """Events in none of whose columns the term stands, as it is written, in any case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lower(F.lit(term)))
    return events.where(~hit)


def by_type(events: DataFrame, kind: str, order: str) -> DataFrame:
    """Events of a type in order."""
    return events.where(F.col("event_type") == kind).orderBy(order)


def turn_timing(events: DataFrame, by: str = "session_id", order: list[str] | None = None) -> DataFrame:
    """Each response with the latest request before it that no other response took; (by, request_id, response_id, ms)."""
    w = W.partitionBy(by).orderBy(*(order or ["ts", "event_id"]))
    asked = F.last(F.when(F.col("event_type") == "request", F.struct("event_id", "ts")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    responses = events.withColumn("_asked", asked).where("event_type = 'response' and _asked is not null")
    first = responses.withColumn("_n", F.row_number().over(W.partitionBy(by, "_asked.event_id").orderBy(*(order or ["ts", "event_id"])))).where("_n = 1")
    ms = (F.unix_micros("ts") - F.unix_micros("_asked.ts")) / 1000
    return first.select(by, F.col("_asked.event_id").alias("request_id"), F.col("event_id").alias("response_id"), ms.alias("ms"))


def turn_type(roles: Column) -> Column:
    """`tool` if the last message is a tool's, else `chat`."""
    return F.when(F.try_element_at(roles, F.lit(-1)) == "tool", "tool").otherwise("chat")


def degraded_turns(results: DataFrame, turn: str = "turn_id") -> DataFrame:
    """A turn is degraded if any of its results is; the reason is the first by name."""
    return results.groupBy(turn).agg(F.bool_or("degraded").alias("degraded"), F.min(F.when(F.col("degraded"), F.col("reason"))).alias("reason"))


def append_events(events: DataFrame, path: str) -> None:
    """Audit events appended, partitioned by day."""
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)
