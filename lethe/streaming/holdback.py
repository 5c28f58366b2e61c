"""Streams: held-back text so that a token cut between chunks comes out whole; sanitizing micro-batches.

State per stream is the text from the last open bracket on.  Tokens are restored after the state step, by a join,
so values never enter the state.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.value_store import ValueStore
from ..operators import sanitize as s
from ..operators.tokens import restore

LONGEST = 200  # characters of a token; an open bracket followed by more is no token
_OPEN = re.compile(r"\[[A-Z0-9_a-f]*$")
OUTPUT = "stream_key string, seq long, text string"


def safe_split(text: str) -> tuple[str, str]:
    """What can go out, and the tail that may still become a token."""
    found = _OPEN.search(text)
    if not found or len(text) - found.start() > LONGEST:
        return text, ""
    return text[: found.start()], text[found.start() :]


def release(pieces: list[tuple[int, str, bool]], held: str, ready: int, waiting: dict[int, tuple[str, bool]]) -> tuple[list[tuple[int, str]], str, int, dict]:
    """Pieces (seq, delta, is_end) in order of seq; one whose predecessors are missing waits.  Repeated ones are dropped."""
    waiting = dict(waiting)
    for seq, delta, end in pieces:
        if seq >= ready:
            waiting[seq] = (delta or "", bool(end))
    out = []
    while ready in waiting:
        delta, end = waiting.pop(ready)
        text, held = safe_split(held + delta)
        if end:
            text, held = text + held, ""
        if text:
            out.append((ready, text))
        ready += 1
    return out, held, ready, waiting


def flush(held: str, ready: int, waiting: dict[int, tuple[str, bool]]) -> tuple[list[tuple[int, str]], int]:
    """What is left of a stream that goes no further, and the seq that it would go on with: the tail held back, then pieces beyond a gap."""
    out = [(ready - 1, held)] if held else []
    out += [(seq, delta) for seq, (delta, _) in sorted(waiting.items()) if delta]
    return out, max([ready, *(seq + 1 for seq in waiting)])


def _rows(key: str, out: list[tuple[int, str]]) -> pd.DataFrame:
    return pd.DataFrame({"stream_key": pd.Series([key] * len(out), dtype=object), "seq": pd.Series([q for q, _ in out], dtype="int64"), "text": pd.Series([t for _, t in out], dtype=object)})


IDLE_SECONDS = 30  # after which a stream that doesn't end comes out
KEEP_SECONDS = 3600  # for which a stream's place is kept, so that late copies of its pieces are known


class Idle(StatefulProcessor):
    """A state that is flushed when a key has had no rows for some time, and forgotten later.

    timed() is called for each batch of rows; it moves the key's one timer.
    """

    def __init__(self, idle_seconds: float = IDLE_SECONDS, keep_seconds: float = KEEP_SECONDS):
        self.idle, self.keep = int(1000 * idle_seconds), int(1000 * keep_seconds)

    def timed(self, timerValues) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)

    def close(self) -> None:
        pass


class HoldBack(Idle):
    """Rows (stream_key, seq, delta, is_end), seq from 0 without gaps, to safe text in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", StructType([StructField("held", StringType()), StructField("ready", LongType()), StructField("waiting", StringType())]), ttlDurationMs=self.keep)

    def _state(self) -> tuple[str, int, dict[int, tuple[str, bool]]]:
        if not self.state.exists():
            return "", 0, {}
        held, ready, packed = self.state.get()
        return held, ready, {seq: (delta, end) for seq, delta, end in json.loads(packed)}

    def _put(self, held: str, ready: int, waiting: dict[int, tuple[str, bool]]) -> None:
        self.state.update((held, ready, json.dumps([(seq, *piece) for seq, piece in waiting.items()])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        pieces = [(int(q), d, e) for part in rows for q, d, e in zip(part["seq"], part["delta"], part["is_end"], strict=True)]
        out, held, ready, waiting = release(sorted(pieces, key=lambda p: p[0]), *self._state())
        self._put(held, ready, waiting)
        self.timed(timerValues)
        yield _rows(str(key[0]), out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        out, ready = flush(*self._state())
        self._put("", ready, {})
        yield _rows(str(key[0]), out)


class LastUsage(Idle):
    """Rows (stream_id, seq, usage, is_end) to each stream's last usage, at its end or when it goes no further."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("usage", StructType([StructField("seq", LongType()), StructField("usage", StringType())]), ttlDurationMs=self.keep)

    def _out(self, key) -> Iterator[pd.DataFrame]:
        if self.state.exists() and self.state.get()[1]:
            seq, usage = self.state.get()
            self.state.update((seq, ""))  # a later end gives nothing more
            yield pd.DataFrame({"stream_id": [key[0]], "usage": [usage]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        best, ended = (self.state.get() if self.state.exists() else (-1, "")), False
        for part in rows:
            ended |= bool(part["is_end"].any())
            for seq, usage in zip(part["seq"], part["usage"], strict=True):
                if isinstance(usage, str) and usage not in ("", "{}") and seq > best[0]:
                    best = (int(seq), usage)
        self.state.update(tuple(best))
        self.timed(timerValues)
        if ended:
            yield from self._out(key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        yield from self._out(key)


def hold_back(chunks: DataFrame, idle_seconds: float = IDLE_SECONDS) -> DataFrame:
    """R1 over a streaming or batch table of chunks.

    A stream without an end comes out when it has had no chunk for idle_seconds; chunks beyond a gap come out then too.
    Streaming needs the RocksDB state store provider, and a processingTime trigger: timers are looked at once a micro-batch,
    and there is always a next one.
    """
    own = chunks.select("stream_key", F.col("seq").cast("long").alias("seq"), "delta", "is_end")
    if chunks.isStreaming:
        return own.groupBy("stream_key").transformWithStateInPandas(statefulProcessor=HoldBack(idle_seconds), outputStructType=OUTPUT, outputMode="Append", timeMode="ProcessingTime")

    return _held_back(own)


def last_usage(chunks: DataFrame, idle_seconds: float = IDLE_SECONDS) -> DataFrame:
    """R3 over streaming chunks (stream_id, seq, data, is_end), as readers.final_usage over a table."""
    own = chunks.select("stream_id", F.col("seq").cast("long").alias("seq"), F.get_json_object("data", "$.usage").alias("usage"), F.coalesce("is_end", F.lit(False)).alias("is_end"))
    return own.groupBy("stream_id").transformWithStateInPandas(statefulProcessor=LastUsage(idle_seconds), outputStructType="stream_id string, usage string", outputMode="Append", timeMode="ProcessingTime")


def _held_back(chunks: DataFrame) -> DataFrame:
    """R1 over a table, by windows: what a chunk holds back is the open bracket at its end, or the one before it if the
    chunk only goes on with it.  No more than LONGEST chunks are looked at for one row.  The chunks are read once."""
    keys = ["stream_key"]
    single = chunks.groupBy("stream_key", "seq").agg(F.max(F.coalesce("delta", F.lit(""))).alias("delta"), F.bool_or(F.coalesce("is_end", F.lit(False))).alias("is_end"))
    in_order = W.partitionBy(*keys).orderBy("seq")
    ready = single.withColumn("top", F.max("seq").over(W.partitionBy(*keys))).withColumn("n", F.row_number().over(in_order) - 1).where("n = seq").where("delta <> '' or is_end")
    ready = ready.withColumn("part", F.coalesce(F.sum(F.col("is_end").cast("int")).over(in_order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    goes_on = F.col("delta").rlike(r"^[A-Z0-9_a-f]*$")
    within = W.partitionBy(*keys, "part").orderBy("seq")
    opened = F.when(goes_on, F.col("delta")).otherwise(F.regexp_extract("delta", r"\[[A-Z0-9_a-f]*$", 0))
    runs = ready.withColumn("opened", opened).withColumn("run", F.sum((~goes_on).cast("int")).over(within))
    run = W.partitionBy(*keys, "part", "run").orderBy("seq")
    tail = F.array_join(F.collect_list("opened").over(run.rowsBetween(-LONGEST, 0)), "")
    open_at = F.first("opened").over(run)
    held = F.when(~F.col("is_end") & F.startswith(open_at, F.lit("[")) & (F.char_length(tail) <= LONGEST), tail).otherwise("")
    kept = runs.withColumn("held", held)
    before = F.coalesce(F.lag("held").over(within), F.lit(""))
    whole = F.concat(before, F.col("delta"))
    text = F.substring(whole, F.lit(1), F.char_length(whole) - F.char_length("held"))
    piece = lambda seq, text: F.struct(seq.alias("seq"), text.alias("text"))
    left = F.when(F.lead("seq").over(in_order).isNull(), F.col("held")).otherwise("")  # of the whole stream
    out = kept.select("stream_key", F.array(piece(F.col("seq"), text), piece(F.col("top") + 1, left)).alias("p"))
    return out.select("stream_key", F.explode(F.filter("p", lambda x: x["text"] != "")).alias("x")).select("stream_key", "x.seq", "x.text")


def restored(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """Safe text with its tokens restored by a static table of known values."""
    held = hold_back(chunks).withColumn("_row", F.concat_ws(":", "stream_key", "seq"))
    return restore(held, known, "_row", "text").drop("_row")


def restore_batch(known: DataFrame, sink):
    """A foreachBatch function over hold_back()'s stream: each micro-batch is kept, since the state step can't run twice, then restored."""

    def of(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        sink(restore(kept.withColumn("_row", F.concat_ws(":", "stream_key", "seq")), known, "_row", "text").drop("_row"), batch_id)
        kept.unpersist()

    return of


def sanitize_batch(store: ValueStore, sink, **stages):
    """A foreachBatch function: each micro-batch reads the newest known values and adds those that it found.

    sink(documents, batch id) gets the sanitized batch.  What is written follows the batch, not the known values.  A batch
    that runs again finds its own values known, gives the same texts and adds nothing.
    """

    def of(batch: DataFrame, batch_id: int) -> None:
        with store.pin(store.generation()) as version:
            known = store.read(version)
            out, table = s.sanitize(batch, known, **stages)
            store.append(table.join(known, "token", "left_anti"))
            sink(out, batch_id)

    return of
