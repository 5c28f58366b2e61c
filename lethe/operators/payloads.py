"""Model-bound text in JSON payloads: found by path, sanitized, put back at its place."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import PAYLOAD_TEXT_KEYS
from ..functions.spans import apply_spans
from ..functions.text import row_key

_MARKS = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]', re.DOTALL)


def strings(payload: str) -> list[tuple[str, str | None, int, int, str]]:
    """(path, parent key, start, end, text) of each string value of a JSON text, at any depth; none where it isn't JSON.

    A list's items have the key of the list.  start and end are the literal's places, quotes included.
    """
    try:
        json.loads(payload)
    except RecursionError:
        pass  # deeper than the parser goes, the walk below has no such limit
    except ValueError:
        return []
    out, stack = [], []  # of open objects and lists [key, expects a key, name] and [key, place]
    for m in _MARKS.finditer(payload):
        mark = m.group()
        top = stack[-1] if stack else None
        if mark == "{":
            stack.append([_key(top), True, None])
        elif mark == "[":
            stack.append([_key(top), 0])
        elif mark in "}]":
            stack.pop()
        elif mark == ",":
            top[1] = True if len(top) == 3 else top[1] + 1
        elif mark == ":":
            top[1] = False
        elif top is not None and top[1] is True:
            top[2] = _text(mark)
        else:
            path = "".join(f".{e[2]}" if len(e) == 3 else f"[{e[1]}]" for e in stack)
            out.append(("$" + path, _key(top), m.start(), m.end(), _text(mark)))
    return out


def _key(top: list | None) -> str | None:
    """Parent key of a value whose container is `top`; a list's items have the list's."""
    return None if top is None else top[2] if len(top) == 3 else top[0]


def _text(literal: str) -> str:
    """A JSON string's text; half a surrogate pair, which JSON may escape, becomes U+FFFD."""
    text = json.loads(literal, strict=False)
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace") if "\\u" in literal else text


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for i, payload in zip(b.column(0), b.column(1), strict=True):
            rows += [(i.as_py(), path, start, end, text) for path, key, start, end, text in strings(payload.as_py() or "") if key in PAYLOAD_TEXT_KEYS and text]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (b.schema.field(0).type, pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["id", "path", "start", "end", "text"])


def text_paths(payloads: DataFrame, id_col: str = "id", payload_col: str = "payload") -> DataFrame:
    """(id, path, start, end, text) of each string whose parent key is a text key, at any place and depth."""
    kind = payloads.schema[id_col].dataType.simpleString()
    found = payloads.select(F.col(id_col).alias("id"), F.col(payload_col).alias("payload")).mapInArrow(_walk, f"id {kind}, path string, start int, end int, text string")
    return found.withColumnRenamed("id", id_col)


BLOCKS = "array<string>"  # each as JSON, as blocks of other kinds may stand between those of text
PARTS = "array<struct<part:string,place:int,text:string>>"
MESSAGE = "struct<content:string,tool_calls:string>"
ITEM = "struct<content:string,arguments:string,output:string,text:string>"


def _items(requests: DataFrame, id_col: str, raw: Column, item: str, lists: list[str]) -> DataFrame:
    """(id, place, i, l) of the items of a JSON array: fields as strings (i), and those of `lists` as blocks (l), null where they are none."""
    as_blocks = f"array<struct<{','.join(f'{n}:{BLOCKS}' for n in lists)}>>"
    both = requests.select(id_col, F.from_json(raw, f"array<{item}>").alias("i"), F.from_json(raw, as_blocks).alias("l"))
    return both.select(id_col, F.posexplode(F.arrays_zip("i", "l")).alias("place", "z")).select(id_col, "place", "z.i", "z.l")


def _texts(blocks: Column) -> Column:
    return F.transform(blocks, lambda b: F.get_json_object(b, "$.text"))


def chat_texts(requests: DataFrame, id_col: str = "id", payload_col: str = "payload") -> DataFrame:
    """(id, part, place, text) of a chat request's messages (string or text blocks), tool calls, system (string or blocks), tools.

    A request is read once for all its parts.  Whether a value is a list is told by the JSON, not by its text, which may
    begin with a bracket.  Descriptions deep
    inside a tool's parameters are found by text_paths.
    """
    p = F.col(payload_col)
    some = lambda name, place, texts: F.coalesce(F.transform(texts, lambda t: F.struct(F.lit(name).alias("part"), place.alias("place"), t.alias("text"))), F.array().cast(PARTS))

    def of(z: Column, place: Column) -> Column:
        kept = F.filter(z["l"]["content"], lambda b: F.get_json_object(b, "$.type") == "text")
        calls = F.from_json(z["i"]["tool_calls"], "array<struct<function:struct<arguments:string>>>")
        return F.concat(some("content", place, F.when(z["l"]["content"].isNull(), F.array(z["i"]["content"]))), some("block", place, _texts(kept)), some("arguments", place, F.transform(calls, lambda c: c["function"]["arguments"])))

    raw, none = F.get_json_object(p, "$.messages"), F.lit(-1)
    messages = F.flatten(F.transform(F.arrays_zip(F.from_json(raw, f"array<{MESSAGE}>").alias("i"), F.from_json(raw, f"array<struct<content:{BLOCKS}>>").alias("l")), of))
    system = F.coalesce(_texts(F.from_json(p, f"struct<system:{BLOCKS}>")["system"]), F.array(F.get_json_object(p, "$.system")))
    tools = F.from_json(F.get_json_object(p, "$.tools"), "array<struct<description:string,function:struct<description:string>>>")
    tools = F.transform(tools, lambda t: F.coalesce(t["description"], t["function"]["description"]))
    parts = F.concat(F.coalesce(messages, F.array().cast(PARTS)), some("system", none, system), some("description", none, tools))
    return requests.select(id_col, F.explode(F.filter(parts, lambda x: x["text"].isNotNull())).alias("x")).select(id_col, "x.part", "x.place", "x.text")


def response_texts(requests: DataFrame, id_col: str = "id", payload_col: str = "payload") -> DataFrame:
    """(id, part, place, text) of a responses request: input string or items (strings or blocks), instructions.

    As in chat_texts, the JSON tells what is a list.
    """
    p = F.col(payload_col)
    lists = ["content", "output", "summary"]
    items = _items(requests, id_col, F.get_json_object(p, "$.input"), ITEM, lists)
    whole = [F.when(F.col(f"l.{n}").isNull(), F.col(f"i.{n}")) for n in ("content", "output")]
    inner = [F.coalesce(_texts(F.col(f"l.{n}")), F.array().cast(BLOCKS)) for n in lists]
    own = items.select(id_col, F.lit("input").alias("part"), "place", F.explode(F.concat(F.array(*whole, "i.arguments", "i.text"), *inner)).alias("text"))
    is_list = F.from_json(p, f"struct<input:{BLOCKS}>")["input"].isNotNull()
    text = requests.select(id_col, F.lit("input").alias("part"), F.lit(-1).alias("place"), F.when(~is_list, F.get_json_object(p, "$.input")).alias("text"))
    more = requests.select(id_col, F.lit("instructions").alias("part"), F.lit(-1).alias("place"), F.get_json_object(p, "$.instructions").alias("text"))
    return own.unionByName(text).unionByName(more).where("text is not null")


def put_back(payload: Column, spans: Column) -> Column:
    """a payload with the literals at spans (start, end, text) replaced by those texts; all else stays as it was written."""
    literal = lambda c: F.substring(F.to_json(F.struct(c.alias("s"))), F.lit(6), F.char_length(F.to_json(F.struct(c.alias("s")))) - 6)
    ranked = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), literal(x["text"]).alias("token"))))
    return apply_spans(payload, ranked)


def sanitize_payloads(payloads: DataFrame, sanitize: Callable[[DataFrame], DataFrame], id_col: str = "id", payload_col: str = "payload") -> DataFrame:
    """Payloads with their model-bound texts run through sanitize: (doc_id, text) -> (doc_id, sanitized).

    Each distinct text is a row, so long conversations spread.
    """
    payloads = payloads.withColumn("_row", row_key(F.col(id_col), F.col(payload_col)))
    keyed = text_paths(payloads, "_row", payload_col).withColumn("doc_id", F.sha2("text", 256))
    done = sanitize(keyed.groupBy("doc_id").agg(F.any_value("text").alias("text"))).select("doc_id", "sanitized")
    spans = keyed.join(done, "doc_id").where("text <> sanitized").groupBy("_row").agg(F.collect_set(F.struct("start", "end", F.col("sanitized").alias("text"))).alias("_spans"))
    out = payloads.join(spans, "_row", "left").drop("_row")
    return out.withColumn(payload_col, F.when(F.col("_spans").isNull(), F.col(payload_col)).otherwise(put_back(F.col(payload_col), F.col("_spans")))).drop("_spans")


def restore_payloads(payloads: DataFrame, restore: Callable[[DataFrame], DataFrame], id_col: str = "id", payload_col: str = "payload") -> DataFrame:
    """Payloads with the tokens in their model-bound texts restored by restore: (doc_id, text) -> (doc_id, text)."""
    return sanitize_payloads(payloads, lambda texts: restore(texts).select("doc_id", F.col("text").alias("sanitized")), id_col, payload_col)


def block_events(blocks: DataFrame) -> DataFrame:
    """Audit events (session_id, event_type, raw, sanitized, token_count, retokenized_only) of the blocks (session_id,
    text, sanitized, minted) that changed; minted: the tokens that are new."""
    changed = blocks.where(~F.col("text").eqNullSafe(F.col("sanitized")))
    n = F.coalesce(F.size("minted"), F.lit(0))
    return changed.select("session_id", F.lit("pii_detected").alias("event_type"), F.left("text", F.lit(500)).alias("raw"), F.left("sanitized", F.lit(500)).alias("sanitized"), n.alias("token_count"), (n <= 0).alias("retokenized_only"))


def stream_pieces(chunks: DataFrame) -> DataFrame:
    """R2: (stream_id, key, seq, delta, is_end) of response chunks (stream_id, seq, data): content, tool arguments, response deltas."""
    d = F.col("data")
    kind = F.get_json_object(d, "$.type")
    choice = "array<struct<index:int,delta:struct<content:string,tool_calls:array<struct<index:int,function:struct<arguments:string>>>>>>"
    choices = chunks.select("stream_id", "seq", F.explode(F.from_json(F.get_json_object(d, "$.choices"), choice)).alias("c"))
    content = choices.where("c.delta.content is not null").select("stream_id", F.concat(F.lit("content:"), F.coalesce("c.index", F.lit(0))).alias("key"), "seq", F.col("c.delta.content").alias("delta"))
    calls = choices.select("stream_id", "seq", F.col("c.index").alias("i"), F.explode("c.delta.tool_calls").alias("t")).where("t.function.arguments is not null").select("stream_id", F.concat_ws(":", F.lit("call"), F.coalesce("i", F.lit(0)), F.coalesce("t.index", F.lit(0))).alias("key"), "seq", F.col("t.function.arguments").alias("delta"))
    get = lambda n: F.coalesce(F.get_json_object(d, f"$.{n}"), F.lit(""))
    deltas = chunks.where(F.endswith(kind, F.lit(".delta"))).select("stream_id", F.concat_ws(":", kind, get("item_id"), get("output_index"), get("content_index")).alias("key"), "seq", F.get_json_object(d, "$.delta").alias("delta"))
    return content.unionByName(calls).unionByName(deltas).withColumn("is_end", F.lit(False))
