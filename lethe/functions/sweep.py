"""Linear sweeps over the spans of a text, as Arrow functions: a text with many matches costs what its length and matches do.

The functions on lists take spans (start, end), half open, in code points.  An empty span meets nothing and is dropped.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fixed import RULE_PATTERNS, SECRET_LITERALS, SECRET_PATTERNS, TOKEN_SHAPE

_TOKEN = re.compile(TOKEN_SHAPE)
_SECRETS = [(re.compile(p.replace("(?iU)", "(?i)")), label, SECRET_LITERALS[p]) for p, label in SECRET_PATTERNS]
#: Rules in ASCII, as the JVM takes them, but for the ends of words.
_RULES = [(re.compile(p.replace(r"\b", r"(?u:\b)"), re.ASCII), label) for p, label in RULE_PATTERNS]
#: Characters of an e-mail's local part, with those that the pattern takes for letters in any case.
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-ſKİı")
FOUND = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("stage", T.IntegerType()), T.StructField("value", T.StringType())]))
_PLACES, _TEXTS = T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType())


def _addresses(pattern: re.Pattern, text: str) -> Iterator[re.Match]:
    """Matches of the e-mail pattern: one can only start where the run of local characters before an @ does."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = pattern.match(text, start)
        if found:
            yield found
            end = found.end()
        at = text.find("@", max(at + 1, end))


def _led(pattern: re.Pattern, literal: str, text: str) -> Iterator[re.Match]:
    """Matches of a pattern that starts with a literal."""
    at = text.find(literal)
    while at >= 0:
        found = pattern.match(text, at)
        if found:
            yield found
        at = text.find(literal, found.end() if found else at + 1)


def secrets(text: str) -> list[tuple[int, int, str, int]]:
    """Matches (start, end, label, stage) of all secret patterns, without those inside a longer one; stages keep the patterns' order."""
    found, folded = [], None
    for i, (pattern, label, literal) in enumerate(_SECRETS):
        if literal == "@":
            matches = _addresses(pattern, text)
        elif pattern.flags & re.IGNORECASE:
            folded = text.upper().lower() if folded is None else folded
            matches = pattern.finditer(text) if literal in folded else ()
        else:
            matches = _led(pattern, literal, text)
        found += [(*m.span(), label, 100 + i) for m in matches]
    return outer(found)


def rules(text: str) -> list[tuple[int, int, str, int]]:
    """Matches (start, end, label, stage) of the rule patterns in a whole text."""
    return [(*m.span(), label, 2) for pattern, label in _RULES for m in pattern.finditer(text)]


def outer(spans: list[tuple]) -> list[tuple]:
    """Spans that don't lie inside a longer one, in order of place."""
    kept, reach = [], -1
    for (_, end), same in groupby(sorted(spans, key=lambda s: (s[0], -s[1])), lambda s: s[:2]):
        if end > reach:
            kept += same
            reach = end
    return kept


def union_of(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover."""
    starts, ends = [], []
    for start, end, *_ in sorted(spans):
        if start >= end:
            continue
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def meets(start: int, end: int, starts: list[int], ends: list[int]) -> bool:
    """Whether a span meets one of the disjoint stretches."""
    k = bisect_right(ends, start)
    return k < len(ends) and starts[k] < end


def greedy(starts: list[int], ends: list[int], ranks: list[tuple]) -> list[int]:
    """Places of the spans that stay, lower ranks first, of one rank the earlier and then the longer; in order of place.

    A rank's spans are swept from left to right against those kept before, and merged into them.
    """
    order = sorted((i for i in range(len(starts)) if starts[i] < ends[i]), key=lambda i: (ranks[i], starts[i], -ends[i]))
    kept: list[int] = []
    for _, same in groupby(order, lambda i: ranks[i]):
        have = [starts[i] for i in kept], [ends[i] for i in kept]
        reach, fresh = -1, []
        for i in same:
            if starts[i] >= reach and not meets(starts[i], ends[i], *have):
                fresh.append(i)
                reach = ends[i]
        kept = sorted(kept + fresh, key=starts.__getitem__) if kept else fresh
    return kept


def cuts(start: int, end: int, starts: list[int], ends: list[int]) -> bool:
    """Whether a span takes a part only of one of the stretches, which are in order and disjoint."""
    k = bisect_right(ends, start)
    while k < len(ends) and starts[k] < end:
        if starts[k] < start or ends[k] > end:
            return True
        k += 1
    return False


def spliced(text: str, spans: Iterator[tuple[int, int, str]]) -> str:
    """text with spans, in order of place, replaced."""
    out, at = [], 0
    for start, end, new in spans:
        if start >= at:
            out += (text[at:start], new)
            at = end
    return "".join([*out, text[at:]])


def lists(array: pa.Array, flat: list) -> Iterator[list]:
    """The rows of a list column, whose values are given; null as empty."""
    at = 0
    for size, valid in zip(np.diff(array.offsets.to_numpy()).tolist(), array.is_valid().to_pylist(), strict=True):
        size = size if valid else 0
        yield flat[at : at + size]
        at += size


Span = tuple[int, int, str, int, str | None]  # start, end, label, stage, text that it covers
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("stage", pa.int32()), ("value", pa.string())])


def _spans(array: pa.Array) -> Iterator[list[Span]]:
    """The rows of a column of spans; a missing value is null."""
    values = array.flatten()
    names = {f.name for f in values.type}
    return lists(array, list(zip(*[values.field(f.name).to_pylist() if f.name in names else [None] * len(values) for f in _SPAN], strict=True)))


def _column(rows: list[list[Span]]) -> pa.Array:
    flat = [s for r in rows for s in r]
    columns = zip(*flat, strict=True) if flat else [[]] * len(_SPAN)
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SPAN, strict=True)], fields=list(_SPAN))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), values)


def _covered(text: str | None, spans: list[tuple]) -> list[Span]:
    return [(*s[:4], text[s[0] : s[1]]) for s in spans] if text else []


def _token_spans(text: str) -> list[tuple]:
    return [(*m.span(), "TOKEN", 0) for m in _TOKEN.finditer(text)] if "[" in text else []


def secrets_outside_tokens(text: str) -> list[tuple[int, int, str, int]]:
    found = secrets(text)
    blocked = union_of(_token_spans(text)) if found else ([], [])
    return [s for s in found if not meets(s[0], s[1], *blocked)]


def _finder(of: Callable[[str], list[tuple]]):
    def find(text: pa.Array) -> pa.Array:
        return _column([_covered(t, of(t)) if t else [] for t in text.to_pylist()])

    return F.arrow_udf(find, FOUND)


#: From text to spans with the text that they cover.
find_secrets, find_secrets_outside_tokens, find_tokens, find_rules = _finder(secrets), _finder(secrets_outside_tokens), _finder(_token_spans), _finder(rules)


def _in_stages(spans: list[Span]) -> list[Span]:
    return [spans[i] for i in greedy([s[0] for s in spans], [s[1] for s in spans], [s[3] for s in spans])]


def _longest(spans: list[Span]) -> list[Span]:
    spans = sorted(spans, key=lambda s: s[3])  # decides between spans of one place
    return [spans[i] for i in greedy([s[0] for s in spans], [s[1] for s in spans], [s[0] - s[1] for s in spans])]


def _last(spans: list[Span]) -> list[Span]:
    kept: list[Span] = []
    for s in sorted((s for s in spans if s[0] < s[1]), key=lambda s: (-s[0], -s[1])):
        if not kept or s[1] <= kept[-1][0]:
            kept.append(s)
    return kept[::-1]


def _chooser(of: Callable[[list[Span]], list[Span]]):
    def choose(spans: pa.Array) -> pa.Array:
        return _column([of(r) if len(r) > 1 else r for r in _spans(spans)])

    return F.arrow_udf(choose, FOUND)


#: Without spans that lie inside a longer one.
without_inner = _chooser(outer)
_ORDERS = {"stage": _chooser(_in_stages), "length": _chooser(_longest), "last": _chooser(_last)}


@F.arrow_udf(FOUND)
def _outside(spans: pa.Array, blocked: pa.Array) -> pa.Array:
    def of(own: list[Span], other: list[Span]) -> list[Span]:
        there = union_of(other)
        return [s for s in own if not meets(s[0], s[1], *there)]

    return _column([of(*row) for row in zip(_spans(spans), _spans(blocked), strict=True)])


@F.arrow_udf(FOUND)
def _uncut(spans: pa.Array, guarded: pa.Array) -> pa.Array:
    def of(own: list[Span], other: list[Span]) -> list[Span]:
        there = union_of(other)
        return [s for s in own if not cuts(s[0], s[1], *there)]

    return _column([of(*row) for row in zip(_spans(spans), _spans(guarded), strict=True)])


@F.arrow_udf(FOUND)
def _with_values(text: pa.Array, spans: pa.Array) -> pa.Array:
    return _column([_covered(t, own) for t, own in zip(text.to_pylist(), _spans(spans), strict=True)])


@F.arrow_udf(T.StringType())
def _splice(text: pa.Array, spans: pa.Array) -> pa.Array:
    values = spans.flatten()
    rows = lists(spans, list(zip(*[values.field(n).to_pylist() for n in ("start", "end", "token")], strict=True)))
    return pa.array([None if t is None else spliced(t, own) for t, own in zip(text.to_pylist(), rows, strict=True)], pa.string())


@F.arrow_udf(T.MapType(T.StringType(), T.StringType()))
def merged_maps(first: pa.Array, second: pa.Array) -> pa.Array:
    """The entries of both maps; of one key the second's value."""
    rows = zip(first.to_pylist(), second.to_pylist(), strict=True)
    return pa.array([list((dict(a or ()) | dict(b or ())).items()) for a, b in rows], pa.map_(pa.string(), pa.string()))


def resolve(spans: Column, order: str = "stage") -> Column:
    """Spans that don't meet, in order of place.

    stage: lower stages first, then the earlier, then the longer.  length: the longest first, then the earlier, then the
    lower stage.  last: the later first, then the longer.
    """
    return _ORDERS[order](spans)


def outside(spans: Column, blocked: Column) -> Column:
    """Spans that meet none of the blocked ones."""
    return _outside(spans, blocked)


def uncut(spans: Column, guarded: Column) -> Column:
    """Spans that take no part only of a stretch that the guarded ones cover."""
    return _uncut(spans, guarded)


def with_values(text: Column, spans: Column) -> Column:
    """Spans with the text that they cover."""
    return _with_values(F.when(F.size(spans) > 0, text), spans)


def apply_spans(text: Column, spans: Column) -> Column:
    """Text with each span (start, end, token), in order of place, replaced by its token."""
    own = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["token"].alias("token")))
    some = F.size(spans) > 0
    return F.when(some, _splice(F.when(some, text), F.when(some, own))).otherwise(text)
