"""Spans in text as arrays of structs: find, resolve, replace.

A span is struct<start:int,end:int,label:string,stage:int>, half open, in code points.  Whole texts, whose spans can be
many, go through the linear sweeps of sweep.py.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import sweep
from .fixed import SECRET_LITERALS, SECRET_PATTERNS
from .sweep import apply_spans, outside, resolve, with_values, without_inner  # noqa: F401

SPANS = "array<struct<start:int,end:int,label:string,stage:int>>"
STAGE_TOKEN, STAGE_ENTITY, STAGE_BLACKLIST, STAGE_SECRET, STAGE_CUSTOM, STAGE_VERIFIER = 0, 2, 3, 4, 5, 6


def no_spans() -> Column:
    return F.array().cast(SPANS)


def could_match(text: Column, pattern: str) -> Column:
    """Whether the text holds the characters that every match of a secret pattern has; a plain search spares most texts the pattern."""
    literal = SECRET_LITERALS.get(pattern)
    if literal is None:
        return F.lit(True)
    return F.contains(F.lower(F.upper(text)) if pattern.startswith("(?i") and literal != "@" else text, F.lit(literal))


def could_hold_secret(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [could_match(text, p) for p, _ in SECRET_PATTERNS])


def secret_spans(text: Column, outside_tokens: bool = False) -> Column:
    """Matches of every secret pattern with the text they cover; stage numbers keep the patterns' order, and a span inside a longer one is left out."""
    find = sweep.find_secrets_outside_tokens if outside_tokens else sweep.find_secrets
    return F.coalesce(find(F.when(could_hold_secret(text), text)), F.array().cast(sweep.FOUND))


def token_spans(text: Column) -> Column:
    return F.coalesce(sweep.find_tokens(F.when(F.contains(text, F.lit("[")), text)), F.array().cast(sweep.FOUND))


def overlaps(a: Column, b: Column) -> Column:
    """Half-open intervals meet."""
    return (a["start"] < b["end"]) & (a["end"] > b["start"])


def covered_text(text: Column, span: Column) -> Column:
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])
