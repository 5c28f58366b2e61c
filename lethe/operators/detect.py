"""Detection: secrets by pattern, entities by rule and, in windows, by model, filters of entities, kinds of terms, path rules."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.spans import could_hold_secret, outside, resolve, secret_spans, token_spans, with_values
from ..functions.sweep import FOUND, find_rules
from ..functions.text import windows

BLOCKED_NAMES = [".env", ".env.local", ".env.production", "secrets.json", "credentials.json", "id_rsa", "id_ed25519", ".netrc"]
MOST_GLOBS = 1000  # of an allow-list: each is a pattern in the plan; plain names have no such bound
BLOCKED_SUFFIXES = [".pem", ".key", ".p12", ".pfx"]


def secret_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, label, value) of each secret or structured personal value outside existing tokens."""
    text = F.col(text_col)
    found = docs.where(could_hold_secret(text)).select(F.col(id_col), F.explode(secret_spans(text, outside_tokens=True)).alias("s"))
    return found.select(id_col, "s.start", "s.end", "s.label", "s.value")


def detector_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ceiling: int | None = fixed.CEILING) -> DataFrame:
    """(id, window, start, text) of texts up to the ceiling, all texts without one, in overlapping windows."""
    own = docs if ceiling is None else docs.where(F.char_length(text_col) <= ceiling)
    return own.select(id_col, F.posexplode(windows(F.col(text_col))).alias("window", "w")).select(id_col, "window", "w.start", "w.text")


def rule_entities(text: Column) -> Column:
    """X1's built-in detector: spans of numbers with a known shape, with the text they cover."""
    return F.coalesce(find_rules(text), F.array().cast(FOUND))


def entity_values(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ceiling: int | None = fixed.CEILING) -> DataFrame:
    """(id, start, end, label, value) of the rule detector over texts up to the ceiling, each once.

    Rules see whole texts: at a window's edge a part of a number would look like a number.
    """
    own = docs if ceiling is None else docs.where(F.char_length(text_col) <= ceiling)
    found = own.select(id_col, F.explode(rule_entities(F.col(text_col))).alias("s"))
    return found.select(id_col, "s.start", "s.end", "s.label", "s.value").distinct()


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ceiling: int | None = fixed.CEILING) -> DataFrame:
    """(id, start, end, label) of the rule detector, each once."""
    return entity_values(docs, id_col, text_col, ceiling).select(id_col, "start", "end", "label").distinct()


def remap(found: DataFrame, id_col: str = "doc_id", *more: str) -> DataFrame:
    """window offsets (_at, start, end, label and more) to document offsets, duplicates of overlaps out."""
    return found.select(id_col, (F.col("_at") + F.col("start")).alias("start"), (F.col("_at") + F.col("end")).alias("end"), "label", *more).distinct()


def model_entities(docs: DataFrame, load: Callable[[], Callable[[list[str]], Iterable[list[tuple[int, int, str]]]]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """X1/X2 with a user's model: (id, start, end, label, degraded).

    load() is called once per task and gives a function from texts to lists of (start, end, label).  A failing
    batch yields one row with null span and degraded = true for each of its windows (R5).
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            ids, ats, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            rows = []
            try:
                model = model or load()
                for i, at, spans in zip(ids, ats, model(texts), strict=True):
                    rows += [(i, at, s, e, label, False) for s, e, label in spans]
            except Exception:  # a model's failure marks its rows; it must not stop the job
                rows = [(i, at, None, None, None, True) for i, at in zip(ids, ats, strict=True)]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (b.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_()), strict=True)], names=[id_col, "_at", "start", "end", "label", "degraded"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = detector_windows(docs, id_col, text_col).select(id_col, "start", "text").mapInArrow(of, f"{id_col} {kind}, _at int, start int, end int, label string, degraded boolean")
    return remap(found, id_col, "degraded")


def least_length(label: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in fixed.LEAST_LENGTHS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, label), F.lit(2))


def plausible(label: Column, value: Column) -> Column:
    """Not a generic word and long enough for its label."""
    norm = F.regexp_replace(F.upper(label), " ", "_")
    bare = F.trim(value)
    return ~F.lower(bare).isin(fixed.GENERIC_WORDS) & (F.char_length(bare) >= least_length(norm))


def in_mode(label: Column, value: Column, mode: str) -> Column:
    """P5: whether the mode strict, balanced or relaxed replaces the entity."""
    norm = F.regexp_replace(F.upper(label), " ", "_")
    several = F.size(F.filter(F.split(F.trim(value), r"(?U)\s+"), lambda w: w != "")) > 1
    affected = {"strict": F.lit(True), "relaxed": F.lit(False), "balanced": F.when(norm.isin("PERSON", "ORGANIZATION"), several).otherwise(True)}[mode]
    return F.when(norm.isin(fixed.ALWAYS), True).when(norm.isin(fixed.MODE_AFFECTED), affected).otherwise(F.lit(mode != "relaxed"))


def allowed(value: Column, names: list[str], escaped: Column | None = None) -> Column:
    """Escaped in this text, or a substring of an allowed name or the other way round, or matching a glob; any case.

    names is configuration, of a size that doesn't grow with the data.
    """
    v = F.lower(value)
    exact = [n.lower() for n in names if not set(n) & set("*?[")]
    globs = [glob_pattern(n.lower()) for n in names if set(n) & set("*?[")]
    out = F.array_contains(escaped, v) if escaped is not None else F.lit(False)
    if exact:
        out = out | F.exists(F.array(*map(F.lit, exact)), lambda n: F.contains(v, n) | F.contains(n, v))
    return reduce(lambda a, g: a | v.rlike(g), globs, out)


def allowed_values(values: DataFrame, names: DataFrame) -> DataFrame:
    """P6 for a list of any size: those of values (value), in lower case, that are a substring of a name (name) or have one, or match a glob.

    Both directions are dictionary passes: names looked up in the values, and values in the names.
    """
    from .dictionary import occurrences  # which itself needs no detector

    v = values.select(F.lower("value").alias("value")).where("value <> ''").distinct()
    n = names.select(F.lower("name").alias("value")).where("value <> ''").distinct()
    glob = F.col("value").rlike(r"[*?\[]")
    plain = n.where(~glob)
    texts = lambda df: df.select(F.col("value").alias("id"), F.col("value").alias("text"))
    found = occurrences(texts(v), plain, "id").select(F.col("id").alias("value")).unionByName(occurrences(texts(plain), v, "id").select("value"))
    globs = [glob_pattern(r["value"]) for r in n.where(glob).limit(MOST_GLOBS + 1).collect()]
    if len(globs) > MOST_GLOBS:
        raise ValueError(f"more than {MOST_GLOBS} globs in an allow-list")
    if globs:
        found = found.unionByName(v.where(reduce(lambda a, b: a | b, [F.col("value").rlike(g) for g in globs])))
    return found.distinct()


def glob_pattern(glob: str) -> str:
    """A shell glob as an anchored regular expression."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            i = end
        else:
            out += "\\" + c if not c.isalnum() else c
        i += 1
    return f"(?s)^{out}$"


def term_kind(term: Column) -> Column:
    """EMAIL, IP, IBAN, CREDIT_CARD, PHONE or PERSON, in this order; VALUE for blanks."""
    s = F.trim(term)
    compact = F.upper(F.regexp_replace(s, "[ -]", ""))
    digits = F.regexp_replace(s, r"\D", "")
    n = F.char_length(digits)
    return (
        F.when(s == "", "VALUE")
        .when(s.rlike(fixed.TERM_EMAIL), "EMAIL")
        .when(s.rlike(fixed.TERM_IP), "IP")
        .when(compact.rlike(fixed.TERM_IBAN), "IBAN")
        .when(n.isin(13, 14, 15, 16, 19), "CREDIT_CARD")
        .when(s.rlike(fixed.TERM_PHONE) & (n >= 7), "PHONE")
        .otherwise("PERSON")
    )


def blocked_path(path: Column, globs: list[str]) -> Column:
    """Why a path is blocked, or null."""
    name = F.element_at(F.split(path, "/"), -1)
    out = F.lit(None).cast("string")
    suffix = reduce(lambda a, s: a | F.endswith(name, F.lit(s)), BLOCKED_SUFFIXES[1:], F.endswith(name, F.lit(BLOCKED_SUFFIXES[0])))
    out = F.when(name.isin(BLOCKED_NAMES) | suffix, F.concat(F.lit("sensitive file type: "), name))
    for g in reversed(globs):
        out = F.when(path.rlike(glob_pattern(g)) | name.rlike(glob_pattern(g)), F.lit(f"matches block pattern: {g}")).otherwise(out)
    return out


def verifier_spans(spans: Column, taken: Column, text: Column, names: list[str]) -> Column:
    """A second pass's spans that are not empty, not in a token, not allowed; of those that meet the later stays, of equal starts the longer."""
    fit = F.filter(with_values(text, spans), lambda s: (s["end"] > s["start"]) & ~allowed(s["value"], names))
    return resolve(outside(outside(fit, token_spans(text)), taken), "last")


def all_spans(docs: DataFrame, verifiers: list[Callable[[DataFrame], DataFrame]], id_col: str = "doc_id") -> DataFrame:
    """Spans (id, start, end, label) of all verifiers over docs (id, text), each once."""
    found = [v(docs).select(id_col, "start", "end", "label") for v in verifiers]
    return reduce(DataFrame.unionByName, found).distinct()


def clean_texts(sanitized: DataFrame) -> DataFrame:
    """Rows whose text came back unchanged and without tokens."""
    return sanitized.where((F.size("tokens") == 0) & F.col("text").eqNullSafe(F.col("sanitized")))
