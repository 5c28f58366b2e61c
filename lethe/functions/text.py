"""Scalar rules on values and text: normalising, masks, tokens, escapes, windows, names, lines."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import ESCAPE, LEFT_PUNCTUATION, LOOK_BACK, OVERLAP, RIGHT_PUNCTUATION, TOKEN_SHAPE, WINDOW

_LINE_ENDS = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


def normalize_value(value: Column) -> Column:
    """trimmed, case folded, white space collapsed."""
    return F.replace(F.lower(F.trim(F.regexp_replace(value, r"(?U)\s+", " "))), F.lit("ß"), F.lit("ss"))


def mask_catalog(value: Column) -> Column:
    """an e-mail keeps its first letter and domain, others two characters and three to eight stars."""
    n = F.char_length(value)
    at = F.instr(value, "@")
    email = F.concat(F.substring(value, 1, 1), F.lit("***@"), F.substring(value, at + 1, n))
    stars = F.concat(F.substring(value, 1, 2), F.repeat(F.lit("*"), F.least(F.lit(8), F.greatest(F.lit(3), n - 2))))
    return F.when(value.rlike(r"(?i)^[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}$"), email).when(n <= 2, F.repeat(F.lit("*"), n)).otherwise(stars)


def mask_status(value: Column) -> Column:
    """first character and stars."""
    return F.concat(F.substring(value, 1, 1), F.repeat(F.lit("*"), F.greatest(F.lit(0), F.char_length(value) - 1)))


def mask_preview(value: Column) -> Column:
    """first character, three stars and the length."""
    return F.concat(F.substring(value, 1, 1), F.lit("*** ("), F.char_length(value).cast("string"), F.lit(")"))


def sanitize_error(text: Column) -> Column:
    """e-mails, assignments of secrets and phone numbers out, 500 characters."""
    out = F.regexp_replace(text, r"(?i)[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}", "[EMAIL]")
    out = F.regexp_replace(out, r"(?i)(password|secret|token|api[_-]?key)\s*[:=]\s*\S+", "$1=[REDACTED]")
    return F.left(F.regexp_replace(out, r"(?U)\+?[\d\s().-]{7,}", "[PHONE]"), F.lit(500))


def normalize_label(label: Column) -> Column:
    """upper case, others than letters to underscores."""
    return F.regexp_replace(F.upper(label), "[^A-Z_]+", "_")


def token_label(token: Column) -> Column:
    """label of a token, catalog tokens included."""
    plain = F.regexp_extract(token, r"^\[([A-Z_]+)_\d+_[0-9a-f]{6,}\]$", 1)
    return F.when(plain != "", plain).otherwise(F.regexp_extract(token, r"^\[(CATALOG_[A-Z0-9_]+)_[0-9a-f]{6,}\]$", 1))


def token_ordinal(token: Column) -> Column:
    """number of a token, null for catalog tokens."""
    return F.when(token.rlike(r"^\[[A-Z_]+_\d+_[0-9a-f]{6,}\]$"), F.regexp_extract(token, r"_(\d+)_[0-9a-f]{6,}\]$", 1).cast("long"))


def token_hex(label: Column, value: Column, salt: str, digits: int = 6) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.lit(salt), label, value), 256), 1, digits)


def catalog_token(category: Column, value: Column, salt: str) -> Column:
    """[CATALOG_<LABEL>_<hex10>], the same for the same value."""
    label = F.regexp_replace(F.regexp_replace(F.upper(category), "[^A-Z0-9_]", "_"), "^_+|_+$", "")
    return F.concat(F.lit("[CATALOG_"), F.when(label == "", "SENSITIVE").otherwise(label), F.lit("_"), token_hex(category, value, salt, 10), F.lit("]"))


def tokens_in(text: Column) -> Column:
    """Tokens in order of place."""
    return F.regexp_extract_all(text, F.lit(TOKEN_SHAPE), F.lit(0))


def replaced_outside_tokens(text: Column, value: Column, token: Column, whole_word: bool = False) -> Column:
    """F8: each place of a value that isn't inside a token replaced; whole_word: only where no word character stands next to it."""
    if whole_word:
        quoted = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)"))
        new = F.regexp_replace(token, r"([\\$])", r"\\$1")
        of = lambda part: F.regexp_replace(part, quoted, new)
    else:
        of = lambda part: F.replace(part, value, token)
    between = F.transform(F.split(text, TOKEN_SHAPE, -1), of)
    parts = F.transform(tokens_in(text), lambda t, i: F.concat(t, F.get(between, i + 1)))
    return F.when(F.contains(text, value) & (value != ""), F.concat(F.get(between, F.lit(0)), F.array_join(parts, ""))).otherwise(text)


def _bare(word: Column) -> Column:
    left = "^[" + "".join("\\" + c for c in LEFT_PUNCTUATION) + "]+"
    right = "[" + "".join("\\" + c for c in RIGHT_PUNCTUATION) + "]+$"
    return F.lower(F.regexp_replace(F.regexp_replace(word, left, ""), right, ""))


def escapes(text: Column) -> Column:
    """values marked by ~ and the phrases that end in them, look-back of LOOK_BACK words."""
    marked = F.transform(F.regexp_extract_all(text, F.lit(ESCAPE), F.lit(1)), _bare)
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    bare = F.transform(words, lambda w: _bare(F.replace(w, F.lit("~"), F.lit(""))))

    def phrases(i: Column) -> Column:
        # Only as far back as all words are non-empty.
        def back(j: Column) -> Column:
            part = F.slice(bare, i + 1 - j, j + 1)
            whole = F.array_join(part, " ")
            return F.when(F.forall(part, lambda w: w != ""), F.array(F.element_at(part, 1), whole)).otherwise(F.array().cast("array<string>"))

        most = F.least(F.lit(LOOK_BACK), i)
        return F.when((most > 0) & F.contains(F.element_at(words, i + 1), F.lit("~")), F.flatten(F.transform(F.sequence(F.lit(1), most), back))).otherwise(F.array().cast("array<string>"))

    every = F.when(F.size(words) > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.size(words) - 1), phrases))).otherwise(F.array().cast("array<string>"))
    found = F.array_distinct(F.filter(F.concat(marked, every), lambda w: w != ""))
    return F.when(F.contains(text, F.lit("~")), F.array_sort(found)).otherwise(F.array().cast("array<string>"))


def without_escape_marks(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("~")), F.regexp_replace(text, ESCAPE, "$1$2")).otherwise(text)


def windows(text: Column, size: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """array<struct<start,text>>; one window if the text fits, else every size-overlap characters until the end is covered."""
    n = F.char_length(text)
    step = size - overlap
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / F.lit(step)).cast("int"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.struct((k * step).alias("start"), F.substring(text, k * step + 1, F.lit(size)).alias("text")))).otherwise(F.array().cast("array<struct<start:int,text:string>>"))


def balanced_name(value: Column) -> Column:
    """F16: the last word of a name of several words, if it has two characters; else null."""
    words = F.split(F.trim(value), r"(?U)\s+")
    last = F.element_at(words, -1)
    return F.when((F.size(words) > 1) & (F.char_length(last) >= 2), last)


def first_name_parts(value: Column) -> Column:
    """struct<first,hidden>, split at the first white space; hidden is empty for one word."""
    parts = F.split(F.trim(value), r"(?U)\s+", 2)
    several = F.size(parts) == 2
    return F.struct(F.when(several, parts[0]).otherwise(value).alias("first"), F.when(several, parts[1]).otherwise("").alias("hidden"))


def canonical_json(value: object) -> str:
    """JSON with sorted keys and no spaces, so equal settings give equal text."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def config_signature(config: dict) -> str:
    """hash of the settings that a result depends on."""
    return hashlib.sha256(canonical_json(config).encode()).hexdigest()


def row_key(key: Column, text: Column) -> Column:
    """What tells the rows of a table of texts apart, also where an id stands on several rows: equal rows have equal keys."""
    return F.concat_ws(":", key.cast("string"), F.hex(F.xxhash64(text)))


def text_identity(text: Column) -> Column:
    """hash of a text's content."""
    return F.sha2(text, 256)


def lines(text: Column) -> Column:
    """Lines as by Python's splitlines: all line ends, no empty last line."""
    parts = F.split(text, _LINE_ENDS, -1)
    return F.when(text == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
