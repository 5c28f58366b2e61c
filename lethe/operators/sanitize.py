"""The composed pipelines on text: tokenize, sanitize against known values, restore, retokenize, audit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans
from ..functions.spans import STAGE_BLACKLIST, STAGE_CUSTOM, STAGE_ENTITY, STAGE_SECRET, STAGE_VERIFIER, no_spans, resolve, secret_spans, with_values
from ..functions.storage import materialized
from ..functions.sweep import merged_maps
from ..functions.text import balanced_name, escapes, normalize_label, row_key, tokens_in, without_escape_marks
from . import catalog, detect, dictionary
from .tokens import SALT, durable, grant_allowance, mint, replaced

_SPAN = ["start", "end", "label", "value", "stage"]


def candidates(docs: DataFrame, mode: str = "balanced", names: list[str] | DataFrame | None = None, entities: DataFrame | None = None, blacklist: DataFrame | None = None, custom: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """Spans (id, start, end, label, value, stage) of all stages: entities, blacklist, secrets, custom phrases.

    entities: (id, start, end, label), from a model or the rule detector; allow-list, modes and escapes hold
    for entities only.  names: the allow-list, as configuration or, at any size, as a table (name).
    """
    if "_secrets" in docs.columns:  # found already
        found = docs.select(id_col, F.explode("_secrets").alias("s")).select(id_col, "s.start", "s.end", "s.label", "s.value", "s.stage")
    else:
        found = detect.secret_matches(docs, id_col).withColumn("stage", F.lit(STAGE_SECRET))
    if entities is not None:
        marked = docs.select(id_col, "text", *(["escaped"] if "escaped" in docs.columns else []))
        own = entities.join(marked, id_col).withColumn("value", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))).withColumn("label", F.regexp_replace(F.upper("label"), " ", "_"))
        escaped = F.col("escaped") if "escaped" in docs.columns else None
        own = own.where(detect.plausible(F.col("label"), F.col("value")) & detect.in_mode(F.col("label"), F.col("value"), mode))
        own = own.where(~detect.allowed(F.col("value"), names if isinstance(names, list) else [], escaped))
        if isinstance(names, DataFrame):
            own = own.withColumn("_v", F.lower("value"))
            own = own.join(detect.allowed_values(own, names).withColumnRenamed("value", "_v"), "_v", "left_anti").drop("_v")
        if mode == "balanced":  # only the last word of a name is hidden
            last = balanced_name(F.col("value"))
            own = own.where((F.col("label") != "PERSON") | last.isNotNull()).withColumn("_last", F.when(F.col("label") == "PERSON", last))
            own = own.withColumn("end", F.when(F.col("_last").isNull(), F.col("end")).otherwise(F.col("start") + F.char_length(F.rtrim("value"))))
            own = own.withColumn("start", F.when(F.col("_last").isNull(), F.col("start")).otherwise(F.col("end") - F.char_length("_last"))).withColumn("value", F.coalesce("_last", "value"))
        found = found.unionByName(own.select(id_col, "start", "end", "label", "value", F.lit(STAGE_ENTITY).alias("stage")))
    if blacklist is not None:
        hits = dictionary.blacklist_hits(docs, blacklist, id_col)
        found = found.unionByName(hits.select(id_col, "start", "end", F.concat(F.lit("BLACKLIST_"), detect.term_kind(F.col("term"))).alias("label"), "value", F.lit(STAGE_BLACKLIST).alias("stage")))
    if custom is not None:
        found = found.unionByName(dictionary.custom_values(docs, custom, id_col).select(id_col, "start", "end", "label", "value", F.lit(STAGE_CUSTOM).alias("stage")))
    return found


def own_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with `_row`, by which the spans of rows that share an id stay apart."""
    return docs.withColumn("_row", row_key(F.col(id_col), F.col("text")))


def chosen(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of each text's candidate spans those that stay, earlier stages first; with the text they cover as value."""
    per_doc = found.groupBy(id_col).agg(F.collect_set(F.struct("start", "end", "label", "stage")).alias("_s"))
    kept = docs.select(id_col, "text").join(per_doc, id_col).withColumn("_s", resolve(F.col("_s")))
    return kept.select(id_col, F.explode(with_values(F.col("text"), F.col("_s"))).alias("s")).select(id_col, "s.start", "s.end", "s.label", "s.value")


def tokenize(docs: DataFrame, known: DataFrame | None = None, salt: str = SALT, id_col: str = "doc_id", verifiers: list[Callable[[DataFrame], DataFrame]] | None = None, **stages) -> tuple[DataFrame, DataFrame]:
    """(documents with sanitized text and their tokens, token table).  Marks of escapes are taken out of the text.

    verifiers: second passes over the sanitized text, each from (id, text) to spans (id, start, end, label).
    """
    own = docs.withColumn("escaped", escapes(F.col("text"))).withColumn("text", without_escape_marks(F.col("text")))
    text = F.col("text")
    own = own_rows(own, id_col).withColumn("_secrets", F.transform(secret_spans(text, outside_tokens=True), lambda s: s.withField("stage", F.lit(STAGE_SECRET))))
    own = materialized(own.withColumn("_secrets", resolve(F.col("_secrets"))), "texts")
    others = {k: v for k, v in stages.items() if v is not None}
    several = bool({"entities", "blacklist", "custom"} & set(others))
    if several:
        if "entities" in others:
            others["entities"] = others["entities"].join(own.select(id_col, "_row").distinct(), id_col)
        found = chosen(own, candidates(own, id_col="_row", **others), "_row")
    else:
        found = own.select("_row", F.explode("_secrets").alias("s")).select("_row", "s.start", "s.end", "s.label", "s.value")
    found = materialized(found.distinct(), "spans")
    table = mint(found, known, salt, every=True)
    busy = own if several else own.where(F.size("_secrets") > 0)
    out = replaced(busy, found, table, "_row")
    if not several:  # most texts have nothing to replace and take no part in the join
        idle = own.where(F.size("_secrets") == 0)
        out = out.unionByName(idle.withColumn("tokens", F.create_map().cast("map<string,string>")))
    out = out.drop("_row", "_secrets")
    if verifiers:
        out, table = verified(out, verifiers, table, stages.get("names", []), salt, id_col)
    return out.withColumnRenamed("text", "sanitized").drop("escaped"), table


def verified(docs: DataFrame, verifiers: list[Callable[[DataFrame], DataFrame]], known: DataFrame, names: list[str] | DataFrame | None, salt: str = SALT, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """T1's last stage, U2, P16: what verifiers still find in sanitized texts becomes VERIFIED_<label> tokens."""
    docs = own_rows(docs, id_col)
    texts = docs.select(F.col("_row").alias(id_col), "text")
    found = detect.all_spans(texts, verifiers, id_col)
    if isinstance(names, DataFrame):
        own = texts.join(found.groupBy(id_col).agg(F.collect_set(F.struct("start", "end", "label", F.lit(STAGE_VERIFIER).alias("stage"))).alias("_s")), id_col)
        valued = materialized(own.select(id_col, F.explode(with_values(F.col("text"), F.col("_s"))).alias("s")).select(id_col, "s.start", "s.end", "s.label", F.lower("s.value").alias("value")).distinct(), "spans")
        found, names = valued.join(detect.allowed_values(valued, names), "value", "left_anti").drop("value"), []
    spans_of = found.groupBy(id_col).agg(F.collect_set(F.struct("start", "end", "label", F.lit(STAGE_VERIFIER).alias("stage"))).alias("_s"))
    own = texts.join(spans_of, id_col)
    kept = own.select(id_col, F.explode(detect.verifier_spans(F.col("_s"), no_spans(), F.col("text"), names or [])).alias("s"))
    label = F.concat(F.lit("VERIFIED_"), normalize_label(F.coalesce(F.nullif("s.label", F.lit("")), F.lit("SENSITIVE"))))
    found = materialized(kept.select(id_col, "s.start", "s.end", label.alias("label"), "s.value").distinct(), "spans")
    table = mint(found, known, salt, every=True)
    out = replaced(docs.withColumnRenamed("tokens", "_first"), found.withColumnRenamed(id_col, "_row"), table, "_row").drop("_row")
    return _merged(out, "_first"), table


def _merged(docs: DataFrame, *maps: str) -> DataFrame:
    """docs whose map `tokens` also holds the entries of other maps, which are dropped."""
    for m in maps:
        both = (F.size(m) > 0) & (F.size("tokens") > 0)
        merged = merged_maps(F.when(both, F.col(m)), F.when(both, F.col("tokens")))
        docs = docs.withColumn("tokens", F.when(both, merged).when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.coalesce(m, F.create_map().cast("map<string,string>"))))
    return docs.drop(*maps)


def retokenize_known(docs: DataFrame, known: DataFrame, excluded: DataFrame | None = None, id_col: str = "doc_id", skip_col: str | None = None, guard_col: str | None = None) -> DataFrame:
    """T5: values that are known (token, value, label) replaced by their tokens; `inserted`: the tokens put in.

    guard_col: spans of a text of which no value takes a part only.
    """
    first = known.groupBy("value").agg(F.min(F.struct("token", "label")).alias("k")).select("value", "k.token", "k.label")
    own = own_rows(docs, id_col)
    found = dictionary.known_values(own, first.select("value"), excluded, id_col="_row", skip_col=skip_col, guard_col=guard_col).join(first.select("value", "label"), "value")
    out = replaced(own, found, first, "_row").drop("_row")
    return out.withColumn("inserted", F.map_keys("tokens"))


def escape_grants(docs: DataFrame, now: Column, minutes: int) -> DataFrame:
    """The allowances that texts' ~ marks grant from now on."""
    values = docs.select(F.explode(escapes(F.col("text"))).alias("value")).distinct()
    return grant_allowance(values, now, minutes)


def sanitize(docs: DataFrame, known: DataFrame, excluded: DataFrame | None = None, salt: str = SALT, id_col: str = "doc_id", entries: DataFrame | None = None, grants: DataFrame | None = None, now: Column | None = None, policy: dict | None = None, **stages) -> tuple[DataFrame, DataFrame]:
    """Catalog entries, then known values, then detection; gives (documents, next snapshot of known values).

    A known value that is a part of a secret waits for detection, which takes the whole secret; else the secret would not
    be known to later texts.  What a text marks by ~ is left out of the known values' step in that text, and of detection as tokenize does.
    excluded: values that no text replaces (allowed names, active allowances).  entries: active catalog entries,
    enforced under `policy` (the options of catalog.decisions) and the grants that hold now.
    """
    pre = docs.withColumn("_marked", escapes(F.col("text")))
    if entries is not None:
        decided = materialized(catalog.decisions(pre, entries, grants, now, id_col=id_col, **(policy or {})), "decided")
        pre = catalog.enforce(pre, decided, id_col).withColumnRenamed("sanitized", "text").withColumnRenamed("tokens", "_catalog")
    pre = pre.withColumn("_secrets", secret_spans(F.col("text"), outside_tokens=True))
    pre = retokenize_known(pre, known, excluded, id_col, "_marked", "_secrets").drop("inserted", "_marked", "_secrets").withColumnRenamed("tokens", "_pre")
    out, table = tokenize(pre, known, salt, id_col, **stages)
    return _merged(out, *(["_catalog"] if entries is not None else []), "_pre"), table.where(durable(F.col("value")))


def distinct_texts(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """T4: (one row per distinct text by hash, id -> hash), so that a detector runs once per text."""
    hashed = docs.withColumn("text_hash", F.sha2("text", 256))
    return hashed.groupBy("text_hash").agg(F.any_value("text").alias("text")), hashed.select(id_col, "text_hash")


def reused(docs: DataFrame, results: DataFrame, config_hash: str, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """T4, incremental: (documents whose result is there already, distinct texts still to do).  Degraded results are never reused."""
    hashed = docs.withColumn("text_hash", F.sha2("text", 256))
    good = results.where((F.col("config_hash") == config_hash) & ~F.col("degraded"))
    todo = hashed.join(good, "text_hash", "left_anti").groupBy("text_hash").agg(F.any_value("text").alias("text"))
    return hashed.join(good.drop("config_hash", "degraded"), "text_hash"), todo


def residual_tokens(docs: DataFrame, known: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, content_hash, live, unknown, raw_values): tokens left in stored text and known raw values in it."""
    docs = own_rows(docs, id_col)
    uses = docs.select("_row", F.explode_outer(F.array_distinct(tokens_in(F.col("text")))).alias("token")).distinct()
    live = uses.join(known.select("token").distinct().withColumn("_known", F.lit(1)), "token", "left").groupBy("_row").agg(F.count("_known").alias("live"), F.count_if(F.col("token").isNotNull() & F.col("_known").isNull()).alias("unknown"))
    raw = dictionary.occurrences(docs, known.select("value"), "_row").groupBy("_row").agg(F.count_distinct("value").alias("raw_values"))
    return docs.select(id_col, "_row", F.sha2("text", 256).alias("content_hash")).join(live, "_row").join(raw, "_row", "left").drop("_row").withColumn("raw_values", F.coalesce("raw_values", F.lit(0)))


def span_patches(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, patch) from rows (id, before, after, tokens): where in the text before each token of the text after belongs.

    patch is an array of (start, end, token, value); null where the map doesn't lead from one text to the other.
    """
    found = spans.token_spans(F.col("after"))
    zero = F.struct(F.lit(0).alias("shift"), F.array().cast("array<struct<start:int,end:int,token:string,value:string>>").alias("out"))

    def step(acc, s):
        token = F.substring("after", s["start"] + 1, s["end"] - s["start"])
        value = F.try_element_at(F.col("tokens"), token)
        size = F.char_length(value)
        start = s["start"] - acc["shift"]
        span = F.struct(start.alias("start"), (start + size).alias("end"), token.alias("token"), value.alias("value"))
        moved = F.struct((acc["shift"] + s["end"] - s["start"] - size).alias("shift"), F.concat(acc["out"], F.array(span)).alias("out"))
        return F.when(value.isNull(), acc).otherwise(moved)

    patch = F.aggregate(found, zero, step, lambda a: a["out"])
    own = rows.withColumn("patch", patch)
    same = spans.apply_spans(F.col("before"), F.col("patch")) == F.col("after")
    right = F.forall("patch", lambda x: F.substring("before", x["start"] + 1, x["end"] - x["start"]) == x["value"])
    return own.select(id_col, F.when(same & right, F.col("patch")).alias("patch"))


def mapped_labels(entities: DataFrame, labels: dict[str, str]) -> DataFrame:
    """a verifier's labels in the engine's names; spans of other labels are left out."""
    table = F.create_map(*[F.lit(x) for k, v in labels.items() for x in (k.lower(), v)])
    return entities.withColumn("label", F.try_element_at(table, F.lower("label"))).where("label is not null")


def request_metrics(sanitized: DataFrame) -> DataFrame:
    """Of a batch: texts, characters, texts with tokens and tokens."""
    return sanitized.agg(F.count("*").alias("texts"), F.sum(F.char_length("sanitized")).alias("chars"), F.count_if(F.size("tokens") > 0).alias("pii_found"), F.sum(F.greatest(F.size("tokens"), F.lit(0))).alias("token_count"))

