"""The catalog of sensitive values: scan, classify, accept, refresh, review, enforce, forget.

Tables are snapshots; each operator is a function of old snapshots and changes to new ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.spans import apply_spans
from ..functions.storage import Snapshots, drop_scratch
from ..functions.value_store import ValueStore
from ..functions.text import catalog_token, first_name_parts, mask_catalog, normalize_value, row_key
from . import dictionary

SALT = "lethe"
REFERENCE_KEY = ["entry_id", "source", "dataset", "column", "row_ref"]


def melt(records: DataFrame, dataset: str, key: str | None, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(dataset, column, row_ref, value) of each cell; rows without a key column are named by their hash.

    columns: all, sorted, by default; an unknown one is an error.  `limit` is the scan scope's row limit.
    """
    unknown = set(columns or []) - set(records.columns)
    if unknown:
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    own = sorted(columns or records.columns)
    ref = F.col(key).cast("string") if key else F.sha2(F.to_json(F.struct(*sorted(records.columns))), 256)
    rows = records.limit(limit) if limit else records
    cells = rows.select(F.concat(F.lit(f"{dataset}:"), ref).alias("row_ref"), *[F.col(c).cast("string").alias(c) for c in own])
    names = {"first_name", "last_name"} <= set(own)
    if names:  # F32
        cells, own = cells.withColumn("first_name+last_name", F.concat_ws(" ", "first_name", "last_name")), [*own, "first_name+last_name"]
    return cells.unpivot(["row_ref"], own, "column", "value").select(F.lit(dataset).alias("dataset"), "column", "row_ref", "value")


def field_category(column: Column, hint: Column | None = None) -> Column:
    """P7's rules on field names; a connector's hint comes first."""
    c = F.lower(column)
    by_name = (
        F.when(F.contains(c, F.lit("email")), "EMAIL_ADDRESS")
        .when(F.contains(c, F.lit("phone")) | F.contains(c, F.lit("mobile")), "PHONE_NUMBER")
        .when(c.isin("name", "first_name", "last_name", "full_name") | F.endswith(c, F.lit("_name")), "PERSON")
        .when(F.contains(c, F.lit("address")) | F.contains(c, F.lit("street")), "ADDRESS")
        .when(F.contains(c, F.lit("account")) | F.endswith(c, F.lit("_id")), "IDENTIFIER")
    )
    if hint is None:
        return by_name
    roles = F.create_map(*[F.lit(x) for kv in fixed.ROLE_CATEGORIES.items() for x in kv])
    return F.coalesce(F.try_element_at(roles, F.lower(F.trim(hint))), by_name)


def classify(cells: DataFrame, hint: Column | None = None) -> DataFrame:
    """Adds category, confidence, reason; blank cells and cells of no category get a null category."""
    v = F.trim("value")
    email, phone = v.rlike(fixed.EMAIL_CELL), v.rlike(fixed.PHONE_CELL) & (F.char_length(F.regexp_replace(v, r"\D", "")) >= 7)
    by_field = field_category(F.col("column"), hint)
    filled = F.coalesce(v, F.lit("")) != ""
    category = F.when(filled, F.when(email, "EMAIL_ADDRESS").when(phone, "PHONE_NUMBER").otherwise(by_field))
    reason = F.when(category.isNotNull(), F.when(email, "email pattern").when(phone, "phone pattern").otherwise("field name"))
    return cells.withColumn("category", category).withColumn("confidence", F.when(category.isNotNull(), "deterministic").otherwise("low")).withColumn("reason", F.coalesce(reason, F.lit("")))


def findings(cells: DataFrame, source: str, hint: Column | None = None) -> DataFrame:
    """Classified cells as findings; deterministic and high confidence are accepted, others candidates."""
    own = classify(cells, hint).where("category is not null")
    status = F.when(F.col("confidence").isin("deterministic", "high"), "accepted").otherwise("candidate")
    return own.select(F.lit(source).alias("source"), "dataset", "column", "row_ref", "value", normalize_value(F.col("value")).alias("normalized_value"), "category", "confidence", "reason", status.alias("status"))


def model_findings(unclassified: DataFrame, entities: DataFrame, source: str) -> DataFrame:
    """Cells of up to 500 characters that no rule classified, with a model's label (row_ref, column, label): candidates."""
    own = unclassified.where("category is null").where(F.char_length("value") <= 500).drop("category", "confidence", "reason")
    return own.join(entities, ["row_ref", "column"]).select(F.lit(source).alias("source"), "dataset", "column", "row_ref", "value", normalize_value(F.col("value")).alias("normalized_value"), F.col("label").alias("category"), F.lit("medium").alias("confidence"), F.lit("model").alias("reason"), F.lit("candidate").alias("status"))


def scan_counters(found: DataFrame, by: str = "source") -> DataFrame:
    """A1: totals of a scan by status."""
    status = F.col("status")
    return found.groupBy(by).agg(F.count("*").alias("total"), F.count_if(status == "accepted").alias("accepted"), F.count_if(status == "candidate").alias("uncertain"), F.count_if(status == "rejected").alias("rejected"))


def _entry_id(category: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws("|", category, value), 256)


def upsert_entries(entries: DataFrame | None, found: DataFrame, now: Column, salt: str = SALT) -> DataFrame:
    """Accepted findings into entries by (category, normalized value): seen again, reactivated or new."""
    own = found.where("status = 'accepted'").groupBy("category", "normalized_value").agg(F.min("value").alias("value"))
    fresh = own.select(_entry_id(F.col("category"), F.col("normalized_value")).alias("entry_id"), "category", "normalized_value", "value", catalog_token(F.col("category"), F.col("normalized_value"), salt).alias("token"), F.lit("active").alias("status"), now.alias("created_at"), now.alias("last_seen_at"))
    if entries is None:
        return fresh
    old, new = entries.alias("o"), fresh.alias("n")
    live = entries.where("status <> 'removed'").alias("o")
    both = live.join(new, F.col("o.entry_id") == F.col("n.entry_id"), "full_outer")
    seen = F.col("n.entry_id").isNotNull()
    cols = [F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in ("entry_id", "category", "normalized_value", "value", "token")]
    merged = both.select(*cols, F.when(seen, "active").otherwise(F.col("o.status")).alias("status"), F.coalesce("o.created_at", "n.created_at").alias("created_at"), F.when(seen, now).otherwise(F.col("o.last_seen_at")).alias("last_seen_at"))
    return merged.unionByName(old.where("status = 'removed'"))


def upsert_references(references: DataFrame | None, found: DataFrame, run: str, now: Column) -> DataFrame:
    """One reference for each entry and cell, with the last run that saw it."""
    fresh = found.where("status = 'accepted'").select(_entry_id(F.col("category"), F.col("normalized_value")).alias("entry_id"), "source", "dataset", "column", "row_ref", F.lit(run).alias("run"), now.alias("seen_at"))
    both = fresh if references is None else references.unionByName(fresh)
    return both.groupBy(*REFERENCE_KEY).agg(F.max(F.struct("seen_at", "run")).alias("last")).select(*REFERENCE_KEY, "last.run", "last.seen_at")


def source_counts(entries: DataFrame, references: DataFrame) -> DataFrame:
    """Entries with the number of their references."""
    n = references.groupBy("entry_id").agg(F.count("*").alias("source_count"))
    return entries.join(n, "entry_id", "left").withColumn("source_count", F.coalesce("source_count", F.lit(0)))


def mark_stale(entries: DataFrame, references: DataFrame, source: str, run: str) -> DataFrame:
    """Active entries that the source referenced and this run didn't see become stale, even if another source has them."""
    own = references.where(F.col("source") == source)
    seen = own.where(F.col("run") == run).select("entry_id").distinct()
    gone = own.select("entry_id").distinct().join(seen, "entry_id", "left_anti").withColumn("_gone", F.lit(True))
    stale = F.col("_gone").isNotNull() & (F.col("status") == "active")
    return entries.join(gone, "entry_id", "left").withColumn("status", F.when(stale, "stale").otherwise(F.col("status"))).drop("_gone")


def refresh(entries: DataFrame | None, references: DataFrame | None, found: DataFrame, source: str, run: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """Scan results into entries and references, then stale ones marked."""
    refs = upsert_references(references, found, run, now)
    return mark_stale(upsert_entries(entries, found, now), refs, source, run), refs


def allowed_entries(entries: DataFrame, references: DataFrame, sources: list[str], connectors: list[str] | None = None) -> DataFrame:
    """Active entries that a reference of the named sources and datasets holds, both on one reference."""
    own = references
    if sources:
        own = own.where(F.col("source").isin(sources))
    if connectors:
        own = own.where(F.col("dataset").isin(connectors))
    active = entries.where("status = 'active'")
    return active if not sources and not connectors else active.join(own, "entry_id", "left_semi")


def near_strong_identifier(text: Column, start: Column, end: Column, around: int = 80) -> Column:
    """P10: an e-mail, phone number or keyword within 80 characters on either side."""
    lo = F.greatest(F.lit(0), start - around)
    nearby = F.concat(F.substring(text, lo + 1, start - lo), F.lit(" "), F.substring(text, end + 1, F.lit(around)))
    return nearby.rlike(fixed.STRONG_IDENTIFIER)


def decisions(docs: DataFrame, entries: DataFrame, grants: DataFrame | None, now: Column | None, name_mode: str = "balanced", allow_first_name: bool = True, strict_near: bool = True, enabled: bool = True, id_col: str = "doc_id") -> DataFrame:
    """(id, start, end, entry_id, category, token, decision, replacement, restore, row_key) of each entry in each distinct (id, text)."""
    rows = docs.select(row_key(F.col(id_col), F.col("text")).alias("row_key"), id_col, "text")
    found = dictionary.matches(rows, entries.select("value"), "row_key").distinct().join(entries.select("value", "entry_id", "category", "token"), "value").join(rows, "row_key")
    if grants is None:
        found = found.withColumn("_granted", F.lit(False))
    else:
        live = grants.where((F.col("expires_at") > now) & (F.col("status") == "active")).select("entry_id").distinct().withColumn("_g", F.lit(True))
        found = found.join(live, "entry_id", "left").withColumn("_granted", F.col("_g").isNotNull()).drop("_g")
    name = F.col("category") == "PERSON"
    near = F.lit(strict_near) & near_strong_identifier(F.col("text"), F.col("start"), F.col("end"))
    first = F.lit(name_mode == "balanced" and allow_first_name)
    decision = F.when(F.lit(not enabled), "tokenized").when(F.col("_granted"), "temporarily_revealed").when(~name, "tokenized").when(near, "strict_override").when(F.lit(name_mode == "relaxed"), "visible").when(first, "first_name_visible").otherwise("tokenized")
    parts = first_name_parts(F.col("value"))
    shown = F.when(parts["hidden"] != "", F.concat(parts["first"], F.lit(" "), F.col("token"))).otherwise(F.col("value"))
    out = found.withColumn("decision", decision).withColumn("replacement", F.when(F.col("decision").isin("tokenized", "strict_override"), F.col("token")).when(F.col("decision") == "first_name_visible", shown).otherwise(F.col("value")))
    restore = F.when(F.col("decision").isin("tokenized", "strict_override"), F.col("value")).when(F.col("decision") == "first_name_visible", F.nullif(parts["hidden"], F.lit("")))
    return out.withColumn("restore", restore).select(id_col, "start", "end", "entry_id", "category", "token", "decision", "replacement", "restore", "row_key").distinct()


def enforce(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents with the decisions applied and their token map; of one token's restore values the longest."""
    spans = decided.groupBy("row_key").agg(F.array_sort(F.collect_set(F.struct("start", "end", F.col("replacement").alias("token")))).alias("_spans"))
    pairs = decided.where("restore is not null").groupBy("row_key", "token").agg(F.max_by("restore", F.struct(F.char_length("restore"), F.col("restore"))).alias("value"))
    maps = pairs.groupBy("row_key").agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("tokens"))
    out = docs.withColumn("row_key", row_key(F.col(id_col), F.col("text"))).join(spans, "row_key", "left").join(maps, "row_key", "left")
    empty = F.array().cast("array<struct<start:int,end:int,token:string>>")
    return out.withColumn("sanitized", apply_spans(F.col("text"), F.coalesce("_spans", empty))).drop("_spans", "text", "row_key")


def enforcement_audit(decided: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of each text: matches, entries, categories, decisions and tokens."""
    return decided.groupBy(id_col).agg(F.count("*").alias("matches"), *[F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in ("entry_id", "category", "decision", "token")])


def review(found: DataFrame, decided: DataFrame, reviewer: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """Findings with decisions (finding key columns, decision accept or reject) applied, and the decision rows."""
    key = ["source", "dataset", "column", "row_ref"]
    joined = found.join(decided.select(*key, "decision"), key, "left")
    status = F.when(F.col("decision") == "accept", "accepted").when(F.col("decision") == "reject", "rejected").otherwise(F.col("status"))
    log = joined.where("decision is not null").select(*key, "decision", F.col("status").alias("old_status"), status.alias("new_status"), F.lit(reviewer).alias("reviewer"), now.alias("decided_at"))
    return joined.withColumn("status", status).drop("decision"), log


def review_audit(log: DataFrame) -> DataFrame:
    """Audit rows (event_type, summary, metadata, ts) of review decisions; values stay out of them."""
    summary = F.when(F.col("decision") == "accept", "Accepted catalog finding").otherwise("Rejected catalog finding")
    metadata = F.to_json(F.struct("source", "dataset", "column", "row_ref", "reviewer"))
    return log.select(F.lit("catalog_review").alias("event_type"), summary.alias("summary"), metadata.alias("metadata"), F.col("decided_at").alias("ts"))


def reveal_audit(found: DataFrame, viewer: str, now: Column) -> DataFrame:
    """The audit row of a report whose values were revealed: how many findings, of how many sources."""
    n = found.agg(F.count("*").alias("findings"), F.count_distinct("source").alias("sources"))
    return n.select(F.lit("catalog_reveal").alias("event_type"), F.lit("Revealed catalog findings").alias("summary"), F.to_json(F.struct("findings", "sources", F.lit(viewer).alias("viewer"))).alias("metadata"), now.alias("ts"))


def report(found: DataFrame, reveal: bool = False, status: str | None = None, source: str | None = None, category: str | None = None) -> DataFrame:
    """Findings of a status, source and category; values masked unless revealed."""
    for name, want in (("status", status), ("source", source), ("category", category)):
        found = found.where(F.col(name) == want) if want else found
    return found if reveal else found.withColumn("value", mask_catalog(F.col("value"))).drop("normalized_value")


def expire_grants(grants: DataFrame, now: Column) -> DataFrame:
    """Active grants whose time is over."""
    over = (F.col("status") == "active") & (F.col("expires_at") <= now)
    return grants.withColumn("status", F.when(over, "expired").otherwise(F.col("status")))


def forget(entries: DataFrame, references: DataFrame, found: DataFrame, audit: DataFrame, value: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A value out of the catalog: entries and findings removed and emptied, references and audit rows (detail) deleted."""
    norm = normalize_value(F.lit(value))
    hit = F.col("normalized_value") == norm
    gone = entries.where(hit).select("entry_id")

    def emptied(df: DataFrame) -> DataFrame:
        out = df.withColumn("_hit", F.coalesce(hit, F.lit(False)))
        for c in ("value", "normalized_value"):
            out = out.withColumn(c, F.when(~F.col("_hit"), F.col(c)))
        return out.withColumn("status", F.when(F.col("_hit"), "removed").otherwise(F.col("status"))).drop("_hit")

    kept = audit.where(~F.coalesce(F.contains(F.lower("detail"), F.lower(F.lit(value))), F.lit(False)))
    return emptied(entries), references.join(gone, "entry_id", "left_anti"), emptied(found), kept


def erase_everywhere(value: str, values: ValueStore | None = None, tables: dict[str, tuple[Snapshots, Column]] | None = None) -> dict[str, int]:
    """A value out of every stored version: of the known values, and of tables by the rows that hold it.

    tables: name -> (snapshots, which rows hold the value).  Scratch tables of this application go too.  Gives how many
    versions of each table were rewritten, and how many parts of known values wait for readers.
    """
    done = {name: store.erase(hit) for name, (store, hit) in (tables or {}).items()}
    if values is not None:
        done["waiting_parts"] = values.erase(value)
        drop_scratch(values.spark)
    for store, _ in (tables or {}).values():
        drop_scratch(store.spark)
    return done


def forget_everywhere(value: str, entries: DataFrame, references: DataFrame, found: DataFrame, audit: DataFrame, known: DataFrame, allowances: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables without the value, and one row with what was taken out of each."""
    from .tokens import erase

    e, r, f, a = forget(entries, references, found, audit, value)
    k, w = erase(known, allowances, value)
    norm = normalize_value(F.lit(value))
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, t in (("entries", entries.where(F.col("normalized_value") == norm)), ("references", references.join(entries.where(F.col("normalized_value") == norm), "entry_id", "left_semi")), ("known_values", known.where(F.col("value") == value)), ("allowances", allowances.where(F.col("value") == value)))]
    report_row = reduce(DataFrame.unionByName, counts).groupBy().pivot("table", ["entries", "references", "known_values", "allowances"]).sum("n")
    return {"entries": e, "references": r, "findings": f, "audit": a, "known_values": k, "allowances": w}, report_row
