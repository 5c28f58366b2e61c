"""Known values and tokens: minting, restoring, recovery, scopes, retention and erasure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fixed import TOKEN_SHAPE as _SPLIT
from ..functions.spans import apply_spans
from ..functions.storage import materialized
from ..functions.text import row_key, token_hex, token_label, token_ordinal, tokens_in

SALT = "lethe"
ROUNDS = 10  # levels of chained tokens; chained() reaches just these


def durable(value: Column) -> Column:
    """Values of two characters or more are kept."""
    return F.char_length(F.trim(value)) >= 2


def numbered(values: DataFrame) -> DataFrame:
    """Distinct (label, value) with their number within the label, by value.

    Rows are range-partitioned; each partition counts its labels, and sums of the counts before it give the
    offsets, so no label is numbered by one task.
    """
    ranged = materialized(values.select("label", "value").distinct().repartitionByRange("label", "value").withColumn("part", F.spark_partition_id()), "numbered")
    counts = ranged.groupBy("label", "part").agg(F.count("*").alias("n"))
    before = counts.select("label", "part", F.coalesce(F.sum("n").over(W.partitionBy("label").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = ranged.withColumn("place", F.row_number().over(W.partitionBy("label", "part").orderBy("value")))
    return own.join(before, ["label", "part"]).select("label", "value", (F.col("before") + F.col("place")).alias("ordinal"))


def mint(values: DataFrame, known: DataFrame | None = None, salt: str = SALT, every: bool = False) -> DataFrame:
    """(token, value, label) of each distinct durable (label, value); values known already keep their tokens.

    every: all values but blank ones, as the texts at hand need it; what is stored for later texts are the durable ones.
    """
    wanted = values.where(F.trim("value") != "" if every else durable(F.col("value"))).select("label", "value").distinct()
    if known is None:
        fresh, last = numbered(wanted), None
    else:
        kept = known.select("token", "value", "label")
        fresh = numbered(wanted.join(kept, ["label", "value"], "left_anti"))
        last = last_ordinals(kept)
        fresh = fresh.join(last, "label", "left").withColumn("ordinal", F.col("ordinal") + F.coalesce("last", F.lit(0)))
    token = F.concat(F.lit("["), F.col("label"), F.lit("_"), F.col("ordinal").cast("string"), F.lit("_"), token_hex(F.col("label"), F.col("value"), salt), F.lit("]"))
    made = fresh.select(token.alias("token"), "value", "label")
    return made if known is None else kept.unionByName(made)


def last_ordinals(known: DataFrame) -> DataFrame:
    """Highest number of each label."""
    return known.select(F.coalesce(F.nullif(token_label(F.col("token")), F.lit("")), F.col("label")).alias("label"), token_ordinal(F.col("token")).alias("n")).groupBy("label").agg(F.max("n").alias("last"))


def numbered_in_text(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Found spans with their number among the spans of their label in the same text, left to right."""
    return found.withColumn("ordinal", F.row_number().over(W.partitionBy(id_col, "label").orderBy("start", "end")))


def active_counts(known: DataFrame) -> DataFrame:
    """How many tokens there are by kind, with a row of null kind for all."""
    return known.select("token", F.coalesce(F.nullif(token_label(F.col("token")), F.lit("")), F.col("label")).alias("kind")).distinct().rollup("kind").agg(F.count("*").alias("n"))


def ingest(known: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (token, value, label) whose token isn't there yet are added; of several with one token the least value."""
    fresh = pairs.where(durable(F.col("value"))).groupBy("token").agg(F.min(F.struct("value", "label")).alias("p")).select("token", "p.value", "p.label")
    return known.select("token", "value", "label").unionByName(fresh.join(known, "token", "left_anti"))


def token_uses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token) of each distinct token in each text."""
    return docs.where(F.contains(F.col(text_col), F.lit("["))).select(F.col(id_col), F.explode(F.array_distinct(tokens_in(F.col(text_col)))).alias("token"))


def unresolved(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token) that no known value stands for."""
    return token_uses(docs, id_col, text_col).join(known.select("token").distinct(), "token", "left_anti").select(id_col, "token")


def chained(known: DataFrame) -> DataFrame:
    """(token, value) with the tokens in values restored, ROUNDS levels deep; what lies deeper stays, so cycles end too.

    Levels are doubled: values that are open for k levels, restored by values that are open for m, are so for k + m + 1.
    After 1, 3 and 7 levels a last step takes the values of 7 by those of 2, so chains of 10 need 4 steps one after another.
    """
    base = known.groupBy("token").agg(F.min("value").alias("value"))
    nested = lambda table: table.where(F.size(tokens_in(F.col("value"))) > 0)
    if not nested(base).limit(1).count():
        return base
    opened = {0: base}
    for k, m in ((0, 0), (1, 1), (1, 0), (3, 3), (7, 2)):
        open_values = nested(opened[k])
        inner = restore(open_values.select(F.col("token").alias("_id"), F.col("value").alias("text")), opened[m], "_id").select(F.col("_id").alias("token"), F.col("text").alias("value"))
        table = materialized(opened[k].join(open_values.select("token"), "token", "left_anti").unionByName(inner), "chained")
        opened[k + m + 1] = table
        if m != 0 or k == 0:
            if not nested(table).limit(1).count():
                return table
    return opened[ROUNDS]


def restore(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens in texts back to their values, in one pass; unknown tokens stay, of a token's values the least is taken."""
    rows = docs.withColumn("_row", row_key(F.col(id_col), F.col(text_col)))
    single = known.groupBy("token").agg(F.min("value").alias("value"))
    found = token_uses(rows, "_row", text_col).distinct().join(single, "token").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("_values"))
    tokens, between = tokens_in(F.col(text_col)), F.split(F.col(text_col), _SPLIT, -1)
    parts = F.transform(tokens, lambda t, i: F.concat(F.coalesce(F.try_element_at(F.col("_values"), t), t), F.get(between, i + 1)))
    text = F.when(F.col("_values").isNull(), F.col(text_col)).otherwise(F.concat(F.get(between, F.lit(0)), F.array_join(parts, "")))
    return rows.join(found, "_row", "left").withColumn(text_col, text).drop("_values", "_row")


def block_unresolved(docs: DataFrame, known: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """J8 under the policy `block`: documents whose tokens are all known, and those kept back."""
    missing = unresolved(docs, known, id_col).select(id_col).distinct()
    return docs.join(missing, id_col, "left_anti"), docs.join(missing, id_col, "left_semi")


def recover(missing: DataFrame, events: DataFrame) -> DataFrame:
    """Values of missing tokens (token) from audit events (event_id, tokens_map); the newest event wins."""
    pairs = events.select("event_id", F.explode("tokens_map").alias("token", "value"))
    found = pairs.join(missing.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.max_by("value", "event_id").alias("value"))
    return found.select("token", "value", token_label(F.col("token")).alias("label"), F.lit("audit_recovery").alias("source"))


def scoped(stores: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of the first store that has their key (project before global); within a store the least token."""
    ranked = None
    for i, s in enumerate(stores):
        one = s.select("token", "value", "label").withColumn("_scope", F.lit(i))
        ranked = one if ranked is None else ranked.unionByName(one)
    best = ranked.groupBy(*keys).agg(F.min(F.struct("_scope", "token", "value", "label")).alias("b"))
    return best.select("b.token", "b.value", "b.label")


def token_changes(before: Column, after: Column) -> Column:
    """U4: tokens of the text after that weren't in it before."""
    return F.array_except(tokens_in(after), tokens_in(before))


def active_allowances(allowances: DataFrame, now: Column) -> DataFrame:
    """(value, expires_at) that still hold, the latest expiry of each value."""
    return allowances.where(F.col("expires_at") > now).groupBy("value").agg(F.max("expires_at").alias("expires_at"))


def grant_allowance(values: DataFrame, now: Column, minutes: int) -> DataFrame:
    """allowances from now for some minutes, 1 to 1440."""
    if not 1 <= minutes <= 1440:
        raise ValueError("an allowance holds 1 to 1440 minutes")
    return values.select("value", now.alias("granted_at"), (now + F.make_interval(mins=F.lit(minutes))).alias("expires_at"))


def sweep(known: DataFrame, allowances: DataFrame, now: Column, retention: str) -> tuple[DataFrame, DataFrame]:
    """G1: `permanent` keeps all values, `days:N` those created within N days; expired allowances go."""
    if retention != "permanent":
        kind, _, days = retention.partition(":")
        if kind != "days" or not days.isdigit():
            raise ValueError(f"retention {retention!r}")
        known = known.where(F.col("created_at") >= now - F.make_interval(days=F.lit(int(days))))
    return known, allowances.where(F.col("expires_at") > now)


def erase(known: DataFrame, allowances: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """A value's tokens and allowances out."""
    return known.where(~F.col("value").eqNullSafe(F.lit(value))), allowances.where(~F.col("value").eqNullSafe(F.lit(value)))


def replaced(docs: DataFrame, found: DataFrame, table: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with their spans found (id, start, end, label, value) replaced by the table's tokens; values not in the table stay.

    Adds `tokens`: map of the document's tokens to their values.
    """
    named = found.join(table, ["label", "value"]).groupBy(id_col).agg(F.array_sort(F.collect_set(F.struct("start", "end", "token", "value"))).alias("_spans"), F.collect_set(F.struct("token", "value")).alias("_pairs"))
    joined = docs.join(named, id_col, "left")
    spans = F.coalesce(F.col("_spans"), F.array().cast("array<struct<start:int,end:int,token:string,value:string>>"))
    pairs = F.coalesce(F.col("_pairs"), F.array().cast("array<struct<token:string,value:string>>"))
    return joined.withColumn(text_col, apply_spans(F.col(text_col), spans)).withColumn("tokens", F.map_from_entries(pairs)).drop("_spans", "_pairs")
