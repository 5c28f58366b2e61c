"""The registered queries of the engine's own operators, each over its whole tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import spans as sp
from ..functions import text as tx
from ..functions.storage import spread
from ..operators import audit, catalog, detect, dictionary, loc, quality, sanitize, tokens
from ..streaming import holdback


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}

# RE2 has no look-around; the secret patterns that SQL joins into one, with the e-mail's ends left out.
EMAIL_RE = r"(?i:[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,})"
KEY_RE = r"sk-[a-zA-Z0-9\-_]{20,}|ghp_[a-zA-Z0-9]{36}|glpat-[a-zA-Z0-9\-_]{20,}|xox[baprs]-[a-zA-Z0-9\-]+|AKIA[0-9A-Z]{16}|-----BEGIN [A-Z ]+PRIVATE KEY-----"
PASSWORD_RE, SECRET_RE = r"(?i:password\s*[:=]\s*['\"]?\S{6,})".replace("'", "''"), r"(?i:secret\s*[:=]\s*['\"]?\S{6,})".replace("'", "''")
API_RE, TOKEN_RE = r"(?i:api[_\-]?key\s*[:=]\s*['\"]?\S{8,})".replace("'", "''"), r"(?i:token\s*[:=]\s*['\"]?\S{8,})".replace("'", "''")
ALL_RE = "|".join((PASSWORD_RE, SECRET_RE, API_RE, TOKEN_RE, EMAIL_RE, KEY_RE))
LABEL_SQL = f"""CASE WHEN regexp_full_match(value, '{TOKEN_RE}') THEN 'TOKEN' WHEN regexp_full_match(value, '{API_RE}') THEN 'API_KEY'
  WHEN regexp_full_match(value, '{SECRET_RE}') THEN 'SECRET' WHEN regexp_full_match(value, '{PASSWORD_RE}') THEN 'PASSWORD' WHEN value LIKE 'sk-%' THEN 'API_KEY'
  WHEN value LIKE 'ghp_%' THEN 'GITHUB_TOKEN' WHEN value LIKE 'glpat-%' THEN 'GITLAB_TOKEN' WHEN value LIKE 'xox%' THEN 'SLACK_TOKEN' WHEN value LIKE 'AKIA%' THEN 'AWS_KEY'
  WHEN value LIKE '-----%' THEN 'PRIVATE_KEY' ELSE 'EMAIL_ADDRESS' END"""
FOUND_SQL = f"""found AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '{ALL_RE}')) AS value, unnest(range(1, len(regexp_extract_all(text, '{ALL_RE}')) + 1)) AS place FROM documents
), labelled AS (SELECT *, {LABEL_SQL} AS label FROM found)"""
TABLE_SQL = FOUND_SQL + """, numbered AS (
  SELECT label, value, row_number() OVER (PARTITION BY label ORDER BY value) AS n FROM (SELECT DISTINCT label, value FROM labelled)
), known AS (
  SELECT '[' || label || '_' || n || '_' || substr(sha256('lethe|' || label || '|' || value), 1, 6) || ']' AS token, value, label FROM numbered
)"""


def query(sql: str | None = None):
    def of(f: Callable) -> Callable:
        QUERIES[f.__name__] = Query(f, sql)
        return f

    return of


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dealt(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table for rules on each row: dealt to all cores where a task or two would read it all."""
    return spread(table(spark, sf, name))


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


@query(f"WITH {FOUND_SQL} SELECT label, count(*) AS n, count(DISTINCT value) AS n_values, count(DISTINCT doc_id) AS n_docs FROM labelled GROUP BY label")
def secret_matches_by_label(spark, sf):
    return detect.secret_matches(docs(spark, sf)).groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"), F.count_distinct("doc_id").alias("n_docs"))


@query(
    f"""WITH {FOUND_SQL}, pieces AS (
  SELECT doc_id, unnest(regexp_split_to_array(text, '{ALL_RE}')) AS piece, unnest(range(1, len(regexp_split_to_array(text, '{ALL_RE}')) + 1)) AS place FROM documents
), ends AS (
  SELECT l.doc_id, l.label, l.value, sum(length(p.piece) + coalesce(length(l.value), 0)) OVER (PARTITION BY p.doc_id ORDER BY p.place) AS stop
  FROM pieces p LEFT JOIN labelled l ON l.doc_id = p.doc_id AND l.place = p.place
) SELECT doc_id, CAST(stop - length(value) AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end", label, value FROM ends WHERE value IS NOT NULL"""
)
def secret_spans(spark, sf):
    return detect.secret_matches(docs(spark, sf))


@query(
    f"""WITH {TABLE_SQL}, pieces AS (
  SELECT doc_id, unnest(regexp_split_to_array(text, '{ALL_RE}')) AS piece, unnest(range(1, len(regexp_split_to_array(text, '{ALL_RE}')) + 1)) AS place FROM documents
) SELECT p.doc_id, string_agg(p.piece || coalesce(k.token, ''), '' ORDER BY p.place) AS sanitized, count(DISTINCT k.token) AS n_tokens
FROM pieces p LEFT JOIN labelled l ON l.doc_id = p.doc_id AND l.place = p.place LEFT JOIN known k ON k.label = l.label AND k.value = l.value GROUP BY p.doc_id"""
)
def tokenize_documents(spark, sf):
    out, _ = sanitize.tokenize(docs(spark, sf))
    return out.select("doc_id", "sanitized", F.greatest(F.size("tokens"), F.lit(0)).cast("long").alias("n_tokens"))


@query(f"WITH {TABLE_SQL} SELECT token, value, label FROM known")
def token_table(spark, sf):
    return tokens.mint(detect.secret_matches(docs(spark, sf)))


@query("SELECT doc_id, sha256(text) AS restored FROM documents")
def detokenize_roundtrip(spark, sf):
    out, known = sanitize.tokenize(docs(spark, sf))
    back = tokens.restore(out.select("doc_id", F.col("sanitized").alias("text")), tokens.chained(known))
    return back.select("doc_id", F.sha2("text", 256).alias("restored"))


@query(f"WITH {TABLE_SQL} SELECT DISTINCT l.doc_id, k.token FROM labelled l JOIN known k ON k.label = l.label AND k.value = l.value WHERE hex(sha256(k.value)) IS NOT NULL AND substr(sha256(k.value), 1, 1) >= '8'")
def unresolved_tokens(spark, sf):
    out, known = sanitize.tokenize(docs(spark, sf))
    half = known.where(F.substring(F.sha2("value", 256), 1, 1) < "8")
    return tokens.unresolved(out.select("doc_id", F.col("sanitized").alias("text")), half)


PHRASES_SQL = "phrases AS (SELECT DISTINCT text AS value FROM benchmark)"


@query(f"WITH {PHRASES_SQL} SELECT d.doc_id, p.value, CAST((length(d.text) - length(replace(d.text, p.value, ''))) / length(p.value) AS BIGINT) AS n FROM documents d JOIN phrases p ON contains(d.text, p.value)")
def dictionary_match(spark, sf):
    phrases = table(spark, sf, "benchmark").select(F.col("text").alias("value"))
    return dictionary.value_counts(dictionary.matches(docs(spark, sf), phrases))


@query(
    """WITH vals AS (SELECT DISTINCT n_name AS value FROM nation UNION SELECT DISTINCT text FROM benchmark)
SELECT d.doc_id, v.value, CAST((length(d.text) - length(replace(d.text, v.value, ''))) / length(v.value) AS BIGINT) AS n
FROM documents d JOIN vals v ON contains(d.text, v.value) WHERE length(trim(v.value)) >= 2"""
)
def known_value_prescan(spark, sf):
    values = table(spark, sf, "nation").select(F.col("n_name").alias("value")).unionByName(table(spark, sf, "benchmark").select(F.col("text").alias("value")))
    return dictionary.value_counts(dictionary.known_values(docs(spark, sf), values))


NOTES_SQL = """notes AS (SELECT doc_id AS id, text FROM documents
  UNION ALL SELECT -1 - o_orderkey, 'Order ' || o_orderkey || ' of ' || c_name || ', ' || o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey)"""


def notes(spark, sf):
    """Documents and a line of text for each order, which names its customer."""
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.expr("c_custkey = o_custkey"))
    line = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" of "), F.col("c_name"), F.lit(", "), F.col("o_orderpriority"))
    return docs(spark, sf).select(F.col("doc_id").alias("id"), "text").unionByName(orders.select((-1 - F.col("o_orderkey")).alias("id"), line.alias("text")))


@query(
    f"""WITH {NOTES_SQL}, hits AS (SELECT id, unnest(regexp_extract_all(text, 'Customer#[0-9]+')) AS value FROM notes)
SELECT value, count(*) AS n, count(DISTINCT id) AS texts FROM hits WHERE value IN (SELECT c_name FROM customer) GROUP BY ALL"""
)
def known_customers(spark, sf):
    """J3 with a large dictionary: every customer is a known value (15000 at scale factor 0.1)."""
    values = table(spark, sf, "customer").select(F.col("c_name").alias("value"))
    found = dictionary.known_values(notes(spark, sf), values, id_col="id")
    return found.groupBy("value").agg(F.count("*").alias("n"), F.count_distinct("id").alias("texts"))


TERMS = ["the", "idiot", "10.0.0.1", "secret", "token", "una"]


@query(
    "WITH terms AS (SELECT unnest(" + str(TERMS) + r""") AS term), words AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM documents
) SELECT w.doc_id, t.term, CASE WHEN t.term = '10.0.0.1' THEN 'IP' ELSE 'PERSON' END AS kind, count(*) AS n FROM words w JOIN terms t ON w.word = t.term GROUP BY ALL
UNION ALL SELECT doc_id, '10.0.0.1', 'IP', len(regexp_extract_all(' ' || text || ' ', '[^\w]10\.0\.0\.1[^\w]')) AS n FROM documents WHERE regexp_matches(' ' || text || ' ', '[^\w]10\.0\.0\.1[^\w]')"""
)
def blacklist_hits(spark, sf):
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    return dictionary.blacklist_hits(docs(spark, sf), terms).withColumn("kind", detect.term_kind(F.col("term"))).groupBy("doc_id", "term", "kind").agg(F.count("*").alias("n"))


@query(
    """SELECT doc_id, CAST(k AS INTEGER) AS "window", CAST(k * 1350 AS INTEGER) AS start, sha256(substr(text, CAST(k * 1350 + 1 AS BIGINT), 1500)) AS text_hash
FROM (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 1500 THEN 1 ELSE CAST(ceil((length(text) - 1500) / 1350.0) AS BIGINT) + 1 END)) AS k FROM documents WHERE length(text) > 0)"""
)
def ner_windows(spark, sf):
    return detect.detector_windows(docs(spark, sf), ceiling=None).select("doc_id", "window", "start", F.sha2("text", 256).alias("text_hash"))


@query(r"""WITH m AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '(?:\d{1,3}\.){3}\d{1,3}')) AS value FROM documents)
SELECT doc_id, count(DISTINCT value) AS n FROM m GROUP BY doc_id""")
def rule_entities(spark, sf):
    found = detect.entity_values(docs(spark, sf), ceiling=None).where("label = 'IP_ADDRESS'")
    return found.groupBy("doc_id").agg(F.count_distinct("value").alias("n"))


@query("SELECT source, count(*) AS n, count(DISTINCT sha256(text)) AS distinct_texts FROM documents GROUP BY source")
def distinct_text_reuse(spark, sf):
    _, hashed = sanitize.distinct_texts(docs(spark, sf))
    return hashed.join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("text_hash").alias("distinct_texts"))


CELLS_SQL = """cells AS (
  SELECT 'customer' AS dataset, 'customer:' || c_custkey AS row_ref, unnest(['c_acctbal', 'c_custkey', 'c_mktsegment', 'c_name', 'c_nationkey']) AS "column",
         unnest([NULL, CAST(c_custkey AS VARCHAR), c_mktsegment, c_name, CAST(c_nationkey AS VARCHAR)]) AS value FROM customer
  UNION ALL SELECT 'supplier', 'supplier:' || s_suppkey, unnest(['s_acctbal', 's_name', 's_nationkey', 's_suppkey']), unnest([NULL, s_name, CAST(s_nationkey AS VARCHAR), CAST(s_suppkey AS VARCHAR)]) FROM supplier
), findings AS (
  SELECT *, lower(regexp_replace(trim(value), '\\s+', ' ', 'g')) AS normalized_value, CASE WHEN regexp_full_match(value, '\\+?[\\d\\s().-]{7,}') THEN 'PHONE_NUMBER' ELSE 'PERSON' END AS category,
    CASE WHEN regexp_full_match(value, '\\+?[\\d\\s().-]{7,}') THEN 'phone pattern' ELSE 'field name' END AS reason
  FROM cells WHERE value IS NOT NULL AND (regexp_full_match(value, '\\+?[\\d\\s().-]{7,}') OR "column" LIKE '%_name')
)""".replace("\\\\", "\\")


def scanned(spark, sf) -> DataFrame:
    customer = catalog.melt(table(spark, sf, "customer"), "customer", "c_custkey", ["c_custkey", "c_mktsegment", "c_name", "c_nationkey"])
    supplier = catalog.melt(table(spark, sf, "supplier"), "supplier", "s_suppkey", ["s_name", "s_nationkey", "s_suppkey"])
    return catalog.findings(customer.unionByName(supplier), "erp")


@query(f'WITH {CELLS_SQL} SELECT dataset, "column", row_ref, value, normalized_value, category, reason FROM findings')
def catalog_findings(spark, sf):
    return scanned(spark, sf).select("dataset", "column", "row_ref", "value", "normalized_value", "category", "reason")


@query(
    f"""WITH {CELLS_SQL} SELECT category, normalized_value, min(value) AS value, count(*) AS source_count,
  '[CATALOG_' || category || '_' || substr(sha256('lethe|' || category || '|' || normalized_value), 1, 10) || ']' AS token FROM findings GROUP BY category, normalized_value"""
)
def catalog_entries(spark, sf):
    now = F.lit("2024-01-01").cast("timestamp")
    found = scanned(spark, sf)
    entries, refs = catalog.refresh(None, None, found, "erp", "r1", now)
    return catalog.source_counts(entries, refs).select("category", "normalized_value", "value", "source_count", "token")


@query(f"WITH {CELLS_SQL} SELECT 'erp' AS source, count(*) AS total, count(*) AS accepted, 0 AS uncertain, 0 AS rejected FROM findings")
def catalog_scan_counters(spark, sf):
    return catalog.scan_counters(scanned(spark, sf))


@query("SELECT CASE WHEN c_custkey % 3 = 0 THEN 'stale' ELSE 'active' END AS status, count(*) AS n, min(lower(c_name)) AS first FROM customer GROUP BY 1")
def catalog_stale(spark, sf):
    t1, t2 = F.lit("2024-01-01").cast("timestamp"), F.lit("2024-02-01").cast("timestamp")
    customer = table(spark, sf, "customer").select("c_custkey", "c_name")
    found = lambda df: catalog.findings(catalog.melt(df, "customer", "c_custkey", ["c_name"]), "crm")
    entries, refs = catalog.refresh(None, None, found(customer), "crm", "r1", t1)
    entries, _ = catalog.refresh(entries, refs, found(customer.where("c_custkey % 3 <> 0")), "crm", "r2", t2)
    return entries.groupBy("status").agg(F.count("*").alias("n"), F.min("normalized_value").alias("first"))


@query(
    r"""WITH hits AS (
  SELECT d.doc_id, d.text, p.text AS value, p.item_id, unnest(range(0, CAST((length(d.text) - length(replace(d.text, p.text, ''))) / length(p.text) AS BIGINT))) AS k FROM documents d JOIN benchmark p ON contains(d.text, p.text)
), placed AS (
  SELECT *, list_sum(list_transform(string_split(text, value)[1:CAST(k + 1 AS INTEGER)], lambda x: length(x))) + k * length(value) AS start FROM hits
) SELECT CASE WHEN item_id % 3 = 0 THEN 'tokenized' WHEN regexp_matches(substr(text, CAST(greatest(0, start - 80) + 1 AS BIGINT), CAST(start - greatest(0, start - 80) AS BIGINT)) || ' ' || substr(text, CAST(start + length(value) + 1 AS BIGINT), 80),
  '(?i)([a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}|\+?[\d\s().-]{7,}|\b(account|customer|iban|vat|bsn|ssn|dob|date of birth|passport|phone|email)\b)') THEN 'strict_override' ELSE 'first_name_visible' END AS decision,
  count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM placed GROUP BY 1"""
)
def catalog_enforce_policy(spark, sf):
    category = F.when(F.col("item_id") % 3 == 0, "IDENTIFIER").otherwise("PERSON")
    entries = table(spark, sf, "benchmark").select(F.sha2("text", 256).alias("entry_id"), F.col("text").alias("value"), category.alias("category"), catalog.catalog_token(category, F.col("text"), "lethe").alias("token"))
    return catalog.decisions(docs(spark, sf), entries, None, None).groupBy("decision").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query("SELECT 'customer:' || c_custkey AS row_ref, substr(c_name, 1, 2) || repeat('*', CAST(least(8, greatest(3, length(c_name) - 2)) AS INTEGER)) AS value FROM customer")
def masked_findings(spark, sf):
    cells = catalog.melt(table(spark, sf, "customer"), "customer", "c_custkey", ["c_name"])
    return catalog.report(catalog.findings(cells, "crm"), category="PERSON").select("row_ref", "value")


TURNS = "CAST(user_id AS VARCHAR) AS session_id, CAST(floor(value) AS BIGINT) AS input_tokens, CAST(event_id % 7 AS BIGINT) AS output_tokens, CAST(event_id % 3 AS BIGINT) AS cache_creation_tokens, CAST(event_id % 11 AS BIGINT) AS cache_read_tokens"


@query(
    f"""WITH turns AS (SELECT {TURNS} FROM events) SELECT session_id, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens, sum(cache_creation_tokens) AS cache_creation_tokens,
  sum(cache_read_tokens) AS cache_read_tokens, count(*) AS turns, sum(input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens) AS total,
  round(sum(cache_read_tokens) / greatest(1, sum(input_tokens + cache_creation_tokens + cache_read_tokens)), 6) AS hit_ratio FROM turns GROUP BY ROLLUP (session_id)"""
)
def usage_summary(spark, sf):
    turns = table(spark, sf, "events").selectExpr(*[x.strip() for x in TURNS.replace("VARCHAR", "STRING").split(", ")])
    return audit.usage_summary(turns).withColumn("hit_ratio", F.round("hit_ratio", 6))


@query(f"WITH turns AS (SELECT {TURNS} FROM events) SELECT session_id, sum(input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens) AS total FROM turns GROUP BY session_id ORDER BY total DESC, session_id LIMIT 5")
def top_sessions(spark, sf):
    turns = table(spark, sf, "events").selectExpr(*[x.strip() for x in TURNS.replace("VARCHAR", "STRING").split(", ")])
    return audit.top_sessions(audit.usage_summary(turns)).select("session_id", "total")


@query(f"WITH turns AS (SELECT {TURNS} FROM events) SELECT session_id, max(input_tokens) AS input_tokens, max(output_tokens) AS output_tokens, max(cache_creation_tokens) AS cache_creation_tokens, max(cache_read_tokens) AS cache_read_tokens FROM turns GROUP BY session_id")
def legacy_usage(spark, sf):
    return audit.legacy_usage(table(spark, sf, "events").selectExpr(*[x.strip() for x in TURNS.replace("VARCHAR", "STRING").split(", ")]))


@query(
    """WITH s AS (SELECT event_type AS source, list_sort(list(value)) AS v, count(value) AS n, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max FROM events WHERE value IS NOT NULL GROUP BY event_type)
SELECT source, n, avg, min, max, v[least(n - 1, CAST(floor(n * 0.5) AS BIGINT)) + 1] AS p50, v[least(n - 1, CAST(floor(n * 0.95) AS BIGINT)) + 1] AS p95, v[least(n - 1, CAST(floor(n * 0.99) AS BIGINT)) + 1] AS p99 FROM s"""
)
def latency_percentiles(spark, sf):
    turns = table(spark, sf, "events").select(F.col("event_type").alias("source"), F.col("value").alias("ms"))
    return audit.latency_summary(turns).withColumn("avg", F.round("avg", 6))


@query(
    """WITH t AS (SELECT event_type AS source, CASE WHEN event_id % 2 = 0 THEN 'tool' ELSE 'chat' END AS turn_type, value FROM events WHERE value IS NOT NULL),
s AS (SELECT source, turn_type, list_sort(list(value)) AS v, count(*) AS n FROM t GROUP BY ALL)
SELECT source, turn_type, n, v[least(n - 1, CAST(floor(n * 0.5) AS BIGINT)) + 1] AS p50, v[least(n - 1, CAST(floor(n * 0.95) AS BIGINT)) + 1] AS p95 FROM s"""
)
def latency_by_turn_type(spark, sf):
    turns = table(spark, sf, "events").select(F.col("event_type").alias("source"), F.when(F.col("event_id") % 2 == 0, "tool").otherwise("chat").alias("turn_type"), F.col("value").alias("ms"))
    return audit.latency_by_type(turns).select("source", "turn_type", "n", "p50", "p95")


@query("""SELECT event_type AS event, k AS key, sum(v) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS k, CAST(json_extract(props, '$.' || unnest(json_keys(props))) AS BIGINT) AS v FROM events WHERE props IS NOT NULL) GROUP BY ALL
UNION ALL SELECT event_type, 'hit', count(*) FROM events WHERE event_id % 4 = 0 GROUP BY 1""")
def perf_frequency(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("event"), F.from_json("props", "map<string,bigint>").alias("cache_counts"), F.when(F.col("event_id") % 4 == 0, "hit").alias("cache_result"))
    return audit.frequencies(e)


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def event_tail(spark, sf):
    return audit.tail(table(spark, sf, "events"), 50, ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY event_type")
def prune_events(spark, sf):
    events = table(spark, sf, "events")
    return audit.prune(events, events.agg(F.max("ts")).scalar(), 7).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n FROM events WHERE NOT contains(lower(coalesce(event_type, '')), 'click') AND NOT contains(lower(coalesce(props, '')), 'click') GROUP BY event_type")
def forget_events(spark, sf):
    return audit.forget_term(table(spark, sf, "events"), "CLICK", ["event_type", "props"]).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    """WITH e AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'request' ELSE 'response' END AS event_type FROM conversations),
a AS (SELECT *, last_value(CASE WHEN event_type = 'request' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked FROM e),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, asked ORDER BY turn) AS n FROM a WHERE event_type = 'response' AND asked IS NOT NULL)
SELECT conv_id, asked AS request_id, turn AS response_id, (turn - asked) * 1000.0::DOUBLE AS ms FROM f WHERE n = 1"""
)
def turn_type_and_timing(spark, sf):
    e = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("event_id"), F.timestamp_seconds("turn").alias("ts"), F.when(F.col("role") == "user", "request").otherwise("response").alias("event_type"))
    return audit.turn_timing(e, "conv_id", ["event_id"])


@query(
    f"""WITH {FOUND_SQL}, x AS (SELECT doc_id, list(DISTINCT lower(value)) AS detected FROM labelled WHERE label = 'EMAIL_ADDRESS' GROUP BY doc_id), e AS (
  SELECT d.lang AS config, list_distinct(list_transform(regexp_extract_all(text, '(?i)[a-z0-9._%+\\-]+@[a-z0-9.\\-]+\\.com'), lambda v: lower(v))) AS expected, coalesce(detected, []) AS detected FROM documents d LEFT JOIN x ON x.doc_id = d.doc_id),
c AS (SELECT config, sum(len(list_filter(detected, lambda v: list_contains(expected, v)))) AS tp, sum(len(list_filter(detected, lambda v: NOT list_contains(expected, v)))) AS fp, sum(len(list_filter(expected, lambda v: NOT list_contains(detected, v)))) AS fn FROM e GROUP BY config)
SELECT config, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM c"""
)
def detection_quality(spark, sf):
    own = table(spark, sf, "documents")
    detected = detect.secret_matches(docs(spark, sf)).where("label = 'EMAIL_ADDRESS'").groupBy("doc_id").agg(F.collect_set("value").alias("detected"))
    rows = own.join(detected, "doc_id", "left").select(F.col("lang").alias("config"), F.regexp_extract_all("text", F.lit(r"(?i)[a-z0-9._%+\-]+@[a-z0-9.\-]+\.com"), F.lit(0)).alias("expected"), "detected")
    return quality.summary(quality.scored(rows))


@query(
    r"""WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents), f AS (SELECT lang, count(*) AS files FROM documents GROUP BY lang)
SELECT coalesce(lang, 'TOTAL') AS language, CAST(sum(n) AS BIGINT) AS total, CAST(sum(blank) AS BIGINT) AS blank, CAST(sum(comment) AS BIGINT) AS comment, CAST(sum(n - blank - comment) AS BIGINT) AS code
FROM (SELECT lang, count(*) AS n, count(*) FILTER (trim(line) = '') AS blank, count(*) FILTER (starts_with(trim(line), '//') OR starts_with(trim(line), '*') OR starts_with(trim(line), '/*')) AS comment FROM l GROUP BY lang) GROUP BY ROLLUP (lang)"""
)
def line_counts(spark, sf):
    own = spread(table(spark, sf, "documents").select("lang", "text")).withColumn("c", loc.line_counts(F.col("text"), F.lit("JavaScript")))
    return own.rollup("lang").agg(*[F.sum(f"c.{k}").alias(k) for k in ("total", "blank", "comment", "code")]).select(F.coalesce("lang", F.lit("TOTAL")).alias("language"), "total", "blank", "comment", "code")


@query("SELECT CAST(conv_id AS VARCHAR) AS stream_key, sha256(string_agg(text, '' ORDER BY turn)) AS text_hash FROM conversations GROUP BY conv_id")
def stream_holdback(spark, sf):
    """Conversations tokenized, cut into pieces of seven characters, so through tokens, and restored."""
    c = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    safe, known = sanitize.tokenize(c)
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.char_length("sanitized") / 7).cast("int") - 1)), lambda k: F.substring("sanitized", k * 7 + 1, F.lit(7)))
    cut = safe.select(F.floor(F.col("doc_id") / 1000).cast("string").alias("stream_key"), F.col("doc_id").alias("turn"), F.posexplode(pieces).alias("place", "delta"))
    n = F.row_number().over(Window.partitionBy("stream_key").orderBy("turn", "place")) - 1
    out = holdback.restored(cut.select("stream_key", n.cast("long").alias("seq"), "delta", F.lit(False).alias("is_end")), known)
    return out.groupBy("stream_key").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), ""), 256).alias("text_hash"))


SAFE_SQL = TABLE_SQL + f""", pieces AS (
  SELECT doc_id, unnest(regexp_split_to_array(text, '{ALL_RE}')) AS piece, unnest(range(1, len(regexp_split_to_array(text, '{ALL_RE}')) + 1)) AS place FROM documents
), safe AS (
  SELECT p.doc_id, string_agg(CASE WHEN p.doc_id % 2 = 0 THEN p.piece || coalesce(k.token, '') ELSE p.piece || coalesce(l.value, '') END, '' ORDER BY p.place) AS text
  FROM pieces p LEFT JOIN labelled l ON l.doc_id = p.doc_id AND l.place = p.place LEFT JOIN known k ON k.label = l.label AND k.value = l.value GROUP BY p.doc_id
)"""
_SHAPE = r"\[(?:[A-Z_]+_\d+_[0-9a-f]{6,}|CATALOG_[A-Z0-9_]+_[0-9a-f]{6,})\]"


def half_safe(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Documents of which every other one is tokenized, and the token table."""
    own = docs(spark, sf)
    out, known = sanitize.tokenize(own)
    safe = out.select("doc_id", F.col("sanitized").alias("safe"))
    return own.join(safe, "doc_id").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("safe")).otherwise(F.col("text")).alias("text")), known


@query(
    f"""WITH {SAFE_SQL}, half AS (SELECT * FROM known WHERE substr(sha256(value), 1, 1) < '8'), t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{_SHAPE}'))) AS token FROM safe),
u AS (SELECT doc_id, count(h.token) AS live, count(*) - count(h.token) AS unknown FROM t LEFT JOIN half h ON h.token = t.token GROUP BY doc_id), r AS (SELECT doc_id, count(DISTINCT h.value) AS n FROM safe s JOIN half h ON contains(s.text, h.value) GROUP BY doc_id)
SELECT s.doc_id, sha256(s.text) AS content_hash, coalesce(live, 0) AS live, coalesce(unknown, 0) AS unknown, coalesce(r.n, 0) AS raw_values FROM safe s LEFT JOIN u ON u.doc_id = s.doc_id LEFT JOIN r ON r.doc_id = s.doc_id"""
)
def residual_tokens(spark, sf):
    safe, known = half_safe(spark, sf)
    return sanitize.residual_tokens(safe, known.where(F.substring(F.sha2("value", 256), 1, 1) < "8"))


@query(f"WITH {TABLE_SQL} SELECT label, max(n) AS last FROM numbered GROUP BY label")
def last_ordinals(spark, sf):
    return tokens.last_ordinals(tokens.mint(detect.secret_matches(docs(spark, sf))))


@query(r"SELECT url, CASE WHEN regexp_matches(url, '\.(pem|key|p12|pfx)$') THEN 'sensitive' WHEN url LIKE '%.html' THEN 'glob' ELSE 'open' END AS decision FROM pages")
def blocked_paths(spark, sf):
    why = detect.blocked_path(F.col("url"), ["*.html"])
    return table(spark, sf, "pages").select("url", F.when(why.isNull(), "open").when(F.startswith(why, F.lit("matches")), "glob").otherwise("sensitive").alias("decision"))


@query(f"WITH {SAFE_SQL} SELECT doc_id, CAST(len(regexp_extract_all(text, '{_SHAPE}')) AS INTEGER) AS n_tokens, contains(text, '~') AS marked FROM safe")
def token_shapes(spark, sf):
    safe, _ = half_safe(spark, sf)
    return safe.select("doc_id", F.size(sp.token_spans(F.col("text"))).alias("n_tokens"), (F.size(tx.escapes(F.col("text"))) > 0).alias("marked"))
