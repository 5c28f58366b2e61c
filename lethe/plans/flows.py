"""Registered queries of streams, stores that grow, paged sources, rows that share an id and parts of requests, each with its SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import Snapshots, materialized, scratch_folder, spread
from ..functions.text import replaced_outside_tokens
from ..functions.value_store import ValueStore
from ..operators import audit, catalog, detect, dictionary, loc, payloads, sanitize, tokens
from ..sources import readers
from ..streaming import holdback
from .registry import ALL_RE, FOUND_SQL, TABLE_SQL, docs, query, table

TWICE_SQL = f"""{TABLE_SQL}, pieces AS (
  SELECT doc_id, unnest(regexp_split_to_array(text, '{ALL_RE}')) AS piece, unnest(range(1, len(regexp_split_to_array(text, '{ALL_RE}')) + 1)) AS place FROM documents
), single AS (
  SELECT p.doc_id, string_agg(p.piece || coalesce(k.token, ''), '' ORDER BY p.place) AS text, count(DISTINCT k.token) AS n_tokens
  FROM pieces p LEFT JOIN labelled l ON l.doc_id = p.doc_id AND l.place = p.place LEFT JOIN known k ON k.label = l.label AND k.value = l.value GROUP BY p.doc_id
)"""


def twice(spark, sf) -> DataFrame:
    """Each document and another text of the same id, with all places moved."""
    own = docs(spark, sf)
    return own.unionByName(own.withColumn("text", F.concat(F.lit("once more "), "text")))


@query(f"WITH {TWICE_SQL} SELECT doc_id, sha256(text) AS sanitized, n_tokens FROM single UNION ALL SELECT doc_id, sha256('once more ' || text), n_tokens FROM single")
def repeated_ids_tokenize(spark, sf):
    """Texts of one id keep their own spans."""
    out, _ = sanitize.tokenize(twice(spark, sf))
    return out.select("doc_id", F.sha2("sanitized", 256).alias("sanitized"), F.size("tokens").cast("long").alias("n_tokens"))


@query("SELECT doc_id, sha256(text) AS restored FROM documents UNION ALL SELECT doc_id, sha256('once more ' || text) FROM documents")
def repeated_ids_restore(spark, sf):
    """Tokens of several rows of one id, in a store that has a second, greater value for each token."""
    out, known = sanitize.tokenize(twice(spark, sf))
    doubled = known.unionByName(known.withColumn("value", F.concat("value", F.lit("~"))))
    back = tokens.restore(out.select("doc_id", F.col("sanitized").alias("text")), doubled)
    return back.select("doc_id", F.sha2("text", 256).alias("restored"))


@query(
    """WITH vals AS (SELECT DISTINCT text AS value FROM benchmark), own AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, 'once more ' || text FROM documents)
SELECT d.doc_id, count(v.value) AS n_tokens FROM own d LEFT JOIN vals v ON contains(d.text, v.value) GROUP BY d.doc_id, d.text"""
)
def repeated_ids_known(spark, sf):
    """Known values in several texts of one id."""
    known = table(spark, sf, "benchmark").select(F.concat(F.lit("[ITEM_"), "item_id", F.lit("_abcdef]")).alias("token"), F.col("text").alias("value"), F.lit("ITEM").alias("label"))
    return sanitize.retokenize_known(twice(spark, sf), known).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"))


@query(
    r"""WITH words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM documents)
SELECT doc_id, word AS term, count(*) AS n FROM words WHERE word IN ('a', 'y', 'o', 'e', '7') GROUP BY ALL
UNION ALL SELECT doc_id, 'é!', length(text) - length(replace(text, 'é', '')) FROM documents WHERE contains(text, 'é')"""
)
def one_character_terms(spark, sf):
    """Terms and phrases of one character."""
    terms = spark.createDataFrame([(t,) for t in "ayoe7"], "term string")
    hits = dictionary.blacklist_hits(docs(spark, sf), terms).select("doc_id", "term")
    phrases = dictionary.custom_values(docs(spark, sf), spark.createDataFrame([("é",)], "value string")).select("doc_id", F.lit("é!").alias("term"))
    return hits.unionByName(phrases).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS id, 'line ' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '.' AS value, length('Order ' || l_orderkey || ', see ') AS start FROM lineitem WHERE l_linenumber = 1")
def large_dictionary(spark, sf):
    """J3 beyond the automaton: every order line is a known value (12 million characters at scale factor 0.1), in notes on orders and documents."""
    line = F.concat(F.lit("line "), "l_orderkey", F.lit("-"), "l_linenumber", F.lit("-"), "l_partkey", F.lit("."))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", line.alias("value"))
    notes = lines.where("l_linenumber = 1").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("Order "), "l_orderkey", F.lit(", see "), "value", F.lit(" first")).alias("text"))
    own = notes.unionByName(docs(spark, sf).select((-1 - F.col("doc_id")).alias("id"), "text"))
    return dictionary.occurrences_by_grams(own, lines.select("value"), "id").select("id", "value", F.col("start").cast("long").alias("start"))


@query(
    r"""SELECT doc_id, sha256(replace(text, 'the', '[T_1_abcdef]') || ' [the_1_abcdef] [THE_1_abcdef]') AS bare,
  sha256(regexp_replace(text, '\bthe\b', '[T_1_abcdef]', 'g') || ' [the_1_abcdef] [THE_1_abcdef]') AS whole FROM documents""".replace(
        "' [the_1_abcdef] [THE_1_abcdef]') AS bare", "' [[T_1_abcdef]_1_abcdef] [THE_1_abcdef]') AS bare"
    )
)
def outside_tokens(spark, sf):
    """F8: a value that also stands inside a token, and in what only looks like one."""
    own = docs(spark, sf).withColumn("text", F.concat("text", F.lit(" [the_1_abcdef] [THE_1_abcdef]")))
    bare, whole = (replaced_outside_tokens(F.col("text"), F.lit("the"), F.lit("[T_1_abcdef]"), w) for w in (False, True))
    return own.select("doc_id", F.sha2(bare, 256).alias("bare"), F.sha2(whole, 256).alias("whole"))


@query(
    """WITH s AS (SELECT event_type AS source, list_sort(list(value)) AS v, count(value) AS n, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max FROM events WHERE value IS NOT NULL AND ts >= TIMESTAMP '2024-01-08' GROUP BY event_type)
SELECT source, n, avg, min, max, v[least(n - 1, CAST(floor(n * 0.5) AS BIGINT)) + 1] AS p50, v[least(n - 1, CAST(floor(n * 0.95) AS BIGINT)) + 1] AS p95 FROM s"""
)
def daily_latency(spark, sf):
    """Percentiles from counts a day, kept up to date over three additions, a merge and a prune."""
    store = audit.DailyCounts(spark, f"{scratch_folder(spark)}/daily-{uuid.uuid4().hex}", ["source"], "ms")
    events = table(spark, sf, "events").select("event_id", "ts", F.col("event_type").alias("source"), F.col("value").alias("ms"))
    for k in range(3):
        store.add(events.where(F.pmod("event_id", F.lit(3)) == k))
    store.compact("2024-01-09")
    store.drop_before("2024-01-08")
    return store.summary({"p50": 0.5, "p95": 0.95}).select("source", "n", F.round("avg", 6).alias("avg"), "min", "max", "p50", "p95")


def _streamed(spark, sf, name: str, **stages):
    """documents as a stream of files into a store of known values; gives (store, path of what came out)."""
    at = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    store = ValueStore(spark, f"{at}/known")
    path = f"{sf}/documents.parque[t]"  # a pattern, so that it may be one file or a folder
    sink = lambda out, batch: out.select("doc_id", "sanitized", "tokens").write.mode("overwrite").parquet(f"{at}/out/batch={batch}")
    texts = spark.readStream.schema(table(spark, sf, "documents").schema).option("maxFilesPerTrigger", 4).parquet(path).select("doc_id", "text")
    run = texts.writeStream.foreachBatch(holdback.sanitize_batch(store, sink, **stages)).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return store, f"{at}/out"


@query(f"WITH {FOUND_SQL} SELECT label, count(DISTINCT value) AS n_values FROM labelled GROUP BY label")
def stream_known_values(spark, sf):
    """The known values that micro-batches have added up."""
    store, _ = _streamed(spark, sf, "known-values")
    return store.read().groupBy("label").agg(F.count_distinct("value").alias("n_values"))


@query("SELECT doc_id, sha256(text) AS restored FROM documents")
def stream_sanitized(spark, sf):
    """Documents sanitized in micro-batches, restored by the values that these have left."""
    store, out = _streamed(spark, sf, "sanitized")
    back = tokens.restore(spark.read.parquet(out).select("doc_id", F.col("sanitized").alias("text")), store.read())
    return back.select("doc_id", F.sha2("text", 256).alias("restored"))


@query("SELECT c_custkey, c_name FROM customer")
def paged_customers(spark, sf):
    """Customers by pages of 400 rows, how many isn't said."""
    path = f"{sf}/customer.parquet"

    def fetch(page: int) -> list[tuple]:
        import pyarrow.parquet as pq

        rows = pq.read_table(path, columns=["c_custkey", "c_name"]).slice(400 * page, 400)
        return list(zip(*[c.to_pylist() for c in rows.columns], strict=True))

    spark.dataSource.register(readers.paged_source("paged_customers", spark.read.parquet(path).select("c_custkey", "c_name").schema, fetch))
    return spark.read.format("paged_customers").load()


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) FILTER (trim(line) <> '' AND NOT starts_with(trim(line), '//') AND NOT starts_with(trim(line), '*') AND NOT starts_with(trim(line), '/*')) AS code FROM l GROUP BY doc_id ORDER BY code DESC, doc_id LIMIT 10"""
)
def largest_files(spark, sf):
    """K3: the ten documents with the most lines of code, as JavaScript."""
    own = docs(spark, sf).select("doc_id", loc.line_counts(F.col("text"), F.lit("JavaScript"))["code"].cast("long").alias("code"))
    return audit.top(own, "code", 10, "doc_id")


@query("SELECT 'people' AS dataset, 'first_name+last_name' AS \"column\", 'people:' || c_custkey AS row_ref, split_part(c_name, '#', 1) || ' ' || split_part(c_name, '#', 2) AS value FROM customer")
def combined_names(spark, sf):
    """F32: one cell more where a table has first and last names."""
    people = table(spark, sf, "customer").select("c_custkey", F.split_part("c_name", F.lit("#"), F.lit(1)).alias("first_name"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("last_name"))
    return catalog.melt(people, "people", "c_custkey", ["first_name", "last_name"]).where(F.contains("column", F.lit("+")))


@query(
    """WITH gone AS (SELECT min(c_name) AS v FROM customer) SELECT 'known values' AS stored, count(*) AS versions, CAST(sum(n) AS BIGINT) AS "rows", 0::BIGINT AS hits FROM (
  SELECT count(*) AS n FROM customer, gone WHERE c_name <> v AND c_custkey % 2 = 0 UNION ALL SELECT count(*) FROM customer, gone WHERE c_name <> v UNION ALL SELECT count(*) FROM customer, gone WHERE c_name <> v)
UNION ALL SELECT 'orders', 2, (SELECT 2 * count(*) FROM orders JOIN customer ON c_custkey = o_custkey, gone WHERE c_name <> v), 0"""
)
def erased_versions(spark, sf):
    """A customer's name erased from each version of the known values, and of a table of orders."""
    names = table(spark, sf, "customer").select(F.concat(F.lit("[PERSON_"), "c_custkey", F.lit("_abcdef]")).alias("token"), F.col("c_name").alias("value"), F.lit("PERSON").alias("label"))
    at = f"{scratch_folder(spark)}/erased-{uuid.uuid4().hex}"
    store, orders = ValueStore(spark, f"{at}/known"), Snapshots(spark, f"{at}/orders")
    store.append(names.where("token rlike '[02468]_abcdef'"))
    store.append(names)
    lines = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.expr("c_custkey = o_custkey")).select("o_orderkey", F.col("c_name").alias("value"))
    for _ in range(2):
        orders.commit(lines)
    value = names.agg(F.min("value")).first()[0]
    orders.erase(F.col("value") == value)
    store.erase(value)

    def counted(name: str, kept: Snapshots | ValueStore) -> DataFrame:
        each = [kept.read(v).agg(F.count("*").alias("n"), F.count_if(F.col("value") == value).alias("hits")) for v in kept.versions()]
        return reduce(DataFrame.unionByName, each).agg(F.lit(name).alias("stored"), F.count("*").alias("versions"), F.sum("n").alias("rows"), F.sum("hits").alias("hits")).select("stored", "versions", "rows", "hits")

    return counted("known values", store).unionByName(counted("orders", orders))


_SHAPES = [
    ("IBAN", "'NL' || CAST(10 + c_custkey % 90 AS VARCHAR) || 'BANK' || lpad(CAST(c_custkey AS VARCHAR), 10, '0')"),
    ("CREDIT_CARD_NUMBER", "'4' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || ' 2222-3333 ' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')"),
    ("PHONE_NUMBER", "'+31 (20) ' || lpad(CAST(c_custkey % 10000000 AS VARCHAR), 7, '0')"),
    ("IP_ADDRESS", "'10.' || CAST(c_custkey % 256 AS VARCHAR) || '.0.' || CAST(c_nationkey AS VARCHAR)"),
]


@query(
    "WITH v AS (SELECT c_custkey, " + ", ".join(f"{sql} AS v{i}" for i, (_, sql) in enumerate(_SHAPES)) + ", c_custkey % 3 * 1350 + c_custkey % 90 * 10 + 200 AS p0 FROM customer), "
    "p AS (SELECT *, p0 + length(v0) + 4 AS p1, p0 + length(v0) + length(v1) + 8 AS p2, p0 + length(v0) + length(v1) + length(v2) + 12 AS p3 FROM v) "
    + " UNION ALL ".join(f"SELECT c_custkey, '{label}' AS label, CAST(p{i} AS INTEGER) AS start, v{i} AS value FROM p" for i, (label, _) in enumerate(_SHAPES))
)
def shaped_entities(spark, sf):
    """Account, card, phone and address numbers at places known beforehand, in three windows of the detector."""
    pad = F.expr("repeat('w ', CAST((c_custkey % 3 * 1350 + c_custkey % 90 * 10 + 200) / 2 AS INT))")
    values = [F.expr(sql.replace("VARCHAR", "STRING")) for _, sql in _SHAPES]
    text = F.concat(pad, values[0], F.lit(" or "), values[1], F.lit(" or "), values[2], F.lit(" or "), values[3], F.lit(" w"))
    own = spread(table(spark, sf, "customer").select("c_custkey", "c_nationkey")).select("c_custkey", text.alias("text"))
    return detect.entity_values(own, "c_custkey", ceiling=None).select("c_custkey", "label", "start", "value")


_TURNS = "SELECT conv_id, role, text, turn, turn % 4 AS kind, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations WHERE text IS NOT NULL"


@query(
    f"""WITH t AS ({_TURNS}), c AS (SELECT DISTINCT conv_id FROM t)
SELECT conv_id, CASE kind WHEN 1 THEN 'block' WHEN 2 THEN 'arguments' ELSE 'content' END AS part, place, sha256(CASE WHEN kind = 0 THEN '[NOTE] ' || text WHEN kind = 3 THEN '["' || text ELSE text END) AS text_hash FROM t
UNION ALL SELECT conv_id, 'system', -1, sha256('[be] kind ' || conv_id) FROM c UNION ALL SELECT conv_id, 'system', -1, sha256('and brief') FROM c WHERE conv_id % 2 = 0
UNION ALL SELECT conv_id, 'description', -1, sha256(d || conv_id) FROM c, (SELECT unnest(['reads ', 'writes ']) AS d)"""
)
def chat_request_parts(spark, sf):
    """Texts that begin like lists, blocks of text beside others, tool calls, system as string and blocks, tools of both forms."""
    k, text = F.col("turn") % 4, F.col("text")
    message = lambda *fields: F.to_json(F.struct("role", *fields))
    block = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("text"))
    call = F.struct(F.lit("i").alias("id"), F.struct(F.lit("f").alias("name"), text.alias("arguments")).alias("function"))
    own = F.when(k == 0, message(F.concat(F.lit("[NOTE] "), text).alias("content"))).when(k == 1, message(F.array(block("image", F.lit("none")), block("text", text)).alias("content")))
    own = own.when(k == 2, message(F.array(call).alias("tool_calls"))).otherwise(message(F.concat(F.lit('["'), text).alias("content")))
    turns = table(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", own.alias("m")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "m"))).alias("m"))
    messages = F.array_join(F.transform("m", lambda x: x["m"]), ",")
    name = F.concat(F.lit("[be] kind "), "conv_id")
    system = F.when(F.col("conv_id") % 2 == 0, F.to_json(F.array(block("text", name), block("text", F.lit("and brief"))))).otherwise(F.concat(F.lit('"'), name, F.lit('"')))
    tools = F.concat(F.lit('[{"name":"r","description":"reads '), "conv_id", F.lit('"},{"type":"function","function":{"description":"writes '), "conv_id", F.lit('"}}]'))
    payload = F.concat(F.lit('{"messages":['), messages, F.lit('],"system":'), system, F.lit(',"tools":'), tools, F.lit("}"))
    found = payloads.chat_texts(turns.select("conv_id", payload.alias("payload")), "conv_id")
    return found.select("conv_id", "part", F.col("place").cast("long").alias("place"), F.sha2("text", 256).alias("text_hash"))


@query(
    f"""WITH t AS ({_TURNS})
SELECT conv_id, 'input' AS part, place, sha256(CASE WHEN kind = 0 THEN '[NOTE] ' || text ELSE text END) AS text_hash FROM t WHERE conv_id % 3 <> 0
UNION ALL SELECT conv_id, 'input', place, sha256(role) FROM t WHERE kind = 1 AND conv_id % 3 <> 0
UNION ALL SELECT conv_id, 'input', -1, sha256('["' || max(text)) FROM t WHERE conv_id % 3 = 0 GROUP BY conv_id UNION ALL SELECT conv_id, 'instructions', -1, sha256('[be] kind ' || conv_id) FROM t GROUP BY conv_id"""
)
def response_request_parts(spark, sf):
    """Input as a string that begins like a list, and as items of strings, blocks, arguments and outputs."""
    k, text = F.col("turn") % 4, F.col("text")
    block = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("text"))
    item = lambda value, name: F.to_json(F.struct(value.alias(name)))
    own = F.when(k == 0, item(F.concat(F.lit("[NOTE] "), text), "content")).when(k == 1, item(F.array(block("input_text", text), block("output_text", F.col("role"))), "content"))
    own = own.when(k == 2, item(text, "arguments")).otherwise(item(text, "output"))
    turns = table(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", "text", own.alias("i")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "i"))).alias("i"), F.max("text").alias("last"))
    one = F.to_json(F.struct(F.concat(F.lit('["'), "last").alias("input")))
    start = F.when(F.col("conv_id") % 3 == 0, F.left(one, F.char_length(one) - 1)).otherwise(F.concat(F.lit('{"input":['), F.array_join(F.transform("i", lambda x: x["i"]), ","), F.lit("]")))
    payload = F.concat(start, F.lit(',"instructions":"[be] kind '), "conv_id", F.lit('"}'))
    found = payloads.response_texts(turns.select("conv_id", payload.alias("payload")), "conv_id")
    return found.select("conv_id", "part", F.col("place").cast("long").alias("place"), F.sha2("text", 256).alias("text_hash"))


_MAILED = "SELECT conv_id * 1000 + turn AS doc_id, conv_id, turn, text || CASE WHEN turn % 2 = 0 THEN ' mail u' || CAST(conv_id % 5 + turn AS VARCHAR) || '@ex.org' ELSE '' END AS text FROM conversations WHERE text IS NOT NULL"


@query(
    f"""WITH documents AS ({_MAILED}), {FOUND_SQL}, old AS (SELECT DISTINCT l.label, l.value FROM labelled l JOIN documents d ON d.doc_id = l.doc_id WHERE d.turn % 4 = 0),
f AS (SELECT DISTINCT l.doc_id, l.label, l.value, o.value IS NULL AS fresh FROM labelled l LEFT JOIN old o ON o.label = l.label AND o.value = l.value), b AS (SELECT doc_id, CAST(count(*) FILTER (fresh) AS BIGINT) AS n FROM f GROUP BY doc_id)
SELECT conv_id AS session_id, 'pii_detected' AS event_type, count(*) AS blocks, CAST(sum(n) AS BIGINT) AS tokens, count(*) FILTER (n = 0) AS retokenized FROM b JOIN documents d ON d.doc_id = b.doc_id GROUP BY conv_id"""
)
def audited_blocks(spark, sf):
    """Blocks sanitized with the values of every fourth turn known before, and an event of each that changed."""
    own = table(spark, sf, "conversations").where("text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.col("conv_id").alias("session_id"), "turn", F.concat("text", F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" mail u"), F.col("conv_id") % 5 + F.col("turn"), F.lit("@ex.org"))).otherwise("")).alias("text"))
    known = materialized(tokens.mint(detect.secret_matches(own.where("turn % 4 = 0").select("doc_id", "text"))), "known")
    out, _ = sanitize.tokenize(own.select("doc_id", "text"), known)
    fresh = out.select("doc_id", F.explode(F.map_keys("tokens")).alias("token")).join(known.select("token"), "token", "left_anti").groupBy("doc_id").agg(F.collect_list("token").alias("minted"))
    blocks = own.join(out.select("doc_id", "sanitized"), "doc_id").join(fresh, "doc_id", "left")
    events = payloads.block_events(blocks)
    return events.groupBy("session_id", "event_type").agg(F.count("*").alias("blocks"), F.sum(F.col("token_count").cast("long")).alias("tokens"), F.sum(F.col("retokenized_only").cast("long")).alias("retokenized"))


@query(
    """SELECT 'erp' AS source, count(*) + count(*) FILTER (c_custkey % 2 = 0) AS total, count(*) + count(*) FILTER (c_custkey % 4 = 2 AND c_custkey % 10 = 2) AS accepted,
  count(*) FILTER (c_custkey % 4 = 2 AND c_custkey % 10 <> 2) AS uncertain, count(*) FILTER (c_custkey % 4 = 0) AS rejected FROM customer"""
)
def reviewed_scan_counters(spark, sf):
    """Names found by rule, segments found by a model of which a reviewer accepts and rejects some."""
    customer = table(spark, sf, "customer")
    cells = lambda column: catalog.melt(customer, "customer", "c_custkey", [column])
    labels = customer.where("c_custkey % 2 = 0").select(F.concat(F.lit("customer:"), "c_custkey").alias("row_ref"), F.lit("c_mktsegment").alias("column"), F.lit("ORGANIZATION").alias("label"))
    guessed = catalog.model_findings(catalog.classify(cells("c_mktsegment")), labels, "erp")
    k = F.split_part("row_ref", F.lit(":"), F.lit(2)).cast("long")
    decided = guessed.withColumn("decision", F.when(k % 4 == 0, "reject").when(k % 10 == 2, "accept")).where("decision is not null")
    found, _ = catalog.review(catalog.findings(cells("c_name"), "erp").unionByName(guessed), decided, "me", F.lit("2024-01-01").cast("timestamp"))
    return catalog.scan_counters(found)
