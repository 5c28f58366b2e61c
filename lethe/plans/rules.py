"""Registered queries of scalar rules, readers, payloads and lines, each over whole tables, with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..functions.storage import shared_folder
from ..operators import audit, detect, loc, payloads, quality, sanitize, tokens
from ..sources import readers
from .registry import FOUND_SQL, dealt, docs, query, table


def new_folder(spark, name: str) -> str:
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_GENERIC = ", ".join(f"'{w}'" for w in fixed.GENERIC_WORDS)
_LEAST = " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.LEAST_LENGTHS.items())
_ALWAYS = ", ".join(f"'{w}'" for w in fixed.ALWAYS)


@query(
    f"""WITH v AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ORGANIZATION' WHEN 2 THEN 'EMAIL_ADDRESS' ELSE 'DISEASE' END AS label,
  CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE 'Email' END AS value FROM part),
d AS (SELECT *, lower(value) NOT IN ({_GENERIC}) AND length(value) >= CASE label {_LEAST} ELSE 2 END AS plausible, label IN ({_ALWAYS}) AS always, contains(value, ' ') AS several FROM v)
SELECT id, plausible, CASE WHEN always THEN true ELSE true END AS strict, CASE WHEN label IN ('PERSON', 'ORGANIZATION') THEN several ELSE true END AS balanced, always AS relaxed,
  contains(lower(value), 'brand#1') OR contains('brand#1', lower(value)) OR lower(value) LIKE '%widget' AS allowed FROM d"""
)
def entity_filters(spark, sf):
    """P4, P5, P6."""
    k = F.col("p_partkey")
    label = F.when(k % 4 == 0, "PERSON").when(k % 4 == 1, "ORGANIZATION").when(k % 4 == 2, "EMAIL_ADDRESS").otherwise("DISEASE")
    value = F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, F.col("p_brand")).otherwise("Email")
    own = dealt(spark, sf, "part").select(k.alias("id"), label.alias("label"), value.alias("value"))
    modes = [detect.in_mode(F.col("label"), F.col("value"), m).alias(m) for m in ("strict", "balanced", "relaxed")]
    return own.select("id", detect.plausible(F.col("label"), F.col("value")).alias("plausible"), *modes, detect.allowed(F.col("value"), ["Brand#1", "*widget"]).alias("allowed"))


@query(
    r"""SELECT c_custkey, substr(c_name, 1, 1) || repeat('*', length(c_name) - 1) AS status, substr(c_name, 1, 1) || '*** (' || length(c_name) || ')' AS preview,
  regexp_replace(upper(c_mktsegment || '-' || c_nationkey), '[^A-Z_]+', '_', 'g') AS label, 'fail ' || c_mktsegment || ' [EMAIL] password=[REDACTED]' AS error, lower(c_name) AS normalized FROM customer"""
)
def value_masks(spark, sf):
    """F1, F3, F4, F5, F7."""
    name = F.col("c_name")
    error = F.concat(F.lit("fail "), "c_mktsegment", F.lit(" a.b@example.org password: "), F.md5(name))
    return dealt(spark, sf, "customer").select("c_custkey", tx.mask_status(name).alias("status"), tx.mask_preview(name).alias("preview"), tx.normalize_label(F.concat_ws("-", "c_mktsegment", "c_nationkey")).alias("label"), tx.sanitize_error(error).alias("error"), tx.normalize_value(F.concat(F.lit(" "), name, F.lit("\t"))).alias("normalized"))


@query(
    """WITH c AS (SELECT c_custkey, lower(c_name) AS a, lower(c_mktsegment) AS b FROM customer)
SELECT c_custkey, array_to_string(list_sort(list_distinct([b, 'of', 'of ' || b, a, a || ' of ' || b, 'ask', 'ask ' || a || ' of ' || b])), '|') AS escaped, 'ask ' || c_name || ' of "' || c_mktsegment || '", now' AS cleaned FROM c JOIN customer USING (c_custkey)"""
)
def escape_phrases(spark, sf):
    """F11."""
    text = F.concat(F.lit("ask "), "c_name", F.lit(' of "'), "c_mktsegment", F.lit('~", now'))
    return dealt(spark, sf, "customer").select("c_custkey", F.array_join(F.array_sort(tx.escapes(text)), "|").alias("escaped"), tx.without_escape_marks(text).alias("cleaned"))


@query(
    """SELECT p_partkey, CASE WHEN contains(p_name, ' ') AND length(string_split(p_name, ' ')[-1]) >= 2 THEN string_split(p_name, ' ')[-1] END AS last_word,
  string_split(p_name, ' ')[1] AS first, CASE WHEN contains(p_name, ' ') THEN substr(p_name, instr(p_name, ' ') + 1) ELSE '' END AS hidden FROM part"""
)
def name_parts(spark, sf):
    """F16, F17."""
    parts = tx.first_name_parts(F.col("p_name"))
    return dealt(spark, sf, "part").select("p_partkey", tx.balanced_name(F.col("p_name")).alias("last_word"), parts["first"].alias("first"), parts["hidden"].alias("hidden"))


@query("SELECT upper(event_type) AS kind, max(event_id) AS last, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT NULL, NULL, count(*) FROM events")
def token_kinds(spark, sf):
    """F6, A12, A14."""
    made = dealt(spark, sf, "events").select(F.concat(F.lit("["), F.upper("event_type"), F.lit("_"), "event_id", F.lit("_abcdef]")).alias("token"), F.col("event_type").alias("label"))
    last = tokens.last_ordinals(made).withColumnRenamed("label", "kind")
    return tokens.active_counts(made).join(last, "kind", "left").select("kind", "last", "n")


@query(f"WITH {FOUND_SQL} SELECT doc_id, label, value, row_number() OVER (PARTITION BY doc_id, label ORDER BY place) AS ordinal FROM labelled")
def text_ordinals(spark, sf):
    """W1."""
    return tokens.numbered_in_text(detect.secret_matches(docs(spark, sf))).select("doc_id", "label", "value", F.col("ordinal").cast("long").alias("ordinal"))


@query(f"WITH {FOUND_SQL} SELECT lang, count(*) AS n, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labelled)) AS clean FROM documents GROUP BY lang")
def clean_documents(spark, sf):
    """P17."""
    out, _ = sanitize.tokenize(table(spark, sf, "documents").select("doc_id", "text", "lang"))
    own = table(spark, sf, "documents").select("doc_id", F.col("text"))
    clean = detect.clean_texts(out.join(own, "doc_id")).groupBy("lang").agg(F.count("*").alias("clean"))
    return out.groupBy("lang").agg(F.count("*").alias("n")).join(clean, "lang", "left").select("lang", "n", F.coalesce("clean", F.lit(0)).alias("clean"))


@query(
    """SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS clicks, max(CASE WHEN event_type = 'click' THEN event_id END) AS last_click FROM events
WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 5 DAY GROUP BY user_id"""
)
def recent_events(spark, sf):
    """P15, P19."""
    events = dealt(spark, sf, "events")
    own = audit.recent(events, events.agg(F.max("ts")).scalar(), 5)
    clicks = audit.by_type(own, "click", "event_id").groupBy("user_id").agg(F.count("*").alias("clicks"), F.max("event_id").alias("last_click"))
    return own.groupBy("user_id").agg(F.count("*").alias("n")).join(clicks, "user_id", "left").select("user_id", "n", F.coalesce("clicks", F.lit(0)).alias("clicks"), "last_click")


@query(
    """WITH m AS (SELECT event_id, event_id % 4 AS kind, CAST(floor(value) AS BIGINT) AS n, event_id % 7 AS o FROM events WHERE value IS NOT NULL)
SELECT event_id, n AS input_tokens, o AS output_tokens, CASE WHEN kind = 3 THEN 0 ELSE 5 END AS cache_read_tokens FROM m WHERE kind <> 1 AND n + o + CASE WHEN kind = 3 THEN 0 ELSE 5 END > 0"""
)
def admitted_usage(spark, sf):
    """deltas with (0) and without (1) a stop reason, starts (2), the other vendor's names (3)."""
    e = dealt(spark, sf, "events").where("value is not null").select("event_id", (F.col("event_id") % 4).alias("kind"), F.floor("value").alias("n"), (F.col("event_id") % 7).alias("o"))
    usage = F.struct(F.col("n").alias("input_tokens"), F.col("o").alias("output_tokens"), F.lit(5).alias("cache_read_input_tokens"))
    delta = lambda stop: F.to_json(F.struct(F.lit("message_delta").alias("type"), F.struct(stop.alias("stop_reason")).alias("delta"), usage.alias("usage")))
    start = F.to_json(F.struct(F.lit("message_start").alias("type"), F.struct(usage.alias("usage")).alias("message")))
    other = F.to_json(F.struct(F.struct(F.col("n").alias("prompt_tokens"), F.col("o").alias("completion_tokens")).alias("usage")))
    message = F.when(F.col("kind") == 0, delta(F.lit("end"))).when(F.col("kind") == 1, delta(F.lit(None).cast("string"))).when(F.col("kind") == 2, start).otherwise(other)
    u = audit.normalized_usage(audit.admitted_usage(message))
    return e.select("event_id", F.explode(F.array_compact(F.array(u))).alias("u")).select("event_id", "u.input_tokens", "u.output_tokens", F.col("u.cache_read_tokens").cast("int").alias("cache_read_tokens"))


@query("SELECT conv_id, CASE WHEN arg_max(role, turn) = 'tool' THEN 'tool' ELSE 'chat' END AS turn_type FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN 'tool' ELSE role END AS role FROM conversations) GROUP BY conv_id")
def turn_types(spark, sf):
    """F27; every third turn stands for a tool's."""
    own = table(spark, sf, "conversations").withColumn("role", F.when(F.col("turn") % 3 == 1, "tool").otherwise(F.col("role")))
    roles = own.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("m"))
    return roles.select("conv_id", audit.turn_type(F.transform("m", lambda x: x["role"])).alias("turn_type"))


@query(
    """WITH s AS (SELECT event_type AS source, (event_id % 7) / (value / 1000) AS speed FROM events WHERE value > 0), v AS (SELECT source, list_sort(list(speed)) AS v, count(*) AS n FROM s GROUP BY source)
SELECT source, round(v[least(n - 1, CAST(floor(n * 0.5) AS BIGINT)) + 1], 6) AS p50, round(list_min(v), 6) AS min, round(list_max(v), 6) AS max FROM v"""
)
def output_speed(spark, sf):
    """A5, F34."""
    turns = dealt(spark, sf, "events").select(F.col("event_type").alias("source"), (F.col("event_id") % 7).alias("output_tokens"), F.col("value").alias("ms"))
    return audit.output_speed(turns).select("source", *[F.round(c, 6).alias(c) for c in ("p50", "min", "max")])


@query(
    """WITH e AS (SELECT event_type AS event, value AS wall, event_id % 50 AS cpu, event_id % 9 AS texts FROM events WHERE value IS NOT NULL), v AS (SELECT event, list_sort(list(wall)) AS v FROM e GROUP BY event)
SELECT e.event, count(*) AS n, max(cpu) AS cpu_max, sum(texts) AS texts, v[least(len(v) - 1, CAST(floor(len(v) * 0.95) AS BIGINT)) + 1] AS wall_p95 FROM e JOIN v ON e.event = v.event GROUP BY e.event, v.v"""
)
def perf_log(spark, sf):
    """Events written as JSON lines with broken ones between them, read back and summed up."""
    at = new_folder(spark, "perf")
    e = dealt(spark, sf, "events").where("value is not null")
    line = F.to_json(F.struct(F.col("event_type").alias("event"), F.col("value").alias("wall_ms"), (F.col("event_id") % 50).alias("cpu_ms"), (F.col("event_id") % 9).alias("text_count"), F.lit(1).alias("text_chars")))
    e.select(F.explode(F.array(line, F.concat(F.lit("{"), "event_type"))).alias("value")).write.text(at)
    read = readers.perf_events(spark, at, "event string, wall_ms double, cpu_ms long, text_count long, text_chars long")
    return audit.perf_summary(read).select("event", "n", "cpu_max", "texts", "wall_p95")


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1")
def audit_append(spark, sf):
    """Appended in two goes, by day."""
    at = new_folder(spark, "audit")
    for rest in (0, 1):
        audit.append_events(dealt(spark, sf, "events").where(F.col("event_id") % 2 == rest), at)
    return spark.read.parquet(at).groupBy("day").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query("SELECT term, min(file) AS file FROM (SELECT p_name AS term, 0 AS file FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_name, 1 FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_type, 1 FROM part) GROUP BY term")
def term_files(spark, sf):
    """Names written as term lists with comments, read back."""
    first, second = new_folder(spark, "terms"), new_folder(spark, "terms")
    part = dealt(spark, sf, "part")
    part.where("p_partkey % 2 = 0").select(F.concat(F.lit(" "), "p_name", F.lit("  # "), "p_brand")).write.text(first)
    part.where("p_partkey % 3 = 0").select(F.col("p_name").alias("value")).unionByName(part.select(F.explode(F.array("p_type", F.lit("# all"), F.lit(""))).alias("value"))).write.text(second)
    return readers.term_list(spark, [first, second])


@query(
    r"""WITH e AS (SELECT lang, list_distinct(list_transform(regexp_extract_all(text, '(?i)[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}'), lambda x: lower(x))) AS expected, list_distinct(list_transform(list_filter(regexp_extract_all(text, '(?i)[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}'), lambda x: length(x) % 2 = 0), lambda x: lower(x))) AS detected FROM documents)
SELECT coalesce(lang, '?') AS config, CAST(sum(len(list_intersect(expected, detected))) AS BIGINT) AS tp, CAST(sum(len(list_filter(detected, lambda x: NOT list_contains(expected, x)))) AS BIGINT) AS fp, CAST(sum(len(list_filter(expected, lambda x: NOT list_contains(detected, x)))) AS BIGINT) AS fn FROM e GROUP BY 1"""
)
def labelled_corpus(spark, sf):
    """A labelled corpus in JSON lines, scored against a detector that misses addresses of odd length."""
    at, email = new_folder(spark, "corpus"), r"(?i)[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}"
    own = table(spark, sf, "documents").select("text", "lang", F.regexp_extract_all("text", F.lit(email), F.lit(0)).alias("expected"))
    own.select(F.explode(F.array(F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("expected", F.array().cast("array<string>")).alias("expected"))), F.lit("# note"))).alias("value"), F.coalesce("lang", F.lit("?")).alias("config")).write.partitionBy("config").text(at)
    rows = readers.labelled_corpus(spark, at)
    detected = F.filter(F.regexp_extract_all("text", F.lit(email), F.lit(0)), lambda x: F.char_length(x) % 2 == 0)
    return quality.summary(quality.scored(rows.withColumn("detected", detected))).select("config", "tp", "fp", "fn")


def _page_path() -> Column:
    k = F.col("page_id") % 6
    return F.when(k == 0, "src/A.py").when(k == 1, "node_modules/a.js").when(k == 2, "x/b.MIN.js").when(k == 3, "docs/c.md").when(k == 4, "x/Makefile").otherwise("x/d.unknown")


@query(
    r"""WITH f AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'Python' WHEN 3 THEN 'Markdown' WHEN 4 THEN 'Make' END AS language, regexp_split_to_array(html, '\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]') AS l FROM pages WHERE page_id % 6 IN (0, 3, 4) AND page_id % 7 <> 0),
g AS (SELECT language, CASE WHEN l[-1] = '' THEN l[1:-2] ELSE l END AS l FROM f),
h AS (SELECT language, unnest(list_transform(l, lambda x: trim(x, chr(9) || ' '))) AS line FROM g), n AS (SELECT language, count(*) AS files FROM f GROUP BY language),
c AS (SELECT h.language, files, count(*) AS total, count(*) FILTER (line = '') AS blank, count(*) FILTER (line <> '' AND starts_with(line, CASE h.language WHEN 'Markdown' THEN '<!--' ELSE '#' END)) AS comment FROM h JOIN n ON h.language = n.language GROUP BY h.language, files)
SELECT coalesce(language, 'TOTAL') AS language, CAST(sum(files) AS BIGINT) AS files, CAST(sum(total) AS BIGINT) AS total, CAST(sum(blank) AS BIGINT) AS blank, CAST(sum(comment) AS BIGINT) AS comment, CAST(sum(total - blank - comment) AS BIGINT) AS code FROM c GROUP BY ROLLUP (language)"""
)
def loc_by_language(spark, sf):
    """Pages as source files, some in skipped folders, of skipped or unknown endings, or binary."""
    content = F.when(F.col("page_id") % 7 == 0, F.concat("html", F.lit("\0"))).otherwise(F.col("html")).cast("binary")
    files = table(spark, sf, "pages").select(_page_path().alias("path"), content.alias("content"))
    return loc.loc_summary(readers.counted_files(files)).select("language", "files", *[F.col(c).cast("long").alias(c) for c in ("total", "blank", "comment", "code")])


_LINES = r"len(regexp_split_to_array({0}, '\r\n|[\n\r\x{{0b}}\x{{0c}}\x{{1c}}-\x{{1e}}\x{{85}}\x{{2028}}\x{{2029}}]')) - CASE WHEN {0} = '' OR regexp_matches({0}, '[\n\r\x{{0b}}\x{{0c}}\x{{1c}}-\x{{1e}}\x{{85}}\x{{2028}}\x{{2029}}]$') THEN 1 ELSE 0 END"


@query(
    f"""WITH t AS (SELECT conv_id, turn, text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS old FROM conversations), d AS (SELECT conv_id, turn, {_LINES.format('text')} - ({_LINES.format('old')}) AS net FROM t)
SELECT conv_id, turn, CAST(greatest(net, 0) AS INTEGER) AS added, CAST(greatest(-net, 0) AS INTEGER) AS removed, CAST(net AS INTEGER) AS net FROM d"""
)
def line_deltas(spark, sf):
    """each turn against the one before."""
    own = table(spark, sf, "conversations").withColumn("old", F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("")))
    d = loc.line_delta(F.col("old"), F.col("text"), F.lit("Markdown"))
    return own.select("conv_id", "turn", d.alias("d")).select("conv_id", "turn", "d.added", "d.removed", "d.net")


_PLAIN = "regexp_replace({0}, '[^A-Za-z0-9 ]', '', 'g')"


@query(
    f"""SELECT conv_id * 1000 + turn AS id, role || '.py' AS file, CAST(len(string_split({_PLAIN.format('text')}, ' ')) AS BIGINT) AS added, 1::BIGINT AS removed FROM conversations
UNION ALL SELECT conv_id * 1000 + turn, 'b.js', 0, 2 FROM conversations"""
)
def patch_lines(spark, sf):
    """patches of both kinds, a line a word."""
    words = F.replace(F.regexp_replace("text", "[^A-Za-z0-9 ]", ""), F.lit(" "), F.lit("\n+"))
    patch = F.concat(F.lit("-lost\n--- a/x\n+++ b/"), "role", F.lit(".py\n@@\n+"), words, F.lit("\n-old\n same\n*** Update File: b.js\n-a\n-b\n"))
    rows = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), patch.alias("patch"))
    return loc.patch_lines(rows)


@query(
    f"""WITH c AS (SELECT turn, role || '.py' AS file_path, len(string_split(trim({_PLAIN.format('text')}), ' ')) AS n FROM conversations),
e AS (SELECT CASE WHEN turn % 3 = 2 THEN '(unknown)' ELSE file_path END AS file_path, n AS added, CASE WHEN turn % 3 = 1 THEN 2 ELSE 0 END AS removed, n - CASE WHEN turn % 3 = 1 THEN 2 ELSE 0 END AS net, CASE WHEN turn % 3 = 1 THEN 2 ELSE 1 END AS operation_count FROM c)
SELECT file_path, CAST(sum(added) AS BIGINT) AS added, CAST(sum(removed) AS BIGINT) AS removed, CAST(sum(net) AS BIGINT) AS net, CAST(sum(operation_count) AS BIGINT) AS operation_count, count(DISTINCT file_path) AS files FROM e GROUP BY ROLLUP (file_path)"""
)
def written_lines(spark, sf):
    """Tool calls of three shapes, one with two edits."""
    body = F.replace(F.trim(F.regexp_replace("text", "[^A-Za-z0-9 ]", "")), F.lit(" "), F.lit("\n"))
    path = F.concat("role", F.lit(".py"))
    write = F.struct(path.alias("file_path"), body.alias("content"))
    edits = F.struct(path.alias("file_path"), F.array(F.struct(F.lit("").alias("old_string"), body.alias("new_string")), F.struct(F.lit("a\nb").alias("old_string"), F.lit("").alias("new_string"))).alias("edits"))
    block = F.to_json(F.struct(F.array(F.struct(F.lit("tool_use").alias("type"), F.lit("i").alias("id"), F.lit("Write").alias("name"), write.alias("input"))).alias("content")))
    call = F.to_json(F.struct(F.array(F.struct(F.lit("i").alias("id"), F.struct(F.lit("MultiEdit").alias("name"), F.to_json(edits).alias("arguments")).alias("function"))).alias("tool_calls")))
    item = F.to_json(F.struct(F.array(F.struct(F.lit("function_call").alias("type"), F.lit("i").alias("call_id"), F.lit("Write").alias("name"), F.to_json(F.struct(body.alias("content"))).alias("arguments"))).alias("output")))
    k = F.col("turn") % 3
    messages = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(k == 0, block).when(k == 1, call).otherwise(item).alias("payload"))
    return loc.written_summary(loc.write_events(messages))


def _payloads(spark, sf) -> DataFrame:
    """Each conversation as a chat request."""
    m = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    own = table(spark, sf, "conversations").groupBy("conv_id").agg(m.alias("m"))
    return own.select("conv_id", F.to_json(F.struct(F.lit("m").alias("model"), F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))).alias("payload"))


@query("SELECT conv_id, '$.messages[' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) || '].content' AS path, sha256(text) AS text_hash FROM conversations WHERE text <> ''")
def payload_texts(spark, sf):
    """P18, F14."""
    return payloads.text_paths(_payloads(spark, sf), "conv_id").select("conv_id", "path", F.sha2("text", 256).alias("text_hash"))


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, sha256(text) AS text_hash, 'content' AS part FROM conversations WHERE text IS NOT NULL AND NOT starts_with(ltrim(text), '[')")
def chat_texts(spark, sf):
    """T7."""
    return payloads.chat_texts(_payloads(spark, sf), "conv_id").select("conv_id", F.col("place").cast("long").alias("place"), F.sha2("text", 256).alias("text_hash"), "part")


@query("SELECT conv_id * 1000 + turn AS id, 'input' AS part, 0::BIGINT AS place, sha256(text) AS text_hash FROM conversations WHERE text IS NOT NULL UNION ALL SELECT conv_id * 1000 + turn, 'instructions', -1, sha256(role) FROM conversations")
def response_texts(spark, sf):
    """T8."""
    item = F.struct(F.lit("message").alias("type"), F.col("role"), F.col("text").alias("content"))
    own = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.to_json(F.struct(F.array(item).alias("input"), F.col("role").alias("instructions"))).alias("payload"))
    return payloads.response_texts(own).select("id", "part", F.col("place").cast("long").alias("place"), F.sha2("text", 256).alias("text_hash"))


@query(
    f"""WITH {FOUND_SQL.replace("doc_id", "conv_id").replace("FROM documents", "FROM conversations")} SELECT c.conv_id, true AS restored, count(*) FILTER (f.conv_id IS NOT NULL) > 0 AS changed
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN labelled f ON f.conv_id = c.conv_id GROUP BY c.conv_id"""
)
def payload_roundtrip(spark, sf):
    """Payloads sanitized and restored."""
    own = _payloads(spark, sf)
    known: list[DataFrame] = []

    def clean(texts: DataFrame) -> DataFrame:
        out, minted = sanitize.tokenize(texts)
        known.append(minted)
        return out

    safe = payloads.sanitize_payloads(own, clean, "conv_id")
    back = payloads.restore_payloads(safe, lambda texts: tokens.restore(texts, known[0]), "conv_id")
    both = own.join(safe.withColumnRenamed("payload", "safe"), "conv_id").join(back.withColumnRenamed("payload", "back"), "conv_id")
    return both.select("conv_id", (F.col("back") == F.col("payload")).alias("restored"), (F.col("safe") != F.col("payload")).alias("changed"))


@query(
    """SELECT CAST(conv_id AS VARCHAR) AS stream_id, CASE WHEN turn % 2 = 0 THEN 'content:0' ELSE 'call:0:1' END AS key, count(*) AS pieces, max(turn) AS last_seq,
  (SELECT max(turn) FROM conversations x WHERE x.conv_id = c.conv_id AND x.turn % 3 <> 1) AS usage FROM conversations c WHERE text IS NOT NULL GROUP BY conv_id, key"""
)
def response_stream(spark, sf):
    """Event-stream lines of contents and tool arguments, with usage on some."""
    c = table(spark, sf, "conversations").where("text is not null")
    content = F.struct(F.lit(0).alias("index"), F.struct(F.col("text").alias("content"), F.lit(None).cast("array<struct<index:int,function:struct<arguments:string>>>").alias("tool_calls")).alias("delta"))
    call = F.struct(F.lit(0).alias("index"), F.struct(F.lit(None).cast("string").alias("content"), F.array(F.struct(F.lit(1).alias("index"), F.struct(F.col("text").alias("arguments")).alias("function"))).alias("tool_calls")).alias("delta"))
    usage = F.when(F.col("turn") % 3 != 1, F.struct(F.col("turn").alias("total")))
    data = F.to_json(F.struct(F.array(F.when(F.col("turn") % 2 == 0, content).otherwise(call)).alias("choices"), usage.alias("usage")))
    lines = c.select(F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").alias("seq"), F.explode(F.array(F.concat(F.lit("data: "), data), F.lit("data: [DONE]"), F.lit(": ping"))).alias("line"))
    chunks = readers.response_chunks(lines).where("data is not null")
    pieces = payloads.stream_pieces(chunks).groupBy("stream_id", "key").agg(F.count("*").alias("pieces"), F.max("seq").alias("last_seq"))
    final = readers.final_usage(chunks).select("stream_id", F.get_json_object("usage", "$.total").cast("long").alias("usage"))
    return pieces.join(final, "stream_id", "left").select("stream_id", "key", "pieces", "last_seq", "usage")


@query(
    """SELECT collection, field, kind, pii, n FROM (SELECT unnest(['customer', 'customer', 'customer', 'supplier', 'supplier']) AS collection, unnest(['c_custkey', 'c_name', 'c_mktsegment', 's_name', 's_suppkey']) AS field,
  unnest(['text', 'text', 'text', 'text', 'text']) AS kind, unnest(['', 'person', '', 'person', '']) AS pii), (SELECT count(*) AS c FROM customer), (SELECT count(*) AS s FROM supplier), LATERAL (SELECT CASE WHEN collection = 'customer' THEN c ELSE s END AS n)"""
)
def source_fields(spark, sf):
    """Fields of two sources with their hints, and how many cells each has."""
    tables = {"customer": dealt(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), "supplier": dealt(spark, sf, "supplier").select("s_name", "s_suppkey")}
    cells = None
    for name, df in tables.items():
        n = df.select(*[F.count(c).alias(c) for c in df.columns]).unpivot([], df.columns, "field", "n").withColumn("collection", F.lit(name))
        cells = n if cells is None else cells.unionByName(n)
    return readers.fields(tables).join(cells, ["collection", "field"]).select("collection", "field", "kind", "pii", "n")


@query(f"WITH {FOUND_SQL} SELECT doc_id, CAST(count(*) AS INTEGER) AS patches FROM labelled GROUP BY doc_id")
def span_patches(spark, sf):
    """patches found again from the texts before and after and the tokens."""
    own = docs(spark, sf)
    out, _ = sanitize.tokenize(own)
    rows = own.withColumnRenamed("text", "before").join(out.select("doc_id", F.col("sanitized").alias("after"), "tokens"), "doc_id").where(F.size("tokens") > 0)
    return sanitize.span_patches(rows).select("doc_id", F.size("patch").alias("patches"))


@query(r"WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:\d{1,3}\.){3}\d{1,3}')) AS value FROM documents) SELECT doc_id, count(DISTINCT value) AS n FROM m GROUP BY doc_id")
def verified_addresses(spark, sf):
    """Two verifiers over sanitized texts, one with the labels of another naming."""
    def rule(texts: DataFrame) -> DataFrame:
        return detect.entities(texts, ceiling=None).where("label = 'IP_ADDRESS'")

    def other(texts: DataFrame) -> DataFrame:
        return sanitize.mapped_labels(rule(texts).withColumn("label", F.lit("IPv4")), {"ipv4": "IP_ADDRESS"})

    out, _ = sanitize.tokenize(docs(spark, sf), verifiers=[rule, other])
    found = out.select("doc_id", F.size(F.filter(F.map_keys("tokens"), lambda t: F.startswith(t, F.lit("[VERIFIED_IP_ADDRESS_")))).cast("long").alias("n"))
    return found.where("n > 0")
