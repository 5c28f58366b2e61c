"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, fill_middle, importance, language_id, simhash, tiff, token_file, toxicity, warc_revisits
from .cutting import digest
from .near_dup import near_duplicates
from .substring_dedup import remove_repeated_words
from .suffix_dedup import remove_repeated_bytes


ARROW_ROWS = 2000  # rows of an Arrow batch: whole texts are long, and both sides hold a batch in memory


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(of: int) -> Column:
    """crc32 of the decimal doc_id, modulo `of`."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(5) == 0
    filters = language_id.fit(docs.where(~held_out))
    return language_id.predict(docs, filters).withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score")


def op2_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = tiff.text_images(table(spark, sf_dir, "documents"))
    return tiff.page_digests(tiff.tiff_pages(images, "id", "content"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(remove_repeated_words(table(spark, sf_dir, "documents")), "n_words")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(3) == 1
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs, labels.where(~held_out))
    scored = toxicity.scores(docs, model).withColumn("held_out", held_out)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc_revisits.resolve_revisits(warc_revisits.records_of(table(spark, sf_dir, "pages")))
    return found.select("revisit_id", "canonical", "response_id", "status", warc_revisits.header_lines(F.col("headers")).alias("headers"))


OP6_SQL = r"""
WITH page AS (
  SELECT page_id, url, coalesce(html, '') AS html, regexp_replace(trim(url), '#.*$', '') AS bare,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(page_id) AS first,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(page_id + 1 + page_id % 9973) AS later
  FROM pages
), keyed AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), '(^[^@]*@)|(:(80|443)$)', '', 'g'), '^(www|m)\.', '')
    || regexp_replace(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') AS place,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$'))), '&') AS query
  FROM page
), full_page AS (
  SELECT *, place || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical, '"' || md5(html) || '"' AS etag FROM keyed
), captures AS (
  SELECT page_id * 2 AS record_id, 1 AS is_full, canonical, first AS captured FROM full_page
  UNION ALL SELECT page_id * 2 + 1, 0, canonical, later FROM full_page
), latest AS (
  SELECT *, last_value(CASE WHEN is_full = 1 THEN record_id END IGNORE NULLS) OVER (
    PARTITION BY canonical ORDER BY captured, is_full, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS response_id
  FROM captures
), found AS (
  SELECT a.record_id AS revisit_id, a.canonical, a.response_id, r.page_id % 5 AS turn, r.etag AS own_etag, r.first AS own_first, r.later,
         s.etag, s.first, s.html,
         CASE WHEN a.response_id IS NULL THEN 'unresolved'
              WHEN r.page_id % 5 = 0 THEN 'mismatch'
              WHEN r.page_id % 5 = 1 THEN CASE WHEN r.first = s.first THEN 'resolved' ELSE 'mismatch' END
              WHEN r.page_id % 5 = 2 THEN 'unchecked'
              WHEN r.etag = s.etag THEN 'resolved' ELSE 'mismatch' END AS status
  FROM latest a JOIN full_page r ON a.record_id = r.page_id * 2 + 1 LEFT JOIN full_page s ON a.response_id = s.page_id * 2
  WHERE a.is_full = 0
)
SELECT revisit_id, canonical, response_id, status,
  CASE WHEN status IN ('resolved', 'unchecked') THEN
    'cache-control: max-age=60' || chr(10) || 'content-length: ' || strlen(html) || chr(10) || 'content-type: text/html' || chr(10)
    || 'date: ' || strftime(later, '%Y-%m-%d %H:%M:%S') || chr(10) || 'etag: ' || CASE WHEN turn IN (3, 4) THEN 'W/' || own_etag ELSE etag END || chr(10)
    || 'last-modified: ' || strftime(CASE WHEN turn = 1 THEN own_first ELSE first END, '%Y-%m-%d %H:%M:%S') END AS headers
FROM found
"""


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(remove_repeated_bytes(table(spark, sf_dir, "documents")), "n_bytes", "n_spans")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.digests(byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)


def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        model = f.read()
    return token_file.tokenized(table(spark, sf_dir, "documents"), model, 2)


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), simhash.hex_digits(F.col("print")).alias("fingerprint"), F.col("component").alias("component_id"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), "n_features", "weight", "score", "rank")


OP12_SQL = r"""
WITH step AS (
  SELECT list(v ORDER BY i) AS steps FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) AS t(i))
), own AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), used AS (
  SELECT r, unnest(words) AS word FROM own
), aim AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
), hexed AS (
  SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM used UNION SELECT word FROM aim)
), bytes AS (
  SELECT word, [CAST('0x' || substr(h, 2 * k + 1, 2) AS BIGINT) FOR k IN range(length(h) // 2)] AS b FROM hexed
), hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c // 256, steps[1 + (xor(c, x) & 255)])), 4294967295) % 10000 AS bucket FROM bytes, step
), corpus AS (SELECT bucket, count(*) AS s FROM used JOIN hashed USING (word) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS t FROM aim JOIN hashed USING (word) GROUP BY bucket),
total AS (SELECT CAST((SELECT coalesce(sum(s), 0) FROM corpus) AS DOUBLE) + 10000 AS all_s, CAST((SELECT coalesce(sum(t), 0) FROM target) AS DOUBLE) + 10000 AS all_t),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * all_s / ((s + 1) * all_t))) AS BIGINT) AS g FROM corpus LEFT JOIN target USING (bucket), total
), weighed AS (
  SELECT r, count(*) AS n, CAST(sum(g) AS BIGINT) AS w FROM used JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY r
), scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(w, 0) AS weight,
    coalesce(w, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM own LEFT JOIN weighed USING (r)
), ranked AS (
  SELECT *, n_features >= 20 AND score IS NOT NULL AS fit, row_number() OVER (PARTITION BY n_features >= 20 AND score IS NOT NULL ORDER BY score DESC, doc_id) AS place FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= (SELECT count(*) FROM ranked WHERE fit) * 10 // 100 THEN place END AS rank FROM ranked
"""


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fill_middle(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH own AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS drawn FROM documents
), numbers AS (
  SELECT *, len(lines) AS n, [CAST('0x' || substr(drawn, 1 + 8 * k, 8) AS BIGINT) FOR k IN range(4)] AS h FROM own
), planned AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM numbers
), parts AS (
  SELECT *, coalesce(array_to_string(lines[1:a], ''), '') AS p, coalesce(array_to_string(lines[a + 1:b], ''), '') AS m, coalesce(array_to_string(lines[b + 1:], ''), '') AS s FROM planned
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_tiff, op3_benchmark_decontamination, op4_substring_dedup, op5_toxicity, op6_warc_revisits, op7_minhash_near_dedup, op8_suffix_dedup, op9_byte_bpe, op10_token_file, op11_simhash_near_dedup, op12_importance_resampling, op13_fill_middle)}


def oracle_sql() -> dict[str, str]:
    return {"op6_warc_revisits": OP6_SQL, "op12_importance_resampling": OP12_SQL, "op13_fill_middle": OP13_SQL}
