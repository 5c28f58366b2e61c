"""WARC not-modified revisits: an as-of join by canonical URL to the latest earlier full response.

The join runs over distinct (URL, date) pairs in two levels, so that a URL with a large share of all captures isn't
sorted by one task: inside a time bucket by a window over (URL, bucket), and from bucket to bucket over one row each.
Dates of whole seconds bound a window by BUCKET_SECONDS rows.  Revisits then find their pair by an equi-join, which
AQE splits where one is hot; only ids and dates go through it, headers are joined afterwards by id.

A revisit's validators are checked (ETag by weak comparison, else Last-Modified), then the headers that a 304 may
update replace the response's own.

Defined results: a revisit without URL or date, or with no response of an earlier date, is `unresolved`; of
responses of one date the larger id counts; validators that differ give `mismatch` with the response's id but
no headers; a revisit without validators is `unchecked`; repeated revisits (same id) are each resolved, to the
largest id of a response that one of them leads to; of repeated responses (same id) the headers count that sort first; header names are compared in lower case; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET_SECONDS = 21_600
# Headers that a 304 response sends to update the stored ones (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary", "last-modified")
# Query parameters that don't pick a document.
IGNORED = r"^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$"
_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www., m. or default port; path without a last slash; sorted query; no scheme, fragment or tracking."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, _AUTHORITY, 1)), r"(^[^@]*@)|(:(80|443)$)", "")
    host = F.regexp_replace(host, r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(IGNORED))), "&")
    return F.when(bare.rlike(_AUTHORITY), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _lower_names(headers: Column) -> Column:
    """Header names in lower case; of names that then clash the one that sorts last stays."""
    pairs = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    return F.aggregate(
        pairs,
        F.create_map().cast("map<string,string>"),
        lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != F.lower(e["key"])), F.create_map(F.lower(e["key"]), e["value"])),
    )


def _opaque(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """records (record_id, kind, url, date, headers) -> (revisit_id, canonical, response_id, status, headers).

    kind: `response` or `revisit`; others are ignored.
    """
    own = records.where(F.col("kind").isin("response", "revisit")).select("record_id", (F.col("kind") == "response").cast("int").alias("full"), canonical_url(F.col("url")).alias("canonical"), F.col("date").cast("timestamp").alias("date"), "headers")
    keyed = own.where("canonical is not null and date is not null").withColumn("bucket", F.floor(F.unix_timestamp("date") / BUCKET_SECONDS))
    # A row a URL and date: captures of one moment, however many, are one row in both windows.
    moments = keyed.groupBy("canonical", "bucket", "date").agg(F.max(F.when(F.col("full") == 1, F.col("record_id"))).alias("response_id"))
    response = F.when(F.col("response_id").isNotNull(), F.struct("date", "response_id"))
    inside = W.partitionBy("canonical", "bucket").orderBy("date").rowsBetween(W.unboundedPreceding, -1)
    near = moments.select("canonical", "bucket", "date", F.last(response, ignorenulls=True).over(inside).alias("near"))
    lasts = moments.groupBy("canonical", "bucket").agg(F.max(response).alias("last"))
    across = W.partitionBy("canonical").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = lasts.select("canonical", "bucket", F.last("last", ignorenulls=True).over(across).alias("far"))
    asof = near.join(carried, ["canonical", "bucket"], "left").select("canonical", "date", F.coalesce("near.response_id", "far.response_id").alias("response_id"))
    revisits = own.where("full = 0").select(F.col("record_id").alias("revisit_id"), "canonical", _lower_names(F.col("headers")).alias("sent"))
    stored = own.where("full = 1").select(F.col("record_id").alias("response_id"), _lower_names(F.col("headers")).alias("stored"))
    responses = stored.groupBy("response_id").agg(F.min_by("stored", header_lines(F.col("stored"))).alias("stored"))
    asked = keyed.where("full = 0").select(F.col("record_id").alias("revisit_id"), "canonical", "date")
    known = asked.join(asof, ["canonical", "date"]).groupBy("revisit_id").agg(F.max("response_id").alias("response_id"))
    joined = revisits.join(known, "revisit_id", "left").join(responses, "response_id", "left")
    etag, changed = F.col("sent")["etag"], F.col("sent")["last-modified"]
    status = (
        F.when(F.col("response_id").isNull(), "unresolved")
        .when(etag.isNotNull(), F.when(_opaque(etag) == _opaque(F.col("stored")["etag"]), "resolved").otherwise("mismatch"))
        .when(changed.isNotNull(), F.when(changed == F.col("stored")["last-modified"], "resolved").otherwise("mismatch"))
        .otherwise("unchecked")
    )
    update = F.map_filter("sent", lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    merged = F.map_concat(F.map_filter("stored", lambda k, v: ~F.map_contains_key(update, k)), update)
    return joined.withColumn("status", status).select("revisit_id", "canonical", "response_id", "status", F.when(F.col("status").isin("resolved", "unchecked"), merged).alias("headers"))


def header_lines(headers: Column) -> Column:
    """Headers as sorted `name: value` lines."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))), "\n")


EPOCH = "2024-01-01 00:00:00"


def records_of(pages: DataFrame) -> DataFrame:
    """Two captures of each page (page_id, url, html): the full response, and a later revisit that the server answered with 304.

    By page_id, a fifth of the revisits carry a foreign ETag, a fifth only Last-Modified, a fifth no validator.
    """
    at = lambda minutes: F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH)) + minutes * 60)
    stamp = lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss")
    page = F.col("page_id")
    first, later = at(page), at(page + 1 + page % 9973)
    etag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    full = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("ETag"), etag, F.lit("Last-Modified"), stamp(first), F.lit("Date"), stamp(first), F.lit("Cache-Control"), F.lit("max-age=3600"))
    turn = page % 5
    sent = F.create_map(F.lit("Date"), stamp(later), F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Content-Length"), F.lit("0"), F.lit("Server"), F.lit("x"))
    sent = F.map_concat(sent, F.when(turn == 0, F.create_map(F.lit("etag"), F.lit('"other"'))).when(turn == 1, F.create_map(F.lit("last-modified"), stamp(first))).when(turn == 2, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("etag"), F.concat(F.lit("W/"), etag))))
    variant = F.concat(F.col("url"), F.when(F.col("url").contains("#"), "").otherwise("#again"))
    return pages.select((page * 2).alias("record_id"), F.lit("response").alias("kind"), "url", first.alias("date"), full.alias("headers")).unionByName(pages.select((page * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), variant.alias("url"), later.alias("date"), sent.alias("headers")))
