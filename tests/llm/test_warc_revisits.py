import datetime as dt

import pytest
from pyspark.sql import functions as F

from lethe.llm import warc_revisits as R


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://WWW.Ex.com:80/a/#x", "ex.com/a"),
        ("https://m.ex.com/a?b=2&utm_source=q&a=1&ref=x", "ex.com/a?a=1&b=2"),
        ("https://u@ex.com:8443/P/", "ex.com:8443/P"),
        ("http://ex.com", "ex.com"),
        ("http://ex.com?q", "ex.com?q"),
        ("nonsense", None),
        ("", None),
        (None, None),
    ],
)
def test_canonical(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(R.canonical_url(F.col("u")).alias("c")).first().c == want


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


SCHEMA = "record_id long, kind string, url string, date timestamp, headers map<string,string>, status string"


def brute(records):
    import re

    def canon(u):
        return None if u is None else re.sub(r"#.*", "", u).lower().rstrip("/").split("://")[1]

    out = {}
    for i, kind, url, date, sent, _ in records:
        if kind != "revisit":
            continue
        best = None
        for j, k, u, d, h, _ in records:
            if k == "response" and url and u and d and date and canon(u) == canon(url) and d < date and (best is None or (d, j) > best[:2]):
                best = d, j, h
        sent = {k.lower(): v for k, v in (sent or {}).items()}
        if best is None:
            out[i] = (None, "unresolved", None)
            continue
        stored = {k.lower(): v for k, v in (best[2] or {}).items()}
        status = "unchecked"
        if sent.get("etag") is not None:
            status = "resolved" if (stored.get("etag") or "").removeprefix("W/") == sent["etag"].removeprefix("W/") else "mismatch"
        elif sent.get("last-modified") is not None:
            status = "resolved" if stored.get("last-modified") == sent["last-modified"] else "mismatch"
        merged = stored | {k: v for k, v in sent.items() if k in R.PERMITTED and v is not None}
        out[i] = (best[1], status, merged if status != "mismatch" else None)
    return out


def test_against_brute_force(spark):
    import random

    r = random.Random(4)
    records = []
    for i in range(400):
        url = r.choice(["http://a.x/p", "https://A.x/p/", "http://a.x/q#z", None, "http://b.x/" + str(r.randrange(30))])
        date = None if r.random() < 0.03 else at(r.randint(1, 9), r.randint(0, 3))
        kind = r.choice(["response", "revisit", "revisit", "request"])
        headers = r.choice([None, {"ETag": r.choice(['"1"', 'W/"1"', '"2"']), "Date": str(i), "Content-Length": "0"}, {"Last-Modified": r.choice("ab")}, {"eTag": None, "Vary": "x"}])
        records.append((i, kind, url, date, headers, "clash"))
    got = {x.revisit_id: (x.response_id, x.status, x.headers) for x in R.resolve_revisits(spark.createDataFrame(records, SCHEMA)).collect()}
    assert got == brute(records)


def test_edges(spark):
    assert R.resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0
    one = (1, "response", "http://a/", at(1), {"A": "1", "a": "2"}, None)
    two = (2, "revisit", "http://a", at(2), None, None)
    rows = R.resolve_revisits(spark.createDataFrame([one, one, two, two], SCHEMA)).collect()
    assert [(r.revisit_id, r.response_id, r.status, r.headers) for r in rows] == [(2, 1, "unchecked", {"a": "2"})] * 2


def test_large_page_ids_and_repeated_ids(spark):
    pages = spark.createDataFrame([(3_000_000_000, "http://a.example/x", "<p>"), (7, "http://a.example/y", None)], "page_id long, url string, html string")
    assert {r.status for r in R.resolve_revisits(R.records_of(pages)).collect()} == {"mismatch", "unchecked"}
    rows = [(1, "response", "http://e.com/a", at(1), {"etag": "b"}), (1, "response", "http://e.com/a", at(1), {"etag": "a"}), (2, "revisit", "http://e.com/a", at(2), {"etag": "a"}), (2, "revisit", "http://e.com/a", at(3), {"etag": "a"})]
    got = R.resolve_revisits(spark.createDataFrame(rows, "record_id long, kind string, url string, date timestamp, headers map<string,string>")).collect()
    assert [(r.revisit_id, r.response_id, r.status, r.headers) for r in got] == [(2, 1, "resolved", {"etag": "a"})] * 2


def test_one_url_and_moment_with_a_third_of_all_captures(spark):
    import random

    r = random.Random(6)
    records = []
    for i in range(600):
        hot = i % 3 == 0
        url, date = ("http://a.x/hot", at(5, 1)) if hot else (r.choice(["http://a.x/hot", "http://a.x/b"]), at(r.randint(4, 6), r.randint(0, 23)))
        records.append((i, r.choice(["response", "revisit", "revisit"]), url, date, {"etag": r.choice("12")}, None))
    got = {x.revisit_id: (x.response_id, x.status, x.headers) for x in R.resolve_revisits(spark.createDataFrame(records, SCHEMA)).collect()}
    assert got == brute(records)
