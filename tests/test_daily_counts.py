"""Counts a day against the scan of all events, after additions, a merge and a prune."""

import random

from pyspark.sql import functions as F

from lethe.operators import audit

Q = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def test_equal_to_the_full_scan(spark, tmp_path):
    r = random.Random(1)
    rows = [(f"2024-03-{r.randint(1, 6):02d} 0{r.randint(0, 9)}:00:00", r.choice("ab"), r.choice([None, float(r.randint(-5, 60)), r.random() * 1000])) for _ in range(900)]
    events = spark.createDataFrame(rows, "ts string, source string, ms double").withColumn("ts", F.col("ts").cast("timestamp"))
    store = audit.DailyCounts(spark, str(tmp_path / "counts"), ["source"], "ms")
    parts = events.randomSplit([1.0, 1.0, 1.0], 3)
    for k, part in enumerate(parts):
        store.add(part)
        if k == 1:
            store.compact("2024-03-03")
    store.drop_before("2024-03-02")
    assert store.days() == [f"2024-03-{d:02d}" for d in range(2, 7)]
    for first, last in ((None, None), ("2024-03-03", "2024-03-04"), ("2024-03-06", None), ("2025-01-01", None)):
        kept = events.where(F.to_date("ts").between(max(first or "", "2024-03-02"), last or "9999-01-01"))
        want = {x.source: x for x in audit.latency_summary(kept).collect()}
        got = {x.source: x for x in store.summary(Q, first, last).collect()}
        assert set(got) == set(want)
        for s, x in got.items():
            y = want[s]
            assert (x.n, x.min, x.max, x.p50, x.p95, x.p99) == (y.n, y.min, y.max, y.p50, y.p95, y.p99) and abs(x.avg - y.avg) < 1e-9
