"""Detection quality: true and false positives, precision, recall, F1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scored(results: DataFrame) -> DataFrame:
    """Rows (config, expected, detected) with tp, fp, fn by case-insensitive sets."""
    norm = lambda c: F.array_distinct(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda v: F.lower(F.trim(v))))
    e, d = norm("expected"), norm("detected")
    return results.withColumn("tp", F.size(F.array_intersect(e, d))).withColumn("fp", F.size(F.array_except(d, e))).withColumn("fn", F.size(F.array_except(e, d)))


def summary(rows: DataFrame, by: str = "config") -> DataFrame:
    """A10: sums and micro precision, recall and F1 by configuration; a ratio without cases is 0."""
    sums = rows.groupBy(by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))
