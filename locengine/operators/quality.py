"""Confidence of translated segments and its report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locengine.functions.text import (
    Profile,
    has_script,
    is_blank,
    strip_tags,
    strip_ws,
    tags_match,
)


def confidence(
    source: Column,
    target: Column,
    retry_count: Column,
    cache_hit: Column,
    p: str | Profile = "ja",
) -> Column:
    """0..1 from script left over, tags, length ratio, retries and memory hits."""
    source_length = F.greatest(F.length(strip_ws(source)), F.lit(1))
    ratio = F.length(strip_ws(target)) / source_length
    retries = F.least(F.coalesce(retry_count, F.lit(0)), F.lit(3))
    score = (
        F.lit(1.0)
        - F.when(has_script(strip_tags(target, self_closing=True), p), 0.5).otherwise(0.0)
        - F.when(tags_match(source, target, self_closing=True), 0.0).otherwise(0.4)
        - F.when((ratio < 0.3) | (ratio > 3.0), 0.3).otherwise(0.0)
        - F.greatest(retries, F.lit(0)) * 0.1
    )
    score = F.when(
        F.coalesce(cache_hit, F.lit(False)), F.least(score + 0.2, F.lit(1.0))
    ).otherwise(score)
    return F.when(is_blank(target), 0.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(score, 2)))
    )


def score(segments: DataFrame, p: str | Profile = "ja") -> DataFrame:
    return segments.withColumn(
        "confidence",
        confidence(
            F.col("text"),
            F.col("translated_text"),
            F.col("retry_count"),
            F.col("cache_hit"),
            p,
        ),
    )


def bucket(conf: Column, high: float = 0.85, low: float = 0.60) -> Column:
    return F.when(conf >= high, "high").when(conf < low, "low").otherwise("medium")


def classify(
    segments: DataFrame, p: str | Profile = "ja", high: float = 0.85, low: float = 0.60
) -> DataFrame:
    return score(segments, p).withColumn("bucket", bucket(F.col("confidence"), high, low))


def confidence_stats(classified: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Totals, bucket counts, share of high and average; zero rows give zeros.

    Scores have two decimals, so the average is taken over whole hundredths: the result
    does not depend on the order in which partitions are added up.
    """
    counts = [
        F.count_if(F.col("bucket") == name).alias(f"{name}_count")
        for name in ("high", "medium", "low")
    ]
    hundredths = F.sum(F.round(F.col("confidence") * 100).cast("bigint"))
    whole = F.greatest(F.col("total"), F.lit(1))
    return (
        classified.groupBy(*keys)
        .agg(
            F.count("*").alias("total"),
            *counts,
            F.coalesce(hundredths, F.lit(0)).alias("_h"),
        )
        .select(
            *keys,
            "total",
            "high_count",
            "medium_count",
            "low_count",
            (F.col("high_count") / whole * 100).alias("high_pct"),
            (F.col("_h") / 100.0 / whole).alias("avg_confidence"),
        )
    )


def bucket_report(classified: DataFrame, key: str = "doc_id") -> DataFrame:
    """Segments per document and bucket, with subtotals and the corpus total."""
    return classified.rollup(key, "bucket").agg(F.count("*").alias("segments"))
