"""Translation memory: lookup, misses, upsert, and maps built from segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locengine.functions.text import strip_ws
from locengine.operators.ordering import latest_by


def usable(memory: DataFrame) -> DataFrame:
    """Entries that count as hits: an empty stored target is a miss."""
    return memory.filter(F.col("target").isNotNull() & (F.col("target") != ""))


def lookup_memory(segments: DataFrame, memory: DataFrame) -> DataFrame:
    """Fill ``translated_text`` from the memory and set ``cache_hit``.

    The memory has one row per source. A text that fills much of the segment table makes
    one join partition large; adaptive execution splits that partition, since the segment
    side is the preserved side of the join.
    """
    entries = usable(memory).select(
        F.col("source").alias("text"), F.col("target").alias("_target")
    )
    base = segments.drop("translated_text", "cache_hit")
    return base.join(entries, "text", "left").select(
        *base.columns,
        F.col("_target").alias("translated_text"),
        F.col("_target").isNotNull().alias("cache_hit"),
    )


def memory_misses(segments: DataFrame, memory: DataFrame) -> DataFrame:
    """Distinct texts without a usable entry.

    Texts are made distinct before the join, so repeated texts collapse in each task and
    the join reuses the partitioning of the distinct step.
    """
    texts = segments.select("text").distinct()
    known = usable(memory).select(F.col("source").alias("text"))
    return texts.join(known, "text", "left_anti")


def upsert_memory(memory: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or replace accepted pairs; the highest ``seq`` of a source wins."""
    columns = ["source", "target", "seq"]
    return latest_by(memory.select(*columns).unionByName(new.select(*columns)), ["source"], ["seq"])


def write_memory(memory: DataFrame, path: str, version: int) -> str:
    """Write a memory version; readers of earlier versions are not disturbed."""
    target = f"{path.rstrip('/')}/version={version}"
    memory.write.mode("errorifexists").parquet(target)
    return target


def latest_memory(spark: SparkSession, path: str) -> DataFrame:
    """The last version that ``write_memory`` finished; one that is being written is not seen."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, "version=*/_SUCCESS"))
    versions = [int(f.getPath().getParent().getName().partition("=")[2]) for f in found or []]
    if not versions:
        raise ValueError(f"no memory version below {path}")
    return spark.read.parquet(f"{path.rstrip('/')}/version={max(versions)}")


def build_translation_map(segments: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Distinct trimmed source to target; blanks and identity pairs dropped, last wins.

    ``seq`` is that of the pair that won, ``first_seq`` the first place of the source: phrases
    of equal length are replaced in the order of their first places.
    """
    pairs = segments.select(
        *keys,
        "seq",
        strip_ws(F.col("text")).alias("source"),
        strip_ws(F.col("translated_text")).alias("target"),
    ).filter("source <> '' AND target <> '' AND source <> target")
    last = F.max(F.struct("seq", "target")).alias("last")
    return pairs.groupBy(*keys, "source").agg(last, F.min("seq").alias("first_seq")).select(
        *keys, "last.seq", "source", "last.target", "first_seq"
    )


def merge_reviewed(segments: DataFrame, reviewed: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Reviewed targets into segments by trimmed source; unmatched segments unchanged.

    Adds ``reviewed``: whether the segment was matched.
    """
    pairs = reviewed.select(
        *keys,
        "seq",
        strip_ws(F.col("text")).alias("_key"),
        strip_ws(F.col("translated_text")).alias("_target"),
    ).filter("_key <> '' AND _target <> ''")
    last = latest_by(pairs, [*keys, "_key"], ["seq"]).drop("seq")
    columns = [c for c in segments.columns if c != "translated_text"]
    return (
        segments.withColumn("_key", strip_ws(F.col("text")))
        .join(last, [*keys, "_key"], "left")
        .select(
            *columns,
            F.coalesce("_target", "translated_text").alias("translated_text"),
            F.col("_target").isNotNull().alias("reviewed"),
        )
    )
