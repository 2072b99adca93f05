"""Limits, session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Limits:
    max_inline_tags: int = 8
    max_segment_chars: int = 400
    chunk_chars: int = 3000
    batch_max_chars: int = 3000
    batch_max_segments: int = 5
    max_retries: int = 3
    temperature: float = 0.3
    context_tokens: int = 8192  # what a model is asked to keep of prompt and reply
    high_threshold: float = 0.85
    low_threshold: float = 0.60
    review_threshold: float = 0.6
    recent_jobs: int = 20


LIMITS = Limits()

# Adaptive execution picks join sides from measured sizes and splits skewed join
# partitions; both are defaults of Spark and are pinned here so that a cluster default
# cannot switch them off unnoticed.
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Rows sent to Python workers can be large (packages, batches, documents), and several workers
    # of a task hold a batch, its Python objects and what they make of it at the same time.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


_LOCAL: dict[str, str] = {}  # folders of local sessions without the setting, by application


def work_dir(spark: SparkSession) -> str:
    """Shared folder for written tables: ``spark.checkpoint.dir`` of the session.

    Only a local session without the setting gets a temporary folder; a cluster must
    name one that all executors see.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        own = spark.sparkContext.applicationId
        if own not in _LOCAL:
            _LOCAL[own] = tempfile.mkdtemp(prefix="locengine-")
        root = _LOCAL[own]
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scratch: list[str] | None = None


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Used after model calls: a written table is never inferred again when an executor is
    lost or when several consumers read it, and it cuts the lineage. The shuffle files of the
    write are removed as soon as it is done, since nothing reads them again.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_SHUFFLES, None)
    spark.conf.set(_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_SHUFFLES) if before is None else spark.conf.set(_SHUFFLES, before)
    if _scratch is not None:
        _scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(paths: list[str]):
    """Note the tables that ``materialise`` writes meanwhile, for ``release``."""
    global _scratch
    before, _scratch = _scratch, paths
    try:
        yield paths
    finally:
        _scratch = before


def release(spark: SparkSession, paths: list[str]) -> None:
    """Remove written tables that no DataFrame needs any more."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
