"""The corpus pipeline: five stages from raw documents to a mixed training corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read as the next stage's docs. All but the last return the columns of documents. A stage begins
by removing the tables that the stage before it wrote on its way: its result is written by then.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locengine.config import materialise, release, scratch
from locengine.llm import decontaminate, jaccard, langid, mixing, substrings
from locengine.llm.common import prepare

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_tables: dict[str, list[str]] = {}  # that a stage wrote on its way, by its name
MIN_SCORE = 0.3  # below it no learned language fits


def stage(after: str | None = None) -> Callable[[Stage], Stage]:
    """A stage, which removes what the stage `after` which it comes wrote on its way."""

    def of(fn: Stage) -> Stage:
        own = _tables.setdefault(fn.__name__, [])

        @functools.wraps(fn)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            release(spark, _tables.get(after, []))
            with scratch(own):
                return fn(prepare(spark), docs, sf_dir)

        return run_stage

    return of


@stage()
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no letters, or no learned language fits."""
    known = docs.where(~langid.held_out("doc_id")).select("text", "lang")
    return langid.drop_unknown(docs, langid.fit(known), least=MIN_SCORE)


@stage("language_id")
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles of five words at 0.8 or more, that with the least id stays."""
    return jaccard.keep_one(docs, n=5, percent=80)


@stage("near_duplicates")
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go out of the texts; every document stays.

    A text that loses words is its other words joined by one space; n_chars follows.
    """
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    text = f"c{docs.columns.index('text')}"
    made = substrings.remove_repeats(plain, text=text)
    changed = F.col("n_removed") > 0
    made = made.withColumn(text, F.when(changed, F.col("kept")).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        count = f"c{docs.columns.index('n_chars')}"
        made = made.withColumn(
            count, F.when(changed, F.length(text).cast("long")).otherwise(F.col(count))
        )
    return made.drop("n_words", "n_removed", "spans", "kept").toDF(*docs.columns)


@stage("substring_dedup")
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    made = decontaminate.decontaminate(
        plain, benchmark, text=f"c{docs.columns.index('text')}"
    )
    kept = made.where("not contaminated").select(*plain.columns)
    return kept.toDF(*docs.columns)


@stage("decontamination")
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed by temperature: every document is used, none of a source more than twice."""
    return mixing.mix(docs, max_repeats=2.0)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("mixture", mixture),
]
# Language ID is a trained network, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
