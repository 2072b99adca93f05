"""Plans: what is shuffled, what is not, and how a hot key is spread."""

import random

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from locengine.config import configure
from locengine.operators import extract, jobs, memory, runs
from locengine.operators.ordering import latest_by, pack_batches

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_query_has_a_product_join(spark, name):
    text = plan(queries()[name](spark, DATA))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def stored(spark, tmp_path, df, files=8):
    path = str(tmp_path / "table")
    df.repartition(files).write.parquet(path)
    return spark.read.parquet(path)


def test_document_work_needs_no_shuffle(spark, tmp_path):
    docs = stored(
        spark, tmp_path, spark.createDataFrame([(1, "文", "x")], "doc_id long, text string, unused string")
    )
    for df in (
        extract.extract_text(docs),
        extract.mark_lines(docs),
        extract.split_pieces(extract.extract_text(docs)),
    ):
        text = plan(df)
        assert "Exchange" not in text and "Window" not in text
        assert "unused" not in text


def test_aggregates_combine_before_the_shuffle(spark):
    df = spark.createDataFrame([("d", 0, "文", "x")], "doc_id string, seq long, text string, translated_text string")
    events = spark.createDataFrame([(1, 1, None, "failed")], "job_id long, event_id long, ts timestamp, status string")
    for out in (
        extract.dedup_segments(df),
        latest_by(df, ["text"], ["seq"]),
        memory.build_translation_map(df),
        jobs.latest_status(events),
    ):
        text = plan(out)
        assert "partial_" in text and "Window" not in text


def test_packing_shuffles_lengths_once(spark):
    df = spark.createDataFrame(
        [(d, i, "x" * i) for d in range(3) for i in range(20)], "doc_id long, seq long, text string"
    )
    text = final_plan(pack_batches(df, 50, 5, bucket=4))
    assert "ReusedExchange" in text
    exchanged = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanged and not any("text" in line for line in exchanged)


@pytest.fixture()
def small_thresholds(spark):
    """Limits small enough that the tables of a test count as large."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield configure(spark)
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_hot_text_is_split_in_the_lookup(spark, small_thresholds, tmp_path):
    """One text holds half of the rows; its join partition is cut into several tasks."""
    rng = random.Random(2)
    rows = [(i, "hot" if i % 2 else f"t{rng.randint(0, 5000)}", "p" * 40 + str(rng.random())) for i in range(8000)]
    segments = stored(spark, tmp_path, spark.createDataFrame(rows, "seq long, text string, pay string"))
    table = spark.createDataFrame([("hot", "H")] + [(f"t{i}", f"T{i}") for i in range(3000)], "source string, target string")
    out = memory.lookup_memory(segments, table)
    text = final_plan(out)
    assert "skew=true" in text and "skewed" in text
    assert out.filter("text = 'hot' AND translated_text = 'H'").count() == 4000
    assert out.count() == 8000


def test_a_hot_document_is_packed_in_buckets(spark):
    """All rows belong to one document; no group holds more than a bucket of them."""
    df = spark.range(20_000).select(
        F.lit("hot").alias("doc_id"), F.col("id").alias("seq"), F.repeat(F.lit("x"), F.lit(10)).alias("text")
    )
    out = pack_batches(df, 3000, 5, bucket=512)
    sizes = out.groupBy("batch_id").count()
    assert sizes.count() == 4000 and sizes.filter("count <> 5").count() == 0
    assert out.select(F.max("batch_id")).head()[0] == 3999


def test_a_hot_paragraph_text_keeps_all_rows(spark):
    rows = [("d", i, "同じ") for i in range(3000)] + [("d", 3000, "別")]
    df = spark.createDataFrame(rows, "doc_id string, seq long, text string")
    tmap = spark.createDataFrame([("d", "同じ", "same")], "doc_id string, source string, target string")
    out = runs.match_paragraphs(df, tmap)
    assert out.count() == 3001 and out.filter("translated_text = 'same'").count() == 3000
    assert [r.seq for r in extract.dedup_segments(df).orderBy("seq").collect()] == [0, 3000]
