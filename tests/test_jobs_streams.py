import datetime as dt

from pyspark.sql import functions as F

from locengine.operators import jobs
from locengine.operators.extract import extract_text
from locengine.operators.memory import latest_memory, lookup_memory, write_memory
from locengine.streaming.streams import arriving, arriving_table, stream_lookup, stream_status, write_batch

T0 = dt.datetime(2024, 1, 1)
EVENT = "job_id long, event_id long, ts timestamp, status string"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


EVENTS = [
    (1, 0, at(0), "pending"), (1, 1, at(1), "extracting"), (1, 2, at(2), "completed"),
    (1, 3, at(9), "verifying"), (2, 4, at(0), "pending"), (2, 5, at(3), "translating"),
    (3, 6, at(1), "failed"), (3, 7, at(2), "completed"),
]


def test_status(spark):
    out = jobs.latest_status(spark.createDataFrame(EVENTS, EVENT)).collect()
    assert {(r.job_id, r.status, r.events) for r in out} == {
        (1, "completed", 4), (2, "translating", 2), (3, "completed", 2),
    }


def test_status_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(EVENTS, EVENT)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, part in enumerate(("event_id < 3", "event_id BETWEEN 3 AND 5", "event_id > 5")):
        df.filter(part).coalesce(1).write.mode("append").parquet(source)
        query = stream_status(
            arriving(spark, source, df.schema),
            str(tmp_path / "state"),
            lambda rows, batch: rows.withColumn("batch", F.lit(batch)).write.mode("append").parquet(out),
        )
        query.awaitTermination()
    changes = spark.read.parquet(out)
    last = changes.groupBy("job_id").agg(F.max_by("status", "batch").alias("status"))
    batch = jobs.latest_status(df).select("job_id", "status")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, batch.collect()))
    # Update mode: a job that did not change is not sent again.
    assert changes.filter("job_id = 3").count() == 1


def test_lookup_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame(
        [(i, f"文{i % 3}\nplain\n| 名 | 値 |") for i in range(9)], "doc_id long, text string"
    )
    memory = spark.createDataFrame([("文1", "C1"), ("名", "N")], "source string, target string")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for low in (0, 5):
        docs.filter(F.col("doc_id").between(low, low + 4)).write.mode("append").parquet(source)
        stream_lookup(
            arriving(spark, source, docs.schema), memory, out, str(tmp_path / "state")
        ).awaitTermination()
    columns = ["doc_id", "seq", "text", "translated_text", "cache_hit"]
    expected = lookup_memory(extract_text(docs), memory).select(*columns).collect()
    got = spark.read.parquet(out).select(*columns).collect()
    key = lambda r: (r.doc_id, r.seq)
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert sum(r.cache_hit for r in got) == 3 + 9


JOB = "job_id long, filename string, created_at timestamp"


def test_recent_jobs(spark):
    rows = [(i, f"{i}.md", at(i // 2)) for i in range(30)]
    out = jobs.recent_jobs(spark.createDataFrame(rows, JOB)).collect()
    assert [r.job_id for r in out] == list(range(29, 9, -1))


def test_detail(spark):
    many = spark.createDataFrame([(1, "a", at(0)), (2, "b", at(1))], JOB)
    attempts = spark.createDataFrame(
        [(1, n, "translating", n == 2, 1.0) for n in (2, 0, 1)] + [(1, 1000, "x", True, 1.0)],
        "job_id long, attempt_number long, phase string, success boolean, duration double",
    )
    out = jobs.job_detail(many, attempts).collect()
    assert [(r.job_id, r.attempt_number) for r in out] == [
        (1, 0), (1, 1), (1, 2), (1, 1000), (2, None)
    ]
    out = jobs.job_detail(many, attempts, nested=True).orderBy("job_id").collect()
    assert [[a.attempt_number for a in r.attempts] for r in out] == [[0, 1, 2, 1000], []]
    assert [r.attempt_number for r in jobs.ordered_attempts(attempts).collect()] == [0, 1, 2, 1000]


def test_summary_and_progress(spark):
    results = spark.createDataFrame(
        [("completed", 1.5, 3), ("failed", 0.25, 0), ("completed", 0.1, 4)],
        "status string, duration double, segments_count int",
    )
    assert tuple(jobs.job_summary(results).head()) == (2, 3, 1.85, 7)
    assert tuple(jobs.job_summary(results.filter("false")).head()) == (0, 0, 0.0, 0)
    batches = spark.createDataFrame([(1, 0, 5), (1, 1, 5), (1, 2, 2)], "job_id long, batch_id long, segments int")
    out = jobs.job_progress(batches).orderBy("batch_id").collect()
    assert [(r.done, round(r.progress, 4)) for r in out] == [(5, 0.5083), (10, 0.7167), (12, 0.8)]


def status_run(spark, tmp_path, name, rows, seen):
    """One more file of events, and a run of the stream over what is new."""
    source = tmp_path / "events"
    source.mkdir(exist_ok=True)
    (spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(str(source)))
    stream = spark.readStream.schema(EVENT).parquet(str(source))

    def sink(changed, number):
        seen.extend((name, r.job_id, r.status, r.events) for r in changed.collect())

    stream_status(stream, str(tmp_path / "state"), sink, late="1 hour", keep_hours=2).awaitTermination()


def test_status_state_is_bounded(spark, tmp_path):
    """Ended jobs leave the state; late events after that are dropped, newer ones begin anew."""
    seen = []
    hour = lambda n: at(60 * n)
    status_run(spark, tmp_path, "a", [(1, 1, hour(0), "completed"), (1, 2, hour(1), "translating"), (2, 3, hour(0), "pending")], seen)
    status_run(spark, tmp_path, "b", [(3, 4, hour(50), "pending"), (2, 5, hour(49), "translating")], seen)

    def held():
        state = spark.read.format("statestore").option("stateVarName", "last")
        rows = state.load(str(tmp_path / "state")).collect()
        return sorted(r.key.job_id for r in rows)

    status_run(spark, tmp_path, "c", [(4, 6, hour(51), "pending")], seen)
    assert held() == [2, 3, 4]
    status_run(spark, tmp_path, "d", [(1, 7, hour(2), "translating"), (4, 8, hour(52), "failed")], seen)
    status_run(spark, tmp_path, "e", [(1, 9, hour(60), "pending")], seen)
    assert [s for s in seen if s[0] == "a"] and {s[1:] for s in seen if s[0] == "a"} == {
        (1, "completed", 2), (2, "pending", 1),
    }
    assert {s[1:] for s in seen if s[0] == "b"} == {(3, "pending", 1), (2, "translating", 2)}
    assert {s[1:] for s in seen if s[0] == "d"} == {(4, "failed", 2)}
    assert {s[1:] for s in seen if s[0] == "e"} == {(1, "pending", 1)}


def test_lookup_sees_the_memory_of_its_batch(spark, tmp_path):
    schema = "doc_id long, text string"
    source, out, versions = (str(tmp_path / n) for n in ("in", "out", "memory"))

    def known(target, version):
        rows = spark.createDataFrame([("文", target, 1)], "source string, target string, seq long")
        write_memory(rows, versions, version)

    def run(doc_id):
        spark.createDataFrame([(doc_id, "文")], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        stream_lookup(
            stream, lambda: latest_memory(spark, versions), out, str(tmp_path / "state")
        ).awaitTermination()

    known("one", 1)
    run(1)
    known("two", 2)
    (tmp_path / "memory" / "version=3").mkdir()  # a version that is being written is not seen
    run(2)
    found = {r.doc_id: (r.translated_text, r.batch) for r in spark.read.parquet(out).collect()}
    assert found == {1: ("one", 0), 2: ("two", 1)}
    # A batch that is run again replaces what it wrote.
    write_batch(spark.read.parquet(f"{out}/batch=1").limit(0).unionByName(
        spark.createDataFrame([(2, 0, "文", "again", True)], "doc_id long, seq long, text string, translated_text string, cache_hit boolean"),
        allowMissingColumns=True,
    ), out, 1)
    assert sorted(r.translated_text for r in spark.read.parquet(out).collect()) == ["again", "one"]


def test_a_setting_is_given_back(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    status_run(spark, tmp_path, "a", [(1, 1, T0, "pending")], [])
    assert spark.conf.get(key) == before


def test_table_in_one_file_or_many_arrives(spark, tmp_path):
    """A table is a folder of files, as large ones are, or one file of its name."""
    rows = spark.range(9).withColumnRenamed("id", "doc_id")
    rows.repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "part"))
    (tmp_path / "one").mkdir()
    next((tmp_path / "part").glob("part-*")).rename(tmp_path / "one" / "documents.parquet")
    rows.write.parquet(str(tmp_path / "many" / "others.parquet"))
    for kind in ("one", "many"):
        found = []
        stream = arriving_table(spark, str(tmp_path / kind), "documents.parquet", rows.schema)
        stream.writeStream.foreachBatch(lambda df, _: found.extend(df.collect())).option(
            "checkpointLocation", str(tmp_path / f"state-{kind}")
        ).trigger(availableNow=True).start().awaitTermination()
        assert sorted(r.doc_id for r in found) == list(range(9))
