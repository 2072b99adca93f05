"""Continuous extraction with memory lookup, and continuous job status."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from locengine.functions.text import Profile
from locengine.operators.extract import extract_text
from locengine.operators.jobs import TERMINAL
from locengine.operators.memory import lookup_memory

ONCE = {"availableNow": True}
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def arriving(spark: SparkSession, path: str, schema, glob: str = "*.parquet") -> DataFrame:
    """Files that land in ``path`` as a stream."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", 1000)
        .parquet(path)
    )


def arriving_table(spark: SparkSession, path: str, name: str, schema) -> DataFrame:
    """A table below ``path`` as a stream: one file of that name, or a folder of files."""
    # Without braces Spark takes the path for a folder, also if it is a file.
    return arriving(spark, f"{path.rstrip('/')}/{{{name}}}", schema, "*")


def write_batch(rows: DataFrame, out: str, number: int) -> None:
    """The rows of a micro-batch; a batch that is run again replaces what it wrote before."""
    rows.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")


def stream_lookup(
    docs: DataFrame,
    memory: DataFrame | Callable[[], DataFrame],
    out: str,
    checkpoint: str,
    p: str | Profile = "ja",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Extract arriving documents and look their segments up in the memory.

    ``memory`` is a table, or a function that gives the version to use: it is called once per
    micro-batch, so that a stream sees pairs that were accepted after it began (see
    ``memory.latest_memory``). Extraction works inside a document's row and keeps no state. A
    batch is written to a folder of its own, ``batch=N`` below ``out``. ``trigger`` are the
    options of ``DataStreamWriter.trigger``; without any, what is there is worked on once.
    """

    def work(rows: DataFrame, number: int) -> None:
        known = memory() if callable(memory) else memory
        write_batch(lookup_memory(extract_text(rows, p), known), out, number)

    return (
        docs.writeStream.foreachBatch(work)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ONCE))
        .start()
    )


def _rows(jobs: list, statuses: list, events: list) -> pd.DataFrame:
    columns = {"job_id": jobs, "status": statuses, "events": events}
    return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in columns.items()})


class JobStatus(StatefulProcessor):
    """The last status of a job; a terminal one outranks every progress event.

    A job's state goes ``keep`` after its terminal event, and ``idle`` after its last event
    where it never ended, both in event time.
    """

    def __init__(self, keep_ms: int, idle_ms: int):
        self.keep_ms, self.idle_ms = keep_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "last", "terminal boolean, ts timestamp, event_id long, status string, events long"
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best, events = None, 0
        if self.state.exists():
            *best, events = self.state.get()
        for pdf in rows:
            events += len(pdf)
            found = zip(
                pdf["status"].isin(TERMINAL), pdf["ts"], pdf["event_id"], pdf["status"], strict=True
            )
            for terminal, ts, event_id, status in found:
                new = [bool(terminal), pd.Timestamp(ts).to_pydatetime(), int(event_id), status]
                if best is None or new[:3] > list(best[:3]):
                    best = new
        self.state.update((*best, events))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        wait = self.keep_ms if best[0] else self.idle_ms
        self.handle.registerTimer(int(pd.Timestamp(best[1], tz="UTC").timestamp() * 1000) + wait)
        yield _rows([key[0]], [best[3]], [events])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield _rows([], [], [])

    def close(self) -> None:
        pass


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    """A setting that a query takes along when it starts, as it was before afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stream_status(
    events: DataFrame,
    checkpoint: str,
    sink,
    late: str = "1 day",
    keep_hours: float = 24,
    idle_hours: float = 24 * 30,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Status per job in update mode; ``sink(rows, batch)`` gets the changed jobs.

    One small row of state per job, in RocksDB, so that it is not limited by the heap. Once
    the watermark (the greatest ``ts`` less ``late``) is ``keep_hours`` beyond a job's terminal
    event its state goes, so state is bounded by the jobs of that time. An event that comes
    later and is older than the watermark is dropped, so it never opens an ended job again; a
    newer one begins the job anew. ``events`` has ``job_id, event_id, ts, status``.
    """
    spark = events.sparkSession
    types = dict(events.dtypes)
    hour = 3_600_000
    states = (
        events.filter("ts IS NOT NULL")
        .select("job_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "status")
        .withWatermark("ts", late)
        .groupBy("job_id")
        .transformWithStateInPandas(
            JobStatus(int(keep_hours * hour), int(idle_hours * hour)),
            f"job_id {types['job_id']}, status string, events long",
            "Update",
            "EventTime",
        )
    )
    with _setting(spark, _PROVIDER, _ROCKSDB):
        return (
            states.writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .foreachBatch(sink)
            .trigger(**(trigger or ONCE))
            .start()
        )
