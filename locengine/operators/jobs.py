"""Jobs, their attempts, progress and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locengine.operators.ordering import running_sum

# Statuses that no later progress event may overwrite.
TERMINAL = ("completed", "failed")


def recent_jobs(jobs: DataFrame, limit: int = 20) -> DataFrame:
    """Newest jobs first; ``job_id`` breaks ties."""
    return jobs.orderBy(F.col("created_at").desc(), F.col("job_id").desc()).limit(limit)


def attempt_text() -> Column:
    return F.concat_ws(
        ":", F.col("attempt_number").cast("string"), "phase", F.col("success").cast("string")
    )


def ordered_attempts(attempts: DataFrame) -> DataFrame:
    """All attempts, a row each, by job and number."""
    return attempts.select("job_id", "attempt_number", "phase", "success", "duration").orderBy(
        "job_id", "attempt_number", "phase", "success", "duration"
    )


def job_detail(jobs: DataFrame, attempts: DataFrame, nested: bool = False) -> DataFrame:
    """Each job with its attempts in order, a row each; a job without any has one row of nulls.

    ``nested`` gives one row per job with an array of attempts, which has to fit a task.
    """
    columns = ("attempt_number", "phase", "success", "duration")
    flat = attempts.select("job_id", *columns)
    if not nested:
        return jobs.join(flat, "job_id", "left").orderBy("job_id", *columns)
    gathered = flat.groupBy("job_id").agg(
        F.array_sort(F.collect_list(F.struct(*columns))).alias("attempts")
    )
    empty = F.array().cast(
        "array<struct<attempt_number:bigint,phase:string,success:boolean,duration:double>>"
    )
    return jobs.join(gathered, "job_id", "left").select(
        *jobs.columns, F.coalesce("attempts", empty).alias("attempts")
    )


def job_summary(results: DataFrame) -> DataFrame:
    """Run summary: succeeded, total, seconds and segments. Seconds are added as decimals,
    so the sum does not depend on the order of partitions."""
    seconds = F.sum(F.col("duration").cast("decimal(18,6)"))
    return results.agg(
        F.count_if(F.col("status") == "completed").alias("ok"),
        F.count("*").alias("total"),
        F.coalesce(seconds, F.lit(0)).cast("double").alias("seconds"),
        F.coalesce(F.sum("segments_count"), F.lit(0)).alias("segments"),
    )


def job_progress(batches: DataFrame) -> DataFrame:
    """Progress after each batch: ``0.3 + 0.5 * done / total``.

    ``batches`` has ``job_id, batch_id, segments``.
    """
    totals = batches.groupBy("job_id").agg(F.sum("segments").alias("total"))
    done = running_sum(batches, ["job_id"], ["batch_id"], F.col("segments"), "done")
    return done.join(totals, "job_id").withColumn(
        "progress",
        F.lit(0.3) + F.lit(0.5) * F.col("done") / F.greatest(F.col("total"), F.lit(1)),
    )


def latest_status(events: DataFrame) -> DataFrame:
    """Last status per job; a terminal status outranks every progress event.

    ``max_by`` is combined before the shuffle and keeps one row of state per job, so the
    same expression serves batch and streaming.
    """
    terminal = F.col("status").isin(*TERMINAL)
    return events.groupBy("job_id").agg(
        F.max_by("status", F.struct(terminal.alias("t"), "ts", "event_id")).alias("status"),
        F.count("*").alias("events"),
    )


def corpus_events(calls: DataFrame, status: DataFrame) -> DataFrame:
    """Progress events of a run, ``job_id, ts, status, progress``: one after each model call of a
    document, and its last one.

    ``calls`` has ``doc_id, segments, finished``, ``status`` has ``doc_id, status``. The last event
    comes with the document's last call, or with the run's, where it needed none.
    """
    micros = (F.col("finished") * 1_000_000).cast("bigint")
    batches = calls.select(F.col("doc_id").alias("job_id"), micros.alias("batch_id"), "segments")
    time = F.timestamp_micros("batch_id").alias("ts")
    during = job_progress(batches.groupBy("job_id", "batch_id").agg(F.sum("segments").alias("segments"))).select(
        "job_id", time, F.lit("translating").alias("status"), "progress"
    )
    last = batches.groupBy("job_id").agg(F.max("batch_id").alias("own"))
    end = batches.agg(F.max("batch_id").alias("run"))
    ends = status.select(F.col("doc_id").alias("job_id"), "status").join(last, "job_id", "left")
    at = F.timestamp_micros(F.coalesce("own", F.lit(end.head()["run"]).cast("bigint"))).alias("ts")
    done = F.when(F.col("status") == "failed", 0.0).otherwise(1.0).alias("progress")
    return during.unionByName(ends.select("job_id", at, "status", done))
