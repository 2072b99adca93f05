"""Calling the translation function, with retries.

The function is any callable ``fn(Request) -> str`` that raises ``TimeoutError`` when the
model does not answer. Any other exception is kept with its row: it costs that row's
translation and never the run. The function runs inside ``mapInPandas``; replies are written to
a table before anything else reads them, so a lost executor never changes an answer that has
already been used. Rows carry their file type; the prompt, one per file type, is looked up
where the model is called and is never shuffled.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locengine.config import LIMITS, Limits, materialise
from locengine.functions.text import Profile, profile
from locengine.operators.batch import (
    DELIMITER,
    batch_rows,
    retry_warning,
    route_replies,
)


@dataclass(frozen=True)
class Request:
    system: str
    prompt: str
    temperature: float
    attempt: int  # 0 for a batch, then 1, 2, ... for a single segment
    context_tokens: int = LIMITS.context_tokens


Translate = Callable[[Request], str]


def spread_calls(df: DataFrame, concurrency: int | None) -> DataFrame:
    """Rows over ``concurrency`` partitions, hence so many model calls at a time.

    A call takes far longer than its few bytes suggest, so partitions must not be merged
    by size; without a limit all cores call the model.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(concurrency or max(cores, shuffles))


def _systems(prompts: DataFrame) -> Broadcast[dict[str, str]]:
    """The prompt of every file type, one row each, for the workers."""
    rows = prompts.select("file_type", "system").collect()
    return prompts.sparkSession.sparkContext.broadcast({r.file_type: r.system for r in rows})


_TIMES = [T.StructField(n, T.DoubleType()) for n in ("finished", "seconds")]


def _fault(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


def translate_batches(
    batches: DataFrame,
    fn: Translate,
    prompts: DataFrame,
    concurrency: int | None = None,
    limits: Limits = LIMITS,
) -> DataFrame:
    """Add ``reply`` and ``error`` to rows with ``file_type`` and ``entries``; the reply is null
    after a timeout, and after a fault, which ``error`` tells. ``finished`` (seconds since 1970)
    and ``seconds`` are the time of the call."""
    temperature, context, systems = limits.temperature, limits.context_tokens, _systems(prompts)

    def call(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            replies, errors, times = [], [], []
            for file_type, entries in zip(pdf["file_type"], pdf["entries"]):
                prompt = DELIMITER.join(e["text"] for e in entries)
                reply, error, began = None, None, time.time()
                try:
                    reply = fn(Request(systems.value.get(file_type), prompt, temperature, 0, context))
                except TimeoutError:
                    pass
                except Exception as e:  # whatever the caller's function raises is its row's
                    error = _fault(e)
                replies.append(reply)
                errors.append(error)
                times.append((time.time(), time.time() - began))
            made = {"reply": replies, "error": errors}
            made = {k: pd.Series(v, index=pdf.index, dtype=object) for k, v in made.items()}
            yield pdf.assign(**made, finished=[t[0] for t in times], seconds=[t[1] for t in times])

    added = [T.StructField(n, T.StringType()) for n in ("reply", "error")]
    schema = T.StructType([*batches.schema.fields, *added, *_TIMES])
    return spread_calls(batches, concurrency).mapInPandas(call, schema)


def python_class(chars: str) -> str:
    """A regular-expression class of a profile in Python's notation."""
    return re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: chr(int(m.group(1), 16)), chars)


def retry_single(
    rows: DataFrame,
    fn: Translate,
    prompts: DataFrame,
    p: str | Profile = "ja",
    concurrency: int | None = None,
    limits: Limits = LIMITS,
) -> DataFrame:
    """Retry rows one by one until script and tags are right, at most ``max_retries``
    times. The last answer is kept either way; ``accepted`` tells which it is, and ``error``
    what the last attempt raised, with the source as the answer."""
    leak = re.compile(f"[{python_class(profile(p).leak)}]")
    tag = re.compile(r"</?tag[0-9]+>")
    attempts, temperature = limits.max_retries, max(limits.temperature - 0.1, 0.1)
    systems = _systems(prompts)

    def attempt_row(file_type: str, warning: str, text: str) -> tuple[str, int, bool, str | None]:
        wanted = sorted(tag.findall(text))
        answer, error, system = text, None, systems.value.get(file_type)
        for n in range(1, attempts + 1):
            prompt = system if n == 1 or system is None else system + warning
            error = None
            try:
                answer = fn(Request(prompt, text, temperature, n, limits.context_tokens)).strip()
            except TimeoutError:
                answer = text
            except Exception as e:  # whatever the caller's function raises is its row's
                answer, error = text, _fault(e)
            if error is None and not leak.search(answer) and sorted(tag.findall(answer)) == wanted:
                return answer, n, True, None
        return answer, attempts, False, error

    def call(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            done, times = [], []
            for row in zip(pdf["file_type"], pdf["_warning"], pdf["text"]):
                began = time.time()
                done.append(attempt_row(*row))
                times.append((time.time(), time.time() - began))
            made = {
                "translated_text": [d[0] for d in done],
                "retry_count": [d[1] for d in done],
                "accepted": [d[2] for d in done],
                "error": pd.Series([d[3] for d in done], index=pdf.index, dtype=object),
                "finished": [t[0] for t in times],
                "seconds": [t[1] for t in times],
            }
            yield pdf[names].assign(**made)

    base = rows.select(*[c for c in rows.columns if c not in ("translated_text", "error")])
    schema = T.StructType(
        [
            *base.schema.fields,
            T.StructField("translated_text", T.StringType()),
            T.StructField("retry_count", T.IntegerType()),
            T.StructField("accepted", T.BooleanType()),
            T.StructField("error", T.StringType()),
            *_TIMES,
        ]
    )
    warned = base.withColumn("_warning", retry_warning(F.col("text"), F.lit(2)))
    names = base.columns
    return spread_calls(warned, concurrency).mapInPandas(call, schema)


@dataclass(frozen=True)
class Translations:
    """``segments``: ``keys, seq, text, translated_text, retry_count, status, error``.
    ``calls``: ``keys, segments, finished, seconds, error``, one row per batch and per segment
    that was sent by itself."""

    segments: DataFrame
    calls: DataFrame


def translate(
    packed: DataFrame,
    prompts: DataFrame,
    fn: Translate,
    p: str | Profile = "ja",
    keys: tuple[str, ...] = ("doc_id",),
    concurrency: int | None = None,
    limits: Limits = LIMITS,
) -> Translations:
    """Batches, routing and single retries.

    ``status`` is ``accepted``, ``timeout``, ``best_effort`` or ``error``, where every attempt
    ended in the function's own exception or with a wrong answer, the last one in the former;
    only accepted pairs may enter the memory. Both rounds of model calls are written before
    they are read again.
    """
    batches = batch_rows(packed, keys)
    replies = materialise(translate_batches(batches, fn, prompts, concurrency, limits), "replies")
    routed = route_replies(replies, p, keys)
    settled = F.col("route").isin("accept", "timeout")
    columns = [*keys, "seq", "text", "translated_text", "retry_count", "status", "error"]
    first = (
        routed.filter(settled)
        .withColumn("retry_count", F.lit(0))
        .withColumn("status", F.when(F.col("route") == "accept", "accepted").otherwise("timeout"))
    )
    failing = routed.filter(~settled).select(*keys, "seq", "file_type", "text", "translated_text")
    again = materialise(retry_single(failing, fn, prompts, p, concurrency, limits), "retries")
    second = again.withColumn(
        "status",
        F.when(F.col("accepted"), "accepted").when(F.col("error").isNotNull(), "error").otherwise("best_effort"),
    )
    times = ["finished", "seconds", "error"]
    calls = replies.select(*keys, F.size("entries").alias("segments"), *times).unionByName(
        again.select(*keys, F.lit(1).alias("segments"), *times)
    )
    return Translations(first.select(*columns).unionByName(second.select(*columns)), calls)


def translate_with_retries(packed: DataFrame, prompts: DataFrame, fn: Translate, *args, **kwargs) -> DataFrame:
    """The segments of ``translate``."""
    return translate(packed, prompts, fn, *args, **kwargs).segments
