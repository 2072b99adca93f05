"""The whole flow over a table of text documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locengine.config import LIMITS, Limits, materialise
from locengine.functions.text import Profile
from locengine.operators.batch import build_prompts
from locengine.operators.extract import OFFICE_TYPES, TEXT_TYPES, extract_text
from locengine.operators.inference import Translate, Translations, translate
from locengine.operators.memory import (
    build_translation_map,
    merge_reviewed,
    upsert_memory,
    usable,
)
from locengine.operators.ordering import pack_batches, renumber
from locengine.operators.phrases import translate_paragraphs
from locengine.operators.quality import classify, confidence_stats
from locengine.operators.rebuild import rebuild_documents
from locengine.operators.review import exchange_name, write_xliff, xliff_lines
from locengine.operators.runs import drop_noise_runs, office_segments, tagged_text
from locengine.sources.documents import output_path, write_documents

NO_TEXT = "no translatable text"
UNSUPPORTED = "unsupported type"


@dataclass
class CorpusResult:
    """``documents`` is null without write-back, ``paragraphs`` without office paragraphs,
    ``exchange`` without an export, ``memory`` when no model was called. ``failures`` are the
    segments on which the model's function raised at the last attempt; their documents fail and
    are not among ``documents``. ``calls`` are the model's calls with their times, of the document
    in which a text stands first (see ``jobs.corpus_events``)."""

    segments: DataFrame
    status: DataFrame
    documents: DataFrame | None = None
    paragraphs: DataFrame | None = None
    exchange: DataFrame | None = None
    memory: DataFrame | None = None
    failures: DataFrame | None = None
    calls: DataFrame | None = None


def extract_documents(
    docs: DataFrame, paragraphs: DataFrame, p: str | Profile = "ja"
) -> DataFrame:
    """Segments of text documents (``doc_id, file_type, text``) and of office paragraphs;
    a document that cannot be read is one row with ``error`` and no text."""
    columns = ["doc_id", "file_type", "location", "type", "cell_index", "text", "error"]
    none = F.lit(None)
    is_text = F.coalesce(F.col("file_type").isin(*TEXT_TYPES), F.lit(False))
    text = extract_text(docs.filter(is_text), p, ("doc_id", "file_type"))
    office = office_segments(paragraphs, p).withColumn(
        "type", F.when(F.col("error").isNull(), F.col("type"))
    )
    unsupported = docs.filter(~is_text).select(
        "doc_id", "file_type", F.lit(UNSUPPORTED).alias("error")
    )
    return (
        text.withColumn("error", none.cast("string"))
        .select(*columns)
        .unionByName(office.withColumn("cell_index", none.cast("int")).select(*columns))
        .unionByName(unsupported, allowMissingColumns=True)
    )


def infer_misses(
    segments: DataFrame,
    memory: DataFrame,
    fn: Translate,
    glossary: DataFrame | None = None,
    p: str | Profile = "ja",
    concurrency: int | None = None,
    limits: Limits = LIMITS,
) -> Translations:
    """Translate each text that the memory lacks once.

    A text that occurs in many documents belongs to its first occurrence; only owners are
    packed and sent. The segments are ``text, translated_text, retry_count, status, error``.
    """
    # Repeated texts collapse in each task before the shuffle, and the memory is then joined
    # on the same key: no text is hot any more when it meets the memory.
    known = usable(memory).select(F.col("source").alias("text"))
    owners = (
        segments.groupBy("text")
        .agg(F.min(F.struct("doc_id", "seq", "file_type")).alias("o"))
        .join(known, "text", "left_anti")
        .select("o.doc_id", "o.seq", "o.file_type", "text")
    )
    owners = materialise(owners, "owners")
    batches = pack_batches(owners, limits.batch_max_chars, limits.batch_max_segments)
    packed = owners.join(batches, ["doc_id", "seq"])
    prompts = build_prompts(segments.sparkSession, glossary)
    made = translate(packed, prompts, fn, p, concurrency=concurrency, limits=limits)
    columns = ["text", "translated_text", "retry_count", "status", "error"]
    return Translations(made.segments.select(*columns), made.calls)


def answers(memory: DataFrame, results: DataFrame) -> DataFrame:
    """Memory hits and fresh translations in one table with one row per text."""
    hits = usable(memory).select(
        F.col("source").alias("text"),
        F.col("target").alias("translated_text"),
        F.lit(0).alias("retry_count"),
        F.lit("memory").alias("status"),
        F.lit(None).cast("string").alias("error"),
    )
    return hits.unionByName(results)


def translated_segments(segments: DataFrame, answered: DataFrame) -> DataFrame:
    """One join on the text fills hits and fresh translations alike."""
    return segments.join(answered, "text", "left").withColumn(
        "cache_hit", F.coalesce(F.col("status") == "memory", F.lit(False))
    )


def failures(segments: DataFrame) -> DataFrame:
    """``doc_id, seq, text, retry_count, error`` of the segments that the model failed on."""
    return segments.filter("status = 'error'").select("doc_id", "seq", "text", "retry_count", "error")


def document_status(
    docs: DataFrame, classified: DataFrame, paragraphs: DataFrame | None = None
) -> DataFrame:
    """Status, segment count and confidence of every document, failed ones included.

    A document of which a part could not be read is ``partial``, with that part's fault.
    """
    stats = confidence_stats(classified, ("doc_id",))
    faults = failures(classified).groupBy("doc_id").agg(F.min("error").alias("_fault"))
    found = F.col("total").isNotNull()
    fault = F.col("_fault").isNotNull()
    supported = F.col("file_type").isin(*TEXT_TYPES, *OFFICE_TYPES)
    joined = docs.select("doc_id", "file_type").join(stats, "doc_id", "left")
    joined = joined.join(faults, "doc_id", "left")
    if paragraphs is None:
        joined = joined.withColumn("_unread", F.lit(None).cast("string"))
    else:
        unread = paragraphs.filter("error IS NOT NULL").groupBy("doc_id").agg(
            F.min(F.concat_ws(": ", "part", "error")).alias("_unread")
        )
        joined = joined.join(unread, "doc_id", "left")
    return joined.select(
        "doc_id",
        F.when(fault, "failed")
        .when(found & F.col("_unread").isNotNull(), "partial")
        .when(found, "completed")
        .otherwise("failed")
        .alias("status"),
        F.coalesce("total", F.lit(0)).alias("segments_count"),
        F.when(~F.coalesce(supported, F.lit(False)), UNSUPPORTED)
        .when(~found, F.coalesce("_unread", F.lit(NO_TEXT)))
        .when(fault, F.col("_fault"))
        .otherwise(F.col("_unread"))
        .alias("error"),
        "high_count",
        "medium_count",
        "low_count",
        "avg_confidence",
    )


def corpus_segments(
    docs: DataFrame, paragraphs: DataFrame | None, p: str | Profile = "ja"
) -> DataFrame:
    """Segments of text documents and of office paragraphs with dense positions."""
    columns = ["doc_id", "file_type", "seq", "location", "line_idx", "type", "cell_index", "text"]
    text_docs = docs.filter(F.col("file_type").isin(*TEXT_TYPES))
    segments = extract_text(text_docs, p, ("doc_id", "file_type")).select(*columns)
    if paragraphs is None:
        return segments
    found = office_segments(paragraphs, p).filter("text IS NOT NULL")
    office = renumber(found, ["doc_id"], ["seq", "piece"], "seq")
    none = F.lit(None).cast("int")
    return segments.unionByName(
        office.withColumn("line_idx", none).withColumn("cell_index", none).select(*columns)
    )


def rebuilt_paragraphs(paragraphs: DataFrame, classified: DataFrame) -> DataFrame:
    """All office paragraphs with text, and their translations by text: paragraphs that
    were left out as duplicates or split into pieces get theirs as well."""
    tagged = drop_noise_runs(paragraphs).select(
        "doc_id", "seq", "part", "kind", "ordinal", tagged_text(F.col("runs")).alias("text")
    ).filter("text <> ''")
    office = classified.filter(F.col("file_type").isin(*OFFICE_TYPES))
    return translate_paragraphs(tagged, build_translation_map(office))


def translate_corpus(
    docs: DataFrame,
    memory: DataFrame,
    fn: Translate | None = None,
    mode: str = "auto",
    glossary: DataFrame | None = None,
    reviewed: DataFrame | None = None,
    paragraphs: DataFrame | None = None,
    p: str | Profile = "ja",
    version: str = "1.2",
    concurrency: int | None = None,
    limits: Limits = LIMITS,
) -> CorpusResult:
    """Translate ``docs`` (``doc_id, file_type, text``).

    Office documents have no text there; their ``paragraphs`` come from the office source.

    ``auto`` calls the model and writes back, ``export`` also gives exchange lines,
    ``import`` takes targets from ``reviewed`` instead of the model, per document where
    ``reviewed`` has a ``doc_id``, and ``no_translate``
    only gives exchange lines with empty targets.
    """
    if mode not in ("auto", "export", "import", "no_translate"):
        raise ValueError(f"unknown mode: {mode}")
    # Segments are read for the lookup, for the final join and by every output, so they are
    # extracted and written once; the same holds for the scored segments below.
    # Packages are parsed once as well.
    if paragraphs is not None:
        paragraphs = materialise(paragraphs, "paragraphs")
    segments = materialise(corpus_segments(docs, paragraphs, p), "segments")
    names = docs.select(
        "doc_id",
        "file_type",
        F.concat_ws(".", F.col("doc_id").cast("string"), "file_type").alias("filename"),
    )
    blank = (
        segments.withColumn("translated_text", F.lit(None).cast("string"))
        .withColumn("retry_count", F.lit(0))
        .withColumn("status", F.lit(None).cast("string"))
        .withColumn("error", F.lit(None).cast("string"))
        .withColumn("cache_hit", F.lit(False))
    )

    def exchange(classified: DataFrame) -> DataFrame:
        units = classified.withColumn("xliff_state", F.lit(None).cast("string"))
        return xliff_lines(units, names, version)

    if mode == "no_translate":
        empty = blank.withColumn("confidence", F.lit(None).cast("double"))
        unscored = empty.withColumn("bucket", F.lit(None).cast("string"))
        status = document_status(docs, unscored, paragraphs)
        return CorpusResult(empty, status, exchange=exchange(empty))

    merged, new_memory, calls = None, None, None
    if mode == "import":
        own = ("doc_id",) if "doc_id" in reviewed.columns else ()
        merged = merge_reviewed(blank, reviewed, own).drop("reviewed")
    else:
        inferred = infer_misses(segments, memory, fn, glossary, p, concurrency, limits)
        results, calls = inferred.segments, inferred.calls
        merged = translated_segments(segments, answers(memory, results))
        last = memory.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_last"))
        accepted = results.filter("status = 'accepted'").select(
            F.col("text").alias("source"), F.col("translated_text").alias("target")
        )
        new_memory = upsert_memory(
            memory, accepted.withColumn("seq", F.lit(last.head()[0] + 1).cast("bigint"))
        )
    classified = materialise(
        classify(merged, p, limits.high_threshold, limits.low_threshold), "scored"
    )
    failed = failures(classified).select("doc_id").distinct()
    good = docs.filter(F.col("file_type").isin(*TEXT_TYPES)).join(failed, "doc_id", "left_anti")
    return CorpusResult(
        classified,
        document_status(docs, classified, paragraphs),
        documents=rebuild_documents(good, classified.filter(F.col("file_type").isin(*TEXT_TYPES))),
        paragraphs=None if paragraphs is None else rebuilt_paragraphs(paragraphs, classified),
        exchange=exchange(classified) if mode == "export" else None,
        memory=new_memory,
        failures=failures(classified),
        calls=calls,
    )


def write_corpus(result: CorpusResult, names: DataFrame, path: str, suffix: str = "_vi") -> DataFrame:
    """Write the documents, and the exchange files if there are any, below ``path``.

    ``names`` has ``doc_id, filename``. Gives the status of every document with ``output_path``,
    ``xliff_path`` and ``duration_seconds`` (of its model calls); null where there is none.
    """
    names = names.select("doc_id", "filename")
    made = result.status.join(names, "doc_id", "left")
    none = F.lit(None).cast("string")
    output, exchange, seconds = none, none, F.lit(None).cast("double")
    if result.documents is not None:
        documents = result.documents.join(names, "doc_id")
        write_documents(documents, f"{path}/documents", suffix)
        own = documents.select("doc_id", F.lit(True).alias("_written"))
        made = made.join(own, "doc_id", "left")
        place = F.concat(F.lit(f"{path}/documents/"), output_path(F.col("filename"), suffix))
        output = F.when(F.col("_written"), place)
    if result.exchange is not None:
        write_xliff(result.exchange, names, f"{path}/exchange")
        own = result.exchange.select("doc_id").distinct().withColumn("_sent", F.lit(True))
        made = made.join(own, "doc_id", "left")
        place = F.concat(F.lit(f"{path}/exchange/"), exchange_name(F.col("filename"), F.lit(0)))
        exchange = F.when(F.col("_sent"), place)
    if result.calls is not None:
        spent = result.calls.groupBy("doc_id").agg(F.sum("seconds").alias("_seconds"))
        made = made.join(spent, "doc_id", "left")
        seconds = F.col("_seconds")
    return made.select(
        *result.status.columns,
        output.alias("output_path"),
        exchange.alias("xliff_path"),
        seconds.alias("duration_seconds"),
    )
