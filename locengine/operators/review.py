"""Bilingual exchange units and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locengine.functions.markup import (
    escape_attribute,
    escape_xml,
    map_state,
    review_state,
    text_to_xliff,
)
from locengine.functions.text import is_blank
from locengine.operators.ordering import bucket_of
from locengine.sources.named_files import relative_path, write_named

# Namespaces of the two versions.
NAMESPACE = {
    "1.2": "urn:oasis:names:tc:xliff:document:1.2",
    "2.1": "urn:oasis:names:tc:xliff:document:2.1",
}
TOOL = "locengine"


def with_state(segments: DataFrame) -> DataFrame:
    """Fill ``xliff_state``: explicit state, else from target and confidence."""
    return segments.withColumn(
        "xliff_state",
        review_state(F.col("xliff_state"), F.col("translated_text"), F.col("confidence")),
    )


def _notes() -> Column:
    def note(text: Column) -> Column:
        return F.concat(F.lit('<note from="system">'), text, F.lit("</note>"))

    def labelled(label: str, c: Column) -> Column:
        present = c.isNotNull() & (c != "")
        return F.when(present, note(F.concat(F.lit(f"{label}: "), escape_xml(c)))).otherwise("")

    confidence = F.when(
        F.col("confidence").isNotNull(),
        note(F.concat(F.lit("confidence: "), F.format_string("%.2f", "confidence"))),
    ).otherwise("")
    return F.concat(
        labelled("location", F.col("location")), labelled("type", F.col("type")), confidence
    )


def xliff_units(
    segments: DataFrame, version: str = "1.2", source_lang: str = "ja", target_lang: str = "vi"
) -> DataFrame:
    """One ``unit`` string per non-blank segment.

    ``seq`` is the 0-based position of the segment in its document, counted before blank
    sources are skipped; the unit id is ``seq + 1``.
    """
    rows = with_state(segments).filter(~is_blank(F.col("text")))
    source = text_to_xliff(F.col("text"), version)
    target = F.when(
        ~is_blank(F.col("translated_text")), text_to_xliff(F.col("translated_text"), version)
    ).otherwise("")
    number = (F.col("seq") + 1).cast("string")
    if version.startswith("2"):
        unit = F.concat(
            F.lit('<unit id="u'), number, F.lit('"><segment state="'),
            map_state(F.col("xliff_state"), "2.1"),
            F.lit('"><source>'), source, F.lit("</source><target>"), target,
            F.lit("</target></segment>"), _notes(), F.lit("</unit>"),
        )
    else:
        unit = F.concat(
            F.lit('<trans-unit id="'), number, F.lit('" translate="yes"><source xml:lang="'),
            F.lit(source_lang), F.lit('">'), source, F.lit('</source><target xml:lang="'),
            F.lit(target_lang), F.lit('" state="'), escape_attribute(F.col("xliff_state")),
            F.lit('">'), target, F.lit("</target>"), _notes(), F.lit("</trans-unit>"),
        )
    return rows.select("doc_id", "seq", unit.alias("unit"))


def xliff_header(
    original: Column, file_type: Column, version: str, source_lang: str, target_lang: str
) -> Column:
    name = escape_attribute(original)
    if version.startswith("2"):
        return F.concat(
            F.lit(
                f'<?xml version="1.0" encoding="UTF-8"?>\n<xliff version="2.1" '
                f'xmlns="{NAMESPACE["2.1"]}" srcLang="{source_lang}" trgLang="{target_lang}">\n'
                '<file id="f1" original="'
            ),
            name,
            F.lit('">'),
        )
    return F.concat(
        F.lit(
            f'<?xml version="1.0" encoding="UTF-8"?>\n<xliff version="1.2" '
            f'xmlns="{NAMESPACE["1.2"]}">\n<file original="'
        ),
        name,
        F.lit(
            f'" source-language="{source_lang}" target-language="{target_lang}" datatype="x-'
        ),
        escape_attribute(file_type),
        F.lit(
            f'" tool-id="{TOOL}">\n<header><tool tool-id="{TOOL}" '
            f'tool-name="{TOOL}"/></header>\n<body>'
        ),
    )


def xliff_footer(version: str) -> str:
    return "</file>\n</xliff>" if version.startswith("2") else "</body>\n</file>\n</xliff>"


def xliff_lines(
    segments: DataFrame,
    documents: DataFrame,
    version: str = "1.2",
    source_lang: str = "ja",
    target_lang: str = "vi",
    units_per_file: int | None = None,
) -> DataFrame:
    """Lines of the exchange files: ``doc_id, file_no, line_no, line``.

    A document is one file; with ``units_per_file`` it becomes a series of complete files of
    at most as many units. ``documents`` has ``doc_id, filename, file_type``.
    """
    number = F.lit(0).cast("bigint")
    if units_per_file is not None:
        number = bucket_of("seq", units_per_file).cast("bigint")
    units = xliff_units(segments, version, source_lang, target_lang).select(
        "doc_id",
        number.alias("file_no"),
        (F.col("seq") + 1).alias("line_no"),
        F.col("unit").alias("line"),
    )
    files = units.select("doc_id", "file_no").distinct().join(documents, "doc_id")
    head = xliff_header(
        F.col("filename"), F.col("file_type"), version, source_lang, target_lang
    )
    frame = files.select(
        "doc_id",
        "file_no",
        F.inline(
            F.array(
                F.struct(F.lit(0).cast("bigint").alias("line_no"), head.alias("line")),
                F.struct(
                    F.lit(2**62).cast("bigint").alias("line_no"),
                    F.lit(xliff_footer(version)).alias("line"),
                ),
            )
        ),
    )
    return units.unionByName(frame)


def xliff_documents(lines: DataFrame) -> DataFrame:
    """Whole files as rows ``doc_id, file_no, content``; the units of a file are
    gathered in one row, so documents of any size need ``units_per_file``."""
    return (
        lines.groupBy("doc_id", "file_no")
        .agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
        .select(
            "doc_id",
            "file_no",
            F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("content"),
        )
    )


def exchange_name(filename: Column, file_no: Column, several: bool = False) -> Column:
    """Name of a document's exchange file; of a series of files, each with its number."""
    base = relative_path(filename)
    number = F.concat(F.lit("-"), file_no.cast("string")) if several else F.lit("")
    return F.concat(base, number, F.lit(".xlf"))


def write_xliff(
    lines: DataFrame, documents: DataFrame, path: str, several: bool = False, overwrite: bool = False
) -> None:
    """One named exchange file per document, or, with ``several``, per document and file number.

    ``documents`` has ``doc_id, filename``. The lines of a file are sorted in one task and
    written as they come, so a file never has to fit a row. Equal file names are an error.
    """
    named = documents.select(relative_path(F.col("filename")).alias("name")).groupBy("name").count()
    twice = named.filter("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"names that stand more than once: {[r['name'] for r in twice]}")
    name = exchange_name(F.col("filename"), F.col("file_no"), several)
    rows = (
        lines.join(documents.select("doc_id", "filename"), "doc_id")
        .select("doc_id", "file_no", "line_no", name.alias("name"), F.concat("line", F.lit("\n")).alias("content"))
        .repartition("doc_id", "file_no")
        .sortWithinPartitions("doc_id", "file_no", "line_no")
    )
    write_named(rows, path, overwrite, ordered=True)
