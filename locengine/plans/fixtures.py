"""Inputs of the registered queries, derived from the given tables.

Each view is built by Spark from whole tables. The SQL that describes the same views for
the comparison engine is in ``oracles.py``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locengine.functions.text import strip_ws
from locengine.operators.batch import DELIMITER
from locengine.operators.inference import Request
from locengine.sources.documents import spread

# Accented letters and the ASCII letters that stand for them.
ACCENTED = "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
FOLDED = "AAAAAAACEEEEIIIIDNOOOOOOUUUUYTsaaaaaaaceeeeiiiidnoooooouuuuyty"
P = "accent"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def fold(c):
    """The stand-in translation: accents removed."""
    return F.translate(c, ACCENTED, FOLDED)


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def md_docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents with fences, diagrams, table rows and headings at fixed line positions,
    and a file type; one in nine has a type that is not a text type. Marks are added to the
    lines, which stay whole."""

    def line(raw, i):
        at = i % 12
        return (
            F.when(at.isin(3, 6), F.concat(F.lit("```\n"), raw))
            .when((at == 5) & (F.col("doc_id") % 2 == 0), F.concat(F.lit("│ "), raw, F.lit(" │")))
            .when(
                at == 8,
                F.concat(
                    F.lit("| "), F.substring(raw, 1, 12), F.lit(" | "),
                    F.substring(raw, F.lit(13), F.length(raw)), F.lit(" |"),
                ),
            )
            .when(at == 9, F.concat(F.lit("# "), raw))
            .otherwise(raw)
        )

    kind = F.col("doc_id") % 9
    # The explode of one element stands for the stored text: filters are not pushed into
    # the derivation.
    return documents(spark, d).select(
        "doc_id",
        F.when(kind == 8, "pdf")
        .when(kind % 3 == 0, "txt")
        .when(kind % 3 == 1, "md")
        .otherwise("csv")
        .alias("file_type"),
        F.explode(
            F.array(F.array_join(F.transform(F.split("text", "\n", -1), line), "\n"))
        ).alias("text"),
    )


BITEXT = """
SELECT s.conv_id, s.turn, s.conv_id * 100 + s.turn AS seq, s.text AS source, a.text AS target
FROM {conversations} s JOIN {conversations} a ON a.conv_id = s.conv_id AND a.turn = s.turn + 1
WHERE s.role = 'user' AND a.role = 'assistant'
"""
TAGGED = """
SELECT seq, conv_id, concat('<tag1>', substr(source, 1, 10), '</tag1>', substr(source, 11)) AS source,
  CASE WHEN seq % 5 = 1 THEN NULL WHEN seq % 5 = 2 THEN ''
       WHEN conv_id % 3 = 0 THEN concat('<tag1>', target)
       ELSE concat('<tag1>', substr(target, 1, 10), '</tag1>', substr(target, 11)) END AS target,
  CAST(seq % 4 AS int) AS retry_count, seq % 7 = 0 AS cache_hit FROM {bitext}
"""
TM_RAW = """
SELECT source, CASE WHEN conv_id % 10 = 4 THEN '' ELSE target END AS target, seq
FROM {bitext} WHERE conv_id % 2 = 0
UNION ALL
SELECT source, 'old' AS target, seq - 1000000 AS seq FROM {bitext} WHERE conv_id % 4 = 0
"""
JOB_EVENTS = """
SELECT event_id, user_id AS job_id, ts, value AS duration,
  CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'extracting'
    WHEN 'click' THEN 'translating' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status
FROM {events}
"""
JOBS = """
SELECT job_id, concat('doc_', CAST(job_id AS varchar(20)), '.md') AS filename,
  min(ts) AS created_at FROM {job_events} GROUP BY job_id
"""


def bitext(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(BITEXT, conversations=table(spark, d, "conversations"))


def tagged(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(TAGGED, bitext=bitext(spark, d))


def tm_raw(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(TM_RAW, bitext=bitext(spark, d))


def as_job_events(events: DataFrame) -> DataFrame:
    return events.sparkSession.sql(JOB_EVENTS, events=events)


def job_events(spark: SparkSession, d: str) -> DataFrame:
    return as_job_events(table(spark, d, "events"))


def jobs(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(JOBS, job_events=job_events(spark, d))


def attempts(spark: SparkSession, d: str) -> DataFrame:
    """Every event of a job after it left the queue is one attempt."""
    return job_events(spark, d).filter("status <> 'pending'").select(
        "job_id",
        F.col("event_id").alias("attempt_number"),
        F.col("status").alias("phase"),
        (F.col("status") != "failed").alias("success"),
        "duration",
    )


def scored_input(spark: SparkSession, d: str) -> DataFrame:
    return tagged(spark, d).select(
        F.col("conv_id").alias("doc_id"),
        "seq",
        F.col("source").alias("text"),
        F.col("target").alias("translated_text"),
        "retry_count",
        "cache_hit",
    )


def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Each document line as a paragraph; its words are runs, some formatted, some inside
    links. A footnote mark is added as a run of its own after the fifth of nine words."""

    def runs(word, i):
        own = F.struct(
            F.concat(word, F.lit(" ")).alias("text"),
            ((i + F.col("line_idx")) % 3 == 0).alias("has_format"),
            (i % 11 == 10).alias("in_link"),
        )
        mark = F.struct(
            F.lit("[1]").alias("text"),
            (i % 2 == 0).alias("has_format"),
            F.lit(False).alias("in_link"),
        )
        return F.when(i % 9 == 4, F.array(own, mark)).otherwise(F.array(own))

    lines = documents(spark, d).select(
        "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_idx", "raw")
    )
    return lines.select(
        "doc_id",
        F.lit("word/document.xml").alias("part"),
        F.lit("p").alias("kind"),
        F.col("line_idx").cast("bigint").alias("seq"),
        F.col("line_idx").alias("ordinal"),
        F.flatten(F.transform(F.split("raw", " ", -1), runs)).alias("runs"),
    )


def translated_md(spark: SparkSession, d: str, segments: DataFrame) -> DataFrame:
    """Stand-in translations of segments: accents removed; diagram tokens become one
    column wider; body lines at every seventh position have none."""
    folded = fold(F.col("text"))
    return segments.withColumn(
        "translated_text",
        F.when(F.col("type") == "diagram_token", F.concat(folded, F.lit("+")))
        .when((F.col("type") == "body") & (F.col("seq") % 7 == 3), F.lit(None))
        .when(F.col("type") == "body", F.concat(F.lit("|## "), folded, F.lit("|")))
        .otherwise(folded),
    )


def phrase_lines(spark: SparkSession, d: str) -> DataFrame:
    """Document lines with a footnote mark after the 20th character of every fourth."""
    lines = documents(spark, d).select(
        "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("seq", "raw")
    )
    marked = F.concat(F.substring("raw", 1, 20), F.lit("[3]"), F.expr("substr(raw, 21)"))
    return lines.select(
        "doc_id",
        F.col("seq").cast("bigint").alias("seq"),
        "raw",
        F.when(F.col("seq") % 4 == 0, marked).otherwise(F.col("raw")).alias("text"),
    )


def phrase_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Phrases cut from the same lines: whole lines, beginnings and short inner pieces."""
    line = strip_ws(F.col("raw"))
    source = (
        F.when(F.col("seq") % 3 == 0, line)
        .when(F.col("seq") % 3 == 1, F.substring(line, 1, 10))
        .otherwise(F.substring(line, 5, 4))
    )
    return phrase_lines(spark, d).select(
        "doc_id",
        "seq",
        source.alias("text"),
        F.concat(F.lit("«"), F.substring(line, 3, 5), F.lit("»")).alias("translated_text"),
    )


def glossary_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(
        F.col("item_id").alias("id"),
        F.expr("replace(substring(text, 1, length(text) div 2), '\n', ' ')").alias("jp"),
        F.expr("replace(substring(text, length(text) div 2 + 1), '\n', ' ')").alias("vi"),
        F.when(F.col("item_id") % 2 == 0, "general").alias("context"),
    )


def nation_terms(spark: SparkSession, d: str) -> DataFrame:
    """A glossary that does not grow with the data: the 25 nations."""
    return table(spark, d, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("id"),
        F.col("n_name").alias("jp"),
        F.initcap("n_name").alias("vi"),
        F.lit(None).cast("string").alias("context"),
    )


# ---- the stand-in model ---------------------------------------------------------------

_TABLE = str.maketrans(ACCENTED, FOLDED)


def stand_in(request: Request) -> str:
    """Deterministic model with the failures a real one shows: no answer, a wrong number
    of segments, untranslated segments and lost tags, chosen by text length."""
    if request.attempt == 0:
        size = len(request.prompt)
        if size % 11 == 0:
            raise TimeoutError
        pieces = [_batch_piece(t) for t in request.prompt.split(DELIMITER)]
        return DELIMITER.join(pieces + (["extra"] if size % 7 == 0 else []))
    size = len(request.prompt)
    if size % 13 == 0 or (size % 5 == 0 and request.attempt == 1):
        return request.prompt
    return request.prompt.translate(_TABLE)


def failing(request: Request) -> str:
    """The stand-in model, but for texts whose length is a multiple of 17 it raises."""
    if any(len(t) % 17 == 0 for t in request.prompt.split(DELIMITER)):
        raise RuntimeError("refused")
    return stand_in(request)


def _batch_piece(text: str) -> str:
    return text if len(text) % 5 == 0 else f" {text.translate(_TABLE)} "


# ---- packages and files built from documents ------------------------------------------


def docx_files(spark: SparkSession, d: str) -> DataFrame:
    """Each document as a word-processing package: one paragraph per line, its first ten
    characters formatted."""

    def build(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile
        from xml.sax.saxutils import escape

        ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"

        def run(text: str, bold: bool) -> str:
            mark = "<w:rPr><w:b/></w:rPr>" if bold else ""
            body = f'<w:t xml:space="preserve">{escape(text)}</w:t>'
            return f"<w:r>{mark}{body}</w:r>"

        for pdf in parts:
            packages = []
            for text in pdf["text"]:
                paragraphs = "".join(
                    f"<w:p>{run(line[:10], True)}{run(line[10:], False)}</w:p>"
                    for line in text.split("\n")
                )
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
                    package.writestr(
                        "word/document.xml",
                        f'<w:document xmlns:w="{ns}"><w:body>{paragraphs}</w:body></w:document>',
                    )
                    package.writestr("word/broken.xml", "<w:document>")
                packages.append(out.getvalue())
            yield pd.DataFrame(
                {"doc_id": pdf["doc_id"], "file_type": "docx", "content": packages}
            )

    return documents(spark, d).mapInPandas(
        build, "doc_id bigint, file_type string, content binary"
    )


def _packages(spark: SparkSession, d: str, file_type: str, parts_of) -> DataFrame:
    """Packages of the parts that ``parts_of(lines)`` gives, of every document."""

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for pdf in frames:
            packages = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
                    for name, content in parts_of(doc_id, text.split("\n")):
                        package.writestr(name, content)
                packages.append(out.getvalue())
            yield pd.DataFrame(
                {"doc_id": pdf["doc_id"], "file_type": file_type, "content": packages}
            )

    return documents(spark, d).mapInPandas(
        build, "doc_id bigint, file_type string, content binary"
    )


def _types(*parts: tuple[str, str]) -> tuple[str, str]:
    own = "".join(
        f'<Override PartName="/{name}" ContentType="application/vnd.openxmlformats-officedocument.{kind}+xml"/>'
        for name, kind in parts
    )
    ns = "http://schemas.openxmlformats.org/package/2006/content-types"
    return "[Content_Types].xml", f'<Types xmlns="{ns}">{own}</Types>'


def xlsx_files(spark: SparkSession, d: str) -> DataFrame:
    """Each document as a workbook: a sheet named by its id, lines at even places as shared
    strings, the others as inline strings."""

    def parts(doc_id, lines):
        from xml.sax.saxutils import escape

        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        cell = lambda t: f'<t xml:space="preserve">{escape(t)}</t>'
        shared = "".join(f"<si>{cell(t)}</si>" for t in lines[::2])
        rows = "".join(f'<row><c t="inlineStr"><is>{cell(t)}</is></c></row>' for t in lines[1::2])
        yield _types(
            ("xl/worksheets/one.xml", "spreadsheetml.worksheet"),
            ("xl/sharedStrings.xml", "spreadsheetml.sharedStrings"),
            ("xl/workbook.xml", "spreadsheetml.sheet.main"),
        )
        yield "xl/worksheets/one.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>"
        yield "xl/sharedStrings.xml", f"<sst {ns}>{shared}</sst>"
        yield "xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S{doc_id}"/></sheets></workbook>'
        yield "docProps/core.xml", "<core/>"

    return _packages(spark, d, "xlsx", parts)


def pptx_files(spark: SparkSession, d: str) -> DataFrame:
    """Each document as slides of twenty lines; the text before the first space of a line is
    formatted. Of every fifth document the second slide is cut off."""

    def parts(doc_id, lines):
        from xml.sax.saxutils import escape

        ns = (
            'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" '
            'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
        )
        slides = [lines[i : i + 20] for i in range(0, len(lines), 20)]
        names = [f"ppt/slides/slide{i}.xml" for i in range(len(slides))]
        yield _types(*((n, "presentationml.slide") for n in names))
        for i, (name, own) in enumerate(zip(names, slides)):
            made = ""
            for line in own:
                first, space, rest = line.partition(" ")
                made += f"<a:p><a:r><a:rPr b=\"1\"/><a:t>{escape(first)}</a:t></a:r>"
                made += f"<a:r><a:t>{escape(space + rest)}</a:t></a:r></a:p>"
            whole = f"<p:sld {ns}><p:txBody>{made}</p:txBody></p:sld>"
            yield name, whole[:-9] if i == 1 and doc_id % 5 == 0 else whole

    return _packages(spark, d, "pptx", parts)


# A kana for each accented letter, which the older Japanese charsets lack.
KANA = "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワンガギグゲゴザジズゼゾダデドバビブベ"
CHARSETS = (
    "utf-8", "utf-8-sig", "cp932", "euc_jp", "iso2022_jp", "utf-16", "utf-16-le", "utf-16-be", "cp1252",
)
JAPANESE = ("cp932", "euc_jp", "iso2022_jp")


def byte_files(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents as bytes of nine charsets in turn; for the Japanese ones accented
    letters become kana."""
    number = F.col("doc_id") % len(CHARSETS)
    japanese = number.isin([CHARSETS.index(c) for c in JAPANESE])
    text = F.when(japanese, F.translate("text", ACCENTED, KANA)).otherwise(F.col("text"))

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"],
                    "content": [
                        t.encode(CHARSETS[i % len(CHARSETS)]) for i, t in zip(pdf["doc_id"], pdf["text"])
                    ],
                }
            )

    return documents(spark, d).select("doc_id", text.alias("text")).mapInPandas(
        encode, "doc_id bigint, content binary"
    )
