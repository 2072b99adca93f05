"""Prompts, batches for the model, and routing of its replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locengine.functions.text import TAG, Profile, has_leak, strip_ws, tags_match
from locengine.operators.extract import OFFICE_TYPES, TEXT_TYPES

# Fixed value: what separates the segments of a batch in prompt and reply.
DELIMITER = "|||"
DELIMITER_PATTERN = r"\|\|\|"

BASE_PROMPT = (
    "Translate each segment from the source language into the target language.\n"
    f"Segments are separated by {DELIMITER}; return the same number of segments, "
    f"separated by {DELIMITER}, and nothing else.\n"
    "Leave English words, numbers, units, names and symbols as they are."
)
CONTEXT = {
    "docx": "The segments are headings, paragraphs and table cells of a text document.",
    "xlsx": "The segments are labels and cell texts of a spreadsheet; keep them short.",
    "pptx": "The segments are titles and bullet points of slides; be concise.",
    "pdf": "The segments are texts of a fixed-layout document.",
    "md": "The segments are lines of a Markdown file; keep all markup.",
    "txt": "The segments are lines of plain text.",
    "csv": "The segments are lines of a data file; keep numbers and dates.",
}
OFFICE_RULES = (
    "Numbered tags such as <tag1>...</tag1> mark formatting: keep every tag, and put a "
    "space between a closing tag and a following word."
)
TEXT_RULES = "Keep line prefixes, list marks, links and column separators unchanged."
GLOSSARY_HEAD = "Use these translations:\n| Source | Target | Context |\n|:---|:---|:---|"
GLOSSARY_TAIL = "Every term of the table must be translated as given there."
TAG_WARNING = "The last translation lost tags. Keep exactly these tags: "
LEAK_WARNING = "Translate everything; leave no word in the source script."

GLOSSARY_CHARS = 1 << 20  # of a glossary in a prompt, unless the caller allows more
BROADCAST_CHARS = 1 << 22  # longer prompts are joined without a hint


def base_prompts() -> dict[str, str]:
    """Prompt per file type without glossary."""
    rules = dict.fromkeys(OFFICE_TYPES, OFFICE_RULES) | dict.fromkeys(TEXT_TYPES, TEXT_RULES)
    return {
        file_type: "\n".join(t for t in (BASE_PROMPT, context, rules.get(file_type)) if t)
        for file_type, context in CONTEXT.items()
    }


def glossary_lines(terms: DataFrame) -> DataFrame:
    """Glossary as the ordered rows ``part, id, line`` of one table: a head, the terms by ``id``
    and a tail; no rows when there are no terms. Sorted in ranges, so no task holds it all."""
    row = F.concat(
        F.lit("| "), "jp", F.lit(" | "), "vi", F.lit(" | "), F.coalesce("context", F.lit("")),
        F.lit(" |"),
    )
    any_term = terms.limit(1).select(F.lit(1))
    frame = any_term.select(
        F.inline(
            F.array(
                *(
                    F.struct(F.lit(part).alias("part"), F.lit(None).cast("bigint").alias("id"), F.lit(line).alias("line"))
                    for part, line in ((0, GLOSSARY_HEAD), (2, "\n" + GLOSSARY_TAIL))
                )
            )
        )
    )
    own = terms.select(F.lit(1).alias("part"), F.col("id").cast("bigint").alias("id"), row.alias("line"))
    return own.unionByName(frame).orderBy("part", "id", "line")


def glossary_text(terms: DataFrame | None, max_chars: int = GLOSSARY_CHARS) -> str:
    """Glossary for one prompt, "" when empty.

    A prompt holds it whole, so the terms are measured first: a glossary of more than
    ``max_chars`` characters is refused instead of being cut.
    """
    if terms is None:
        return ""
    lines = glossary_lines(terms)
    chars = lines.agg(F.coalesce(F.sum(F.length("line") + 1), F.lit(0))).head()[0]
    if chars > max_chars:
        raise ValueError(f"glossary of {chars} characters does not fit a prompt")
    return "\n".join(r["line"] for r in lines.select("line").toLocalIterator())


def build_prompts(
    spark: SparkSession, terms: DataFrame | None = None, max_chars: int = GLOSSARY_CHARS
) -> DataFrame:
    """``file_type, system``: one row per supported file type."""
    glossary = glossary_text(terms, max_chars)
    rows = [
        (file_type, prompt + ("\n" + glossary if glossary else ""))
        for file_type, prompt in base_prompts().items()
    ]
    prompts = spark.createDataFrame(rows, "file_type string, system string")
    small = sum(len(system) for _, system in rows) <= BROADCAST_CHARS
    return F.broadcast(prompts) if small else prompts


def with_prompt(segments: DataFrame, prompts: DataFrame) -> DataFrame:
    """Add ``system`` by file type; the prompt table has one row per supported type."""
    return segments.join(prompts, "file_type", "left")


def retry_warning(text: Column, attempt: Column) -> Column:
    """Text added to the system prompt of a retry: nothing on the first attempt, then the
    tags to keep (if there are any) and the script warning."""
    tags = F.regexp_extract_all(text, F.lit(TAG), F.lit(0))
    tag_part = F.when(
        F.size(tags) > 0, F.concat(F.lit(TAG_WARNING), F.array_join(tags, " "), F.lit("\n"))
    ).otherwise("")
    return F.when(attempt > 1, F.concat(F.lit("\n\n"), tag_part, F.lit(LEAK_WARNING))).otherwise("")


def batch_rows(packed: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per batch with its ``entries`` (``seq, text``) in order; the batch limit
    bounds the array."""
    return packed.groupBy(*keys, "batch_id", "file_type").agg(
        F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("entries")
    )


def reply_parts(reply: Column) -> Column:
    return F.transform(F.split(strip_ws(reply), DELIMITER_PATTERN, -1), strip_ws)


def check_batches(replies: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document: batches, segments sent, pieces returned, batches with another count, and
    those without a reply, which returned none."""
    sent = F.size("entries")
    lost = F.col("reply").isNull()
    fault = F.col("error").isNotNull() if "error" in replies.columns else F.lit(False)
    got = F.when(lost, 0).otherwise(F.size(reply_parts(F.col("reply"))))
    return replies.groupBy(*keys).agg(
        F.count("*").alias("batches"),
        F.sum(sent).alias("sent"),
        F.sum(got).alias("received"),
        F.count_if(sent != got).alias("mismatched"),
        F.count_if(lost & ~fault).alias("timeouts"),
    )


def route_replies(
    replies: DataFrame, p: str | Profile = "ja", keys: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """One row per segment with ``translated_text`` and ``route``.

    ``accept``; ``error``, ``count``, ``leak`` or ``tags`` when it has to be retried;
    ``timeout`` when the batch got no reply and keeps its source text.
    """
    if "error" not in replies.columns:
        replies = replies.withColumn("error", F.lit(None).cast("string"))
    parts = reply_parts(F.col("reply"))
    matching = F.size("entries") == F.size("parts")
    rows = replies.withColumn("parts", parts).select(
        *[c for c in replies.columns if c not in ("entries", "reply")],
        F.col("reply").isNull().alias("_timeout"),
        matching.alias("_matching"),
        F.posexplode("entries").alias("_pos", "_e"),
        "parts",
    )
    piece = F.when(F.col("_matching"), F.get("parts", F.col("_pos")))
    routed = rows.select(
        *[c for c in rows.columns if not c.startswith("_") and c != "parts"],
        "_timeout",
        "_matching",
        F.col("_e.seq").alias("seq"),
        F.col("_e.text").alias("text"),
        piece.alias("_piece"),
    )
    route = (
        F.when(F.col("error").isNotNull(), "error")
        .when(F.col("_timeout"), "timeout")
        .when(~F.coalesce("_matching", F.lit(False)), "count")
        .when(has_leak(F.col("_piece"), p), "leak")
        .when(~tags_match(F.col("text"), F.col("_piece")), "tags")
        .otherwise("accept")
    )
    return routed.select(
        *[c for c in routed.columns if not c.startswith("_")],
        F.when(F.col("_timeout"), F.col("text"))
        .otherwise(F.col("_piece"))
        .alias("translated_text"),
        route.alias("route"),
    )
