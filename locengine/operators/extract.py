"""Text documents to segments.

A document is one row, and all of its lines are worked on inside that row: fences,
diagram blocks, cells and tokens need no shuffle and no window, and the position of a
segment in its document falls out of the final explode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locengine.functions.text import (
    WHITESPACE,
    Profile,
    has_script,
    is_translatable,
    let,
    line_array,
    line_location,
    profile,
    sentence_pieces,
    strip_ws,
    token_pattern,
)

FENCE = "```"
# Characters that make a fenced block a diagram.
BOX = r"[┌┐└┘│├┤─┬┴┼╔╗╚╝║╠╣═╦╩╬+|]"

TEXT_TYPES = ("txt", "md", "csv")
OFFICE_TYPES = ("docx", "xlsx", "pptx")


def is_fence(raw: Column) -> Column:
    return F.ltrim(raw, F.lit(WHITESPACE)).startswith(FENCE)


def fence_blocks(text: Column) -> Column:
    """Split a document at its fence lines.

    ``n`` fences give ``n + 1`` blocks of lines between them. Block ``k`` lies inside a
    closed fence when ``k`` is odd and a closing fence follows it (``k < n``).
    """

    def cut(lines: Column, fences: Column) -> Column:
        n = F.size(fences)

        def block(k: Column) -> Column:
            start = F.when(k == 0, F.lit(0)).otherwise(F.get(fences, k - 1) + 1)
            stop = F.when(k == n, F.size(lines)).otherwise(F.get(fences, k))
            return F.struct(
                k.alias("block"),
                start.alias("start"),
                ((k % 2 == 1) & (k < n)).alias("inside"),
                F.slice(lines, start + 1, stop - start).alias("lines"),
            )

        return F.transform(F.sequence(F.lit(0), n), block)

    def fences_of(lines: Column) -> Column:
        return F.when(
            text.contains(FENCE),
            F.filter(
                F.transform(lines, lambda line, i: F.when(is_fence(line), i)),
                lambda i: i.isNotNull(),
            ),
        ).otherwise(F.array().cast("array<int>"))

    return let(line_array(text), lambda lines: let(fences_of(lines), lambda f: cut(lines, f)))


def explode_lines(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per line: 0-based ``line_idx``, ``raw`` and the trimmed ``text``."""
    return docs.select(
        *keep, F.posexplode(line_array(F.col("text"))).alias("line_idx", "raw")
    ).withColumn("text", strip_ws(F.col("raw")))


def mark_lines(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Lines without fence lines, with ``block``, ``inside`` and ``is_diagram``."""
    blocks = docs.select(*keep, F.explode(fence_blocks(F.col("text"))).alias("b")).select(
        *keep,
        "b.*",
        (
            F.col("b.inside") & F.exists("b.lines", lambda line: line.rlike(BOX))
        ).alias("is_diagram"),
    )
    return blocks.select(
        *keep, "block", "start", "inside", "is_diagram", F.posexplode("lines")
    ).select(
        *keep,
        (F.col("start") + F.col("pos")).alias("line_idx"),
        F.col("col").alias("raw"),
        "block",
        "inside",
        "is_diagram",
    )


# ---- segments of one line -------------------------------------------------------------


def _segment(line_idx: Column, kind: str, cell: Column, text: Column) -> Column:
    return F.struct(
        line_idx.cast("int").alias("line_idx"),
        F.lit(kind).alias("type"),
        cell.cast("int").alias("cell_index"),
        text.alias("text"),
    )


def is_table_row(text: Column) -> Column:
    return text.startswith("|") & text.endswith("|")


def _tokens(raw: Column, idx: Column, p: Profile) -> Column:
    found = F.regexp_extract_all(raw, F.lit(token_pattern(p)), F.lit(0))
    return F.transform(
        F.filter(found, lambda t: has_script(t, p)),
        lambda t: _segment(idx, "diagram_token", F.lit(None), strip_ws(t)),
    )


def _cells(text: Column, idx: Column, p: Profile) -> Column:
    inner = text.substr(F.lit(2), F.length(text) - 2)
    return F.filter(
        F.transform(
            F.split(inner, r"\|", -1),
            lambda cell, i: _segment(idx, "table_cell", i, strip_ws(cell)),
        ),
        lambda s: is_translatable(s["text"], p),
    )


def _line_segments(raw: Column, text: Column, idx: Column, diagram: Column, p: Profile):
    return (
        F.when(diagram, _tokens(raw, idx, p))
        .when(~is_translatable(text, p), F.array().cast(_SEGMENTS))
        .when(is_table_row(text), _cells(text, idx, p))
        .otherwise(F.array(_segment(idx, "body", F.lit(None), text)))
    )


_SEGMENTS = "array<struct<line_idx:int,type:string,cell_index:int,text:string>>"


def segment_array(text: Column, p: str | Profile = "ja") -> Column:
    """All segments of a document in order, as an array."""
    p = profile(p)

    def of_block(b: Column) -> Column:
        diagram = b["inside"]
        lines = F.transform(
            b["lines"],
            lambda line, i: F.struct(
                line.alias("raw"), strip_ws(line).alias("text"), (b["start"] + i).alias("idx")
            ),
        )
        return F.flatten(
            F.transform(
                lines, lambda x: _line_segments(x["raw"], x["text"], x["idx"], diagram, p)
            )
        )

    kept = F.filter(
        fence_blocks(text),
        lambda b: ~b["inside"] | F.exists(b["lines"], lambda line: line.rlike(BOX)),
    )
    return F.flatten(F.transform(kept, of_block))


def extract_text(
    docs: DataFrame, p: str | Profile = "ja", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Body lines, table cells and diagram tokens of text documents.

    ``seq`` is the 0-based position of the segment in its document.
    """
    return (
        docs.filter(has_script(F.col("text"), p))
        .select(*keep, F.posexplode(segment_array(F.col("text"), p)).alias("seq", "s"))
        .select(
            *keep,
            F.col("seq").cast("bigint").alias("seq"),
            line_location(F.col("s.line_idx")).alias("location"),
            "s.*",
        )
    )


def _only(kind: str) -> Callable[..., DataFrame]:
    def operator(
        docs: DataFrame, p: str | Profile = "ja", keep: tuple[str, ...] = ("doc_id",)
    ) -> DataFrame:
        return extract_text(docs, p, keep).filter(F.col("type") == kind)

    operator.__doc__ = f"Segments of type ``{kind}``."
    return operator


body_segments = _only("body")
table_cells = _only("table_cell")
diagram_tokens = _only("diagram_token")


# ---- common to all formats ------------------------------------------------------------


def dedup_segments(
    segments: DataFrame, keys: tuple[str, ...] = ("doc_id",), order: tuple[str, ...] = ("seq",)
) -> DataFrame:
    """First segment per document and trimmed text.

    ``min`` over a struct is combined before the shuffle, so a text that fills a large
    part of the table leaves each task as one row.
    """
    rest = [c for c in segments.columns if c not in keys and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("first")
    return (
        segments.groupBy(*keys, strip_ws(F.col("text")).alias("_key"))
        .agg(first)
        .select(*keys, "first.*")
        .select(*segments.columns)
    )


def split_pieces(
    segments: DataFrame,
    max_chars: int = 400,
    p: str | Profile = "ja",
    where: Column | None = None,
) -> DataFrame:
    """Split over-long texts at sentence ends; ``location`` gets a ``[pK]`` suffix.

    Segments outside ``where`` stay whole. One pass: a whole segment is an array of one.
    """
    text = F.col("text")
    long = (F.length(text) > max_chars) & (F.lit(True) if where is None else where)
    pieces = F.when(long, sentence_pieces(text, max_chars, p)).otherwise(F.array(text))
    suffix = F.concat(F.lit("[p"), F.col("_k").cast("string"), F.lit("]"))
    return (
        segments.withColumn("_long", F.coalesce(long, F.lit(False)))
        .select("*", F.posexplode(pieces).alias("_k", "_piece"))
        .select(
            *[c for c in segments.columns if c not in ("text", "location")],
            F.when(F.col("_long"), F.concat("location", suffix))
            .otherwise(F.col("location"))
            .alias("location"),
            F.when(F.col("_long"), F.col("_k")).alias("piece"),
            F.col("_piece").alias("text"),
        )
    )


def segment_counts(docs: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments per document and type; a document without any has status ``failed``."""
    counts = segments.groupBy("doc_id", "type").agg(F.count("*").alias("segments"))
    return docs.select("doc_id").join(counts, "doc_id", "left").select(
        "doc_id",
        "type",
        F.coalesce("segments", F.lit(0)).alias("segments"),
        F.when(F.col("segments").isNull(), "failed").otherwise("extracted").alias("status"),
    )
