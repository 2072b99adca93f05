"""Translated segments back into their documents.

Documents are cut into ranges of lines. Translated segments are grouped by document and range
once and everything else - cells, diagram tokens, line prefixes - happens inside the row of a
range; a rebuilt document is one output row, joined from its ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locengine.functions.text import fix_spacing, let, line_array, rebuild_line, visual_width
from locengine.operators.ordering import bucket_of

LINES = 4096  # of a range
_NO_PAIRS = "array<struct<seq:bigint,text:string,target:string>>"


def replace_cells(raw: Column, cells: Column) -> Column:
    """Replace the first occurrence of each cell text, longest text first.

    ``cells`` is an array of ``seq, text, target``.
    """
    ordered = F.transform(
        F.array_sort(
            F.transform(
                cells,
                lambda c: F.struct(
                    (-F.length(c["text"])).alias("rank"),
                    c["seq"].alias("seq"),
                    c["text"].alias("text"),
                    fix_spacing(c["target"]).alias("target"),
                ),
            )
        ),
        lambda c: F.struct(c["text"].alias("text"), c["target"].alias("target")),
    )
    return F.aggregate(ordered, raw, _replace_first)


def _replace_first(line: Column, c: Column) -> Column:
    at = F.position(c["text"], line)
    return F.when(
        at > 0,
        F.concat(
            line.substr(F.lit(1), at - 1),
            c["target"],
            line.substr(at + F.length(c["text"]), F.length(line)),
        ),
    ).otherwise(line)


def replace_tokens(raw: Column, tokens: Column) -> Column:
    """Replace every occurrence of each diagram token, from right to left.

    A translation takes the columns of the token and of the spaces after it and is padded
    to them; when it is wider the line overflows. Returns ``line, overflow``.
    """

    def occurrences(t: Column) -> Column:
        return let(
            F.split(raw, F.concat(F.lit("\\Q"), t["text"], F.lit("\\E")), -1),
            lambda parts: F.transform(
                F.sequence(F.lit(1), F.size(parts) - 1), lambda k: place(t, parts, k)
            ),
        )

    def place(t: Column, parts: Column, k: Column) -> Column:
        before = F.length(F.array_join(F.slice(parts, 1, k), "")) + (k - 1) * F.length(t["text"])
        return F.struct(
            (-before).alias("rank"),
            t["seq"].alias("seq"),
            F.length(t["text"]).alias("length"),
            t["target"].alias("target"),
            t["old_width"].alias("old_width"),
            t["new_width"].alias("new_width"),
        )

    # The same token can stand on a line several times; the first entry is used.
    def first_entries(texts: Column) -> Column:
        return F.filter(
            tokens,
            lambda t, i: (F.array_position(texts, t["text"]) == i + 1)
            & (F.position(t["text"], raw) > 0),
        )

    def measured(t: Column) -> Column:
        return let(
            fix_spacing(t["target"]),
            lambda target: F.struct(
                t["seq"].alias("seq"),
                t["text"].alias("text"),
                target.alias("target"),
                visual_width(t["text"]).alias("old_width"),
                visual_width(target).alias("new_width"),
            ),
        )

    distinct = F.transform(
        let(F.transform(tokens, lambda t: t["text"]), first_entries), measured
    )

    def step(acc: Column, o: Column) -> Column:
        at = -o["rank"]
        tail = acc["line"].substr(at + o["length"] + 1, F.length(acc["line"]))
        return let(tail, lambda rest: put(acc, o, at, rest, F.ltrim(rest)))

    def put(acc: Column, o: Column, at: Column, rest: Column, kept: Column) -> Column:
        room = o["old_width"] + F.length(rest) - F.length(kept)
        pad = F.repeat(F.lit(" "), F.greatest(room - o["new_width"], F.lit(0)))
        return F.struct(
            F.concat(acc["line"].substr(F.lit(1), at), o["target"], pad, kept).alias("line"),
            (acc["overflow"] | (o["new_width"] > room)).alias("overflow"),
        )

    return F.aggregate(
        F.array_sort(F.flatten(F.transform(distinct, occurrences))),
        F.struct(raw.alias("line"), F.lit(False).alias("overflow")),
        step,
        lambda acc: F.struct(
            fix_spacing(acc["line"]).alias("line"), acc["overflow"].alias("overflow")
        ),
    )


def line_edits(segments: DataFrame) -> DataFrame:
    """Per document and range of LINES lines, ``_range``, the array ``edits`` of ``line_idx, cells,
    body, tokens``.

    Partitioned by range once; both groupings use that partitioning.
    """
    changed = F.col("text") != F.col("translated_text")
    pair = F.struct("seq", "text", F.col("translated_text").alias("target"))

    def pairs(kind: str) -> Column:
        return F.array_sort(
            F.collect_list(F.when((F.col("type") == kind) & changed, pair))
        ).alias(kind)

    body = F.when(~F.col("type").isin("table_cell", "diagram_token"), F.struct("seq", "translated_text"))
    return (
        segments.filter("translated_text <> ''")
        .select(
            "doc_id",
            bucket_of("line_idx", LINES).cast("int").alias("_range"),
            "line_idx", "seq", "type", "text", "translated_text",
        )
        .repartition("doc_id", "_range")
        .groupBy("doc_id", "_range", "line_idx")
        .agg(pairs("table_cell"), pairs("diagram_token"), F.max(body).alias("body"))
        .groupBy("doc_id", "_range")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "line_idx",
                        F.col("table_cell").alias("cells"),
                        F.col("diagram_token").alias("tokens"),
                        F.col("body.translated_text").alias("body"),
                    )
                )
            ).alias("edits")
        )
    )


def _rewritten(raw: Column, e: Column) -> Column:
    """``line, kind, overflow`` of an edited line: cells, then body, then tokens."""

    def out(line: Column, kind: str, overflow: Column) -> Column:
        return F.struct(
            line.alias("line"), F.lit(kind).alias("kind"), overflow.alias("overflow")
        )

    no = F.lit(False)
    diagram = let(
        replace_tokens(raw, e["tokens"]), lambda r: out(r["line"], "diagram", r["overflow"])
    )
    return (
        F.when(F.size(e["cells"]) > 0, out(replace_cells(raw, e["cells"]), "cells", no))
        .when(e["body"].isNotNull(), out(rebuild_line(raw, e["body"]), "body", no))
        .when(F.size(e["tokens"]) > 0, diagram)
        .otherwise(out(raw, "same", no))
    )


_EDITS = (
    f"array<struct<line_idx:int,cells:{_NO_PAIRS},tokens:{_NO_PAIRS},body:string>>"
)


def line_ranges(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep, _range, _lines``: the lines of every document in ranges of LINES, at least one."""
    lines = F.col("_all")

    def cut(k: Column) -> Column:
        return F.slice(lines, k * LINES + 1, F.lit(LINES))

    last = F.greatest((F.size(lines) - 1) / LINES, F.lit(0)).cast("int")
    ranges = F.transform(F.sequence(F.lit(0), last), cut)
    return docs.select(*keep, line_array(F.col("text")).alias("_all")).select(
        *keep, F.posexplode(ranges).alias("_range", "_lines")
    )


def _with_edits(ranges: DataFrame, segments: DataFrame, how: str) -> DataFrame:
    joined = ranges.join(line_edits(segments), ["doc_id", "_range"], how)
    first = F.col("_range") * LINES
    known = F.filter("edits", lambda e: e["line_idx"] < first + F.size("_lines"))
    return joined.withColumn("edits", F.coalesce(known, F.array().cast(_EDITS)))


def rewrite_lines(docs: DataFrame, segments: DataFrame) -> DataFrame:
    """Edited lines only: ``doc_id, line_idx, raw, line, kind, overflow``."""
    return (
        _with_edits(line_ranges(docs, ["doc_id"]), segments, "inner")
        .select("doc_id", "_range", "_lines", F.explode("edits").alias("e"))
        .select(
            "doc_id",
            F.col("e.line_idx").alias("line_idx"),
            F.get("_lines", F.col("e.line_idx") - F.col("_range") * LINES).alias("raw"),
            "e",
        )
        .select("*", F.explode(F.array(_rewritten(F.col("raw"), F.col("e")))).alias("r"))
        .select("doc_id", "line_idx", "raw", "r.line", "r.kind", "r.overflow")
    )


def rebuild_documents(docs: DataFrame, segments: DataFrame) -> DataFrame:
    """``docs`` with ``text`` rebuilt; documents without segments stay as they are.

    Edits are applied range by range, so a document of many lines is spread over tasks; at the
    end its ranges are joined. The unchanged stretches between edited lines are taken over as
    slices, so the work is linear in the lines. ``doc_id`` is unique; rows without one have no
    segments.
    """
    own = [c for c in docs.columns if c not in ("doc_id", "text")]
    ends = F.when(F.col("text").rlike(r"[\r\n]\z"), "\n").otherwise("").alias("_end")

    def piece(lines: Column, edits: Column, k: Column) -> Column:
        at = lambda j: F.get(edits, j)["line_idx"] - F.col("_range") * LINES
        start = F.when(k == 0, F.lit(0)).otherwise(at(k - 1) + 1)
        stop = F.when(k == F.size(edits), F.size(lines)).otherwise(at(k))
        new = _rewritten(F.get(lines, at(k)), F.get(edits, k))["line"]
        return F.concat(
            F.slice(lines, start + 1, stop - start),
            F.when(k < F.size(edits), F.array(new)).otherwise(
                F.array().cast("array<string>")
            ),
        )

    lines, edits = F.col("_lines"), F.col("edits")
    pieces = F.transform(
        F.sequence(F.lit(0), F.size(edits)), lambda k: piece(lines, edits, k)
    )
    known = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    kept = known.withColumn("_own", F.struct(*own, ends))
    ranges = line_ranges(kept, ["doc_id", "_own"])
    done = _with_edits(ranges, segments, "left").select(
        "doc_id",
        F.when(F.col("_range") == 0, F.col("_own")).alias("_own"),
        F.struct("_range", F.array_join(F.flatten(pieces), "\n").alias("text")).alias("_part"),
    )
    whole = done.groupBy("doc_id").agg(
        F.any_value("_own", True).alias("_own"), F.array_sort(F.collect_list("_part")).alias("_parts")
    )
    text = F.concat(F.array_join(F.transform("_parts", lambda x: x["text"]), "\n"), F.col("_own._end"))
    rebuilt = whole.select("doc_id", *(F.col(f"_own.`{c}`").alias(c) for c in own), text.alias("text"))
    others = docs.filter("doc_id IS NULL OR text IS NULL")
    return rebuilt.unionByName(others).select(*[c for c in docs.columns if c != "text"], "text")
