"""Office paragraphs to tagged segments.

A paragraph is one row with its runs as an array, so run filters, tag numbering and run
boundaries are array expressions of that row.

Paragraph columns: ``doc_id, part, kind, seq, ordinal,
runs ARRAY<STRUCT<text, has_format, in_link>>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locengine.functions.text import (
    TAG,
    WHITESPACE,
    Profile,
    has_script,
    is_translatable,
    let,
    strip_tags,
    strip_ws,
)
from locengine.operators.extract import dedup_segments, split_pieces

FOOTNOTE = r"^\[\p{Nd}+\]$"
FOOTNOTE_ANY = r"\[\p{Nd}+\]"
RUNS = "array<struct<text:string,has_format:boolean,in_link:boolean>>"


def keep_runs(runs: Column) -> Column:
    """Runs without footnote markers and without runs inside hyperlinks."""
    return F.filter(
        runs,
        lambda r: ~r["in_link"]
        & ~(r["text"].contains("[") & strip_ws(r["text"]).rlike(FOOTNOTE)),
    )


def drop_noise_runs(paragraphs: DataFrame) -> DataFrame:
    """Footnote markers and link anchors are noise in word-processing parts only."""
    word = F.col("part").startswith("word/")
    runs = F.when(word, keep_runs(F.col("runs")))
    return paragraphs.withColumn("runs", runs.otherwise(F.col("runs")))


def numbered_runs(runs: Column) -> Column:
    """Runs with ``tag``: the 1-based number among formatted runs, null on plain ones."""

    def number(runs: Column, formatted: Column) -> Column:
        n = F.size(formatted)

        def piece(k: Column) -> Column:
            start = F.when(k == 0, F.lit(0)).otherwise(F.get(formatted, k - 1) + 1)
            stop = F.when(k == n, F.size(runs)).otherwise(F.get(formatted, k) + 1)
            return F.transform(
                F.slice(runs, start + 1, stop - start),
                lambda r: F.struct(
                    r["text"].alias("text"),
                    r["has_format"].alias("has_format"),
                    F.when(r["has_format"], k + 1).alias("tag"),
                ),
            )

        return F.flatten(F.transform(F.sequence(F.lit(0), n), piece))

    def formatted(runs: Column) -> Column:
        return F.filter(
            F.transform(runs, lambda r, i: F.when(r["has_format"], i)), lambda i: i.isNotNull()
        )

    return let(runs, lambda r: let(formatted(r), lambda f: number(r, f)))


def tagged_text(runs: Column) -> Column:
    """Runs joined in order, formatted ones wrapped in numbered tags; trimmed."""

    def mark(r: Column) -> Column:
        n = r["tag"].cast("string")
        return F.when(r["tag"].isNull(), r["text"]).otherwise(
            F.concat(F.lit("<tag"), n, F.lit(">"), r["text"], F.lit("</tag"), n, F.lit(">"))
        )

    return strip_ws(F.array_join(F.transform(numbered_runs(runs), mark), ""))


def tag_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(TAG))


def tag_runs(paragraphs: DataFrame, p: str | Profile = "ja") -> DataFrame:
    """One tagged segment per translatable paragraph, before splitting and dedup.

    Rows of packages that could not be read (``error`` set) pass through without text.
    """
    location = F.concat(
        "part", F.lit(":"), "kind", F.lit("["), F.col("ordinal").cast("string"), F.lit("]")
    )
    kind = (
        F.when(F.col("kind") == "sheet", "sheet_name")
        .when(F.col("part").startswith("xl/drawings/"), "drawing")
        .otherwise("body")
    )
    wanted = is_translatable(F.col("text"), p)
    if "error" in paragraphs.columns:
        wanted = wanted | F.col("error").isNotNull()
    # Tags and joints bring no character of the script, so runs without one need no tagging.
    def tagged(runs: Column) -> Column:
        return F.when(F.exists(runs, lambda r: has_script(r["text"], p)), tagged_text(runs))

    # The explode of one element keeps the filter above the tagging, which would otherwise
    # be pushed down and computed a second time.
    return (
        paragraphs.select("*", F.explode(F.array(let(F.col("runs"), tagged))).alias("text"))
        .filter(wanted)
        .select(
            *[c for c in paragraphs.columns if c not in ("runs", "kind", "ordinal")],
            location.alias("location"),
            kind.alias("type"),
            "text",
        )
    )


def strip_heavy_tags(
    segments: DataFrame, max_tags: int = 8, max_chars: int = 400, p: str | Profile = "ja"
) -> DataFrame:
    """Word-processing segments with more than ``max_tags`` tags lose the tags and are
    split at sentence ends; all others pass unchanged."""
    word = F.col("part").startswith("word/")
    heavy = word & (tag_count(F.col("text")) > max_tags)
    marked = segments.withColumn("_heavy", heavy)
    text = F.when(F.col("_heavy"), strip_tags(F.col("text"))).otherwise(F.col("text"))
    plain = marked.withColumn("text", text)
    return split_pieces(plain, max_chars, p, F.col("_heavy")).drop("_heavy")


def office_segments(paragraphs: DataFrame, p: str | Profile = "ja") -> DataFrame:
    """Paragraphs to deduplicated segments. ``seq`` is the paragraph's position in its
    document; pieces of a split paragraph share it and are ordered by ``piece``."""
    tagged = tag_runs(drop_noise_runs(paragraphs), p)
    return dedup_segments(strip_heavy_tags(tagged, p=p), order=("seq", "piece"))


def fix_run_boundaries(runs: Column) -> Column:
    """Texts of the runs; a run that ends in a letter before a run that begins with one
    gets a final space."""

    ws = F.lit(WHITESPACE)

    def edges(r: Column) -> Column:
        return F.struct(
            r["text"].alias("text"),
            F.right(F.rtrim(r["text"], ws), F.lit(1)).rlike(r"\p{L}").alias("ends"),
            F.left(F.ltrim(r["text"], ws), F.lit(1)).rlike(r"\p{L}").alias("begins"),
        )

    def spaced(found: Column) -> Column:
        return F.transform(
            found,
            lambda r, i: F.when(
                r["ends"] & F.get(found, i + 1)["begins"], F.concat(r["text"], F.lit(" "))
            ).otherwise(r["text"]),
        )

    return let(F.transform(runs, edges), spaced)


def match_paragraphs(
    paragraphs: DataFrame, tmap: DataFrame, keys: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Translation of each tagged paragraph: by its tagged text, else by the text without
    tags. ``match_kind`` is ``tagged``, ``plain`` or null.

    The map has one row per key, so neither join multiplies rows.
    """
    tagged = paragraphs.withColumn("_tagged", strip_ws(F.col("text"))).withColumn(
        "_plain", strip_ws(strip_tags(F.col("text")))
    )
    exact = tmap.select(
        *keys, F.col("source").alias("_tagged"), F.col("target").alias("_t1")
    )
    plain = tmap.select(
        *keys, F.col("source").alias("_plain"), F.col("target").alias("_t2")
    )
    return (
        tagged.join(exact, [*keys, "_tagged"], "left")
        .join(plain, [*keys, "_plain"], "left")
        .select(
            *paragraphs.columns,
            F.coalesce("_t1", "_t2").alias("translated_text"),
            F.when(F.col("_t1").isNotNull(), "tagged")
            .when(F.col("_t2").isNotNull(), "plain")
            .alias("match_kind"),
        )
    )
