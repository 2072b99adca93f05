"""Bilingual exchange files to segments.

A file is fed to a pull parser piece by piece, which hands over one unit at a time; its inline
elements are walked node by node and become tags. Units before a fault in a file are kept, and
the fault is a row of its own with ``error``: a bad file never ends a job.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locengine.functions.inline import Numbers, local_name, tagged_text
from locengine.functions.markup import map_state
from locengine.functions.text import is_blank
from locengine.sources.arrow import explode_rows

UNITS = (
    T.StructType()
    .add("version", "string")
    .add("unit_no", "long")
    .add("unit_id", "string")
    .add("source", "string")
    .add("target", "string")
    .add("state", "string")
    .add("notes", T.ArrayType(T.StringType()))
    .add("error", "string")
)
_NAMESPACE = "urn:oasis:names:tc:xliff:document:"
_CHUNK = 1 << 16


def _version(root: ET.Element) -> str:
    """Version attribute, else the namespace's, else 1.2."""
    space = root.tag[1:].partition("}")[0] if root.tag.startswith("{") else ""
    return root.get("version") or space.removeprefix(_NAMESPACE).partition(":")[0] or "1.2"


def _child(node: ET.Element, name: str) -> ET.Element | None:
    return next((c for c in node if local_name(c) == name), None)


def _rows(unit: ET.Element, version: str, first: int) -> Iterator[dict]:
    second = version.startswith("2")
    pairs = [c for c in unit if local_name(c) == "segment"] if second else [unit]
    notes = [
        "".join(n.itertext())
        for holder in [unit, *(c for c in unit if local_name(c) == "notes")]
        for n in holder
        if local_name(n) == "note"
    ]
    numbers = Numbers()
    for number, pair in enumerate(pairs, first):
        source, target = _child(pair, "source"), _child(pair, "target")
        holder = pair if second else target
        yield {
            "version": version,
            "unit_no": number,
            "unit_id": unit.get("id"),
            "source": None if source is None else tagged_text(source, numbers),
            "target": None if target is None else tagged_text(target, numbers),
            "state": None if holder is None else holder.get("state"),
            "notes": notes,
        }


def file_units(content: bytes) -> Iterator[dict]:
    """Rows of one file in order; the last one tells what was wrong with it, if anything was."""
    parser = ET.XMLPullParser(("start", "end"))

    def events() -> Iterator[tuple[str, ET.Element]]:
        for at in range(0, len(content), _CHUNK):
            parser.feed(content[at : at + _CHUNK])
            yield from parser.read_events()
        parser.close()
        yield from parser.read_events()

    path: list[ET.Element] = []
    version, number = "1.2", 0
    try:
        for event, node in events():
            if event == "start":
                if not path:
                    version = _version(node)
                    if local_name(node) != "xliff":
                        raise ValueError(f"not an exchange file: {local_name(node)}")
                path.append(node)
                continue
            path.pop()
            if local_name(node) == ("unit" if version.startswith("2") else "trans-unit"):
                for row in _rows(node, version, number):
                    yield row
                    number += 1
                path[-1].remove(node)
    except (ET.ParseError, ValueError, LookupError) as fault:
        yield {"version": version, "unit_no": number, "error": str(fault)}


_CONFIDENCE = (
    "substring(try_element_at(filter(notes, n -> startswith(n, 'confidence: ')), -1), 13)"
)


def _note(prefix: str) -> Column:
    found = F.filter("notes", lambda n: n.startswith(prefix))
    return F.substring(F.try_element_at(found, F.lit(-1)), len(prefix) + 1, 1 << 30)


def xliff_rows(files: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys, content`` of exchange files to segments and faults, in file order.

    Columns: ``keys, version, unit_no, seq, unit_id, text, translated_text, xliff_state,
    location, type, confidence, error``. A row with ``error`` has no text.
    """
    k = list(keys)

    def rows(file: dict) -> Iterator[dict]:
        ids = {c: file[c] for c in k}
        for unit in file_units(file["content"] or b""):
            yield ids | unit

    schema = T.StructType([*[files.schema[c] for c in k], *UNITS.fields])
    units = explode_rows(files.select(*k, F.col("content").cast("binary")), rows, schema)
    second = F.col("version").startswith("2")
    good = F.col("error").isNull()
    target = F.coalesce("target", F.lit(""))
    state = F.when(F.col("state") != "", F.col("state"))
    return units.select(
        *k,
        "version",
        "unit_no",
        F.col("unit_no").alias("seq"),
        "unit_id",
        F.when(good, F.coalesce("source", F.lit(""))).alias("text"),
        F.when(good, F.when(is_blank(target), "").otherwise(target)).alias("translated_text"),
        F.when(second & state.isNotNull(), map_state(state, "1.2"))
        .otherwise(state)
        .alias("xliff_state"),
        _note("location: ").alias("location"),
        _note("type: ").alias("type"),
        F.expr(f"try_cast({_CONFIDENCE} AS double)").alias("confidence"),
        "error",
    )


def xliff_segments(files: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The segments among ``xliff_rows``."""
    return xliff_rows(files, keys).filter("error IS NULL").drop("error")


def read_xliff(spark: SparkSession, path: str) -> DataFrame:
    """Segments and faults of all exchange files below ``path``, keyed by file path."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{xlf,xliff,txt}")
        .load(path)
    ).withColumnRenamed("path", "doc_id")
    return xliff_rows(files)
