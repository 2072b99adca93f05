"""What the operators share: columns beside the input's, keys of texts, salted counts, bitmaps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from locengine.llm.words import grouped

BITMAP_BITS = 1 << 24  # 2 MB; what is broadcast never exceeds it, whatever the input
SALTS = 64


def prepare(spark: SparkSession) -> SparkSession:
    """Smaller batches for Python workers: rows here hold whole texts.

    The registered queries and the pipeline's stages call it; others may, as with configure().
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """The table without columns that an operator is about to add: its own outputs win."""
    taken = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in taken))


def text_columns(
    df: DataFrame,
    text: str,
    fields: list[StructField],
    compute: Callable[[list[bytes | None]], list[list]],
    most: int = 1 << 20,
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """The table's columns and `fields`, computed from one text column in slices of limited size.

    compute gets the texts of a slice as UTF-8 (None where null), then the values of the
    `extra` columns, and returns one list per field. Columns of the input that are named
    like a field are replaced; the extra columns are left out of the result.
    """
    raw = free_name(df, "raw_text")
    names = [f.name for f in fields]
    source = df.withColumn(raw, F.col(f"`{text}`").cast("binary"))
    kept = [c for c in without(df, [*names, *extra]).columns]
    source = source.select(*(F.col(f"`{c}`") for c in [*kept, raw, *extra]))
    schema = StructType([df.schema[c] for c in kept] + fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, texts in slices(batch.column(len(kept)), most):
                part = batch.slice(a, len(texts))
                more = [part.column(len(kept) + 1 + i).to_pylist() for i in range(len(extra))]
                made = compute(texts, *more)
                arrays = [part.column(i).cast(arrow.field(i).type) for i in range(len(kept))]
                arrays += [
                    pa.array(v, type=arrow.field(len(kept) + i).type) for i, v in enumerate(made)
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return source.mapInArrow(run, schema)


def text_keys(text: str | Column) -> tuple[Column, Column]:
    """Two independent 64-bit keys of a text; equal texts have equal keys."""
    c = F.col(f"`{text}`") if isinstance(text, str) else text
    return F.xxhash64(c), F.xxhash64(F.lit("second key"), c)


def marked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counting keys whose hot values are split: salt and whether seen twice in this batch.

    The first row of each key has salt 0 and meets the first rows of other batches; the
    others are known to be repeated and go anywhere.
    """
    n = len(keys)
    if not n:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=bool)
    order = np.argsort(keys, kind="stable")
    new = np.concatenate(([True], keys[order][1:] != keys[order][:-1]))
    sizes = np.diff(np.append(np.flatnonzero(new), n))
    salt, twice = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=bool)
    salt[order] = np.where(new, 0, 1 + np.arange(n) % SALTS)
    twice[order] = np.repeat(sizes > 1, sizes)
    return salt, twice


def bitmap(keys: DataFrame, key: str) -> np.ndarray:
    """Bits of the keys' remainders: 2 MB at most, so that it may be broadcast.

    It only spares a shuffle of rows that have no partner; a join decides.
    """
    slot = F.pmod(F.col(key), F.lit(BITMAP_BITS))
    rows = (
        keys.select((slot / 64).cast("long").alias("word"), (slot % 64).cast("int").alias("bit"))
        .groupBy("word")
        .agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
        .toArrow()
    )
    words = np.zeros(BITMAP_BITS // 64, dtype=np.int64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return words


def sieve(df: DataFrame, key: str, bits: np.ndarray, hit: bool = True) -> DataFrame:
    """Rows whose key may be (hit) or certainly is not (not hit) among the bitmap's keys."""
    at = df.columns.index(key)
    shared = df.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            slot = batch.column(at).to_numpy(zero_copy_only=False) % BITMAP_BITS
            found = (words[slot // 64] >> (slot % 64)) & 1 == 1
            kept = batch.filter(pa.array(found if hit else ~found))
            if kept.num_rows:
                yield kept

    return df.mapInArrow(run, df.schema)


def slices(
    texts: pa.Array, most: int = 1 << 20
) -> Iterator[tuple[int, int, list[bytes | None]]]:
    """Bounds and values of slices of about `most` bytes of a column, one slice in memory."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for a, b in grouped(sizes, most):
        yield a, b, texts.slice(a, b - a).to_pylist()
