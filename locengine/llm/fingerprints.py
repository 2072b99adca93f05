"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the k least distinct 48-bit hashes of a text's shingles of `n` words. Sketches
of parts merge into the sketch of the whole. Two sketches estimate resemblance and containment,
one the number of distinct shingles; with fewer than k shingles all are exact. As text a
sketch is base64 of its hashes in ascending order.

A text with fewer words than a shingle has one shingle of all; null and empty texts have an
empty sketch, which is equal to another empty one and unlike all others.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from locengine.llm.common import slices, text_columns
from locengine.llm.words import Words, grouped

K, WORDS = 128, 5
_LEAST = np.iinfo(np.int64).min
_NEIGHBOURS = (
    "{id} long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double, n_shingles double, "
    "contained_in_next double"
)


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """Of 64-bit shingle hashes in any order."""
    short = hashes >> np.uint64(16)
    if len(short) > 4 * k:
        # Equal hashes may fill the first places, so more are taken until k differ.
        least = np.unique(short[short <= np.partition(short, 2 * k)[2 * k]])
        if len(least) >= k:
            return least[:k]
    return np.unique(short)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of two parts together."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of common shingles in all of both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = merge(a, b, k)
    common = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(both, common, assume_unique=True).sum() / len(both))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**48 / (float(a[k - 1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the first text's shingles that stand in the second."""
    if not len(a):
        return 1.0
    shared = resemblance(a, b, k) * distinct(merge(a, b, k), k)
    return min(1.0, shared / distinct(a, k))


def as_text(a: np.ndarray) -> str:
    raw = a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()
    return base64.b64encode(raw).decode()


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), dtype=np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), dtype=np.uint8)
    wide[:, 2:] = raw
    return wide.view(">u8").reshape(-1).astype(np.uint64)


def sketches(texts: list[bytes], n: int = WORDS, k: int = K) -> list[np.ndarray]:
    """Sketches of whole texts."""
    out = []
    for a, b in grouped([len(t) for t in texts]):
        words = Words(texts[a:b])
        h, _ = words.windows(n)
        for i, j in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
            own = h[i : j - n + 1] if j - i >= n else words.whole(i, j)
            out.append(sketch(own, k))
    return out


def fingerprint(docs: DataFrame, text: str = "text", n: int = WORDS, k: int = K) -> DataFrame:
    """The documents with their fingerprint; such a column of the input is replaced."""

    def compute(raws):
        return [[as_text(s) for s in sketches([r or b"" for r in raws], n, k)]]

    return text_columns(docs, text, [StructField("fingerprint", StringType())], compute)


def edited(text: str, other: str) -> str:
    """The text's last half replaced by the first characters of the other, as many or all."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _splits(ids: DataFrame, parts: int) -> np.ndarray:
    cuts = ids.approxQuantile("id", [i / parts for i in range(1, parts)], 0.2 / parts)
    return np.unique(np.array(cuts, dtype=np.float64))


def _bucket(splits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.searchsorted(splits, ids.astype(np.float64), side="right")


def _dealt(splits: np.ndarray, firsts: dict[int, int], before: dict[int, int], arrow: pa.Schema):
    """Rows with their bucket; a bucket's first document also ends the bucket before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.array(batch.column(1))
            bucket = _bucket(splits, key)
            first = np.array([firsts[b] for b in bucket.tolist()], dtype=np.int64)
            ends = np.flatnonzero(key == first)
            to = np.array([before[b] for b in bucket[ends].tolist()], dtype=np.int64)
            for part, own, tail in (
                (batch, bucket, False),
                (batch.take(pa.array(ends)), to, True),
            ):
                if part.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(part.column(i) for i in range(4)),
                            pa.array(own.astype(np.int32)),
                            pa.array(np.full(part.num_rows, tail)),
                        ],
                        schema=arrow,
                    )

    return run


def _compared(n: int, k: int, arrow: pa.Schema):
    """Rows id, key, tie, raw, bucket, tail in order: each document with the next one."""

    def row(now, after):
        number, text, own = now
        made = edited(text, after[1])
        raw = made.encode()
        other = sketches([raw], n, k)[0]
        return (
            number,
            len(text),
            hashlib.sha256(raw).hexdigest(),
            as_text(own),
            as_text(other),
            resemblance(own, other, k),
            resemblance(own, after[2], k),
            distinct(own, k),
            containment(own, after[2], k),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # bucket, (id, text, sketch)
        for batch in batches:
            for a, b, texts in slices(batch.column(3)):
                raws = [r or b"" for r in texts]
                columns = (batch.column(i).slice(a, b - a).to_pylist() for i in (0, 4, 5))
                rows = []
                for number, bucket, tail, raw, own in zip(
                    *columns, raws, sketches(raws, n, k), strict=True
                ):
                    now = (number, raw.decode("utf-8", "replace"), own)
                    if last is not None and last[0] == bucket:
                        rows.append(row(last[1], now))
                    last = None if tail else (bucket, now)
                if rows:
                    yield _batch(rows, arrow)

    return run


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
    )


def compare_with_next(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = WORDS, k: int = K
) -> DataFrame:
    """Of each document: fingerprints of its text and of its edited text, and how near the
    edited text and the next document are.

    The next document is that with the next id, after the last the first; null ids come
    first, and rows of equal id follow a hash of their texts. Other columns are left out.

    Documents are dealt once, by ranges of ids; the first of a range is sent to the range
    before as well. Ranges follow quantiles, so gaps in the ids do no harm.
    """
    spark = docs.sparkSession
    id_ = F.col(f"`{doc_id}`").cast("long")
    rows = docs.select(
        id_.alias("id"),
        F.coalesce(id_, F.lit(_LEAST)).alias("key"),
        F.xxhash64(F.col(f"`{text}`")).alias("tie"),
        F.col(f"`{text}`").cast("binary").alias("raw"),
    )
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.coalesce(id_, F.lit(_LEAST)).alias("id"))
    splits = _splits(ids, parts)
    arrow = to_arrow_schema(StructType.fromDDL("bucket int, first long"))

    def least(batches):
        for batch in batches:
            key = np.array(batch.column(0))
            bucket = _bucket(splits, key)
            own = np.unique(bucket)
            firsts = [key[bucket == b].min() for b in own]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.astype(np.int32)), pa.array(firsts, type=pa.int64())], schema=arrow
            )

    found = ids.mapInArrow(least, "bucket int, first long").groupBy("bucket")
    firsts = {r.bucket: r.first for r in found.agg(F.min("first").alias("first")).collect()}
    order = sorted(firsts)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    ddl = "id long, key long, tie long, raw binary, bucket int, tail boolean"
    dealt = rows.mapInArrow(
        _dealt(splits, firsts, before, to_arrow_schema(StructType.fromDDL(ddl))), ddl
    )
    dealt = dealt.repartition(parts // 4, "bucket").sortWithinPartitions(
        "bucket", "tail", "key", "tie"
    )
    out = _NEIGHBOURS.format(id="id")
    made = dealt.mapInArrow(_compared(n, k, to_arrow_schema(StructType.fromDDL(out))), out)
    return made.withColumnRenamed("id", doc_id)
