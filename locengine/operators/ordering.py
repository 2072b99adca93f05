"""Order-dependent work per key that does not put a whole key into one task.

Rows of a key are cut into buckets of an integer order column. Each bucket is worked on by
itself, the buckets are combined through one small row each, and the result of the
combination is added back. A key with a third of all rows therefore spreads over as many
tasks as it has buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = 2048


def bucket_of(column: str, size: int) -> Column:
    """Bucket number of an integer column, by integer division."""
    return F.expr(f"{column} div {size}")


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key by ``order``; combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    last = F.max(F.struct(*order, *rest)).alias("last")
    return df.groupBy(*keys).agg(last).select(*keys, "last.*").select(*df.columns)


def running_sum(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: Column,
    out: str,
    bucket: int = BUCKET,
) -> DataFrame:
    """Sum of ``value`` over the rows of a key up to and including the current one.

    The first order column must be a non-negative integer of which a key holds each value
    a limited number of times.
    """
    cut = df.withColumn("_bucket", bucket_of(order[0], bucket)).withColumn("_v", value)
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    earlier = (
        Window.partitionBy(*keys)
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    base = (
        cut.groupBy(*keys, "_bucket")
        .agg(F.sum("_v").alias("_s"))
        .select(
            *keys, "_bucket", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_base")
        )
    )
    within = cut.withColumn(
        "_local", F.sum("_v").over(local.rowsBetween(Window.unboundedPreceding, 0))
    )
    return (
        within.join(base, [*keys, "_bucket"])
        .withColumn(out, F.col("_base") + F.col("_local"))
        .select(*df.columns, out)
    )


def renumber(
    df: DataFrame, keys: list[str], order: list[str], out: str, bucket: int = BUCKET
) -> DataFrame:
    """Dense 0-based position of each row in its key."""
    counted = running_sum(df, keys, order, F.lit(1).cast("bigint"), "_position", bucket)
    return counted.drop(*[c for c in [out] if c in df.columns]).withColumnRenamed(
        "_position", out
    ).withColumn(out, F.col(out) - 1)


class _Bucket:
    """Greedy batches over the lengths of one bucket, for every row that may begin one.

    A batch that begins at row i ends before row ``next[i]``, which two running sums and a
    search give; following these pointers by doubling them gives, for all rows at once, the
    batches up to the end of the bucket, or the rows that a given start leads to.
    """

    def __init__(self, lens: np.ndarray, max_chars: int, max_segs: int):
        self.n, at = len(lens), np.arange(len(lens))
        self.sums = np.concatenate(([0], np.cumsum(lens, dtype=np.int64)))
        fits = np.searchsorted(self.sums[1:], self.sums[:-1] + max_chars, side="right")
        self.next = np.append(np.clip(fits, at + 1, np.minimum(at + max_segs, self.n)), self.n)
        self.rounds = max(1, self.n.bit_length())

    def last(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each start: how many batches follow, and the first row of the last of them."""
        jump, count, last = self.next.copy(), np.ones(self.n + 1, dtype=np.int64), np.arange(self.n + 1)
        count[-1] = 0
        for _ in range(self.rounds):
            more = jump < self.n
            last = np.where(more, last[jump], last)
            count = count + np.where(more, count[jump], 0)
            jump = jump[jump]
        return count[:-1], last[:-1]

    def starts(self, first: int) -> np.ndarray:
        """Which rows begin a batch, if row ``first`` does."""
        found, jump = np.zeros(self.n + 1, dtype=bool), self.next
        found[first] = True
        for _ in range(self.rounds):
            found[jump[found]] = True
            jump = jump[jump]
        return found[:-1]


def _lists(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The fields of each list of (number, length), by number."""
    fields = column.flatten()
    numbers, lens = (fields.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    ends = np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        order = np.argsort(numbers[a:b], kind="stable")
        yield numbers[a:b][order], lens[a:b][order]


def pack_batches(
    segments: DataFrame,
    max_chars: int = 3000,
    max_segs: int = 5,
    keys: tuple[str, ...] = ("doc_id",),
    bucket: int = BUCKET,
) -> DataFrame:
    """``batch_id`` per segment: greedy packing in ``seq`` order within each document.

    A batch closes when it holds ``max_segs`` segments or when the next one would exceed
    ``max_chars``. Packing is sequential, so a bucket of segments is summarised as a function:
    for each row that can begin its first batch (at most ``max_segs``) the batches opened and
    the open one at the end. One task follows these functions through a document, one small
    row per bucket and without holding them, and each bucket is then packed by itself. Time
    grows with the segments, whatever the size of a bucket.

    Only ``seq`` and text lengths are shuffled. Returns ``keys, seq, batch_id``; ``seq`` is
    a unique non-negative integer per document.
    """
    k = list(keys)
    # The explicit null filters are those that the join below would add to one of its two
    # sides; with them on both, the exchange of the buckets is computed once and reused.
    bounded = (
        segments.filter(" AND ".join(f"{c} IS NOT NULL" for c in [*k, "seq"]))
        .select(
            *k,
            bucket_of("seq", bucket).alias("_bucket"),
            F.struct(
                F.col("seq").cast("bigint").alias("seq"), F.length("text").cast("bigint").alias("len")
            ).alias("_row"),
        )
        .filter("_bucket IS NOT NULL")
        .groupBy(*k, "_bucket")
        .agg(F.collect_list("_row").alias("_rows"))
    )
    ids = [T.StructField(c, segments.schema[c].dataType) for c in k]
    longs = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    arrays = ["_head", "_count", "_segs", "_chars"]
    functions = T.StructType(
        [*ids, *longs("_bucket", "_n", "_total")]
        + [T.StructField(c, T.ArrayType(T.LongType())) for c in arrays]
    )

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for _, lens in _lists(batch.column(len(k) + 1)):
                b = _Bucket(lens, max_chars, max_segs)
                count, last = b.last()
                m = min(max_segs, b.n)
                chars = b.sums[-1] - b.sums[last[:m]]
                made.append((b.n, int(b.sums[-1]), lens[:m], count[:m], b.n - last[:m], chars))
            columns = [pa.array(c) for c in zip(*made, strict=True)]
            if made:
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(k) + 1], *columns], functions.names)

    entries = T.StructType([*ids, *longs("_bucket", "_taken", "_before")])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, opened, segs, chars = None, 0, 0, 0
        for batch in batches:
            taken_, before = [], []
            own = list(zip(*(c.to_pylist() for c in batch.columns[: len(k)]), strict=True))
            rest = zip(*(c.to_pylist() for c in batch.columns[len(k) + 1 :]), strict=True)
            for key, (n, total, head, count, end_segs, end_chars) in zip(own, rest, strict=True):
                if key != document:
                    document, opened, segs, chars = key, 0, 0, 0
                taken, room = 0, chars
                while segs and taken < len(head) and segs + taken < max_segs and room + head[taken] <= max_chars:
                    room += head[taken]
                    taken += 1
                taken_.append(taken)
                before.append(opened)
                if taken == n:
                    segs, chars = segs + n, chars + total
                else:
                    opened, segs, chars = opened + count[taken], end_segs[taken], end_chars[taken]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(k) + 1], pa.array(taken_, pa.int64()), pa.array(before, pa.int64())],
                entries.names,
            )

    packed = T.StructType([*ids, *longs("seq", "batch_id")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs, numbers = [], []
            lists = _lists(batch.column(len(k) + 1))
            entry = zip(*(batch.column(len(k) + i).to_pylist() for i in (2, 3)), strict=True)
            for (seq, lens), (taken, before) in zip(lists, entry, strict=True):
                opens = np.zeros(len(seq), dtype=bool)
                if taken < len(seq):
                    opens = _Bucket(lens, max_chars, max_segs).starts(taken)
                seqs.append(seq)
                numbers.append(before - 1 + np.cumsum(opens))
            if seqs:
                row = pa.array(np.repeat(np.arange(len(seqs)), [len(x) for x in seqs]))
                own = [c.take(row) for c in batch.columns[: len(k)]]
                made = [pa.array(np.concatenate(x)) for x in (seqs, numbers)]
                yield pa.RecordBatch.from_arrays([*own, *made], packed.names)

    order = [*k, "_bucket"]
    chained = (
        bounded.mapInArrow(summarise, functions)
        .repartition(*k)
        .sortWithinPartitions(*order)
        .mapInArrow(follow, entries)
    )
    return bounded.join(chained, order).select(*order, "_rows", "_taken", "_before").mapInArrow(pack, packed)
