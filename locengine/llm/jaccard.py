"""N-gram Jaccard join with PartEnum signatures.

A text's set has the distinct hashes of its shingles of `n` words (A-Z in lower case, words
as ASCII white space leaves them); a text with fewer words has one shingle of all, a text
without words has an empty set and is linked with nothing. Two texts are linked when
100 * intersection >= percent * union.

Sizes are cut into bands so that linked sets lie in the same or in neighbouring bands, and
each set works in its own band and the next one. In a band, linked sets differ in at most k
elements. The domain of hashes is cut into more than k parts, so that linked sets agree in a
whole part; the signature of a set in a part is a hash of its elements there (the subsets of
parts enumerated are the single ones, which gives the fewest signatures for these
thresholds). No link can be missed, and every candidate is verified on the sets themselves.

Equal texts are one node. A bucket of at most `SMALL` nodes gives all its pairs. Each set has a
sketch, one bit per element or more: whether an odd number of its elements falls on the bit. Two
sets differ in at least as many elements as their sketches in bits, so a pair whose sketches
differ in too many is dropped before any set is moved, and no link is lost. Pairs that are left
form groups; the sets of a small group are brought together once and compared. Of a large group,
the pairs that verified links have not connected yet are compared. A larger
bucket has a pivot, and the nodes that meet in buckets of one pivot, or of pivots that meet, are
brought together once: in one task, sketches in numpy leave few pairs to compare, and nodes that
links have connected none. If these are too many for a task, each node is compared with one pivot
only, first with that of its heaviest bucket, and buckets of connected nodes are done.
Nodes that are not connected with the pivot may be linked with other nodes of the bucket. Two of them that are near the pivot have nearly
the same difference from it, so they share one of the rarest elements of it; two that are far
from it share one of their own rarest elements. Those meet in new, smaller buckets, and so on
until no large bucket is left: no link is lost, and no group gives all pairs.

Null texts count as empty. Rows of equal id or text are separate documents. Empty tables give empty
results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from locengine.config import materialise
from locengine.llm.common import (
    bitmap,
    free_name,
    marked,
    sieve,
    slices,
    text_keys,
    without,
)
from locengine.llm.components import components
from locengine.llm.words import Words, mixed

SMALL = 32
# What one task compares of the members of a pivot's buckets: 64 MB of elements, 30 s at worst.
MOST_NODES = 1 << 15
MOST_ELEMENTS = 1 << 23
_SLOTS = 1 << 20
# One row per document (signature null) and one per signature of a text.
_SIGNED = "signature long, t1 long, t2 long, id long, n long, salt int, twice boolean"
_SETS = "t1 long, t2 long, n long, elements array<long>"
_SKETCHES = "t1 long, t2 long, n long, sketch binary"


@lru_cache(64)
def bands(percent: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """First size of each band, and its number of parts.

    There are so many parts that a set nearly always has more than k that are not empty: the
    mean of their number lies three deviations above.
    """
    first, parts = [1], []
    for _ in range(count):
        most = first[-1] * 100 // percent
        first.append(most + 1)
        k = most * (100 - percent) // percent
        n = k + 1
        while k and n < 8 * (k + 2):
            empty = math.exp(-most / n)
            spread = n * empty * (1 - empty * (1 + most / n))
            if n * (1 - empty) - 3 * math.sqrt(max(0.0, spread)) >= k + 1:
                break
            n += 1
        parts.append(n)
    return np.array(first, dtype=np.int64), np.array(parts, dtype=np.int64)


def signatures(
    sets: list[np.ndarray], percent: int, frequent: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sorted sets and the index of the set that each belongs to.

    A set of size s differs from a smaller or equal linked one in at most k(s) elements, so it
    signs its first k(s) + 1 parts that are not empty. Of two linked sets, all parts before the
    first non-empty one in which they agree differ or are empty in both; so either set has
    at most k of the smaller one before it, and both sign it.

    Linked sets agree as well where `frequent` elements are left out of both, so signatures
    are first made without them. Sets that then have k or fewer parts meet sets that have more
    in those, and each other by parts of all elements and, if still too few, by empty parts.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if not sizes.sum():
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    elements = np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)), sizes)
    count = 8
    while bands(percent, count)[0][-3] <= sizes.max():
        count *= 2
    first, numbers = bands(percent, count)
    own = np.searchsorted(first, np.maximum(sizes, 1), side="right") - 1
    k = sizes * (100 - percent) // percent
    made, belongs = [], []
    rare = np.ones(len(elements), dtype=bool)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, elements), len(frequent) - 1)
        rare = frequent[at] != elements
    for tag in (own, own + 1):
        parts = numbers[tag]
        mark, at, _, full = _parts(elements[rare], of[rare], parts, 2 * tag, k)
        made.append(mark)
        belongs.append(at)
        few = (full <= k) & (sizes > 0)
        some = few[of]
        mark, at, part, full = _parts(elements[some], of[some], parts, 2 * tag + 1, k)
        made.append(mark)
        belongs.append(at)
        for i in np.flatnonzero((full <= k) & few).tolist():
            empty = np.setdiff1d(np.arange(parts[i]), part[at == i])
            tags = np.full(len(empty), 2 * tag[i] + 1)
            made.append(_sign(np.zeros(len(empty), np.uint64), empty, tags))
            belongs.append(np.full(len(empty), i))
    return np.concatenate(made), np.concatenate(belongs)


def _parts(
    elements: np.ndarray, of: np.ndarray, parts: np.ndarray, tag: np.ndarray, k: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signature, set and number of the first k + 1 non-empty parts of each set, and how many
    each set has in all. Elements are sorted, so a part is a range of them."""
    if not len(elements):
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint64), none, none, np.zeros(len(k), dtype=np.int64)
    part = (elements >> np.uint64(33)).astype(np.int64) * parts[of] >> 31
    edge = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (of[1:] != of[:-1]))))
    sums = np.add.reduceat(mixed(elements), edge)
    at, number = of[edge], part[edge]
    full = np.bincount(at, minlength=len(k))
    place = np.arange(len(at)) - np.repeat(np.cumsum(full) - full, full)
    early = place <= k[at]
    mark = _sign(sums[early], number[early], tag[at[early]])
    return mark, at[early], number[early], full


def _sign(sums: np.ndarray, part: np.ndarray, tag: np.ndarray) -> np.ndarray:
    where = part.astype(np.uint64) << np.uint64(20) | tag.astype(np.uint64)
    return mixed(sums + mixed(where + np.uint64(1)))


def _shingles(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    return Words([t.lower() if t else b"" for t in texts]).shingles(n)


def _frequent(rows: DataFrame, n: int, share: float, most: int = 1 << 20) -> np.ndarray:
    """Sorted elements that stand in four or more different texts of a share of all texts.

    The share is fixed, so an element's number of texts, not the size of the table, decides. Such
    elements are left out of signatures to spare candidates; no link depends on which they
    are. `most` of them are kept, the commonest ones: 8 MB to broadcast.
    """
    chosen = rows.where(F.pmod("t2", F.lit(1 << 20)) < share * (1 << 20))
    chosen = chosen.dropDuplicates(["t1", "t2"]).select("raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in slices(batch.column(0)):
                each = np.concatenate([*_shingles(texts, n), np.zeros(0, dtype=np.uint64)])
                value, count = np.unique(each, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value.view(np.int64)), pa.array(count)], names=["element", "seen"]
                )

    found = chosen.mapInArrow(run, "element long, seen long").groupBy("element")
    found = materialise(found.agg(F.sum("seen").alias("seen")).where("seen >= 4"), "frequent")
    table = found.orderBy(F.desc("seen"), "element").limit(most).select("element").toArrow()
    return np.sort(table.column("element").to_numpy().view(np.uint64))


def _signed(n: int, percent: int, frequent, arrow: pa.Schema, turn: int, passes: int):
    """The signatures of one pass, and in the first one a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed = 0
        for batch in batches:
            t1, t2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rows = batch.num_rows
            count = np.zeros(rows, dtype=np.int64)
            for a, b, texts in slices(batch.column(3)):
                sets = _shingles(texts, n)
                count[a:b] = [len(s) for s in sets]
                _, alone = np.unique(t1[a:b], return_index=True)  # a text once a slice
                mark, of = signatures([sets[i] for i in alone], percent, frequent.value)
                own = mark % np.uint64(passes) == turn
                mark, of = mark[own], of[own]
                salt, twice = marked(mark)
                at = a + alone[of] if len(of) else np.zeros(0, dtype=np.int64)
                empty = pa.nulls(len(mark), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(mark.view(np.int64)),
                        pa.array(t1[at]),
                        empty,
                        empty,
                        empty,
                        pa.array(salt),
                        pa.array(twice),
                    ],
                    schema=arrow,
                )
            if turn:
                continue
            salt = np.arange(seed, seed + rows) % 4096
            seed += rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(rows, pa.int64()),
                    pa.array(t1),
                    pa.array(t2),
                    batch.column(2),
                    pa.array(count),
                    pa.array(salt.astype(np.int32)),
                    pa.array(np.ones(rows, dtype=bool)),
                ],
                schema=arrow,
            )

    return run


def _sets(n: int, arrow: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, alone = np.unique(batch.column(0).to_numpy(), return_index=True)
            batch = batch.take(pa.array(alone))
            for a, b, texts in slices(batch.column(2)):
                sets = _shingles(texts, n)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(
                            pa.array(offsets), pa.array(values), type=arrow.field(3).type
                        ),
                    ],
                    schema=arrow,
                )

    return run


def sketch(elements: np.ndarray) -> bytes:
    """Parity of the number of elements on each bit; as many bits as elements or up to twice that.

    The number of bits is a power of two, 64 or more.
    """
    bits = max(64, 1 << (len(elements) - 1).bit_length()) if len(elements) else 64
    odd = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ: their sets differ in as many elements or more.

    The longer sketch is folded: the parity of two bits together is their sum's.
    """
    if len(a) < len(b):
        a, b = b, a
    x, size = int.from_bytes(a, "little"), len(a)
    while size > len(b):
        size //= 2
        x = x >> 8 * size ^ x & (1 << 8 * size) - 1
    return (x ^ int.from_bytes(b, "little")).bit_count()


def _sketched(n: int, arrow: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, alone = np.unique(batch.column(0).to_numpy(), return_index=True)
            batch = batch.take(pa.array(alone))
            for a, b, texts in slices(batch.column(2)):
                sets = _shingles(texts, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        pa.array([len(s) for s in sets], type=pa.int64()),
                        pa.array([sketch(s) for s in sets], type=pa.binary()),
                    ],
                    schema=arrow,
                )

    return run


def _of_texts(rows: DataFrame, nodes: DataFrame, made, n: int, ddl: str) -> DataFrame:
    """What `made` computes of the text of each node (t1)."""
    arrow = to_arrow_schema(StructType.fromDDL(ddl))
    texts = sieve(rows.select("t1", "t2", "raw"), "t1", bitmap(nodes, "t1"))
    found = texts.mapInArrow(made(n, arrow), ddl)
    return found.join(nodes, "t1", "left_semi").dropDuplicates(["t1", "t2"])


def _alike(members: DataFrame, labels: DataFrame | None, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (t1, u1) of buckets (bucket, t1, held, index, probe): an `index` and a `probe` row
    that no label holds together and whose sizes and sketches allow a link.

    The sketches go to the members, so pairs without a link are made and dropped inside a task. Of
    a bucket the `held` rows, one of its sides at least, come first and stay in memory; the
    others pass by them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, kept = None, []
        for batch in batches:
            made: list[tuple[int, int]] = []
            for now, held, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != bucket:
                    bucket, kept = now, []
                index, probe, t, l1, l2, n, first = row
                for index_, probe_, u, r1, r2, m, other in kept:
                    if (
                        (index and probe_ or probe and index_)
                        and t != u
                        and (l1 != r1 or l2 != r2)
                        and min(n, m) * 100 >= max(n, m) * percent
                        and (100 + percent) * least_difference(first, other) <= (100 - percent) * (n + m)
                    ):
                        made.append((t, u) if t < u else (u, t))
                if held:
                    kept.append(row)
            ends = zip(*set(made), strict=True) if made else [(), ()]
            columns = [pa.array(c, type=pa.int64()) for c in ends]
            yield pa.RecordBatch.from_arrays(columns, names=["t1", "u1"])

    rows = members.join(sketches, "t1")
    own = F.struct("t1", "t2")
    if labels is not None:
        rows, own = rows.join(labels, "t1", "left"), F.coalesce("l", own)
    rows = rows.withColumn("own", own).select(
        "bucket", "held", "index", "probe", "t1", "own.t1", "own.t2", "n", "sketch"
    )
    rows = rows.toDF("bucket", "held", "index", "probe", "t1", "l1", "l2", "n", "sketch")
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", F.desc("held"))
    return rows.mapInArrow(run, "t1 long, u1 long").distinct()


def _whole(buckets: DataFrame) -> DataFrame:
    """Members of buckets of limited size, all pairs of which count."""
    yes = F.lit(True)
    return buckets.select("bucket", "t1", yes.alias("held"), yes.alias("index"), yes.alias("probe"))


def _pairs_of(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """All pairs t1 < u1 of buckets (bucket, t1), but those of one label."""
    own = buckets.select("bucket", "t1").join(labels, "t1", "left")
    other = own.select("bucket", F.col("t1").alias("u1"), F.col("l").alias("r"))
    apart = F.expr("t1 < u1 and (l is null or r is null or l <> r)")
    return own.join(other, "bucket").where(apart).select("t1", "u1").distinct()


def _labels(links: DataFrame) -> DataFrame:
    """(t1, l) of the texts of links: the label of their component."""
    rows = components(links).select(F.col("node.t1").alias("t1"), F.col("label").alias("l"))
    return materialise(rows, "labels")


def _compared(pairs: DataFrame, sets: DataFrame, keep: list[str]) -> DataFrame:
    """Pairs (t1, u1, ...) with both sets: node, other, n, m, elements, others."""
    left = sets.select(
        "t1", F.struct("t1", "t2").alias("node"), "n", "elements"
    )
    right = sets.select(
        F.col("t1").alias("u1"),
        F.struct("t1", "t2").alias("other"),
        F.col("n").alias("m"),
        F.col("elements").alias("others"),
    )
    return pairs.join(left, "t1").join(right, "u1").select(
        *keep, "node", "other", "n", "m", "elements", "others"
    )


def _linked(percent: int):
    """100 * shared >= percent * (n + m - shared), the share of the union."""
    shared = F.size(F.array_intersect("elements", "others"))
    return (100 + percent) * shared >= percent * (F.col("n") + F.col("m"))


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    near = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    rows = _compared(pairs, sets, []).where("node <> other").where(near).where(_linked(percent))
    return rows.select(F.col("node").alias("a"), F.col("other").alias("b"))


def _sized(buckets: DataFrame) -> DataFrame:
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"))
    return buckets.join(sizes, "bucket")


def _pivoted(large: DataFrame) -> DataFrame:
    """(bucket, t1, u1, weight): each other member of a bucket with the bucket's pivot.

    The pivot of a bucket is the member that stands in most large buckets.
    """
    weight = F.sum("members").over(Window.partitionBy("t1"))
    best = (
        large.withColumn("weight", weight)
        .groupBy("bucket")
        .agg(F.max(F.struct("weight", "t1")).alias("best"))
        .select("bucket", F.col("best.t1").alias("u1"), F.col("best.weight").alias("weight"))
    )
    return materialise(
        large.select("bucket", "t1").join(best, "bucket").where("t1 <> u1"), "pivots"
    )


def _rows_of(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """The values of some rows one after the other, and where each row begins."""
    sizes = offsets[rows + 1] - offsets[rows]
    starts = np.cumsum(sizes) - sizes
    return values[np.arange(sizes.sum()) + np.repeat(offsets[rows] - starts, sizes)], starts


def _sketches(elements: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row per set: its sketch, of one length for all, in words of 64 bits."""
    sizes = np.diff(offsets)
    bits = max(64, 1 << (int(sizes.max()) - 1).bit_length())
    out = np.zeros((len(sizes), bits // 64), dtype=np.uint64)
    step = max(1, (1 << 22) // bits)
    for a in range(0, len(sizes), step):
        b = min(a + step, len(sizes))
        slot = (elements[offsets[a] : offsets[b]] & np.uint64(bits - 1)).astype(np.int64)
        slot += bits * np.repeat(np.arange(b - a), sizes[a:b])
        odd = (np.bincount(slot, minlength=(b - a) * bits) & 1).astype(np.uint8)
        out[a:b] = np.packbits(odd, bitorder="little").view(np.uint64).reshape(b - a, -1)
    return out


def spanning(elements: np.ndarray, offsets: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect all linked sets: i and j of sets elements[offsets[i]:offsets[i + 1]].

    Every pair of sets in different components is compared, first by sketches. A set of the
    component `main` needs no turn of its own: the others meet it in theirs.
    """
    sizes, found = np.diff(offsets), []
    count = len(sizes)
    marks = _sketches(elements, offsets)
    names, ids = np.unique(elements, return_inverse=True)
    own = np.zeros(len(names), dtype=bool)
    root, main = np.arange(count), -1
    for i in range(count):
        if i == 16:
            main = int(np.bincount(root).argmax())
        if main >= 0 and root[i] == root[main]:
            continue
        least, most = np.minimum(sizes, sizes[i]), np.maximum(sizes, sizes[i])
        near = np.flatnonzero((root != root[i]) & (least * 100 >= most * percent))
        apart = np.bitwise_count(marks[near] ^ marks[i]).sum(1, dtype=np.int64)
        near = near[(100 + percent) * apart <= (100 - percent) * (sizes[near] + sizes[i])]
        mine = ids[offsets[i] : offsets[i + 1]]
        own[mine] = True
        at, step = 0, 8
        while at < len(near):
            some = near[at : at + step]
            some = some[root[some] != root[i]]
            at, step = at + step, min(2 * step, 1024)
            if not len(some):
                continue
            values, starts = _rows_of(ids, offsets, some)
            shared = np.add.reduceat(own[values], starts, dtype=np.int64)
            for j in some[(100 + percent) * shared >= percent * (sizes[some] + sizes[i])].tolist():
                if root[j] != root[i]:
                    found.append((i, j))
                    root[root == root[j]] = root[i]
        own[mine] = False
    return found


def _compared_whole(percent: int, arrow: pa.Schema):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        cells = table.column("elements").chunk(0)
        elements = cells.flatten().to_numpy().view(np.uint64)
        offsets = cells.offsets.to_numpy().astype(np.int64)
        found = spanning(elements, offsets - offsets[0], percent)
        ends = np.array(found, dtype=np.int64).reshape(-1, 2)
        t1, t2 = table.column("t1").to_numpy(), table.column("t2").to_numpy()
        columns = [x[ends[:, k]] for k in (0, 1) for x in (t1, t2)]
        return pa.Table.from_arrays([pa.array(c) for c in columns], schema=arrow)

    return run


def _together(
    pivoted: DataFrame, sets: DataFrame, percent: int
) -> tuple[DataFrame, DataFrame | None]:
    """Links that connect all that are linked of the nodes that share a pivot's buckets, and the
    rows of pivots that have too many for this, if there are any.

    Pivots share most of their nodes. All nodes that pivots connect are compared at once where
    that is not more work than one pivot after the other.
    """
    pairs = pivoted.select("t1", "u1").distinct()
    members = materialise(
        pairs.unionByName(pairs.select(F.col("u1").alias("t1"), "u1").distinct()), "members"
    )
    label = components(members.select(F.col("t1").alias("a"), F.col("u1").alias("b")))
    label = label.select(F.col("node").alias("t1"), "label")
    rows = members.join(label, "t1").join(sets.select("t1", "n"), "t1")
    size = [F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("elements")]
    fits = (F.col("nodes") <= MOST_NODES) & (F.col("elements") <= MOST_ELEMENTS)
    sizes = rows.groupBy("u1", "label").agg(*size).withColumn("few", fits)
    work = sizes.groupBy("label").agg(F.sum(F.col("nodes") * F.col("nodes")).alias("work"))
    whole = rows.dropDuplicates(["t1", "label"]).groupBy("label").agg(*size).join(work, "label")
    less = F.col("nodes") * F.col("nodes") <= F.col("work")
    whole = whole.select("label", (fits & less).alias("whole"))
    sizes = materialise(sizes.join(whole, "label").select("u1", "label", "few", "whole"), "sizes")
    once = sizes.where("whole").select("label").distinct()
    own = sizes.where("few and not whole").select("u1")
    groups = label.join(once, "label").select(F.col("label").alias("grp"), "t1").unionByName(
        members.join(own, "u1").select(F.col("u1").alias("grp"), "t1")
    )
    ddl = "a1 long, a2 long, b1 long, b2 long"
    arrow = to_arrow_schema(StructType.fromDDL(ddl))
    found = (
        groups.join(sets, "t1")
        .select("grp", "t1", "t2", "elements")
        .groupBy("grp")
        .applyInArrow(_compared_whole(percent, arrow), ddl)
    )
    many = sizes.where("not few and not whole").select("u1")
    rest = None if many.isEmpty() else pivoted.join(many, "u1", "left_semi")
    return materialise(_ends(found).distinct(), "links"), rest


def _ends(found: DataFrame) -> DataFrame:
    """Links (a, b), as structs of both keys, from (a1, a2, b1, b2)."""
    a = F.struct(F.col("a1").alias("t1"), F.col("a2").alias("t2")).alias("a")
    b = F.struct(F.col("b1").alias("t1"), F.col("b2").alias("t2")).alias("b")
    return found.select(a, b)


def _stars(pivoted: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of each node with one pivot: that of the heaviest of its buckets."""
    pairs = pivoted.groupBy("t1").agg(F.max(F.struct("weight", "u1"))["u1"].alias("u1"))
    return materialise(_links(pairs, sets, percent), "links")


def _unsettled(pivoted: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of buckets whose nodes the links have not connected yet."""
    other = labels.select(F.col("t1").alias("u1"), F.col("l").alias("r"))
    ends = pivoted.join(labels, "t1", "left").join(other, "u1", "left")
    apart = ends.where("l is null or r is null or l <> r").select("bucket").distinct()
    return pivoted.join(apart, "bucket", "left_semi")


def _refined(
    pivoted: DataFrame, sets: DataFrame, percent: int, found: DataFrame
) -> tuple[DataFrame, ...]:
    """Of large buckets with their pivots (bucket, t1, u1): all links found so far, those with the
    pivots among them, buckets of nodes near the pivots, the nodes far from them, and labels.

    Nodes that links have connected with a pivot need no comparison between them, so only the
    others are looked up among the nodes near the pivot. Let X be the
    difference of node x from pivot p, n a size, c = (100 - percent) / (100 + percent); linked
    means |X ^ Y| <= c * (nx + ny). With R = 2 * c * (nx + np), the partners of a node whose
    |X| <= R have |Y| <= R + c * (nx + ny), so both are near; two others are both far.

    Of near nodes with x not linked with p, x and y are linked only if X and Y share at least
    t = (|X| + |Y| - c * (nx + ny)) / 2 elements. With the least |X| - c * nx of the pivot's
    nodes that are not connected, any |Y| - t + 1 elements of Y hold a shared one: the rarest.
    """
    c, share = (100 - percent) / (100 + percent), percent / 100
    rows = _compared(pivoted.select("t1", "u1").distinct(), sets, ["t1", "u1"])
    n, m, size = F.col("n"), F.col("m"), F.col("n") + F.col("m") - 2 * F.col("shared")
    near = size <= 2 * c * (n / share + m) + c * n * (1 + 1 / share) + 1e-6
    gap = F.concat(F.array_except("elements", "others"), F.array_except("others", "elements"))
    stars = materialise(
        rows.withColumn("shared", F.size(F.array_intersect("elements", "others"))).select(
            "t1",
            "u1",
            "node",
            "other",
            "n",
            ((100 + percent) * F.col("shared") >= percent * (n + m)).alias("linked"),
            (size > 2 * c * (n + m) - 1e-6).alias("far"),
            F.when(near, gap).alias("difference"),
        ),
        "stars",
    )
    links = stars.where("linked and node <> other").select(
        F.col("node").alias("a"), F.col("other").alias("b")
    )
    far = pivoted.join(stars.where("far").select("t1", "u1").distinct(), ["t1", "u1"], "left_semi")
    found = materialise(found.unionByName(links), "links")
    labels = materialise(components(found), "labels")
    stars = (
        stars.where("difference is not null")
        .join(labels.select("node", F.col("label").alias("l")), "node", "left")
        .join(labels.select(F.col("node").alias("other"), F.col("label").alias("r")), "other", "left")
        .withColumn("settled", F.coalesce("l", "node") == F.coalesce("r", "other"))
    )
    size = F.size("difference")
    least = (
        stars.where("not settled").groupBy("u1").agg(F.min(size - F.col("n") * c).alias("least"))
    )
    shared = F.ceil((F.col("least") + size - F.col("n") * c) / 2 - 1e-6)
    rest = stars.join(least, "u1").withColumn(
        "prefix", F.greatest(F.lit(0), size - shared + 1).cast("int")
    )
    each = rest.select(
        "t1", "u1", "settled", "prefix", F.explode("difference").alias("element")
    )
    nodes = F.count(F.lit(1)).over(Window.partitionBy("u1", "element"))
    place = F.row_number().over(Window.partitionBy("t1", "u1").orderBy("nodes", "element"))
    buckets = (
        each.withColumn("nodes", nodes)
        .withColumn("index", place <= F.col("prefix"))
        .where("nodes > 1 and (index or not settled)")
        .select(
            F.xxhash64("u1", "element").alias("bucket"),
            "t1",
            "index",
            (~F.col("settled")).alias("probe"),
        )
    )
    named = labels.select(F.col("node.t1").alias("t1"), F.col("label").alias("l"))
    return found, buckets, far.select("bucket", "t1").distinct(), named


def _common(sets: DataFrame) -> np.ndarray:
    """How often elements of each of `_SLOTS` slots were seen at least twice in a batch.

    It only orders elements, the rare ones first; its size is fixed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).flatten().to_numpy()
            slot, count = np.unique(values % _SLOTS, return_counts=True)
            often = count > 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot[often]), pa.array(count[often])], names=["slot", "seen"]
            )

    rows = sets.select("elements").mapInArrow(run, "slot long, seen long")
    rows = rows.groupBy("slot").agg(F.sum("seen").alias("seen")).toArrow()
    out = np.zeros(_SLOTS, dtype=np.int64)
    out[rows.column("slot").to_numpy()] = rows.column("seen").to_numpy()
    return out


def _by_rare_elements(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Buckets (bucket, t1) of an element each: linked sets share one of their rarest ones.

    They share percent / 100 of either set, so one of the first n - t + 1 elements of each in
    any common order, t being the least number shared.
    """
    own = materialise(
        sets.join(nodes.select("t1").distinct(), "t1", "left_semi").select("t1", "elements"), "far"
    )
    shared = own.sparkSession.sparkContext.broadcast(_common(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            values = batch.column(1).flatten().to_numpy()
            of = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((values, seen[values % _SLOTS], of))
            place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            prefix = sizes - (sizes * percent + 99) // 100 + 1
            kept = order[place < prefix[of]]
            key = batch.column(0).to_numpy()[of[kept]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(values[kept]), pa.array(key)], names=["bucket", "t1"]
            )

    return own.mapInArrow(run, "bucket long, t1 long").distinct()


def _verified(percent: int, arrow: pa.Schema):
    """Links within groups of sets that come one after the other: label, t1, t2, n, elements."""

    def links(group: list[tuple]) -> Iterator[tuple]:
        group.sort(key=lambda x: x[2])
        for i, (a1, a2, n, own) in enumerate(group):
            for b1, b2, m, other in group[i + 1 :]:
                if n * 100 < m * percent:
                    break
                shared = len(np.intersect1d(own, other, assume_unique=True))
                if (100 + percent) * shared >= percent * (n + m):
                    yield a1, a2, b1, b2

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=pa.int64()) for c in columns], schema=arrow
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, group = None, []
        for one in batches:
            rows: list[tuple] = []
            offsets = one.column(4).offsets.to_numpy()
            values = one.column(4).values.to_numpy()
            columns = (one.column(i).to_pylist() for i in range(4))
            for i, (now, t1, t2, n) in enumerate(zip(*columns, strict=True)):
                if now != label:
                    rows += links(group)
                    label, group = now, []
                group.append((t1, t2, n, values[offsets[i] : offsets[i + 1]].copy()))
            yield batch(rows)
        yield batch(list(links(group)))

    return run


def links_of(
    pairs: DataFrame,
    large: DataFrame | None,
    sets: DataFrame,
    sketches: DataFrame,
    stars: DataFrame | None,
    percent: int,
) -> DataFrame:
    """Links (a, b) between different texts, as structs of both keys, that connect all that are
    linked; from pairs (t1, u1), large buckets with their pivots (bucket, t1, u1), those that are
    not done yet, and the links `stars`, which have connected some already.

    Texts that pairs connect form a group. The sets of a group of at most 2 * SMALL texts are
    brought together and compared. Large buckets are split, and of larger groups those pairs are
    compared whose ends the links found before leave apart.
    """
    label = components(pairs.select(F.col("t1").alias("a"), F.col("u1").alias("b")))
    sizes = label.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    label = materialise(label.join(sizes, "label").withColumnRenamed("node", "t1"), "labels")
    small = label.where(F.col("members") <= 2 * SMALL).select("t1", "label")
    ddl = "a1 long, a2 long, b1 long, b2 long"
    arrow = to_arrow_schema(StructType.fromDDL(ddl))
    near = (
        sets.join(small, "t1")
        .select("label", "t1", "t2", "n", "elements")
        .repartition("label")
        .sortWithinPartitions("label")
        .mapInArrow(_verified(percent, arrow), ddl)
    )
    found = materialise(_ends(near), "near")
    if stars is not None:
        found = found.unionByName(stars)
    if large is not None:
        found = _split_links(large, sets, sketches, percent, found)
    many = label.where(F.col("members") > 2 * SMALL).select("t1")
    if many.limit(1).isEmpty():
        return found
    done = components(found).select(F.col("node.t1").alias("t1"), F.col("label").alias("l"))
    apart = (
        pairs.join(many, "t1", "left_semi")
        .join(done, "t1", "left")
        .join(done.select(F.col("t1").alias("u1"), F.col("l").alias("r")), "u1", "left")
        .where("l is null or r is null or l <> r")
        .select("t1", "u1")
    )
    return found.unionByName(_links(apart, sets, percent))


def _split_links(
    pivoted: DataFrame,
    sets: DataFrame,
    sketches: DataFrame,
    percent: int,
    found: DataFrame,
    rounds: int = 8,
) -> DataFrame:
    """The links found and those of texts in large buckets, by pivots and smaller buckets."""
    for turn in range(rounds):
        if pivoted.limit(1).isEmpty():
            return found
        found, near, far, labels = _refined(pivoted, sets, percent, found)
        near = materialise(near, "near")
        sizes = near.groupBy("bucket").agg(
            F.sum(F.col("index").cast("long")).alias("indexed"),
            F.sum(F.col("probe").cast("long")).alias("probes"),
            F.count(F.lit(1)).alias("members"),
        )
        sized = near.join(sizes.where("indexed > 0 and probes > 0 and members > 1"), "bucket")
        few = F.col("indexed") * F.col("probes") <= 2 * SMALL * F.col("members")
        held = F.when(F.col("probes") <= F.col("indexed"), F.col("probe")).otherwise(F.col("index"))
        ends = sized.where(few).select("bucket", "t1", held.alias("held"), "index", "probe")
        # Far nodes meet by their own rarest elements, later without the pivots' near ones.
        far = _sized(far if turn else _by_rare_elements(far, sets, percent))
        far = materialise(far.where("members > 1"), "far")
        most = SMALL << turn
        ends = ends.unionByName(_whole(far.where(F.col("members") <= most)))
        pairs = _alike(ends, labels, sketches, percent)
        found = materialise(found.unionByName(_links(pairs, sets, percent)), "links")
        large = sized.where(~few).select("bucket", "t1", "members").unionByName(
            far.where(F.col("members") > most).select("bucket", "t1", "members")
        )
        large = materialise(large, "large")
        pivoted = _pivoted(large)
    # Buckets that no pivot has split.
    return found.unionByName(_links(_pairs_of(large, _labels(found)), sets, percent))


def _grouped(
    docs: DataFrame, doc_id: str, text: str, n: int, percent: int, share: float = 1 / 16
) -> DataFrame:
    """(id, t1, t2, n, label) of every document; label names its group."""
    k1, k2 = text_keys(text)
    rows = docs.select(
        k1.alias("t1"),
        k2.alias("t2"),
        F.col(f"`{doc_id}`").cast("long").alias("id"),
        F.col(f"`{text}`").cast("binary").alias("raw"),
    )
    arrow = to_arrow_schema(StructType.fromDDL(_SIGNED))
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(rows, n, share))
    group = Window.partitionBy("signature", "salt")
    # A set signs a share of 2 * (100 - percent) / 100 of its size; a pass sends a fifth at most.
    passes, kept = max(1, -(-(100 - percent) // 10)), None
    for turn in range(passes):
        signed = rows.mapInArrow(_signed(n, percent, frequent, arrow, turn, passes), _SIGNED)
        part = materialise(
            signed.withColumns({"least": F.min("t1").over(group), "most": F.max("t1").over(group)})
            .where(F.col("twice") | (F.col("least") != F.col("most")))
            .select("signature", "t1", "t2", "id", "n"),
            "signed",
        )
        kept = part if kept is None else kept.unionByName(part)
    documents = kept.where("signature is null")
    buckets = materialise(
        kept.where("signature is not null")
        .select(F.col("signature").alias("bucket"), "t1")
        .distinct(),
        "signatures",
    )
    candidates = buckets.select("t1").distinct()
    sketches = materialise(_of_texts(rows, candidates, _sketched, n, _SKETCHES), "sketches")
    sized = materialise(_sized(buckets).where("members > 1"), "buckets")
    # Nodes of large buckets are compared first; what that connects gives no pairs.
    large, hot, stars, labels = sized.where(F.col("members") > SMALL), None, None, None
    if large.limit(1).isEmpty():
        large = None
    else:
        hot = materialise(
            _of_texts(rows, large.select("t1").distinct(), _sets, n, _SETS), "sets"
        )
        stars, large = _together(_pivoted(large), hot, percent)
        if large is not None:
            stars = stars.unionByName(_stars(large, hot, percent))
        labels = _labels(stars)
        if large is not None:
            large = materialise(_unsettled(large, labels), "pivots")
    # Copies share most of their buckets, so buckets of the same nodes are one.
    small = (
        sized.where(F.col("members") <= SMALL)
        .groupBy("bucket")
        .agg(F.sort_array(F.collect_list("t1")).alias("nodes"))
        .select("nodes")
        .distinct()
        .select(F.xxhash64("nodes").alias("bucket"), F.explode("nodes").alias("t1"))
    )
    small = _whole(small.distinct())
    pairs = materialise(_alike(small, labels, sketches, percent), "pairs")
    nodes = pairs.select("t1").union(pairs.select("u1")).distinct()
    if hot is not None:
        nodes = nodes.join(hot.select("t1"), "t1", "left_anti")
    sets = materialise(_of_texts(rows, nodes, _sets, n, _SETS), "sets")
    sets = sets if hot is None else sets.unionByName(hot)
    label = components(links_of(pairs, large, sets, sketches, stars, percent)).select(
        F.col("node.t1").alias("t1"), F.col("node.t2").alias("t2"), "label"
    )
    return documents.join(label, ["t1", "t2"], "left").select(
        "id", "t1", "t2", "n", F.coalesce("label", F.struct("t1", "t2")).alias("label")
    )


def near_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90
) -> DataFrame:
    """(id, n_shingles, component_id) of every document.

    component_id is the smallest id that links reach, its own included; null ids count only
    where there is no other.
    """
    labelled = _grouped(docs, doc_id, text, n, percent)
    least = labelled.where("n > 0").groupBy("label").agg(F.min("id").alias("least"))
    return labelled.join(least, "label", "left").select(
        "id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"),
    )


def keep_one(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80
) -> DataFrame:
    """The documents without all but one of each group: that with the smallest id stays.

    Null ids come after all others, and the key of the text decides between rows of one id;
    of rows with the same id and text one stays. Texts without words all stay.
    """
    groups = _grouped(docs, doc_id, text, n, percent).where("n > 0")
    copies = materialise(
        groups.groupBy("id", "t1", "t2", "label").agg(F.count(F.lit(1)).alias("copies")), "groups"
    )
    order = F.struct(F.col("id").isNull().alias("nameless"), "id", "t1", "t2")
    first = copies.groupBy("label").agg(F.min(order).alias("first"))
    judged = copies.join(first, "label").withColumn("stays", order.eqNullSafe(F.col("first")))
    changes = materialise(
        judged.where("not stays or copies > 1").select("t1", "t2", "id", "stays"), "changes"
    )
    c1, c2, cid, stays = (free_name(docs, x) for x in ("key_1", "key_2", "key_id", "stays"))
    k1, k2 = text_keys(text)
    keyed = docs.withColumns({c1: k1, c2: k2, cid: F.col(f"`{doc_id}`").cast("long")})
    bits = bitmap(changes, "t1")
    named = changes.toDF("n1", "n2", "nid", stays)
    some = sieve(keyed, c1, bits)
    same = (F.col(c1) == F.col("n1")) & (F.col(c2) == F.col("n2"))
    same &= F.col(cid).eqNullSafe(F.col("nid"))
    met = some.join(named, same, "left").drop("n1", "n2", "nid")
    one = met.where(F.col(stays)).dropDuplicates([c1, c2, cid])
    kept = met.where(F.col(stays).isNull()).unionByName(one).drop(stays)
    return without(kept.unionByName(sieve(keyed, c1, bits, hit=False)), [c1, c2, cid])
