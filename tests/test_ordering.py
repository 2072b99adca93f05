import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from locengine.operators.ordering import _Bucket, latest_by, pack_batches, renumber, running_sum


def greedy(lengths, max_chars, max_segs):
    """Batch numbers one after the other."""
    out, batch, chars, segs = [], -1, 0, 0
    for n in lengths:
        if batch < 0 or chars + n > max_chars or segs >= max_segs:
            batch, chars, segs = batch + 1, 0, 0
        chars, segs = chars + n, segs + 1
        out.append(batch)
    return out


def sizes(spark, lengths, max_chars, max_segs, bucket):
    df = spark.createDataFrame(
        [("d", i, "x" * n) for i, n in enumerate(lengths)], "doc_id string, seq long, text string"
    )
    rows = pack_batches(df, max_chars, max_segs, bucket=bucket).collect()
    counts = {}
    for r in rows:
        counts[r.batch_id] = counts.get(r.batch_id, 0) + 1
    return [counts[b] for b in sorted(counts)]


@pytest.mark.parametrize("bucket", [1, 4, 2048])
def test_packing_examples(spark, bucket):
    assert sizes(spark, [2] * 25, 10000, 10, bucket) == [10, 10, 5]
    assert sizes(spark, [100] * 5, 250, 100, bucket) == [2, 2, 1]
    assert sizes(spark, [4000], 3000, 5, bucket) == [1]
    assert sizes(spark, [10, 4000, 10], 3000, 5, bucket) == [1, 1, 1]
    assert sizes(spark, [0, 0, 0, 0, 0, 0], 3000, 5, bucket) == [5, 1]


@pytest.mark.parametrize("bucket, max_segs", [(1, 5), (3, 5), (7, 2), (5, 1), (4, 12)])
def test_packing_equals_one_pass(spark, bucket, max_segs):
    """Buckets are packed apart; gaps in seq and tiny buckets must not show."""
    rng = random.Random(bucket)
    rows, expected = [], {}
    for doc in range(25):
        seqs = sorted(rng.sample(range(90), rng.randint(1, 60)))
        lengths = [rng.choice([0, 1, 5, 20, 60, 130]) for _ in seqs]
        rows += [(doc, s, "x" * n) for s, n in zip(seqs, lengths)]
        expected |= {(doc, s): b for s, b in zip(seqs, greedy(lengths, 100, max_segs))}
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, seq long, text string")
    out = pack_batches(df, 100, max_segs, bucket=bucket).collect()
    assert {(r.doc_id, r.seq): r.batch_id for r in out} == expected
    assert len(out) == len(rows)


def test_running_sum_over_buckets(spark):
    rng = random.Random(1)
    rows = [("hot", i, rng.randint(0, 9)) for i in range(300)] + [("cold", 7, 4)]
    expected, total = {}, 0
    for key, i, v in rows[:-1]:
        total += v
        expected[(key, i)] = total
    expected[("cold", 7)] = 4
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o long, v long")
    out = running_sum(df, ["k"], ["o"], F.col("v"), "s", bucket=16).collect()
    assert {(r.k, r.o): r.s for r in out} == expected


def test_renumber(spark):
    df = spark.createDataFrame(
        [("a", 10, 0), ("a", 10, 1), ("a", 90, 0), ("b", 3, 5)], "k string, seq long, piece int"
    )
    out = renumber(df, ["k"], ["seq", "piece"], "position", bucket=8).collect()
    assert sorted((r.k, r.seq, r.piece, r.position) for r in out) == [
        ("a", 10, 0, 0), ("a", 10, 1, 1), ("a", 90, 0, 2), ("b", 3, 5, 0),
    ]


def test_latest(spark):
    df = spark.createDataFrame(
        [("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", 1, "w")], "k string, seq long, v string"
    )
    assert sorted(map(tuple, latest_by(df, ["k"], ["seq"]).collect())) == [
        ("a", 3, "y"), ("b", 1, "w"),
    ]


def test_pointers_of_a_bucket():
    """Batches from every start, as one pass gives them."""
    rng = random.Random(3)
    for _ in range(60):
        lens = [rng.choice([0, 1, 5, 20, 60, 130]) for _ in range(rng.randint(1, 40))]
        most = rng.choice([1, 2, 5, 100])
        bucket = _Bucket(np.array(lens), 100, most)
        count, last = bucket.last()
        for first in range(len(lens)):
            batches = greedy(lens[first:], 100, most)
            starts = [first + i for i, b in enumerate(batches) if i == 0 or b != batches[i - 1]]
            assert count[first] == batches[-1] + 1 and last[first] == starts[-1]
            assert np.flatnonzero(bucket.starts(first)).tolist() == starts


def test_packing_time_does_not_depend_on_the_bucket(spark):
    """A document of 200,000 segments, in buckets of 64 and of 8,192."""
    df = spark.range(200_000).selectExpr("1L doc_id", "id seq", "repeat('x', cast(id * 7919 % 900 as int)) text")
    df = df.repartition(8).cache()
    df.count()
    seconds, found = {}, []
    for bucket in (2048, 64, 8192):
        started = time.perf_counter()
        found.append(pack_batches(df, bucket=bucket).selectExpr("sum(seq * batch_id)", "max(batch_id)").first())
        seconds[bucket] = time.perf_counter() - started
    assert found[0] == found[1] == found[2]
    assert seconds[8192] < 1.5 * seconds[64] + 1
