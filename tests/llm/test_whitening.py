"""Whitening against brute force in integers and doubles, refinement, and odd tables."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from locengine.llm.whitening import product, refine, whiten

SCHEMA = "vec_id long, embedding array<float>, component string, `a.b` int"


def rows_of(rng, n, size, scale=0.2):
    return [[float(np.float32(rng.gauss(0.1 * j, scale))) for j in range(size)] for _ in range(n)]


def by_force(vectors):
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, size = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(size)]
    deviation = [sum((n * r[j] - sums[j]) ** 2 for j in range(size)) for r in x]
    y = np.array([[(n * r[j] - sums[j]) / n for j in range(size)] for r in x])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    return deviation, y, values[::-1], vectors[:, ::-1]


@pytest.mark.parametrize("n, size, scale", [(300, 8, 0.2), (90, 40, 0.2), (50, 5, 3e9)])
def test_against_brute_force(spark, n, size, scale):
    vectors = rows_of(random.Random(5), n, size, scale)
    vectors[7] = vectors[3]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in enumerate(vectors)], SCHEMA)
    made = whiten(df.repartition(5)).collect()
    deviation, y, values, u = by_force(vectors)
    kept = min(32, size)
    assert len(made) == n * kept and {r.n for r in made} == {n}
    got = np.zeros((n, kept))
    for r in made:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.deviation == (deviation[r.vec_id] if deviation[r.vec_id] < 2**63 else None)
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
        assert r.identity_error < 1e-9
    want = y @ u[:, :kept] / np.sqrt(values[:kept])
    want *= np.sign((want * got).sum(0))
    assert np.abs(got - want).max() < 1e-7
    assert np.abs(got[3] - got[7]).max() == 0


def test_unfit_rows_go(spark):
    rng = random.Random(6)
    good = rows_of(rng, 30, 4)
    rows = [(i, v, "c", 0) for i, v in enumerate(good)] + [(None, good[0], None, 0), (5, good[1], None, 0)]
    inf, nan = float("inf"), float("nan")
    bad = [None, [], [1.0, None, 1.0, 1.0], [1.0, nan, 1.0, 1.0], [inf, 0.0, 0.0, 0.0], [1e30] * 4, [1.0]]
    df = spark.createDataFrame(rows + [(100 + i, v, "c", 0) for i, v in enumerate(bad)], SCHEMA)
    made = whiten(df).collect()
    ids = [r.vec_id for r in made if r.component == 1]
    assert sorted(ids, key=str) == sorted([*range(30), None, 5], key=str)
    assert {r.n for r in made} == {32} and whiten(df).columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"
    ]


def test_few_dimensions_have_variance(spark):
    rows = [(i, [float(i % 5), 2.0 * (i % 5), 1.0], None, 0) for i in range(20)]
    made = whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component for r in made} == {1} and made[0].explained == pytest.approx(1)
    equal = [(i, [0.5, 0.5], None, 0) for i in range(9)]
    assert whiten(spark.createDataFrame(equal, SCHEMA)).collect() == []
    assert whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whiten(spark.createDataFrame([(1, None, None, 0)], SCHEMA)).collect() == []


@pytest.mark.parametrize(
    "values",
    [
        np.r_[1, 1 - 1e-9, 1 - 2e-9, 0.5, 0.5, 0.5, np.linspace(0.4, 0.1, 26)],
        1 + 1e-8 * np.arange(32),
        10.0 ** -np.arange(32.0),
        np.r_[np.linspace(3, 1, 10), np.zeros(22)],
        np.ones(32),
    ],
)
def test_refine(values):
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(32, 32)))
    v = q * values @ q.T
    v = (v + v.T) / 2
    e, x = refine(v)
    rough = np.linalg.eigh(v.astype(np.float32))[1][:, ::-1].astype(float)
    assert np.abs(rough.T @ rough - np.eye(32)).max() > 1e-8  # what refinement starts from
    assert np.abs(x.T @ x - np.eye(32)).max() < 1e-14
    assert np.abs(v @ x - x * e).max() < 1e-14 * np.abs(v).max()
    assert (np.diff(e) <= 1e-15).all() and np.abs(e - np.sort(values)[::-1]).max() < 1e-14


def test_product_is_exact_beyond_doubles():
    rng = np.random.default_rng(2)
    a, b = (rng.normal(size=(20, 20)).astype(np.longdouble) for _ in range(2))
    a += rng.normal(size=(20, 20)).astype(np.longdouble) * np.longdouble(2) ** -55
    assert np.abs(product(a, b) - a @ b).max() < 1e-17  # doubles err by 1e-15
