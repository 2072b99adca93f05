"""Whitening of embeddings: distributed covariance, eigenvectors refined in mixed precision.

Entries become integers (`scaled`), so that counts, sums and products of centred entries are
exact in any order of tasks; an executor that is lost changes nothing. Three small reductions
read the table: sums per dimension, second moments about the mean, and, with the eigenvectors
broadcast, the covariance of the whitened rows. Only matrices of dimension x dimension and
their sums reach the driver, whatever the number of rows.

`refine` starts from float32 eigenvectors and applies the iteration of Ogita and Aishima: with
R = I - X'X and S = X'VX, X grows by XE, where e_ij = (s_ij + e_j r_ij) / (e_j - e_i) for
eigenvalues that are told apart and r_ij / 2 for the others. Clustered eigenvalues are told
apart by an eigenproblem of their own, X_J'(V - m)X_J about the cluster's mean m, whose entries
are as small as the cluster is narrow. Products are float64, then extended precision.

Defined results:
- a null vector, and one with a null or non-finite entry, is dropped, as is one with an entry
  whose integer is no long, and one of another length than most vectors have (of lengths
  equally frequent, the greater);
- repeated rows and repeated or null ids count as often as they stand there;
- a component whose eigenvalue is 0 but for rounding cannot be whitened and has no row: equal
  vectors, or an empty table, give no rows;
- `deviation` is null where it is no long; other columns of the input are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 64, 1_000_000
_LONG = 1 << 63
_EXACT = 1 << 53  # floats hold every integer up to here


def scaled(values: np.ndarray) -> np.ndarray:
    """floor(64 c) + 1000000 of finite doubles whose result is a long."""
    return np.floor(values * SCALE).astype(np.int64) + OFFSET


def _vectors(column: pa.Array, size: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows that remain, and the integers of those of `size` entries (a matrix)."""
    n = len(column)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(column)
    values = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        bad = ~(np.abs(values * SCALE) < float(_LONG - (1 << 32)))
    owner = np.repeat(np.arange(n), np.maximum(lengths, 0))
    good = lengths > 0
    good[owner[bad]] = False
    if size is None:
        return lengths[good], np.zeros((0, 0), dtype=np.int64)
    rows = good & (lengths == size)
    return np.flatnonzero(rows), scaled(values[rows[owner]]).reshape(-1, size)


def _partials(df: DataFrame, vector: str, compute, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from compute(b.column(0) for b in batches)

    return df.select(F.col(f"`{vector}`")).mapInArrow(run, schema)


def _dimension(df: DataFrame, vector: str) -> int | None:
    def lengths(columns):
        for column in columns:
            sizes, counts = np.unique(_vectors(column, None)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(sizes, pa.int32()), pa.array(counts, pa.int64())], ["size", "n"]
            )

    found = _partials(df, vector, lengths, "size int, n long").groupBy("size")
    top = found.agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    return None if top is None else top["size"]


def _sums(df: DataFrame, vector: str, size: int) -> tuple[int, list[int]]:
    """Rows and exact sums per dimension; halves of 32 bits keep partial sums within longs."""

    def halves(columns):
        n, high, low = 0, np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        for column in columns:
            _, x = _vectors(column, size)
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays(
            [np.arange(size, dtype=np.int32), high, low, np.full(size, n, dtype=np.int64)],
            ["i", "high", "low", "n"],
        )

    rows = _partials(df, vector, halves, "i int, high long, low long, n long").groupBy("i")
    made = rows.agg(*(F.sum(c).alias(c) for c in ("high", "low", "n"))).orderBy("i").collect()
    return (made[0].n if made else 0), [(r.high << 32) + r.low for r in made]


@dataclass(frozen=True)
class Centre:
    """n, the sums, the integers next to the means, and what the means are above those."""

    n: int
    sums: list[int]

    @property
    def whole(self) -> np.ndarray:
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], dtype=np.int64)

    @property
    def rest(self) -> np.ndarray:
        whole = self.whole.tolist()
        return np.array([(s - self.n * w) / self.n for s, w in zip(self.sums, whole, strict=True)])

    def near(self, x: np.ndarray) -> np.ndarray:
        """x less the whole centre as doubles, exact below 2**53."""
        whole = self.whole
        far = np.abs(x.astype(np.float64) - whole).max(initial=0.0) >= _EXACT
        return (x.astype(object) - whole).astype(np.float64) if far else (x - whole).astype(float)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)**2, in integers; None beyond a long."""
        whole = self.whole
        rest = [s - self.n * w for s, w in zip(self.sums, whole.tolist(), strict=True)]
        most = np.abs(x.astype(np.float64) - whole).max(initial=0.0) * self.n + self.n
        if most * most * x.shape[1] < _LONG / 2:
            d = (x - whole) * self.n - np.array(rest, dtype=np.int64)
            return (d * d).sum(1).tolist()
        d = (x.astype(object) - whole.astype(object)) * self.n - np.array(rest, dtype=object)
        return [v if v < _LONG else None for v in (d * d).sum(1).tolist()]


def _moments(df: DataFrame, vector: str, size: int, width: int, project) -> np.ndarray:
    """Sum of p'p and, as a last row, of p over all rows, where p = project(integers).

    Each task sends one matrix, as entries; Spark adds them up by entry.
    """

    def products(columns):
        total, below = np.zeros((width, width)), np.zeros(width)
        for column in columns:
            p = project(_vectors(column, size)[1])
            total += p.T @ p
            below += p.sum(0)
        total = np.vstack([total, below])
        yield pa.RecordBatch.from_arrays(
            [np.arange(total.size, dtype=np.int32), total.ravel()], ["at", "v"]
        )

    rows = _partials(df, vector, products, "at int, v double").groupBy("at")
    table = rows.agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((width + 1) * width)
    out[table.column("at").to_numpy()] = table.column("v").to_numpy()
    return out.reshape(width + 1, width)


def _covariance(moments: np.ndarray, n: int) -> np.ndarray:
    mean = moments[-1] / n
    made = moments[:-1] / n - np.outer(mean, mean)
    return (made + made.T) / 2


def _clusters(values: np.ndarray, gap: float) -> list[slice]:
    """Runs of two or more ordered eigenvalues that lie within `gap` of the next."""
    edge = np.flatnonzero(np.abs(np.diff(values)) > gap) + 1
    bounds = [0, *edge.tolist(), len(values)]
    return [slice(a, b) for a, b in zip(bounds, bounds[1:], strict=False) if b - a > 1]


def _slices(m: np.ndarray, axis: int, bits: int) -> list[np.ndarray]:
    """Doubles of `bits` bits each, on one scale along `axis`, that add up to m (long doubles)."""
    parts = []
    for _ in range(-(-64 // bits)):
        top = np.abs(m).max(axis=axis, keepdims=True)
        unit = np.ldexp(np.ones_like(top), np.frexp(top)[1] - bits)
        parts.append((np.rint(m / unit) * unit).astype(np.float64))
        m = m - parts[-1]
    return parts


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b: of doubles as they are, of long doubles by products of slices that are exact."""
    if a.dtype != np.longdouble:
        return a @ b
    bits = (53 - a.shape[1].bit_length()) // 2
    left, right = _slices(a, 1, bits), _slices(b, 0, bits)
    out = np.zeros((a.shape[0], b.shape[1]), dtype=np.longdouble)
    for k in reversed(range(len(left))):
        for i in range(k + 1):
            out += left[i] @ right[k - i]
    return out


def _correct(v: np.ndarray, x: np.ndarray, kind) -> tuple[np.ndarray, np.ndarray, float]:
    """One correction in precision `kind`: eigenvectors, eigenvalues, and the largest change."""
    v, x = v.astype(kind), x.astype(kind)
    r = np.eye(len(v), dtype=kind) - product(x.T, x)
    s = product(x.T, product(v, x))
    r, s = (r + r.T) / 2, (s + s.T) / 2
    values = np.diag(s) / (1 - np.diag(r))
    order = np.argsort(-values, kind="stable")
    x, values, r, s = x[:, order], values[order], r[np.ix_(order, order)], s[np.ix_(order, order)]
    off = np.linalg.norm((s - np.diag(values)).astype(float))
    gap = 2 * (off + np.abs(values).max() * np.linalg.norm(r.astype(float)))
    apart = values[None, :] - values[:, None]
    clear = np.abs(apart) > gap
    e = np.where(clear, (s + values[None, :] * r) / np.where(clear, apart, 1), r / 2)
    x = x + product(x, e)
    change = float(np.abs(e).max())
    for j in _clusters(values, gap):
        part, middle = x[:, j], values[j].mean()
        small = product(part.T, product(v, part) - middle * part)
        inner, turn = np.linalg.eigh(((small + small.T) / 2).astype(float))
        x[:, j] = product(part, turn[:, ::-1].astype(kind))
        values[j] = middle + inner[::-1]
        change = max(change, gap)
    return x, values, change


def refine(v: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix.

    Of each vector the entry that is largest in size is positive.
    """
    unit = np.abs(v).max()
    if not unit:
        return np.zeros(len(v)), np.eye(len(v))
    a = v / unit
    _, x = np.linalg.eigh(a.astype(np.float32))
    x = x.astype(np.float64)
    for kind, enough in ((np.float64, 1e-11), (np.longdouble, 1e-17)):
        last = np.inf
        for _ in range(rounds):
            x, values, change = _correct(a, x, kind)
            if change < enough or change > last / 2:
                break
            last = change
    x = x / np.sqrt((x * x).sum(0))
    x = x * np.sign(x[np.abs(x).argmax(0), np.arange(len(v))])
    return (values * unit).astype(np.float64), x.astype(np.float64)


def whiten(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 32
) -> DataFrame:
    """One row per remaining row and component: see the module for what remains.

    key, component (from 1), n, deviation, whitened, explained (the eigenvalue's share of all)
    and identity_error (the largest entry of the whitened rows' covariance less the identity).
    """
    spark = df.sparkSession
    id_type = dict(df.dtypes)[key]
    schema = (
        f"`{key}` {id_type}, component int, n long, deviation long, "
        "whitened double, explained double, identity_error double"
    )
    size = _dimension(df, vector)
    n, sums = (0, []) if size is None else _sums(df, vector, size)
    if not n:
        return spark.createDataFrame([], schema)
    centre = Centre(n, sums)
    covariance = _covariance(_moments(df, vector, size, size, centre.near), n)
    values, vectors = refine(covariance)
    positive = values > max(values[0], 0.0) * size * 2.0**-50
    kept = min(components, int(positive.sum()))
    if not kept:
        return spark.createDataFrame([], schema)
    turn = spark.sparkContext.broadcast(vectors[:, :kept] / np.sqrt(values[:kept]))
    rest = centre.rest

    def project(x: np.ndarray) -> np.ndarray:
        return (centre.near(x) - rest) @ turn.value

    made = _covariance(_moments(df, vector, size, kept, project), n)
    error = float(np.abs(made - np.eye(kept)).max())
    share = values[:kept] / values.sum()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _vectors(batch.column(1), size)
            m = len(rows) * kept
            arrays = [
                batch.column(0).take(pa.array(np.repeat(rows, kept))),
                pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(rows))),
                pa.array(np.full(m, n, dtype=np.int64)),
                pa.array(centre.deviation(x), pa.int64()).take(
                    pa.array(np.repeat(np.arange(len(rows)), kept))
                ),
                pa.array(project(x).ravel()),
                pa.array(np.tile(share, len(rows))),
                pa.array(np.full(m, error)),
            ]
            yield pa.RecordBatch.from_arrays(
                arrays,
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return df.select(F.col(f"`{key}`"), F.col(f"`{vector}`")).mapInArrow(run, schema)
