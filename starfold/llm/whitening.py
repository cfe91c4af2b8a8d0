"""Whitening of vectors: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its factor.

Two passes gather the exact sum of every dimension and the scatter of the centred vectors;
tasks sum their rows, and the partial sums of each row of the scatter are added in one group. The
scatter A = L L' is factored with diagonal pivoting, which stops at its rank. Rotations from the right
make the columns of L orthogonal (L V = U D): squared column norms are eigenvalues of A, normalised
columns its eigenvectors, without forming a product of L. A third pass projects every vector.

Vectors of each length are a fit of their own; there may be ``MOST_LENGTHS`` of them (an error
beyond). The driver holds one scatter (length x length numbers) at a time.

Edge cases: vectors that are NULL, empty, or hold NULL or non-finite entries have no row in the
result; rows without an id, and rows that repeat, count like any other; directions without
spread (one row, equal rows, dependent dimensions) are no components, so there may be
fewer than asked for, or none; no rows give no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfold.llm.common import keep

#: Components kept, and lengths of vectors that one table may hold.
COMPONENTS, MOST_LENGTHS = 8, 64
#: Numbers beyond this are added and squared as Python integers.
_SAFE = 1 << 40
#: Spread below this many rounding errors of the largest is none.
ROUNDING = 100
#: Whole numbers are kept within this (so that sums fit 38 digits).
LARGEST = 1 << 62


@dataclass(frozen=True)
class Whitening:
    """Fit of the vectors of one length."""

    n: int
    sums: list[int]
    directions: np.ndarray  # length x components, unit columns
    variances: np.ndarray  # falling eigenvalues of the covariance
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums)

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.directions / np.sqrt(self.variances))

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S) squared, exact."""
        largest = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if largest * largest * max(x.shape[1], 1) < 1 << 63:
            d = self.n * x - np.array(self.sums, dtype=np.int64)
            return (d * d).sum(axis=1).tolist()
        mean = [s // self.n for s in self.sums]
        base = [s - m * self.n for s, m in zip(self.sums, mean)]
        if max(map(abs, mean)) < _SAFE and np.abs(x).max(initial=0) < _SAFE:
            z = x - np.array(mean, dtype=np.int64)
            far = self.n * (int(np.abs(z).max(initial=0)) + 1)
            if far * far * x.shape[1] < 1 << 63:
                d = self.n * z - np.array(base, dtype=np.int64)
                return (d * d).sum(axis=1).tolist()
        d = self.n * x.astype(object) - np.array(self.sums, dtype=object)
        return (d * d).sum(axis=1).tolist()


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n: the whole part of the mean is taken off exactly."""
    whole = [s // n for s in sums]
    rest = np.array([(s - w * n) / n for s, w in zip(sums, whole)])
    return (x - np.array(whole, dtype=np.int64)).astype(np.float64) - rest


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with ``a`` = L L' in the order of ``a``; as many columns as ``a`` has rank."""
    n = len(a)
    left = np.diag(a).astype(np.float64).copy()
    out = np.zeros((n, n))
    floor = ROUNDING * n * np.finfo(float).eps * left.max(initial=0.0)
    free = np.ones(n, dtype=bool)
    for k in range(n):
        at = int(np.where(free, left, -1.0).argmax())
        if not left[at] > floor:
            return out[:, :k]
        out[at, k] = np.sqrt(left[at])
        free[at] = False
        column = (a[free, at] - out[free, :k] @ out[at, :k]) / out[at, k]
        out[free, k] = column
        left[free] -= column * column
        left[at] = 0.0
    return out


def one_sided_jacobi(factor: np.ndarray, most: int = 60) -> np.ndarray:
    """``factor`` rotated from the right until its columns are orthogonal, longest column first.

    Every step rotates disjoint pairs of columns at once; n - 1 steps meet all pairs.
    """
    g = factor[:, np.argsort(-np.linalg.norm(factor, axis=0), kind="stable")].copy()
    n = g.shape[1]
    seats = np.arange(n + n % 2)
    small = np.finfo(float).eps * max(len(g), 1) ** 0.5
    for _ in range(most):
        turned = False
        for _ in range(len(seats) - 1):
            p, q = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
            real = (p < n) & (q < n)
            p, q = np.minimum(p, q)[real], np.maximum(p, q)[real]
            x, y = g[:, p], g[:, q]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            act = np.abs(xy) > small * np.sqrt(xx * yy)
            if act.any():
                turned = True
                p, q, x, y, xx, yy, xy = p[act], q[act], x[:, act], y[:, act], xx[act], yy[act], xy[act]
                zeta = (yy - xx) / (2 * xy)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                g[:, p], g[:, q] = c * x - c * t * y, c * t * x + c * y
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if not turned:
            break
    return g[:, np.argsort(-np.linalg.norm(g, axis=0), kind="stable")]


def components(scatter: np.ndarray, n: int, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Unit eigenvectors and falling eigenvalues of ``scatter`` / ``n``; the largest entry of each vector is positive."""
    g = one_sided_jacobi(pivoted_cholesky(scatter))
    norms = np.linalg.norm(g, axis=0)
    real = norms > norms.max(initial=0.0) * np.sqrt(ROUNDING * len(scatter) * np.finfo(float).eps)
    unit = (g[:, real] / norms[real])[:, :most]
    largest = np.take_along_axis(unit, np.abs(unit).argmax(axis=0)[None], axis=0)
    return unit * np.where(largest < 0, -1.0, 1.0), (norms[real] ** 2 / n)[:most]


def whole_vectors(table: DataFrame, vector: str = "embedding", scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """vec_id, x: floor(scale * c) + shift of every vector that holds finite numbers only; within ``LARGEST``."""
    v = F.col(vector)
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    near = lambda c: F.greatest(F.least(c.cast("double") * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))
    return table.filter(v.isNotNull() & (F.size(v) > 0) & good).select(
        "vec_id", F.transform(v, lambda c: F.floor(near(c)) + F.lit(shift)).alias("x")
    )


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of equal length of each batch, with their numbers as a matrix."""
    for batch in batches:
        lengths = pc.list_value_length(batch.column("x")).to_numpy(zero_copy_only=False)
        for d in np.unique(lengths):
            rows = batch if (lengths == d).all() else batch.filter(pa.array(lengths == d))
            yield rows, rows.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, int(d))


def _sums(vectors: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Per length: number of vectors and the exact sum of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for _, x in _by_length(batches):
            d = x.shape[1]
            x = x if np.abs(x).max(initial=0) < _SAFE else x.astype(object)
            n[d] = n.get(d, 0) + len(x)
            sums[d] = sums.get(d, np.zeros(d, dtype=object)) + x.sum(axis=0).astype(object)
        for d in n:
            yield pa.RecordBatch.from_pydict({
                "d": pa.array([d] * d, pa.int32()), "i": pa.array(range(d), pa.int32()), "n": pa.array([n[d]] * d, pa.int64()),
                "s": pa.array([str(v) for v in sums[d]], pa.string()),
            })

    rows = vectors.select("x").mapInArrow(run, "d int, i int, n long, s string")
    rows = keep(rows.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")), "whiten-sums")
    lengths = [r[0] for r in rows.select("d").distinct().limit(MOST_LENGTHS + 1).collect()]
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
    out = {}
    for d in sorted(lengths):
        found = sorted((r["i"], r["n"], int(r["s"])) for r in rows.filter(F.col("d") == d).collect())
        out[d] = found[0][1], [s for _, _, s in found]
    return out


def _scatters(vectors: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> DataFrame:
    """d, i, row: the scatter of the centred vectors of each length, summed by partitions, then over them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for _, x in _by_length(batches):
            d = x.shape[1]
            c = centred(x, *sums[d])
            made[d] = made.get(d, 0.0) + c.T @ c
        for d, a in made.items():
            yield pa.RecordBatch.from_pydict({
                "d": pa.array([d] * d, pa.int32()), "i": pa.array(range(d), pa.int32()), "row": pa.array(list(a), pa.list_(pa.float64())),
            })

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate([b.column("row").flatten().to_numpy().reshape(len(b), -1) for b in batches])
        rows = rows[np.lexsort(rows.T)]  # the order of the tasks does not matter
        yield pa.RecordBatch.from_pydict({
            "d": pa.array([key[0].as_py()], pa.int32()), "i": pa.array([key[1].as_py()], pa.int32()), "row": pa.array([rows.sum(axis=0)], pa.list_(pa.float64())),
        })

    schema = "d int, i int, row array<double>"
    return vectors.select("x").mapInArrow(run, schema).groupBy("d", "i").applyInArrow(add, schema)


def fit(vectors: DataFrame, most: int = COMPONENTS) -> dict[int, Whitening]:
    """The whitening of all rows of ``vectors`` (x: array of longs), per length."""
    sums = _sums(vectors)
    if not sums:
        return {}
    rows = keep(_scatters(vectors, sums), "whiten-scatter")
    out = {}
    for d, (n, s) in sums.items():
        found = rows.filter(F.col("d") == d).orderBy("i").select("row").collect()
        a = np.array([r[0] for r in found])
        unit, values = components((a + a.T) / 2, n, most)
        out[d] = Whitening(n, s, unit, values, float(np.trace(a)) / n)
    return out


def whiten(vectors: DataFrame, model: dict[int, Whitening]) -> DataFrame:
    """vec_id, d (length), n, deviation (decimal), white (array of doubles, one a component) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, x in _by_length(batches):
            m, k = model[x.shape[1]], len(rows)
            yield pa.RecordBatch.from_pydict({
                "vec_id": rows.column("vec_id"), "d": pa.array([x.shape[1]] * k, pa.int32()), "n": pa.array([m.n] * k, pa.int64()),
                "deviation": pa.array([str(v) for v in m.deviations(x)], pa.string()),
                "white": pa.array(list(m.project(x)), pa.list_(pa.float64())),
            })

    kind = vectors.schema["vec_id"].dataType.simpleString()
    made = vectors.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, d int, n long, deviation string, white array<double>")
    return made.withColumn("deviation", F.expr("try_cast(deviation AS decimal(38,0))"))


def identity_error(whitened: DataFrame) -> float:
    """Largest absolute entry, over all lengths, of the covariance of ``white`` minus the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, list] = {}
        for batch in batches:
            for d, group in _groups(batch):
                w = group.column("white").flatten().to_numpy().reshape(len(group), -1)
                old = made.get(d, [0, 0.0, 0.0])
                made[d] = [old[0] + len(w), old[1] + w.sum(axis=0), old[2] + w.T @ w]
        for d, (n, s, a) in made.items():
            for i in range(len(s)):
                for j in range(i + 1):
                    yield pa.RecordBatch.from_pydict({
                        "d": pa.array([d], pa.int32()), "i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()),
                        "n": pa.array([n], pa.int64()), "a": pa.array([a[i, j]]), "si": pa.array([s[i]]), "sj": pa.array([s[j]]),
                    })

    def _groups(batch: pa.RecordBatch):
        lengths = batch.column("d").to_numpy(zero_copy_only=False)
        for d in np.unique(lengths):
            yield int(d), batch.filter(pa.array(lengths == d))

    parts = whitened.select("d", "white").mapInArrow(run, "d int, i int, j int, n long, a double, si double, sj double")
    total = parts.groupBy("d", "i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "a", "si", "sj")])
    cov = F.col("a") / F.col("n") - F.col("si") / F.col("n") * F.col("sj") / F.col("n")
    gap = F.abs(cov - (F.col("i") == F.col("j")).cast("double"))
    return float(total.agg(F.max(gap)).first()[0] or 0.0)


def digest(table: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """One row a vector and component; a deviation that passes 64 bits is NULL there and whole in ``deviation_exact``."""
    vectors = whole_vectors(table)
    model = fit(vectors, most)
    rows = keep(whiten(vectors, model), "whitened")
    error = identity_error(rows)
    shares = F.create_map(*[c for d, m in model.items() for c in (F.lit(d), F.array(*[F.lit(float(v / m.trace)) for v in m.variances]))]) if model else None
    long = rows.select("vec_id", "d", "n", "deviation", F.posexplode("white").alias("at", "whitened"))
    share = shares[F.col("d")][F.col("at")] if model else F.lit(None).cast("double")
    return long.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        "n",
        F.expr("try_cast(deviation AS long)").alias("deviation"),
        F.col("deviation").alias("deviation_exact"),
        "whitened",
        share.alias("explained"),
        F.lit(error).alias("identity_error"),
    )
