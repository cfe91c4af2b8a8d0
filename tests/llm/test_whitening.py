"""Whitening against exact sums and a dense eigendecomposition."""

import os

import numpy as np
import pytest

from starfold.llm import whitening
from starfold.llm.common import table

PATH = "/root/testdata/sf0.01"
given = pytest.mark.skipif(not os.path.isdir(PATH), reason="generated tables not present")


def brute(x):
    """Deviations, eigenvalues and eigenvectors of whole-number rows."""
    n = len(x)
    sums = [sum(int(v) for v in col) for col in x.T]
    deviations = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    c = x - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(c.T @ c / n)
    return deviations, values[::-1], vectors[:, ::-1], c


def compare(got, ids, x, tolerance=1e-8):
    deviations, values, vectors, c = brute(x)
    rows = {}
    for r in got:
        rows.setdefault(r["component"], {})[r["vec_id"]] = r
    for k, found in rows.items():
        assert set(found) == set(ids)
        white = np.array([found[i]["whitened"] for i in ids])
        want = c @ vectors[:, k - 1] / np.sqrt(values[k - 1])
        assert min(np.abs(white - want).max(), np.abs(white + want).max()) < tolerance
        assert found[ids[0]]["explained"] == pytest.approx(values[k - 1] / values.sum(), rel=1e-9)
        assert [found[i]["deviation"] for i in ids] == deviations
        assert {r["n"] for r in found.values()} == {len(x)}
    return rows


@given
def test_the_given_vectors(spark):
    rows = sorted((r["vec_id"], r["embedding"]) for r in table(spark, PATH, "embeddings").collect())
    x = np.floor(1024 * np.array([v for _, v in rows], dtype=np.float64)).astype(np.int64) + 100_000
    got = whitening.digest(table(spark, PATH, "embeddings")).collect()
    assert sorted(compare(got, [i for i, _ in rows], x)) == list(range(1, 9))
    assert max(r["identity_error"] for r in got) < 1e-9


def test_cholesky_and_jacobi_agree_with_a_dense_solver():
    dice = np.random.default_rng(3)
    for d, rank in ((1, 1), (2, 2), (7, 3), (24, 24), (33, 20)):
        b = dice.normal(size=(d, rank)) * np.logspace(0, -3, rank)
        a = b @ b.T
        factor = whitening.pivoted_cholesky(a)
        assert factor.shape[1] == rank and np.allclose(factor @ factor.T, a, atol=1e-12 * np.trace(a))
        g = whitening.one_sided_jacobi(factor)
        off = g.T @ g
        assert np.abs(off - np.diag(np.diag(off))).max() < 1e-13 * np.trace(a)
        assert np.allclose((g * g).sum(axis=0), np.linalg.eigvalsh(a)[::-1][:rank], rtol=1e-9)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 5), float(i % 3), 1.5, float(i % 5) * 2]) for i in range(40)]
    rows += [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0]), (103, [nan, 1.0, 1.0, 1.0]), (104, [1.0, inf, 1.0, 1.0])]
    frame = spark.createDataFrame(rows + [(7, rows[7][1])], "vec_id long, embedding array<double>").selectExpr("*", "'z' AS x", "2 AS d", "3 AS n")
    got = whitening.digest(frame).collect()
    assert {r["vec_id"] for r in got} == set(range(40))
    # the third dimension never changes and the fourth doubles the first, so two components have spread
    assert len(got) == 2 * 41 and {r["component"] for r in got} == {1, 2}
    assert sum(r["explained"] for r in got if r["vec_id"] == 1) == pytest.approx(1.0)
    assert max(r["identity_error"] for r in got) < 1e-12
    assert whitening.digest(frame.limit(0)).count() == 0
    assert whitening.digest(frame.filter("vec_id >= 100")).count() == 0
    assert whitening.digest(frame.filter("vec_id = 3")).count() == 0
    no_id = frame.withColumn("vec_id", whitening.F.lit(None).cast("long"))
    assert whitening.digest(no_id).count() == 82


def test_lengths_and_large_numbers(spark):
    dice = np.random.default_rng(5)
    two = [(i, [float(v) for v in dice.normal(size=2)]) for i in range(30)]
    big = [(100 + i, [float(v) for v in dice.normal(size=3) * 1e9]) for i in range(30)]
    got = whitening.digest(spark.createDataFrame(two + big, "vec_id long, embedding array<double>")).collect()
    exact = lambda part: np.array([[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in part], dtype=object)
    x2, x3 = exact(two), exact(big)
    compare([r for r in got if r["vec_id"] < 100], list(range(30)), x2.astype(np.int64))
    n, sums = 30, x3.sum(axis=0)
    want = [int(sum((n * v - s) ** 2 for v, s in zip(row, sums))) for row in x3]
    found = {r["vec_id"]: r for r in got if r["vec_id"] >= 100}
    assert [int(found[100 + i]["deviation_exact"]) for i in range(30)] == want
    assert all(r["deviation"] is None for r in found.values() if r["deviation_exact"] >= 1 << 63)
    assert whitening.digest(spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0])], "vec_id long, embedding array<double>")).count() == 2
