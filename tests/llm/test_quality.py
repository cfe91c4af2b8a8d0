"""Quality: held-out accuracy, kernel and calibration against plain computations, odd rows."""

import os
import random

import numpy as np
import pytest

from starfold.llm import quality
from starfold.llm.common import id_hash, table

PATH = "/root/testdata/sf0.01"
given = pytest.mark.skipif(not os.path.isdir(PATH), reason="generated tables not present")


@given
def test_held_out_rows(spark):
    docs, labels = table(spark, PATH, "documents"), table(spark, PATH, "labels")
    got = quality.digest(docs, labels)
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 40 and sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)
    assert got.count() == docs.count() and got.filter("score < 0 OR score > 1 OR score IS NULL").isEmpty()
    assert got.filter(got.held_out != (id_hash("doc_id", 5) == 0)).isEmpty()


def test_features_approximate_the_kernel():
    dice = np.random.default_rng(1)
    x = dice.normal(size=(40, 21))
    z = quality.features(x, np.zeros(21), np.ones(21))[:, :-1]
    x = np.clip(x, -quality.CLIP, quality.CLIP)
    square = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    want = np.exp(-square / (2 * quality.WIDTH**2 * 21))
    assert np.abs(z @ z.T - want).max() < 5 / np.sqrt(quality.FEATURES)


def test_summed_equations_give_the_ridge_solution(spark):
    dice = np.random.default_rng(2)
    stats, y = dice.normal(size=(300, 21)), dice.integers(0, 2, size=300)
    rows = spark.createDataFrame([(s.tolist(), int(q), i % 4) for i, (s, q) in enumerate(zip(stats, y))], "stats array<double>, quality int, fold int")
    sums = quality._equations(rows.repartition(7), np.zeros(21), np.ones(21))
    z = quality.features(stats, np.zeros(21), np.ones(21))
    assert sorted(sums) == [0, 1, 2, 3]
    whole = sum(sums.values())
    assert np.allclose(whole[:, :-1], z.T @ z) and np.allclose(whole[:, -1], z.T @ y)
    beta = quality._solve(whole)
    lift = np.full(z.shape[1], quality.RIDGE * 300)
    lift[-1] = 300e-9
    assert np.allclose((z.T @ z + np.diag(lift)) @ beta, z.T @ y, atol=1e-8)


def test_isotonic_is_the_best_rising_fit():
    dice = random.Random(4)
    for _ in range(50):
        n = dice.randrange(1, 9)
        w = np.array([dice.randrange(1, 5) for _ in range(n)], float)
        s = np.array([dice.randrange(0, int(k) + 1) for k in w], float)
        x = np.arange(n, dtype=float)
        knots, values = quality.isotonic(x, w, s)
        fitted = np.interp(x, knots, values)
        # the min-max formula of isotonic regression
        mean = lambda a, b: s[a : b + 1].sum() / w[a : b + 1].sum()
        want = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert np.allclose(fitted, want)


def test_odd_rows(spark):
    good, bad = "a plain and calm sentence of words number {}.", "&&& $$ {} ### !! %%"
    rows = [(i, (good if i % 3 else bad).format(i) * (1 + i % 4), 7) for i in range(200)]
    rows += [(300, None, 7), (301, "", 7), (302, " \n\t ", 7), (303, "\x00퟿🙂", 7), (None, good, 7), (1, good, 7), (304, "word " * 300_000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int").selectExpr("*", "1 AS stats", "'q' AS quality")
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0) for i in range(200)] + [(2, None), (None, 0), (999, 0), (5, 0), (5, 1), (5, 1)], "doc_id long, quality int")
    got = quality.digest(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    first = {r["doc_id"]: r for r in got}
    assert all(first[i]["predicted"] == (1 if i % 3 else 0) for i in range(200) if i != 1)
    assert first[300]["score"] == first[301]["score"]
    assert not next(r for r in got if r["doc_id"] is None)["held_out"]
    assert {r["score"] for r in quality.digest(docs, labels.limit(0)).collect()} == {1.0}
    assert {r["score"] for r in quality.digest(docs, labels.filter("quality = 0")).collect()} == {0.0}
    assert quality.digest(docs.limit(0), labels).count() == 0
    one = labels.filter("doc_id IN (7, 9, 12, 15, 16, 17)")
    assert all(0 <= r["score"] <= 1 for r in quality.digest(docs, one).collect())
