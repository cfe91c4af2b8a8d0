"""Text quality from document statistics: random Fourier features, ridge regression, isotonic calibration.

One pass over the texts turns each into a few statistics of its characters, words and lines.
All later work reads these numbers only. Labelled rows are standardised and mapped by random
Fourier features (``cos(w x + b)``), whose inner products approximate a Gaussian kernel. Every
task adds up its part of the normal equations, for each fold of the ids apart; the sums over all
tasks give one ridge solution of all rows and one that leaves each fold out. The left-out
scores, counted in narrow bins, are calibrated by isotonic regression (pool adjacent violators).
All labelled rows take part; the driver holds the sums and the bins, whose sizes are fixed.

Edge cases: a NULL text counts as empty; equal texts get equal scores; labels of unknown
documents, without a value or without an id are ignored; a document labelled both ways counts
as good if most of its labels are; labels of one class give that class's share as every score;
no labels give a score of one; repeated ids are scored row by row; further columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfold.llm.common import id_hash, keep, small_batches

#: Random features, width of the kernel in standard deviations a statistic, weight of the ridge a row, bound of standardised statistics.
FEATURES, WIDTH, RIDGE, CLIP = 384, 1.5, 1e-4, 5.0
#: Folds that calibration leaves out in turn, and bins of their scores between ``LOW`` and ``HIGH``.
FOLDS, BINS, LOW, HIGH = 4, 4_096, -1.0, 2.0
#: A document passes from this score.
PASSES = 0.3
SEED = 20

_UPPER, _LOWER, _DIGIT, _SPACE, _STOP, _SIGN, _CONTROL, _HIGH = range(8)
_CLASS = np.full(256, _SIGN, dtype=np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = _UPPER
_CLASS[ord("a") : ord("z") + 1] = _LOWER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[[0x20, 9, 10, 13]] = _SPACE
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = _STOP
_CLASS[:9] = _CONTROL
_CLASS[14:32] = _CONTROL
_CLASS[128:] = _HIGH

STATISTICS = (
    "bytes", "words", "word_bytes", "upper", "digits", "spaces", "stops", "signs", "control", "high", "sign_ends", "sign_starts",
    "shouted", "distinct_words", "top_word", "distinct_pairs", "distinct_lines", "line_words", "packed", "spread", "bytes_used",
)


def statistics(text: str | None) -> list[float]:
    """The numbers named in ``STATISTICS``; shares lie between 0 and 1."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
    if not len(raw):
        return [0.0] * len(STATISTICS)
    n = len(raw)
    kind = _CLASS[raw]
    by_kind = np.bincount(kind, minlength=8) / n
    solid = kind != _SPACE
    edge = np.diff(solid.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    m = max(len(start), 1)
    sign = kind == _SIGN
    lower = np.append(0, np.cumsum(kind == _LOWER))
    upper = np.append(0, np.cumsum(kind == _UPPER))
    shouted = ((upper[end] - upper[start] > 1) & (lower[end] == lower[start])).sum()
    words = text.split()
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    lines = [line for line in text.split("\n") if line.strip()]
    share = np.bincount(raw, minlength=256) / n
    share = share[share > 0]
    return [
        math.log1p(n), math.log1p(len(words)), math.log1p((end - start).mean() if len(start) else 0.0),
        by_kind[_UPPER], by_kind[_DIGIT], by_kind[_SPACE], by_kind[_STOP], by_kind[_SIGN], by_kind[_CONTROL], by_kind[_HIGH],
        sign[end - 1].sum() / m, sign[start].sum() / m, shouted / m,
        len(counts) / max(len(words), 1), max(counts.values(), default=0) / max(len(words), 1), pairs / max(len(words) - 1, 1),
        len(set(lines)) / max(len(lines), 1), math.log1p(len(words) / max(len(lines), 1)),
        min(len(zlib.compress(raw, 1)) / n, 2.0), float(-(share * np.log2(share)).sum()), len(share) / 256,
    ]


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, stats of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "stats"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, stats array<double>")


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray
    knots: np.ndarray  # raw scores, rising
    values: np.ndarray  # calibrated scores there, not falling

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return features(stats, self.mean, self.scale) @ self.beta

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(stats), self.values[0])
        return np.clip(np.interp(self.raw(stats), self.knots, self.values), 0.0, 1.0)


def features(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a constant."""
    d = stats.shape[1]
    dice = np.random.default_rng(SEED)
    w = dice.normal(size=(d, FEATURES)) / (WIDTH * math.sqrt(d))
    b = dice.uniform(0, 2 * math.pi, size=FEATURES)
    x = np.clip((stats - mean) / scale, -CLIP, CLIP)
    return np.concatenate([math.sqrt(2 / FEATURES) * np.cos(x @ w + b), np.ones((len(x), 1))], axis=1)


def training_labels(labels: DataFrame, held_out: int = 5) -> DataFrame:
    """doc_id, quality (0 or 1) of labelled documents, without those whose id hashes to 0 modulo ``held_out``."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (id_hash("doc_id", held_out) != 0))
    return known.groupBy("doc_id").agg((F.avg((F.col("quality") > 0).cast("double")) >= 0.5).cast("int").alias("quality"))


def _matrix(batch: pa.RecordBatch, name: str = "stats") -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)


def _equations(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> dict[int, np.ndarray]:
    """Per fold: sums of z z' with z'y and the number of rows as further columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            z, y = features(_matrix(batch), mean, scale), batch.column("quality").to_numpy().astype(float)
            fold = batch.column("fold").to_numpy()
            for k in np.unique(fold):
                part = z[fold == k]
                made[int(k)] = made.get(int(k), 0.0) + np.concatenate([part.T @ part, (part.T @ y[fold == k])[:, None]], axis=1)
        for k, a in made.items():
            yield pa.RecordBatch.from_pydict({
                "fold": pa.array([k] * len(a), pa.int32()), "i": pa.array(range(len(a)), pa.int32()), "row": pa.array(list(a), pa.list_(pa.float64())),
            })

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = np.concatenate([_matrix(b, "row") for b in batches])
        parts = parts[np.lexsort(parts.T)]  # the order of the tasks does not matter
        yield pa.RecordBatch.from_pydict({
            "fold": pa.array([key[0].as_py()], pa.int32()), "i": pa.array([key[1].as_py()], pa.int32()), "row": pa.array([parts.sum(axis=0)], pa.list_(pa.float64())),
        })

    schema = "fold int, i int, row array<double>"
    summed = keep(rows.mapInArrow(run, schema).groupBy("fold", "i").applyInArrow(add, schema), "quality-equations")
    out: dict[int, list] = {}
    for r in summed.orderBy("fold", "i").collect():  # FOLDS x FEATURES rows
        out.setdefault(r["fold"], []).append(r["row"])
    return {k: np.array(v) for k, v in out.items()}


def _solve(a: np.ndarray) -> np.ndarray:
    z, y = a[:, :-1], a[:, -1]
    n = z[-1, -1]
    ridge = np.full(len(z), RIDGE * n)
    ridge[-1] = 1e-9 * n  # the constant is free
    return np.linalg.solve(z + np.diag(ridge), y)


def isotonic(x: np.ndarray, weight: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the rising step fit of ``total / weight`` over rising ``x``; between blocks it is interpolated."""
    blocks: list[list[float]] = []  # weight, sum, first x, last x
    for at, w, s in zip(x, weight, total):
        blocks.append([w, s, at, at])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, s2, _, last = blocks.pop()
            blocks[-1][0] += w2
            blocks[-1][1] += s2
            blocks[-1][3] = last
    knots, values = [], []
    for w, s, first, last in blocks:
        for at in (first, last) if last > first else (first,):
            knots.append(at)
            values.append(s / w)
    return np.array(knots), np.array(values)


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """The model of all labelled rows of ``stats`` (a written table) that are not held out."""
    none = np.zeros(0)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(FOLDS)).cast("int")
    rows = keep(stats.join(training_labels(labels), "doc_id").select("stats", "quality", fold.alias("fold")), "quality-rows")
    share = rows.agg(F.avg("quality")).first()[0]
    if share is None or share in (0.0, 1.0):
        return Model(none, none, none, none, np.array([1.0 if share is None else share]))
    moments = rows.select(F.posexplode("stats").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    found = sorted(tuple(r) for r in moments.collect())
    mean, scale = np.array([m for _, m, _ in found]), np.array([max(s, 1e-9) if s > 1e-9 else 1.0 for *_, s in found])
    sums = _equations(rows, mean, scale)
    whole = sum(sums.values())
    # a fold that alone has rows is scored by the whole
    betas = {k: _solve(whole - a if len(sums) > 1 else whole) for k, a in sums.items()}

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, fold_ = features(_matrix(batch), mean, scale), batch.column("fold").to_numpy()
            raw = np.zeros(len(z))
            for k, beta in betas.items():
                raw[fold_ == k] = z[fold_ == k] @ beta
            bin_ = np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"bin": pa.array(bin_), "quality": batch.column("quality")})

    bins = rows.mapInArrow(left_out, "bin int, quality int").groupBy("bin").agg(F.count("*").alias("n"), F.sum("quality").alias("good"))
    table = np.array(sorted(tuple(r) for r in bins.collect()), dtype=float)
    knots, values = isotonic(LOW + (table[:, 0] + 0.5) * (HIGH - LOW) / BINS, table[:, 1], table[:, 2])
    return Model(mean, scale, _solve(whole), knots, values)


def score(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row of ``stats``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_matrix(batch)), pa.float64())], names=["doc_id", "score"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    return stats.mapInArrow(run, f"doc_id {kind}, score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's score, learned from the labels that are not held out."""
    stats = keep(describe(docs), "quality-stats")
    return score(stats, fit(stats, labels)).select(
        "doc_id",
        F.coalesce(id_hash("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= PASSES).cast("int").alias("predicted"),
    )
