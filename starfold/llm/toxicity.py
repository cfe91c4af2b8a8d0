"""Toxicity by maximum-scoring segments.

Words get log-odds of toxic against clean documents with a Dirichlet prior (the pooled
counts, scaled), kept for words whose log-odds are large and stand out from their sampling
error; all other words cost a constant. Of copies a few count (``COPIES``). One linear scan finds every maximal-scoring segment of
a document. A segment's score has an extreme-value law on clean text, whose two
parameters come from clean training documents; segments that stand out from it add up,
and a logistic curve turns the sum into the document's score.

Edge cases: a NULL or empty text has no segment and gets the curve's lowest score; labels
of unknown documents, without a value or without an id are ignored; a document labelled
both ways counts as toxic; without labels of both classes every score is 0 (all clean);
equal texts get equal scores; other columns are not read by ``score`` and kept by ``add_score``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starfold.llm.common import id_hash, keep, small_batches, trimmed, unused
from starfold.llm.setjoin import shingles

#: Labelled documents of each class that the model is fitted on, at most.
SAMPLE = 4_000
#: Weight of the prior as a share of the pooled counts; least documents, standard scores and log-odds of a word.
PRIOR, LEAST_DOCS, STANDS_OUT, LEAST_ODDS = 0.1, 3, 4.0, 1.0
#: Score of every other word, and bounds of a word's own.
OTHER, LOW, HIGH = -0.25, -3.0, 6.0
#: Least hashes that near copies among the labelled documents are found by.
SKETCHES = 4
#: Copies of one document that the sample keeps, so that a large group of copies does not rule it.
COPIES = 16
#: A segment counts if clean text has one like it in fewer than this many documents of its length.
RARE = 0.05

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    rate: float = 1.0  # the extreme-value law's scale is 1 / rate
    space: float = 1.0  # and its place grows with the logarithm of space * words
    slope: float = 0.0
    offset: float = -math.inf

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        """Every maximal-scoring segment: first word, end, score."""
        get, total = self.weights.get, 0.0
        # first, end, sum before, sum after, the nearest one further left that began lower
        held: list[tuple[int, int, float, float, int]] = []
        for i, w in enumerate(words):
            value = get(w, OTHER)
            if value <= 0:
                total += value
                continue
            first, before, after = i, total, total + value
            total, at = after, len(held) - 1
            while True:
                while at >= 0 and held[at][2] >= before:
                    at = held[at][4]
                if at < 0 or held[at][3] >= after:
                    break
                first, _, before, _, left = held[at]
                del held[at:]
                at = left
            held.append((first, i + 1, before, after, at))
        return [(a, b, y - x) for a, b, x, y, _ in held]

    def evidence(self, words: list[str]) -> tuple[float, list[tuple[int, int, float]]]:
        """Sum of the significant segments' surprise (negative log of the expected number), and these segments."""
        found = []
        total = 0.0
        law = math.log(max(self.space * len(words), 1e-9)) if words else 0.0
        for a, b, s in self.segments(words):
            surprise = self.rate * s - law
            if surprise >= -math.log(RARE):
                found.append((a, b, surprise))
                total += surprise
        return total, found

    def score(self, words: list[str]) -> float:
        x = self.slope * math.log1p(self.evidence(words)[0]) + self.offset
        return 1.0 / (1.0 + math.exp(-x)) if x > -700 else 0.0


def training_labels(labels: DataFrame, held_out: int = 5) -> DataFrame:
    """doc_id, toxic of the labelled documents; without those whose id hashes to 0 modulo ``held_out``."""
    return (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (id_hash("doc_id", held_out) != 0))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )


def training_ids(known: DataFrame, each: int = SAMPLE) -> DataFrame:
    """At most ``each`` of the labelled documents a class, lowest seeded hashes first."""
    order = F.xxhash64("doc_id", F.lit(29))
    some = [known.filter(F.col("toxic") == k).orderBy(order, "doc_id").limit(each) for k in (0, 1)]
    return some[0].unionByName(some[1])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``SKETCHES`` least hashes of five-word shingles; copies, and most of the nearest ones, agree in all of them."""
    seeds = np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for batch in batches:
        least = []
        for text in batch.column("text").to_pylist():
            h = shingles(text, 5)
            least.append([int(((h ^ s) * s).min() >> np.uint64(1)) if len(h) else 0 for s in seeds])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.list_(pa.int64()))], names=["doc_id", "text", "toxic", "m"])


def fit(docs: DataFrame, labels: DataFrame, each: int = SAMPLE) -> Model:
    """The model of the labelled training documents; the driver holds words that stand out in 2 ``each`` documents, and a number for each of these."""
    small_batches(docs.sparkSession)
    known = keep(training_labels(labels), "toxic-labels")
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    ids = keep(training_ids(known, each), "toxic-ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").isNotNull())
    rows = texts.join(ids, "doc_id").mapInArrow(trimmed(_sketch), "doc_id long, text string, toxic int, m array<long>")
    place = Window.partitionBy("toxic", "m").orderBy("doc_id", F.xxhash64("text"))
    rows = rows.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= COPIES)
    rows = keep(rows, "toxic-sample").select("text", "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = [Counter(), Counter()]
        for batch in batches:
            for text, side in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                tallies[side].update(set(words_of(text)))
        for side, docs_ in enumerate(tallies):
            names = list(docs_)
            for k in range(0, len(names), 20_000):
                part = names[k : k + 20_000]
                yield pa.RecordBatch.from_pydict({
                    "word": pa.array(part, pa.string()), "side": pa.array([side] * len(part), pa.int32()),
                    "docs": pa.array([docs_[w] for w in part], pa.int64()),
                })

    per_side = lambda k: F.sum(F.when(F.col("side") == k, F.col("docs")).otherwise(0)).cast("double")
    words = keep(
        rows.mapInArrow(trimmed(count), "word string, side int, docs long").groupBy("word").agg(per_side(0).alias("c"), per_side(1).alias("t")),
        "toxic-words",
    )
    totals = words.agg(F.sum("c").alias("c"), F.sum("t").alias("t")).first()
    if not totals["c"] or not totals["t"]:
        return Model({})
    n = totals["c"] + totals["t"]
    prior = PRIOR * (F.col("c") + F.col("t"))
    odds = lambda x, size: F.log((F.col(x) + prior) / (F.lit(size + PRIOR * n) - F.col(x) - prior))
    scored = words.filter(F.col("c") + F.col("t") >= LEAST_DOCS).select(
        "word", "c", "t",
        (odds("t", totals["t"]) - odds("c", totals["c"])).alias("delta"),
        F.sqrt(1 / (F.col("t") + prior) + 1 / (F.col("c") + prior)).alias("error"),
    )
    stands = F.abs(F.col("delta")) / F.col("error")
    top = scored.filter((stands >= STANDS_OUT) & (F.abs("delta") >= LEAST_ODDS)).orderBy("word").collect()
    weights = {r["word"]: round(min(HIGH, max(LOW, r["delta"] + OTHER)), 4) for r in top}
    # under the same prior, so that a word unseen in clean text is rare there, not impossible
    clean = {r["word"]: (r["c"] + PRIOR * (r["c"] + r["t"])) / (totals["c"] + PRIOR * n) for r in top}
    rate = _rate([(weights[w], p) for w, p in clean.items()], 1.0 - sum(clean.values()))
    plain = Model(weights, rate=rate)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [words_of(t) for t in batch.column("text").to_pylist()]
            top_ = [max((s for _, _, s in plain.segments(w)), default=0.0) for w in texts]
            yield pa.RecordBatch.from_pydict({
                "toxic": batch.column("toxic"), "n": pa.array([len(w) for w in texts], pa.int64()), "s": pa.array(top_, pa.float64()),
            })

    seen = rows.mapInArrow(trimmed(best), "toxic int, n long, s double").collect()
    standard = [rate * r["s"] - math.log(r["n"]) for r in seen if r["toxic"] == 0 and r["n"]]
    # the mean of the law is its place plus Euler's constant; the median bears labels that err
    space = math.exp(float(np.median(standard)) + math.log(math.log(2))) if standard else 1.0
    law = Model(weights, rate=rate, space=max(space, 1e-9))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [law.evidence(words_of(t))[0] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic"), "x": pa.array(x, pa.float64())})

    points = rows.mapInArrow(trimmed(weigh), "toxic int, x double").collect()
    x = np.array([math.log1p(r["x"]) for r in points])
    slope, offset = _curve(x, np.array([r["toxic"] for r in points], dtype=float), share)
    return Model(weights, rate, law.space, slope, offset)


def _rate(weighted: list[tuple[float, float]], other: float) -> float:
    """The positive root of E[exp(rate * score)] = 1 over clean words (1 where there is none)."""

    def excess(rate: float) -> float:
        return sum(p * math.exp(rate * s) for s, p in weighted) + other * math.exp(rate * OTHER) - 1.0

    if not any(s > 0 and p > 0 for s, p in weighted):
        return 1.0
    low, high = 1e-6, 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return min(high, 4.0)


def _curve(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Logistic slope and offset, toxic rows weighed to their ``share`` of all labels, lightly penalised, by Newton steps."""
    weight = np.where(y > 0, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    data, beta = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(data @ beta, -30, 30)))
        slope = data.T @ (weight * (y - p)) - 1e-2 * beta
        bend = (data * (weight * p * (1 - p))[:, None]).T @ data + 1e-2 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def add_score(docs: DataFrame, model: Model, text: str = "text", out: str = "_tox_score") -> DataFrame:
    """``docs`` with the score of the whole text; ``out`` must be no column of ``docs``."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)
    schema = T.StructType(docs.schema.fields + [T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in schema.fields]
        for batch in batches:
            scores = [model.score(words_of(t)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=names)

    return docs.mapInArrow(trimmed(run), schema)


def digest(docs: DataFrame, model: Model) -> DataFrame:
    scored = add_score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        F.coalesce(id_hash("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        F.col("_tox_score").alias("score"),
        (F.col("_tox_score") >= 0.5).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without those whose score is ``least`` or more; same columns."""
    out = unused(docs, "_tox_score")
    return add_score(docs, fit(docs, labels), out=out).filter(F.col(out) < least).drop(out)
