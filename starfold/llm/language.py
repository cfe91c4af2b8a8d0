"""Language identification in two levels: family first, then one-versus-one linear SVMs inside it.

Features are counts of character sequences (one to three bytes of the lower-cased text with
words set off by blanks), hashed into ``WIDTH`` columns, damped by a square root and scaled to unit length.
A linear SVM per pair of families votes for the family; a linear SVM per pair of its
languages votes for the language. A vote weighs by its margin. The score is the logistic
value of the weakest margin that the winner holds, on both levels.

Edge cases: a NULL text, or one without a letter, is ``und`` with score 0; documents without
a language or without an id are not learned from; a language of no known family is a
family of its own; with one learned language only, every text gets it (score 1), with
none ``und``; equal texts get equal results; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfold.llm.common import id_hash, keep, small_batches

#: Learned documents of each language, at most.
SAMPLE = 400
WIDTH_BITS = 11
WIDTH = 1 << WIDTH_BITS
#: Each learned document also gives pieces of these many bytes, so that short texts are learned.
PIECES = (40, 120)
#: Steps and weight decay of the SVMs; steepness of the score.
EPOCHS, DECAY, STEEP = 40, 3e-4, 3.0
UNKNOWN = "und"

#: Families of language codes (fixed values).
FAMILIES = {
    "germanic": "de en nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "indic": "hi ur bn mr pa gu ne",
    "sinitic": "zh yue",
    "semitic": "ar he mt am",
    "austronesian": "id ms tl jv",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], f"={lang}")


#: Bytes of ASCII that are no letters count as blanks.
_FOLD = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint32)


def features(texts: list[str], rows_at_once: int = 24) -> np.ndarray:
    """Unit-length hashed counts, one row per text."""
    out = np.zeros((len(texts), WIDTH), dtype=np.float32)
    for start in range(0, len(texts), rows_at_once):
        part = [f"  {t.lower()}  ".encode() for t in texts[start : start + rows_at_once]]
        owner = np.repeat(np.arange(len(part), dtype=np.int64), [len(p) for p in part])
        b = _FOLD[np.frombuffer(b"".join(part), dtype=np.uint8)]
        gap = (b[1:] == 32) & (b[:-1] == 32)
        keep_ = np.concatenate([[True], ~gap])
        b, owner = b[keep_], owner[keep_]
        grams = [b * np.uint32(0x9E3779B1) + np.uint32(1)]
        if len(b) > 1:
            grams.append((b[:-1] << np.uint32(8) | b[1:]) * np.uint32(0x85EBCA6B) + np.uint32(2))
        if len(b) > 2:
            grams.append((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(0xC2B2AE35) + np.uint32(3))
        counts = np.zeros(len(part) * WIDTH, dtype=np.int64)
        for g in grams:
            g = g ^ (g >> np.uint32(15))
            at = owner[: len(g)] * WIDTH + (g * np.uint32(0x27D4EB2F) >> np.uint32(32 - WIDTH_BITS)).astype(np.int64)
            counts += np.bincount(at, minlength=len(counts))
        x = np.sqrt(counts.reshape(len(part), WIDTH).astype(np.float32))
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        out[start : start + len(part)] = x / np.where(norm > 0, norm, 1)
    return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Linear SVM (squared hinge, weight decay) by accelerated gradient steps; the last entry is the bias."""
    data = np.concatenate([x, np.ones((len(x), 1), dtype=x.dtype)], axis=1)
    y, weight = y.astype(np.float32), weight.astype(np.float32)
    w = np.zeros(data.shape[1], dtype=np.float32)
    ahead, momentum = w, 1.0
    pace = 1.0 / (2 * 2.0 + DECAY)  # rows have squared length 2, weights sum to 1
    for _ in range(EPOCHS * 5):
        slack = np.maximum(0, 1 - y * (data @ ahead))
        slope = DECAY * ahead - 2 * data.T @ (weight * slack * y)
        new = ahead - pace * slope
        later = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead, w, momentum = new + (momentum - 1) / later * (new - w), new, later
    return w


class Ballot:
    """One-versus-one linear SVMs between classes."""

    def __init__(self, classes: list[str], x: np.ndarray, y: np.ndarray):
        self.classes = classes
        self.pairs = list(combinations(range(len(classes)), 2))
        columns = []
        for a, b in self.pairs:
            side = np.where(y == classes[a], 1.0, np.where(y == classes[b], -1.0, 0.0))
            use = side != 0
            weight = np.where(side > 0, 0.5 / max((side > 0).sum(), 1), 0.5 / max((side < 0).sum(), 1))
            columns.append(_svm(x[use], side[use], weight[use]))
        self.w = np.stack(columns, axis=1).astype(np.float32) if columns else None

    def vote(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner and its weakest margin, for each row."""
        if self.w is None:
            return np.zeros(len(x), dtype=int), np.full(len(x), np.inf)
        margins = x @ self.w[:-1] + self.w[-1]
        votes = np.zeros((len(x), len(self.classes)))
        least = np.full((len(x), len(self.classes)), np.inf)
        for k, (a, b) in enumerate(self.pairs):
            m = margins[:, k]
            votes[:, a] += (m >= 0) + np.tanh(m) * 1e-3
            votes[:, b] += (m < 0) - np.tanh(m) * 1e-3
            least[:, a] = np.minimum(least[:, a], m)
            least[:, b] = np.minimum(least[:, b], -m)
        winner = votes.argmax(axis=1)
        return winner, least[np.arange(len(x)), winner]


class Model:
    def __init__(self, x: np.ndarray, langs: np.ndarray):
        self.langs = sorted(set(langs))
        families = np.array([family(v) for v in langs])
        names = sorted(set(families))
        self.top = Ballot(names, x, families)
        self.inner = {
            f: Ballot(sorted(set(langs[families == f])), x[families == f], langs[families == f]) for f in names
        }

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        x = features(texts)
        winner, margin = self.top.vote(x)
        out = np.empty(len(texts), dtype=object)
        for k, name in enumerate(self.top.classes):
            rows = np.flatnonzero(winner == k)
            if len(rows):
                ballot = self.inner[name]
                best, inside = ballot.vote(x[rows])
                out[rows] = np.array(ballot.classes, dtype=object)[best]
                margin[rows] = np.minimum(margin[rows], inside)
        return list(out), 1 / (1 + np.exp(-STEEP * np.clip(margin, -10, 10)))


def training_rows(docs: DataFrame, each: int = SAMPLE, folds: int = 3, held_out: int = 1) -> DataFrame:
    """text, lang of at most ``each`` documents a language, lowest seeded hashes first; never of the held-out fold."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (id_hash("doc_id", folds) != held_out))
    order = F.xxhash64("doc_id", F.lit(37))
    langs = [r["lang"] for r in known.select("lang").distinct().collect()]
    with_letters = known.filter(F.col("text").rlike(r"\p{L}"))
    # ids first: texts of other documents need not be sorted
    ids = None
    for lang in sorted(langs):
        part = with_letters.filter(F.col("lang") == lang).select(F.col("doc_id").alias("_id"), order.alias("_h"))
        part = part.orderBy("_h", "_id").limit(each).select("_id")
        ids = part if ids is None else ids.unionByName(part)
    if ids is None:
        return known.select("text", "lang")
    ids = keep(ids.distinct(), "language-ids")
    return with_letters.join(ids, F.col("doc_id") == F.col("_id"), "left_semi").select("text", "lang")


def fit(docs: DataFrame, each: int = SAMPLE) -> Model | None:
    """The model of the training documents.

    Features are made in tasks; the driver gets, for each sampled document, at most three rows of ``WIDTH`` bytes.
    """
    small_batches(docs.sparkSession)

    def pieces(text: str) -> list[str]:
        out = [text]
        for n in PIECES:
            if len(text) > 2 * n:
                at = (len(text) * 5) // 11
                piece = text[at : at + n]
                if any(c.isalpha() for c in piece):
                    out.append(piece)
        return out

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                x = np.rint(features(pieces(text)) * 255).astype(np.uint8)
                yield pa.RecordBatch.from_pydict({
                    "x": pa.array([r.tobytes() for r in x], pa.binary()), "lang": pa.array([lang] * len(x), pa.string()),
                })

    rows = keep(training_rows(docs, each).mapInArrow(make, "x binary, lang string"), "language-sample").orderBy("lang", "x")
    got = rows.toArrow()
    if not got.num_rows:
        return None
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), dtype=np.uint8).reshape(-1, WIDTH).astype(np.float32)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return Model(x, np.array(got.column("lang").to_pylist(), dtype=object))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    small_batches(docs.sparkSession)
    rows = docs.select(
        "doc_id",
        F.coalesce(id_hash("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"),
    )
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            at = [i for i, t in enumerate(texts) if t is not None] if model else []
            if at:
                found, sure = model.predict([texts[i] for i in at])
                for i, v in zip(at, found):
                    lang[i] = v
                score[at] = sure
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score)],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
