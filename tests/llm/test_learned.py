"""Learned operators: held-out accuracy, exact parts against plain computations, odd rows."""

import os
import random

import pytest

from starfold.llm import language, toxicity
from starfold.llm.common import table

PATH = "/root/testdata/sf0.01"
given = pytest.mark.skipif(not os.path.isdir(PATH), reason="generated tables not present")


def plain_segments(scores):
    """Maximal scoring segments by their definition: recursively the best one, then left and right of it."""
    def walk(lo, hi):
        best = None
        for a in range(lo, hi):
            total = 0.0
            for b in range(a, hi):
                total += scores[b]
                if total > 1e-12 and (best is None or total > best[2] + 1e-9 or (abs(total - best[2]) <= 1e-9 and b + 1 - a < best[1] - best[0])):
                    best = (a, b + 1, total)
        if best is None:
            return []
        return walk(lo, best[0]) + [best] + walk(best[1], hi)

    return walk(0, len(scores))


def test_segments_are_the_maximal_ones():
    dice = random.Random(6)
    weights = {"p": 3.1, "q": 1.7, "r": 0.4, "n": -2.3}
    model = toxicity.Model(weights)
    for _ in range(300):
        words = [dice.choice(["p", "q", "r", "n", "o", "o", "o"]) for _ in range(dice.randrange(0, 14))]
        got = model.segments(words)
        want = plain_segments([weights.get(w, toxicity.OTHER) for w in words])
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want], words
        assert [s for *_, s in got] == pytest.approx([s for *_, s in want])


@given
def test_toxicity_on_held_out_rows(spark):
    docs, labels = table(spark, PATH, "documents"), table(spark, PATH, "labels")
    got = toxicity.digest(docs, toxicity.fit(docs, labels))
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows)
    assert len(rows) > 40 and right >= 0.93 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in got.collect())


def test_toxicity_of_odd_rows(spark):
    foul = " ".join(["plain words"] * 5 + ["scoundrel", "knave", "rascal"])
    rows = [(i, foul + f" t{i}" if i % 2 else f"good day {i} to all of you here", "k") for i in range(60)]
    rows += [(100, None, "k"), (101, "", "k"), (102, "knave scoundrel rascal", "k"), (None, "good", "k"), (3, "good again", "k"), (104, "good " * 20_000, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 0), (2, None), (None, 1), (999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.add_score(docs, model)
    assert got.columns == [*docs.columns, "_tox_score"]
    scores = [(r["doc_id"], r["text"], r["_tox_score"]) for r in got.collect()]
    assert all((s >= 0.5) == bool(t and "knave" in t) for _, t, s in scores)
    assert len({s for _, t, s in scores if not t}) == 1
    nothing = toxicity.fit(docs, labels.limit(0))
    assert {r["predicted"] for r in toxicity.digest(docs, nothing).collect()} == {0}
    assert toxicity.digest(docs.limit(0), model).count() == 0
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.filter("text LIKE '%knave%'").isEmpty()


@given
def test_language_on_held_out_rows(spark):
    docs = table(spark, PATH, "documents")
    got = language.identify(docs, language.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 200 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)


def test_language_of_odd_rows(spark):
    words = {"en": "the of and to in is that", "de": "der die und das nicht ist ein", "fr": "le la les des est une que", "xx": "zug zug wop wop qua"}
    dice = random.Random(1)
    rows = [(i, " ".join(dice.choice(words[l].split()) for _ in range(30)), l) for i in range(240) for l in [sorted(words)[i % 4]]]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "12 34 !?", None), (1003, "der die und das", None), (None, "the of and", "en"), (1004, "the of and to " * 9000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1.5 AS score")
    got = {r["doc_id"]: r for r in language.identify(docs, language.fit(docs)).collect()}
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003, 1004, None)] == ["und", "und", "und", "de", "en", "en"]
    assert got[1000]["score"] == 0 and all(0 <= r["score"] <= 1 for r in got.values())
    assert sum(got[i]["lang_pred"] == rows[i][2] for i in range(240)) == 240
    one = docs.filter("lang = 'de'")
    assert {r["lang_pred"] for r in language.identify(one, language.fit(one)).collect()} == {"de"}
    assert {r["lang_pred"] for r in language.identify(one, language.fit(one.limit(0))).collect()} == {"und"}
    assert language.family("de-AT") == "germanic" and language.family("tlh") == "=tlh"
