"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from starfold.llm import phrases

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least, cover=(80, 100), most=2000):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        longest = Counter()
        for g, a in found.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    longest[g[i : i + k]] = max(longest[g[i : i + k]], a)
        ranked = []
        for g, a in found.items():
            if cover[1] * longest[g] >= cover[0] * a:
                continue
            score, _, l, r = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            ranked.append((-score, -a, " ".join(g).encode(), l, r))
        for rank, (score, a, g, l, r) in enumerate(sorted(ranked)[:most], 1):
            out.append((lang, rank, g.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def mined(spark, rows, least, **more):
    frame = spark.createDataFrame([(i, t, l, "c") for i, (l, t) in enumerate(rows)], "doc_id long, text string, lang string, gram string")
    got = phrases.top(phrases.collocations(frame.selectExpr("*", "1 AS size", "2 AS n"), least, **more))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


def corpus(seed, docs=60):
    dice = random.Random(seed)
    common = ["the", "of", "Café", "und", "a", "b", "straße", "longer_word_than_eight", "longer_word_than_nine", "x" * 40]
    passage = " ".join(f"p{i}" for i in range(70)) + ". tail of the passage"
    rows = []
    for i in range(docs):
        words = [dice.choice(common) if dice.random() < 0.8 else f"r{dice.randrange(400)}" for _ in range(dice.randrange(0, 150))]
        text = "".join(w + dice.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ; ", "\x0b", "　 "]) for w in words)
        rows.append((dice.choice(["en", "de", None, "und", ""]), text + (passage if i % 3 == 0 else "")))
    return rows


@pytest.mark.parametrize("seed,bits", [(1, 27), (2, 15)])
def test_counts_and_ranks_are_exact(spark, seed, bits):
    rows = corpus(seed)
    assert mined(spark, rows, 4, bits=bits) == brute(rows, 4)


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    rows = corpus(3)
    monkeypatch.setattr(phrases, "may_be_frequent", lambda *a: np.full(16, 255, np.uint8))
    assert mined(spark, rows, 4) == brute(rows, 4)


def test_the_bitmap_holds_what_is_frequent_and_little_else(spark):
    rows = [(l or "und", t) for l, t in corpus(4)]
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    marks = phrases.may_be_frequent(frame, 6)
    names = sorted({l for l, _ in rows})
    words = phrases.Words([t.encode() for _, t in rows], [names.index(l) for l, _ in rows])
    h = words.hashes([phrases._seed(n) for n in names])
    for keys in (h, phrases._pairs(h, words.link)):
        u, c = np.unique(keys, return_counts=True)
        assert (phrases._marked(marks, u) == (c >= 6)).all()
    assert phrases.may_be_frequent(frame, 1 << 40).any() == False  # noqa: E712


def test_odd_rows(spark):
    rows = [("en", None), ("en", ""), (None, " \t ."), ("fr", "a a a a a a a a a a a a"), ("xx", "ab ab. ab ab ab, ab")] * 3
    rows += [("de", "eins zwei drei vier fünf sechs eins zwei drei vier fünf sechs eins zwei drei " * 40)]
    assert mined(spark, rows, 3) == brute(rows, 3)
    assert mined(spark, [("en", None)], 1) == []
    frame = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert phrases.top(phrases.collocations(frame)).count() == 0


def test_a_long_text_is_cut_at_breaks_only(spark):
    text = ("one two three four five " * 10 + ". ") * 60 + "no break here " * 400
    assert b"".join(phrases._stretches(text.encode(), 1000)) == text.encode()
    parts = list(phrases._stretches(text.encode(), 1000))
    assert len(parts) > 10 and all(p.endswith(b".") for p in parts[:-1])
    assert mined(spark, [("en", text * 3)], 30) == brute([("en", text * 3)], 30)


def test_words_with_one_hash_are_told_apart(spark, monkeypatch):
    raw = [b"aa bb aa cc bb"]
    words = phrases.Words(raw, [0])
    real = words.hashes([1], lane=1)
    monkeypatch.setattr(words, "hashes", lambda seeds, lane=0: real)
    ids, places = phrases._word_ids(words, [1], np.arange(5), np.zeros(5, np.uint64))
    assert ids[0] == ids[2] and ids[1] == ids[4] and len(set(ids)) == 3 and len(places) == 3


def test_paths_are_compacted(spark):
    rows = [("en", " ".join(f"w{i}" for i in range(3000)))] * 2 + [("en", "w5 w6 w7 w8 other")]
    texts = spark.createDataFrame(rows, "lang string, text string")
    parts = phrases.graph(texts, np.full(16, 255, np.uint8))
    paths = phrases.compact(parts.filter("size = 4 AND n >= 2").select("lang", "gram", "n")).collect()
    assert sorted(len(r["weights"]) for r in paths) == [2997 - 2 * phrases.STRETCH, phrases.STRETCH, phrases.STRETCH]
    assert all(len(r["words"]) == len(r["weights"]) + 3 for r in paths)
    first = min(paths, key=lambda r: r["stretch"])
    assert first["words"][:4] == ["w0", "w1", "w2", "w3"] and first["weights"][5] == 3 and first["weights"][6] == 2


def test_shuffles_of_earlier_steps_are_dropped_before_the_next_one(spark, monkeypatch):
    order = []

    def watch(name):
        step = getattr(phrases, name)
        monkeypatch.setattr(phrases, name, lambda *given: (order.append(name), step(*given))[1])

    for name in ("may_be_frequent", "graph", "flows", "drop_shuffles"):
        watch(name)
    docs = spark.createDataFrame([("en", "a b c d. a b c e")] * 40, "lang string, text string")
    assert phrases.collocations(docs).count() == len(brute([("en", "a b c d. a b c e")] * 40, 30))
    assert order == ["may_be_frequent", "drop_shuffles", "graph", "drop_shuffles", "flows"] + 3 * ["drop_shuffles"]
