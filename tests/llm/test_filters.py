"""Decontamination and mixing against plain computations."""

import hashlib
import random
import re
from fractions import Fraction

import pytest

from starfold.llm import decontaminate as dc
from starfold.llm import mixture

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, items, window):
    w, hit, found = words(text), set(), set()
    for name, item in items:
        v = words(item)
        k = min(window, len(v))
        for j in range(len(v) - k + 1 if k else 0):
            for i in range(len(w) - k + 1):
                if w[i : i + k] == v[j : j + k]:
                    hit.update(range(i, i + k))
                    found.add(name)
    return len(w), hit, {f for f in found if f is not None}


def cases():
    dice = random.Random(11)
    vocabulary = "a b c d É naïve x1 你好 Ω".split()
    items = [(i % 9 if i != 4 else None, " ".join(dice.choice(vocabulary) for _ in range(dice.choice([1, 2, 3, 5, 8, 12])))) for i in range(14)]
    items += [(50, ""), (51, None), (52, "a, B! c"), (10, "É é a")]
    texts = [" ".join(dice.choice(vocabulary) for _ in range(dice.choice([0, 1, 3, 20, 60]))) for _ in range(40)]
    texts += [None, "", "--- !!!", items[2][1].upper() + ".", "a;B\nc", "x" * 4000]
    return items, texts


@pytest.mark.parametrize("window,block", [(4, 150_000), (4, 12), (1, 150_000), (10, 150_000)])
def test_hits_are_those_of_a_plain_search(spark, monkeypatch, window, block):
    monkeypatch.setattr(dc, "BLOCK_WORDS", block)
    items, texts = cases()
    docs = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, item_id string").selectExpr("*", "1 AS row", "2 AS spans", "3 AS items", "4 AS n_words", "5 AS k1", "6 AS _dc_words")
    bench = spark.createDataFrame(items, "item_id long, text string").withColumnRenamed("spans", "s")
    got = dc.digest(dc.scan(docs, bench, window)).collect()
    assert len(got) == len(texts)
    for r in got:
        n, hit, found = plain(texts[r["doc_id"]], items, window)
        listed = ",".join(sorted(str(f) for f in found))
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, len(hit), len(found)), (texts[r["doc_id"]], found)
        assert r["items_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert r["contaminated"] == bool(hit)


def test_removal_by_document_and_by_span(spark):
    docs = spark.createDataFrame(
        [(1, "keep this; one two THREE four! and this", 7), (2, "clean text", 8), (3, None, 9), (4, "one two three four", 1)],
        "doc_id long, text string, n_chars long",
    )
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    kept = dc.decontaminate(docs, bench, window=4)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {2, 3}
    cut = {r["doc_id"]: r["text"] for r in dc.decontaminate(docs, bench, window=4, coverage=0.6).collect()}
    assert cut == {1: "keep this; ! and this", 2: "clean text", 3: None}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.digest(dc.scan(docs, none)).first()["contaminated"] is False
    assert dc.digest(dc.scan(docs.limit(0), none)).count() == 0
    assert mixture.digest(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


# -- mixture ---------------------------------------------------------------------


def test_targets_share_out_the_excess():
    got = mixture.targets({"0a": 10, "0b": 1000, "0c": 1000, "1": 5})
    total = Fraction(3, 2) * 2015
    assert got["0a"] == 20 and got["1"] == 10
    assert got["0b"] == (total - 30) / 3 and got["0c"] == 2 * (total - 30) / 3
    assert mixture.targets({"0a": 0}) == {"0a": 0} and mixture.targets({}) == {}


def test_flow_repeats_only_where_needed():
    sizes = {("a",): 100, ("a", "b"): 50, ("b",): 10}
    got = mixture.route(sizes, {"a": Fraction(120), "b": Fraction(60)})
    assert sum(map(sum, got.values())) == 180
    assert got[("a", "b")][0] == 50 and got[("b",)][0] == 10 and got[("a",)][0] == 100
    assert sum(v[1] for v in got.values()) == 20
    short = mixture.route({("a",): 10}, {"a": Fraction(50)})
    assert short[("a",)] == [10, 10]


@pytest.fixture(scope="module")
def docs(spark):
    dice = random.Random(2)
    rows = [(i, " ".join(["w"] * dice.choice([0, 1, 3, 9])), dice.choice(["b", "a", "null", None])) for i in range(3000)]
    rows += [(5000, None, "b"), (5001, "  \t\x0b ", "Z"), (5002, "x " * 400, "a"), (7, "w w", "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "'q' AS pattern")


def test_taken_words_meet_the_targets(spark, docs):
    got = mixture.digest(docs).collect()
    assert len(got) == docs.count()
    per = {}
    for r in docs.join(mixture.digest(docs).drop("size"), "doc_id").collect():
        per.setdefault(r["source"], [r["source_size"], r["target"], 0])[2] += r["taken"]
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    order = sorted(per, key=lambda s: (s is None, s))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want = mixture.targets({mixture_label(s): per[s][0] for s in order})
    for s in order:
        size, target, taken = per[s]
        assert target == pytest.approx(float(want[mixture_label(s)]), abs=1e-5) and weights[s]
        assert abs(taken - target) <= 401
    key = lambda r: (r["doc_id"], r["size"], r["taken"])
    assert sorted(map(key, mixture.digest(docs.repartition(7)).collect())) == sorted(map(key, got))


def mixture_label(source):
    return "1" if source is None else "0" + source


def test_mix_keeps_columns_and_repeats(spark, docs):
    mixed = mixture.mix(docs)
    assert mixed.columns == docs.columns
    times = {}
    for r in mixed.collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    for r in mixture.digest(docs.filter("doc_id <> 7")).filter("size > 0").limit(0).collect():
        assert times.get(r["doc_id"], 0) * r["size"] == r["taken"]
    taken = {r["doc_id"]: r["taken"] // max(r["size"], 1) for r in mixture.digest(docs).collect() if r["size"] and r["doc_id"] != 7}
    assert all(times.get(i, 0) == n for i, n in taken.items())


def test_overlapping_sources(spark):
    rows = [(i, "w w", ["a"] if i % 3 == 0 else ["a", "b"] if i % 3 == 1 else ["b", None]) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, all array<string>")
    measured = mixture.measured(frame, "all")
    mix = mixture.Mix(measured)
    taken = mix.takes(measured).selectExpr("sum(times * size) AS t").first()["t"]
    assert abs(taken - sum(round(t) for t in mix.target.values())) <= 6
