"""Set join and vector graph against brute force."""

import random

import numpy as np
import pytest

from starfold.llm import common, setjoin, vectorgraph
from starfold.llm.graph import components


def plain_groups(n, linked):
    up = list(range(n))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return [root(k) for k in range(n)]


def corpus(dice):
    """Families of near copies of several kinds, a passage that many share, odd texts."""
    vocabulary = [f"w{i}" for i in range(300)]
    shared = " ".join(dice.choice(vocabulary) for _ in range(25))
    texts = []
    for _ in range(8):
        base = [dice.choice(vocabulary) for _ in range(dice.choice([20, 60, 120]))]
        for _ in range(dice.choice([1, 5, 14])):
            copy = list(base)
            for _ in range(dice.randrange(0, 4)):
                copy[dice.randrange(len(copy))] = dice.choice(vocabulary)
            texts.append(" ".join(copy) + (" " + shared if dice.random() < 0.5 else ""))
    texts += [f"{shared} tail{i}" for i in range(30)]
    texts += [None, "", " \t\n", "one", "One", "one two", "ONE  two", "a b c", "a\x0bb\x0cc", "x " * 500, "x " * 700, texts[0], texts[0].upper()]
    return texts


def fold(text):
    out = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", out) if w]


def plain_sets(texts, size):
    out = []
    for t in texts:
        w = fold(t)
        k = min(size, len(w))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    return out


@pytest.mark.parametrize("size,num,den,settings", [
    (3, 90, 100, {}),
    (5, 8, 10, {}),
    (3, 6, 10, {"SHORT_LIST": 1, "ROUNDS": 0, "BLOCK_BYTES": 900}),
    (2, 7, 10, {"SHORT_LIST": 3, "ROUNDS": 2, "BLOCK_ROWS": 7}),
    (3, 90, 100, {"MOST_SHARED": 1}),
])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, size, num, den, settings):
    for name, value in settings.items():
        monkeypatch.setattr(setjoin, name, value)
    texts = corpus(random.Random(size * num))
    sets = plain_sets(texts, size)

    def linked(a, b):
        x, y = sets[a], sets[b]
        return bool(x) and bool(y) and den * len(x & y) >= num * len(x | y)

    want = plain_groups(len(texts), linked)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, sid int").repartition(5)
    got = sorted(setjoin.groups(docs, size, num, den).collect(), key=lambda r: r["doc_id"])
    assert [r["n_shingles"] for r in got] == [len(s) for s in sets]
    assert [r["component_id"] for r in got] == want


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text), (5, text), (5, text), (9, text + " more"), (None, "alone here"), (None, None), (6, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["component_id"] or -1, r["n_shingles"]) for r in setjoin.groups(docs, 5, 8, 10).collect())
    assert got == sorted([(5, 46)] * 3 + [(5, 47), (-1, 1), (-1, 0), (6, 1)])
    kept = setjoin.keep_first(docs.selectExpr("*", "'x' AS rows", "2 AS first"))
    assert kept.columns == ["doc_id", "text", "rows", "first"]
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, -1, -1, 5, 6]
    # different texts under one id are different documents; a repeated row is one
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(1, text), (1, other), (1, other), (2, other + " end"), (3, text), (4, None), (4, None), (0, "only this")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS _drop", "8 AS row", "9 AS sid")
    kept = setjoin.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"] or "") for r in kept.collect())) == sorted([(0, "only this"), (1, text), (1, other), (4, "")])
    none = docs.limit(0)
    assert setjoin.groups(none).count() == 0 and setjoin.keep_first(none).count() == 0


def test_a_long_list_and_a_very_long_text(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(i, f"{passage} own{i} {passage.upper()} mine{i // 2}") for i in range(5000)]
    rows += [(9000, " ".join(f"z{i % 4001}" for i in range(200_000))), (9001, " ".join(f"z{i % 4001}" for i in range(199_990)))]
    sets = plain_sets([t for _, t in rows[:8]] + [t for _, t in rows[-2:]], 3)
    got = {r["doc_id"]: r for r in setjoin.groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 75, 100).collect()}
    linked = [[100 * len(x & y) >= 75 * len(x | y) for y in sets] for x in sets]
    assert linked[-1][-2] and got[9001]["component_id"] == 9000 and got[9000]["n_shingles"] == len(sets[-2])
    # two neighbours share their last word too; the others share the passage alone
    assert linked[0][1] and not linked[0][2]
    assert all(got[i]["component_id"] == i - i % 2 for i in range(5000))


def test_prefixes_of_similar_sets_meet():
    dice = random.Random(4)
    limit, met = setjoin.Threshold(8, 10), 0
    texts = [[f"w{dice.randrange(40)}" for _ in range(dice.randrange(1, 60))] for _ in range(300)]
    texts += [t[dice.randrange(0, 4) :] + [f"v{dice.randrange(9)}" for _ in range(dice.randrange(0, 3))] for t in texts]
    sets = [setjoin.shingles(" ".join(t), 2) for t in texts]
    bits = np.zeros(1 << 13, dtype=np.uint8)  # so few cells that many shingles fall together
    seen = {}
    for s in sets:
        for c in setjoin._cell(s, len(bits) * 8).tolist():
            if seen.setdefault(c, setjoin.set_id(s)) != setjoin.set_id(s):
                bits[c >> 3] |= 1 << (c & 7)
    counts = np.array([dice.choice([1, 2, 50, 9000]) for _ in range(setjoin.SKETCH)])
    order = setjoin.Order(counts, bits)
    for s, t in zip(sets[:300], sets[300:]):
        if len(s) and len(t) and len(s) != len(np.intersect1d(s, t)) and limit.linked(len(np.intersect1d(s, t)), len(s), len(t)):
            met += 1
            (p, i), (q, j) = order.prefix(s, limit), order.prefix(t, limit)
            both = limit.least_of_pair(len(s), len(t))
            calls = min(both - limit.least_shared(len(v)) + k for v, k in ((s, i), (t, j)))
            assert min(i, j) <= calls <= len(np.intersect1d(p, q))
    assert met > 50


def test_cells_are_packed_as_gaps():
    dice = np.random.default_rng(5)
    for share in (0.9, 1 / 64, 1e-4):
        cells = np.flatnonzero(dice.random(setjoin.PIECE) < share)
        raw = setjoin._packed(cells)
        assert setjoin._unpacked(raw).tolist() == cells.tolist()
        if share == 1 / 64:
            assert len(raw) < 1.1 * len(cells)
    assert setjoin._unpacked(setjoin._packed(np.array([0, 255, 256, 1000, setjoin.PIECE - 1]))).tolist() == [0, 255, 256, 1000, setjoin.PIECE - 1]


def test_sets_stay_where_they_are_written(spark, monkeypatch):
    plans, keep = {}, setjoin.keep

    def seen(df, name, *more):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return keep(df, name, *more)

    monkeypatch.setattr(setjoin, "keep", seen)
    monkeypatch.setattr(setjoin, "LEAST_CELLS", 1)
    monkeypatch.setattr(setjoin, "BYTES_A_CELL", 1)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join([*base, f"end{k % 3}"]) for k in range(60)]  # three sets, in all tasks
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    limit = setjoin.Threshold(90, 100)
    monkeypatch.setattr(setjoin, "PIECE", 1 << 10)
    rows, order = setjoin.describe(docs, 3)
    total = sum(map(len, texts))
    assert total <= len(order.bits) * 8 < total + setjoin.PIECE  # as many cells as asked for, not a power of two
    lists = setjoin.prefix_rows(docs, 3, limit, order)
    wanted = lists.select("sid").distinct()
    sets = setjoin.fetch_sets(docs, wanted, 3, limit, order)
    assert "hashpartitioning" not in plans["picked-sets"]
    assert plans["shared-prefixes"].count("Exchange hashpartitioning") == 1
    ids = sorted(r["sid"] for r in wanted.collect())
    pairs = spark.createDataFrame([(ids[0], ids[1]), (ids[0], ids[2])], "a long, b long")
    assert len(ids) == 3 and sorted(r["sid"] for r in sets.named(pairs, "a", "b").collect()) == ids
    assert {tuple(r) for r in setjoin.verified(pairs, sets, limit).collect()} == {(ids[0], ids[1]), (ids[0], ids[2])}


def test_counts_in_ranges_bound_what_sets_share():
    dice = np.random.default_rng(6)
    for n in (1, 40, 3000, 60_000):
        s, t = (np.unique(dice.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)) for _ in range(2))
        t = np.unique(np.concatenate([s[: n // 2], t[n // 2 :]]))
        bound = setjoin._most_common(setjoin._in_ranges(s), setjoin._in_ranges(t))
        assert len(np.intersect1d(s, t)) <= bound <= min(len(s), len(t))
        assert setjoin._most_common(setjoin._in_ranges(s), setjoin._in_ranges(s)) == len(s)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(8, 40)] + [(3, 3), (200, -5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{k: 7 for k in range(7, 40)}, 200: -5, -5: -5}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- vectors ---------------------------------------------------------------------


def vectors(seed, n=900, dim=16):
    dice = np.random.default_rng(seed)
    x = dice.normal(size=(n, dim))
    heart = dice.normal(size=dim)
    x[: n // 3] = heart + dice.normal(scale=0.12, size=(n // 3, dim))  # a third in one group
    for k in range(n // 3, n // 2, 3):
        x[k + 1] = x[k] * 2 + dice.normal(scale=0.2, size=dim)
        x[k + 2] = x[k]
    return x.astype(np.float32)


def brute(rows, least):
    unit = {}
    for k, v in enumerate(rows):
        if v[0] is None or v[1] is None or not len(v[1]) or any(e is None or not np.isfinite(e) for e in v[1]):
            continue
        a = np.array(v[1], dtype=np.float32).astype(np.float64)
        if a.any():
            unit[k] = a / np.linalg.norm(a)
    linked = lambda a, b: a in unit and b in unit and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least
    links = [sum(linked(a, b) for b in range(len(rows)) if b != a) for a in range(len(rows))]
    return links, plain_groups(len(rows), linked)


@pytest.mark.parametrize("settings", [{}, {"BLOCK": 60, "SHARD": 100}, {"BLOCK": 150, "SHARD": 80, "OVERLAP": 1}])
def test_links_are_those_of_all_pairs(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(vectorgraph, name, value)
    rows = [(k, [float(e) for e in v]) for k, v in enumerate(vectors(1))]
    n = len(rows)
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 16), (n + 3, [float("nan")] * 16), (n + 4, [1.0, None]), (n + 5, [1.0, 2.0]),
             (n + 6, [2.0, 4.0]), (n + 7, [float("inf")] * 16), (n + 8, rows[0][1]), (n + 9, [-0.0] * 16), (n + 10, [1e30] * 16), (n + 11, [1e-30] * 16)]
    frame = spark.createDataFrame([(*r, 3, True) for r in rows], "vec_id long, embedding array<double>, label int, kept boolean")
    got, recall = vectorgraph.near_duplicates(frame, 0.9)
    got = {r["vec_id"]: r for r in got.collect()}
    links, groups = brute(rows, 0.9)
    assert len(got) == len(rows) and recall >= 0.98
    found = sum(min(got[k]["n_links"], links[k]) for k in range(len(rows)))
    assert all(got[k]["n_links"] <= links[k] for k in range(len(rows)))
    assert found >= 0.98 * sum(links)
    same = sum(got[k]["component_id"] == groups[k] for k in range(len(rows)))
    assert same >= 0.99 * len(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert all(got[n + k]["n_links"] == 0 for k in (0, 1, 2, 3, 4, 7, 9)) and got[n + 5]["component_id"] == n + 5 == got[n + 6]["component_id"]


def close_groups(seed=7, groups=33, size=60, dim=64):
    """Groups of distinct near copies, each larger than the lists of its members."""
    dice = np.random.default_rng(seed)
    heart = dice.normal(size=(groups, 1, dim))
    return (heart + dice.normal(scale=0.1, size=(groups, size, dim))).reshape(-1, dim).astype(np.float32)


def test_groups_without_a_medoid_are_found():
    x = close_groups().astype(np.float64)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    hit = np.zeros((len(x), len(x)), dtype=bool)
    for a, b in vectorgraph.search(x, vectorgraph.robust_prune(x), 0.9):
        hit[a, b] = True
    true = x @ x.T >= 0.9
    assert true.sum() > 100_000 and (hit & true).sum() == true.sum()


@pytest.mark.parametrize("step,least", [(1, 0.9), (50, 0.9)])
def test_low_or_unmeasured_recall_compares_all_pairs(spark, monkeypatch, step, least):
    monkeypatch.setattr(vectorgraph, "search", lambda *a: iter(()))  # finds nothing
    rows = [(k * step + 1, [float(e) for e in v]) for k, v in enumerate(vectors(2, n=150))]
    links, groups = brute(rows, least)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, recall = vectorgraph.near_duplicates(frame, least)
    got = {r["vec_id"]: r for r in got.collect()}
    assert recall == 1.0 and sum(links) > 1000
    assert [got[r[0]]["n_links"] for r in rows] == links
    assert [got[r[0]]["component_id"] for r in rows] == [rows[g][0] for g in groups]


def test_groups_over_several_shards_get_their_own(spark):
    assigned = spark.createDataFrame(
        [(k, [1.0], 1, h) for k, h in enumerate([[1, 2], [2, 3], [3, 4], [1, 5], [5], [7]])], "cid long, v array<float>, many long, shards array<long>"
    )
    lists = spark.createDataFrame([(0, [1]), (1, [0, 2]), (2, [1]), (3, [4]), (4, [3]), (5, [])], "cid long, close array<long>")
    got = {r["cid"]: r["shards"] for r in vectorgraph._bridged(assigned, lists).collect()}
    own = got[0][0]
    assert own < -1 and got == {0: [own, 1, 2], 1: [own, 2, 3], 2: [own, 3, 4], 3: [1, 5], 4: [5], 5: [7]}


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectorgraph.near_duplicates(none)[0].count() == 0
    odd = spark.createDataFrame([(None, [1.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"] or -1, r["kept"]) for r in vectorgraph.near_duplicates(odd)[0].collect())
    assert got == [(-1, 0, -1, True), (2, 1, 2, True), (2, 1, 2, True)]


def test_workers_give_memory_back_after_the_last_batch(monkeypatch):
    told = []
    monkeypatch.setattr(common, "give_back", lambda: told.append("back"))
    run = common.trimmed(lambda batches: (told.append(b) or b for b in batches))
    assert list(run(iter("ab"))) == ["a", "b"] and told == ["a", "b", "back"]
    part = run(iter("cd"))
    next(part)
    part.close()
    assert told[3:] == ["c", "back"]
