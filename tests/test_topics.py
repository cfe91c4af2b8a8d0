import numpy as np
import pytest
from build import bag, companies, reviews, rows, topics
from pyspark.sql import functions as F

from starfold.operators import embedding, scoring, similarity, topics as topic_ops
from starfold.plans import search

AS_OF = "2025-12-01"


def _vectors(spark, *rows_):
    return spark.createDataFrame(
        [(i, "m", v) for i, v in rows_], "review_id bigint, model string, text_embedding array<float>")


@pytest.fixture(params=["pairs", "blocks"])
def method(request):
    return request.param


def test_classify(spark, method):
    revs = reviews(spark, {}, {"org_id": "222"}, {})
    tops = topics(
        spark, (1, "111", None, "P", 0, [1.0, 0.0, 0.0]), (2, "111", 1, "A", 1, [0.9, 0.1, 0.0]),
        (3, "111", 1, "B", 2, [0.0, 0.0, 1.0]), (4, "111", 1, "none", 3, None))
    vecs = _vectors(spark, (1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [1.0, 0.0]))
    out = rows(similarity.classify(vecs, revs, tops, method=method), "review_id", "topic_id", "similarity")
    assert [(r, t) for r, t, _ in out] == [(1, 2)] and out[0][2] > 0.9
    assert similarity.classify(vecs, revs, tops, threshold=0.999, method=method).count() == 0


def test_classify_caps_and_breaks_ties_by_id(spark, method):
    revs = reviews(spark, {})
    tops = topics(spark, *[(i, "111", 1, f"T{i}", i, [1.0, 1.0, 1.0]) for i in (9, 4, 7, 5)])
    vecs = _vectors(spark, (1, [1.0, 1.0, 1.0]))
    out = similarity.classify(vecs, revs, tops, max_topics=2, method=method)
    assert bag(out, "topic_id") == [(4,), (5,)]


def test_blocks_agree_with_brute_force(spark, monkeypatch):
    """Orgs cut into many review and topic blocks, one org holding most reviews."""
    monkeypatch.setattr(similarity, "REVIEWS_PER_BLOCK", 7)
    monkeypatch.setattr(similarity, "TOPICS_PER_BLOCK", 3)
    rng = np.random.default_rng(1)
    v, t = rng.normal(size=(60, 5)).astype("f4"), rng.normal(size=(16, 5)).astype("f4")
    org = lambda i: "hot" if i % 3 else f"o{i % 2}"
    revs = reviews(spark, *[{"org_id": org(i)} for i in range(1, 61)])
    vecs = _vectors(spark, *[(i + 1, v[i].tolist()) for i in range(60)])
    tops = topics(spark, *[(j, "hot" if j < 10 else f"o{j % 2}", 99, f"T{j}", j, t[j].tolist()) for j in range(16)])
    want = []
    for i in range(60):
        sims = []
        for j in range(16):
            if ("hot" if j < 10 else f"o{j % 2}") == org(i + 1):
                a, b = v[i].astype(float), t[j].astype(float)
                sims.append((-round(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b), 12), j))
        want += [(i + 1, j) for s, j in sorted(sims)[:3] if -s >= 0.2]
    got = bag(similarity.classify(vecs, revs, tops, 0.2), "review_id", "topic_id")
    assert got == sorted(want, key=repr)
    assert bag(similarity.classify(vecs, revs, tops, 0.2, method="pairs"), "review_id", "topic_id") == got


def test_semantic_and_similar_search(spark):
    revs = reviews(
        spark, {"text": "a"}, {"text": "b", "stars": 2.0}, {"text": ""}, {"text": "d", "org_id": "222"}, {"text": "e"})
    vecs = _vectors(spark, (1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, [1.0]))
    out = rows(similarity.semantic_search(revs, vecs, [1.0, 0.0]), "id", "similarity")
    assert [i for i, _ in out] == [1, 2, 4] and out[0][1] == 1.0 and out[2][1] == 0.0
    assert rows(similarity.semantic_search(revs, vecs, [1.0, 0.0], stars="1-3"), "id") == [(2,)]
    assert rows(similarity.semantic_search(revs, vecs, [1.0, 0.0], limit=0), "id") == []
    assert rows(similarity.similar_to_review(revs, vecs, 4), "id") == [(4,), (2,), (1,)]
    assert rows(similarity.similar_to_review(revs, vecs, 4, org_id="111", limit=1), "id") == [(2,)]
    assert rows(similarity.similar_to_review(revs, vecs, 77), "id") == []


def test_backlog_and_embedders(spark):
    revs = reviews(spark, {"text": "red car"}, {"text": ""}, {"text": None}, {"text": "blue car"})
    none = _vectors(spark).limit(0)
    assert bag(embedding.unembedded(revs, none), "id") == [(1,), (4,)]
    done = _vectors(spark, (1, [0.0]))
    assert bag(embedding.unembedded(revs, done), "id") == [(4,)]
    assert bag(embedding.unembedded(revs, done, force=True), "id") == [(1,), (4,)]

    def lengths(texts):
        assert len(texts) <= 2
        return [[float(len(t)), 1.0] for t in texts]

    many = reviews(spark, *[{"text": "x" * i} for i in range(1, 8)]).coalesce(1)
    out = embedding.embed_reviews(many, none, embedding.BatchEmbedder(lengths, "len", batch_size=2))
    assert bag(out, "review_id", "model", "text_embedding") == [(i, "len", [float(i), 1.0]) for i in range(1, 8)]
    vecs = embedding.embed_reviews(revs, none, embedding.HashingEmbedder(64))
    got = dict(rows(vecs, "review_id", "text_embedding"))
    assert len(got[1]) == 64 and np.linalg.norm(got[1]) == pytest.approx(1, abs=1e-6)
    assert np.dot(got[1], got[4]) == pytest.approx(0.5, abs=1e-5)


def test_embedder_must_return_one_vector_per_text(spark):
    bad = embedding.BatchEmbedder(lambda texts: [[1.0]], "bad")
    with pytest.raises(Exception, match="one vector per text"):
        bad.embed(spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, text string").coalesce(1)).collect()


def test_search_mode(spark):
    revs = reviews(spark, {"text": "red car"}, {"text": "blue boat"})
    model = embedding.HashingEmbedder(64)
    vecs = embedding.embed_reviews(revs, _vectors(spark).limit(0), model)
    mode, out = search.search(spark, revs, vecs, "boat", model)
    assert mode == "semantic" and rows(out, "id")[0] == (2,)
    assert search.search(spark, revs, vecs, "boat")[0] == "text"
    assert search.search(spark, revs, vecs, "boat", model, semantic=False)[0] == "text"
    assert search.search(spark, revs, vecs.limit(0), "boat", model)[0] == "text"

    def broken(texts):
        raise RuntimeError("no service")

    mode, out = search.search(spark, revs, vecs, "BOAT", embedding.BatchEmbedder(broken, "x"))
    assert mode == "text" and rows(out, "id") == [(2,)]
    assert rows(search.similar(spark, revs, vecs, text="red", embedder=model), "id")[0] == (1,)
    with pytest.raises(ValueError):
        search.similar(spark, revs, vecs)


TOPICS = [
    (1, "111", None, "Price", 0, None), (2, "111", 1, "Markup", 1, None), (3, "111", 1, "Cost", 2, None),
    (4, "111", None, "Empty", 3, None),
]


def _assign(spark, *pairs):
    return spark.createDataFrame([(r, t, 0.5) for r, t in pairs], "review_id bigint, topic_id bigint, similarity double")


def test_hierarchy_keeps_childless_parents(spark):
    out = bag(topic_ops.hierarchy(topics(spark, *TOPICS)), "parent_name", "name")
    assert out == [("Empty", None), ("Price", "Cost"), ("Price", "Markup")]


def test_topic_reports(spark):
    revs = reviews(spark, {"stars": 5.0}, {"stars": 4.0, "date": None}, {"stars": 4.0})
    tops, links = topics(spark, *TOPICS), _assign(spark, (1, 2), (2, 2), (3, 2), (3, 3))
    assert bag(topic_ops.topic_stats(tops, links, revs), "name", "review_count", "avg_stars") == [
        ("Cost", 1, 4.0), ("Markup", 3, 4.3)]
    tree = topic_ops.topic_tree(tops, links, revs)
    assert bag(tree.filter("level = 0"), "rank", "name", "review_count", "avg_stars") == [
        (1, "Price", 4, 4.3), (2, "Empty", 0, 0.0)]
    assert topic_ops.topic_tree(tops, links, revs, limit=1).count() == 3
    nested = {r.name: r.children for r in topic_ops.topic_tree_nested(tops, links, revs).collect()}
    assert [c.name for c in nested["Price"]] == ["Markup", "Cost"] and nested["Empty"] == []
    orgs = companies(spark, {"org_id": "111"}, {"org_id": "222"})
    assert bag(topic_ops.classified_counts(orgs, revs, links)) == [("111", 3), ("222", 0)]


def test_missing_stars_keep_the_weight_of_their_topic(spark):
    revs = reviews(spark, {"stars": None}, {"stars": 2.0}, {"stars": 5.0})
    tops, links = topics(spark, *TOPICS), _assign(spark, (1, 2), (2, 2), (3, 3))
    parent = topic_ops.topic_tree(tops, links, revs).filter("name = 'Price'").first()
    assert (parent.review_count, parent.avg_stars) == (3, 3.0)


def _score(spark, *reviews_):
    revs = reviews(spark, *[{"stars": s, "date": d} for s, d in reviews_])
    links = _assign(spark, *[(i + 1, 2) for i in range(len(reviews_))]) if reviews_ else _assign(spark, (99, 2))
    out = scoring.subtopic_scores(topics(spark, *TOPICS), links, revs, AS_OF)
    return tuple(out.filter("topic_id = 2").select("score", "review_count", "confidence").first())


def test_worked_scores(spark):
    assert _score(spark, (5.0, "2025-10-01"), (4.0, "2025-11-01"), (3.0, "2025-04-01"), (5.0, "2023-12-01")) == (8.5, 4, "low")
    assert _score(spark, (5.0, AS_OF), (1.0, AS_OF)) == (6.0, 2, "low")
    assert _score(spark) == (0.0, 0, "low")
    assert _score(spark, (5.0, AS_OF), (None, AS_OF)) == (5.0, 2, "low")
    assert _score(spark, (5.0, AS_OF), (1.0, None)) == (10.0, 1, "low")
    assert _score(spark, *[(5.0, AS_OF)] * 5) == (10.0, 5, "medium")


def test_confidence(spark):
    df = spark.createDataFrame([(3,), (4,), (5,), (10,), (19,), (20,), (25,)], "n int")
    assert [c for c, in df.select(scoring.confidence(F.col("n"))).collect()] == [
        "low", "low", "medium", "medium", "medium", "high", "high"]


def test_rollup_counts_assignments(spark):
    revs = reviews(spark, {"stars": 5.0}, {"stars": 4.0, "date": "2020-01-01"}, {"stars": 1.0})
    tops, links = topics(spark, *TOPICS), _assign(spark, (1, 2), (2, 2), (3, 3), (1, 3))
    heads = scoring.parent_scores(tops, links, revs, "2025-06-02")
    # Markup (5*2*2 + 4*2*1)/3 = 9.33 -> 9.3 over 2; Cost (10 + 2)/2 = 6.0 over 2; parent 7.65 -> 7.7
    assert rows(heads.orderBy("rank"), "rank", "name", "score", "review_count") == [
        (1, "Price", 7.7, 4), (2, "Empty", 0.0, 0)]
    orgs = companies(spark, {"org_id": "111"}, {"org_id": "222", "name": "B"})
    assert bag(scoring.overall_scores(orgs, tops, links, revs, "2025-06-02")) == [
        ("111", "111", 7.7, 4), ("222", "B", 0.0, 0)]
    stored = scoring.score_rows(orgs, tops, links, revs, "2025-06-02")
    assert stored.count() == 6 and stored.filter("topic_id IS NULL").count() == 2


def test_comparison(spark):
    heads = spark.createDataFrame([
        ("a", 1, 1, "X", 8.0), ("a", 2, 2, "Y", 6.0), ("b", 1, 3, "Z", 7.0), ("b", 2, 4, "X", 7.5),
        ("b", 3, 5, "Y", 6.4),
    ], "org_id string, rank int, topic_id bigint, name string, score double")
    pairs = spark.createDataFrame([("a", "b")], "org_a string, org_b string")
    out = rows(scoring.compare_scores(heads, pairs).orderBy("place"), "name", "score_a", "score_b", "delta", "marker")
    assert out == [("X", 8.0, 7.5, 0.5, "✅"), ("Y", 6.0, 6.4, -0.4, ""), ("Z", 0.0, 7.0, -7.0, "❌")]


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if "Exchange" in line and "AQEShuffleRead" not in line], plan


def test_search_moves_no_vectors(spark):
    vecs = spark.range(50).selectExpr("id AS review_id", "array(float(id), float(1)) AS text_embedding", "'1' AS org_id")
    revs = spark.range(50).selectExpr(
        "id", "'1' AS org_id", "string(id) AS review_key", "'t' AS text", "5.0D AS stars", "'2025-01-01' AS date",
        "'a' AS author_name", "string(NULL) AS business_response")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = similarity.closest(revs, vecs, similarity.vec.cosine_to([1.0, 0.0])(F.col("text_embedding")))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        join = plan.index("Join")
        assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") > join
        assert "text_embedding" not in plan[:join]
        assert [r["id"] for r in found.orderBy(F.desc("similarity")).limit(2).collect()] == [49, 48]
        blocks = similarity.classify(
            vecs, None, spark.createDataFrame([(1, "1", None, None), (2, "1", 1, [1.0, 0.0])], "id bigint, org_id string, parent_id bigint, embedding array<float>"), 0.0)
        text = blocks._jdf.queryExecution().optimizedPlan().toString()
        assert "Relation" not in text or text.count("text_embedding") >= 1
        assert blocks.count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lengths_that_match_no_topic_are_counted(spark):
    vecs = spark.createDataFrame([(1, "1", [1.0]), (2, "1", [1.0, 0.0]), (3, "2", [1.0])], "review_id bigint, org_id string, text_embedding array<float>")
    tops = spark.createDataFrame([(1, "1", 9, [1.0, 1.0])], "id bigint, org_id string, parent_id bigint, embedding array<float>")
    assert bag(similarity.vector_mismatches(vecs, None, tops)) == [("1", 2, 1)]
