"""Org tables: what a change rewrites; bucketed and streamed writes."""

import os
import uuid

import pytest
from build import bag, batch, companies, reviews, topics
from pyspark.sql import functions as F

from starfold import schemas
from starfold.operators import embedding, ingest, integrity
from starfold.sources.orgtable import OrgTable
from starfold.streaming import model as streamed

SCORES = "org_id string, topic_id long, score double, review_count long, confidence string"


def scores(spark, *rows):
    return spark.createDataFrame([(o, t, s, 1, "low") for o, t, s in rows], SCORES)


def files(table):
    return {
        os.path.join(at, n): os.stat(os.path.join(at, n)).st_mtime_ns
        for at, _, names in os.walk(table.path) for n in names if n.endswith(".parquet")
    }


def test_a_change_rewrites_its_buckets_only(spark, tmp_path):
    table = OrgTable(spark, f"{tmp_path}/t", schemas.SCORES, 16).create(scores(spark, *[(f"o{i}", i, 1.0) for i in range(40)]))
    before = files(table)
    orgs = spark.createDataFrame([("o3",), ("o7",)], "org_id string")
    parts = table.replace_orgs(scores(spark, ("o3", 100, 2.0)), orgs)
    assert len(parts) <= 2
    after = files(table)
    changed = {os.path.basename(os.path.dirname(f)) for f, _ in set(before.items()) ^ set(after.items())}
    assert changed == {f"bucket={p}" for p in parts}
    rows = {(r["org_id"], r["topic_id"]) for r in table.read().collect()}
    assert rows == {(f"o{i}", i) for i in range(40) if i not in (3, 7)} | {("o3", 100)}
    assert {r["org_id"] for r in table.read(orgs).collect()} >= {"o3"}


def test_emptied_buckets_stay_empty_and_repeats_change_nothing(spark, tmp_path):
    table = OrgTable(spark, f"{tmp_path}/t", schemas.SCORES, 4).create(scores(spark, ("a", 1, 1.0), ("b", 2, 1.0)))
    for _ in range(2):
        table.remove_orgs(spark.createDataFrame([("a",), ("b",), ("none",)], "org_id string"))
        assert table.read().count() == 0
    for _ in range(2):
        table.upsert(scores(spark, ("a", 5, 3.0), ("b", 6, 1.0)), "topic_id")
        assert table.read().count() == 2
    assert table.replace_orgs(scores(spark), spark.createDataFrame([], "org_id string")) == []
    assert OrgTable(spark, f"{tmp_path}/e", schemas.SCORES, 4).create().read().count() == 0


def test_vectors_delivered_again_change_nothing(spark, tmp_path):
    tree = topics(spark, (1, "a", None, "P", 1, None), (2, "a", 1, "x", 2, [1.0, 0.0]), (3, "a", 1, "y", 3, [0.0, 1.0]))
    vectors = OrgTable(spark, f"{tmp_path}/v", schemas.REVIEW_VECTORS, 4).create()
    found = OrgTable(spark, f"{tmp_path}/a", streamed.OWNED_ASSIGNMENTS, 4).create()
    step = streamed.VectorIngest(vectors, found, tree, ("seq",), 0.5)
    kind = "review_id long, org_id string, model string, text_embedding array<float>, seq int"
    first = spark.createDataFrame([(1, "a", "m", [1.0, 0.1], 1), (1, "a", "m", [0.0, 1.0], 0), (2, "a", "m", [0.0, 2.0], 0), (9, "b", "m", [1.0, 0.0], 0)], kind)
    state = lambda: (bag(found.read(), "review_id", "topic_id"), bag(vectors.read(), "review_id", "text_embedding"))
    step(first, 0)
    once = state()
    assert once[0] == [(1, 2), (2, 3)] and len(once[1]) == 3
    step(first, 0)
    assert state() == once
    step(spark.createDataFrame([(2, "a", "m", [-1.0, -1.0], 0)], kind), 1)
    assert state()[0] == [(1, 2)]


def test_a_bucketed_table_is_not_shuffled(spark, tmp_path):
    name = f"t{uuid.uuid4().hex}"
    rows = reviews(spark, *[{"review_url": f"u{i}"} for i in range(50)])
    rows.write.bucketBy(8, "review_key").sortBy("review_key").option("path", f"{tmp_path}/b").saveAsTable(name)
    try:
        reduced = ingest.reduce_batch(batch(spark, {"review_url": "u3", "stars": 1.0}, {"review_url": "new"}), ("seq",))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        merged = ingest.merge_reduced(spark.table(name), reduced)
        plan = merged._jdf.queryExecution().executedPlan().toString()
        stored = plan[: plan.index("FileScan")].rsplit("SortMergeJoin", 1)[-1]
        assert "Bucketed: true" in plan and "Exchange" not in stored
        assert merged.count() == 51 and merged.filter("review_key = 'u3'").first()["stars"] == 1.0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE {name}")


def test_the_backlog_moves_no_text(spark, tmp_path):
    rows = reviews(spark, *[{"review_url": f"u{i}"} for i in range(20)])
    rows.write.parquet(f"{tmp_path}/r")
    stored = spark.read.parquet(f"{tmp_path}/r")
    done = spark.createDataFrame([(i,) for i in range(1, 8)], "review_id long")
    new = embedding.embed_reviews(stored, done, embedding.HashingEmbedder(8))
    assert new.count() == 13
    plan = new._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        assert "Exchange" not in line or "Broadcast" in line, plan


def model(spark):
    orgs = companies(spark, {"org_id": "a", "name": "A"}, {"org_id": "b", "name": "B"})
    tree = topics(spark, (1, "a", None, "P", 1, None), (2, "a", 1, "x", 2, None))
    own = reviews(spark, {"review_url": "u1"}, {"review_url": "u2"}, org="a")
    return {"companies": orgs, "topic_templates": tree, "reviews": own}


@pytest.mark.parametrize("table,kind,good,bad", [
    ("company_relations", "company_org_id string, competitor_org_id string", ("a", "b"), [(("a", "z"), "competitor_org_id"), (("z", "b"), "company_org_id")]),
    ("reviews", "review_key string, org_id string", ("k", "a"), [(("k2", "z"), "org_id"), ((None, "a"), "missing")]),
    ("sync_log", "seq long, org_id string", (1, "b"), [((2, "z"), "org_id")]),
    ("topic_templates", "id long, org_id string, parent_id long", (7, "a", 1), [((8, "z", None), "org_id"), ((9, "a", 99), "parent_id")]),
    ("review_embeddings", "review_id long", (1,), [((77,), "review_id")]),
    ("review_topics", "review_id long, topic_id long", (1, 2), [((77, 2), "review_id"), ((1, 99), "topic_id")]),
    ("company_scores", "org_id string, topic_id long", ("a", None), [(("z", None), "org_id"), (("a", 99), "topic_id")]),
])
def test_every_reference_is_checked(spark, table, kind, good, bad):
    tables = model(spark)
    rows = spark.createDataFrame([good, *[b for b, _ in bad]], kind)
    accepted, kept_out = integrity.split_batch(table, rows, tables)
    assert [tuple(r) for r in accepted.collect()] == [good]
    reasons = {tuple(r)[:-1]: r["reasons"] for r in kept_out.collect()}
    assert len(reasons) == len(bad) and all(len(reasons[b]) == 1 and why in reasons[b][0] for b, why in bad)


def test_repeats_wait_outside_and_new_parents_count(spark):
    rows = spark.createDataFrame([(5, "a", 6), (6, "a", None)], "id long, org_id string, parent_id long")
    accepted, kept_out = integrity.split_batch("topic_templates", rows, model(spark))
    assert accepted.count() == 2 and kept_out.count() == 0
    rows = spark.createDataFrame([("k", "a", 2), ("k", "a", 1), ("k", "a", 3)], "review_key string, org_id string, seq int")
    accepted, kept_out = integrity.split_batch("reviews", rows, model(spark), ("seq",))
    assert [r["seq"] for r in accepted.collect()] == [1]
    assert sorted((r["seq"], r["reasons"]) for r in kept_out.collect()) == [(2, ["review_key repeated"]), (3, ["review_key repeated"])]
    accepted, kept_out = integrity.split_batch("reviews", rows.limit(0), model(spark))
    assert accepted.count() == 0 and kept_out.count() == 0
