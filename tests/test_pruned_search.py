"""Searches that skip buckets and clusters, against the plain ones."""

import numpy as np
from build import bag, reviews
from pyspark.sql import functions as F

from starfold.operators import listing, similarity
from starfold.sources.textindex import TextIndex, needed
from starfold.sources.vectorclusters import ODD, VectorClusters


def test_needed_trigrams():
    assert needed("AbCd") == ["abc", "bcd"] and needed("ab%cd_e") == [] and needed("x%Äöü_lll") == ["lll", "Äöü"]


def test_text_search_reads_matching_buckets_only(spark, tmp_path):
    words = ["alpha", "beta", "gamma", "delta", "Straße", "naïve 😀 café", "100% sure_thing", None, ""]
    rows = reviews(spark, *[
        {"review_url": f"u{i}", "text": words[i % 9] and f"{words[i % 9]} tail{i}", "date": f"20{10 + i % 12}-01-01", "stars": 1.0 + i % 5} for i in range(120)
    ])
    index = TextIndex(spark, f"{tmp_path}/i", 16).create(rows)
    for term in ("ALPHA", "ta ta", "tail77", "café", "straß", "%sure", "a_pha", "ga%il11", "xyz", "", "😀 c", "t_", "100%", "TAIL1"):
        for kind in ({}, {"stars": "2-4"}, {"org_id": "111", "limit": 3}, {"org_id": "none"}):
            assert bag(index.search(term, **kind)) == bag(listing.search_text(rows, term, **kind)), (term, kind)
    assert index.candidates("xyz") == [] and index.candidates("t_") is None
    held = {r["bucket"] for r in spark.read.parquet(f"{tmp_path}/i/rows").filter("text LIKE '%tail77%'").select("bucket").collect()}
    assert set(index.candidates("tail77")) == held and len(held) == 1
    plan = index.search("tail77")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters")[1][:60]


def test_semantic_search_skips_far_clusters(spark, tmp_path):
    dice = np.random.default_rng(2)
    centres = dice.normal(size=(12, 8))
    x = [(centres[i % 12] + 0.05 * dice.normal(size=8)).tolist() for i in range(600)]
    rows = reviews(spark, *[{"review_url": f"u{i}", "text": "t" if i % 7 else "", "stars": 1.0 + i % 5} for i in range(600)])
    odd = [(598, [0.0] * 8), (599, None), (600, [1.0, 2.0])]
    vectors = spark.createDataFrame([(i + 1, v) for i, v in enumerate(x[:597])] + odd, "review_id long, text_embedding array<float>")
    vectors = vectors.unionByName(vectors.filter("review_id = 5")).withColumn("org_id", F.lit("111"))
    stored = VectorClusters(spark, f"{tmp_path}/v", 12).create(vectors)
    assert ODD in stored.widths
    for query in (centres[3].tolist(), (-centres[0]).tolist(), dice.normal(size=8).tolist()):
        for kind in ({"limit": 7}, {"limit": 5, "stars": "2-3"}, {"limit": 700}):
            got, read = stored.search(rows, query, **kind)
            want = similarity.semantic_search(rows, vectors, query, **kind)
            assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
    _, read = stored.search(rows, centres[3].tolist(), limit=7)
    assert len(read) <= 4 < len(stored.widths)
    assert stored.search(rows, [0.0] * 8, limit=3)[0].count() == 3
    assert stored.search(rows, [1.0, 1.0], limit=3)[0].count() <= 3
    assert stored.search(rows, centres[3].tolist(), limit=0)[0].count() == 0
    none = VectorClusters(spark, f"{tmp_path}/n", 4).create(vectors.limit(0))
    assert none.search(rows, centres[3].tolist())[0].count() == 0
