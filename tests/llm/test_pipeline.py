"""The pipeline: columns, what each stage keeps, odd tables, and the registered names."""

import os

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from starfold.llm import decontaminate, mixture, setjoin
from starfold.llm.common import keep, table

PATH = "/root/testdata/sf0.01"
given = pytest.mark.skipif(not os.path.isdir(PATH), reason="generated tables not present")


def test_all_queries_and_the_pipeline_are_registered():
    names = set(contract.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 14)}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "decontamination", "mixture", "token_files"]


#: Columns of documents that bear names the stages use themselves.
CLASHING = ["token", "h", "row", "id", "sid", "set", "spans", "items", "n_words", "k1", "_dc_words", "_dc_spans", "_tox_score", "_tox_score_", "_drop"]


@given
def test_stages_in_their_order(spark):
    docs = table(spark, PATH, "documents")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(keep(stage(spark, seen[-1], PATH), name))
    assert all(s.columns == columns for s in seen[:-1])
    ids = [{r[0] for r in s.select("doc_id").collect()} for s in seen]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    toxic = {r["doc_id"] for r in table(spark, PATH, "labels").filter("toxic = 1").collect()}
    assert len(ids[0] & toxic) > 2 * len(ids[1] & toxic) and len(ids[1]) >= 0.9 * len(ids[0] - toxic)
    assert seen[2].count() == len(ids[2])
    firsts = {r["component_id"] for r in setjoin.groups(seen[1]).collect()}
    assert ids[2] == firsts
    foul = decontaminate.digest(decontaminate.scan(seen[2].select("doc_id", "text"), table(spark, PATH, "benchmark")))
    assert ids[3] == {r["doc_id"] for r in foul.filter("NOT contaminated").collect()} and len(ids[3]) < len(ids[2])
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixture.digest(seen[3]).collect() if r["size"]}
    times = {r["doc_id"]: r["count"] for r in seen[4].groupBy("doc_id").count().collect()}
    assert times == {i: n for i, n in taken.items() if n}
    assert seen[5].count() == seen[4].count()


def test_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "some words here", None, None, 15), (2, "some words here", None, None, 15),
            (3, "x " * 30_000, "en", "a", 60_000)]
    for name, frame in {
        "labels": spark.createDataFrame([(2, None, None)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(None, None)], "item_id long, text string"),
    }.items():
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    for part in (rows, []):
        docs = spark.createDataFrame(part, schema).selectExpr("*", *[f"{i} AS {c}" for i, c in enumerate(CLASHING)])
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = keep(stage(spark, docs, str(tmp_path)), "stage")
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *CLASHING]
        out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert {r["doc_id"] for r in out} == ({2, 3} if part else set())
