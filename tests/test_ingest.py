import random

import pytest
from build import bag, batch, companies, reviews, rows
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from starfold import schemas
from starfold.operators import configdoc, ingest, integrity, normalize


def _counts(current, new):
    return tuple(ingest.upsert_counts(current, new).first())


def test_upsert_adds_then_updates(spark):
    first = batch(
        spark, {"review_url": "r/1", "text": "Great!", "likes": 2},
        {"review_url": "r/2", "text": "Good", "stars": 4.0, "business_response": "Thanks"},
    )
    empty = schemas.empty(spark, "reviews")
    assert _counts(empty, first) == (2, 0)
    table = ingest.upsert_reviews(empty, first, ["seq"])
    again = batch(spark, {"review_url": "r/1", "text": "Updated text!", "likes": 5, "dislikes": 1,
                          "author_name": "Other", "date": "2030-01-01"})
    assert _counts(table, again) == (0, 1)
    out = {r.review_key: r for r in ingest.upsert_reviews(table, again, ["seq"]).collect()}
    r = out["r/1"]
    assert (r.text, r.likes, r.dislikes, r.author_name, r.date) == ("Updated text!", 5, 1, "Test", "2025-06-01")
    assert out["r/2"].business_response == "Thanks" and len(out) == 2


def test_repeats_inside_a_batch(spark):
    new = batch(
        spark, {"review_url": "k", "author_name": "first", "text": "one"},
        {"review_url": "k", "author_name": "second", "text": None}, {"review_url": "other"},
    )
    empty = schemas.empty(spark, "reviews")
    assert _counts(empty, new) == (2, 1)
    r = ingest.upsert_reviews(empty, new, ["seq"]).filter("review_key = 'k'").first()
    assert (r.author_name, r.text) == ("first", None)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10**6))
def test_any_split_gives_the_same_table(spark, seed):
    rng = random.Random(seed)
    feed = batch(spark, *[
        {"review_url": f"r/{rng.randrange(6)}", "text": f"t{i}", "stars": float(rng.randrange(1, 6)),
         "author_name": f"a{i}", "business_response": rng.choice([None, "x"])}
        for i in range(20)])
    empty = schemas.empty(spark, "reviews")
    whole = ingest.upsert_reviews(empty, feed, ["seq"])
    cut = rng.randrange(21)
    early = ingest.upsert_reviews(empty, feed.filter(F.col("seq") <= cut), ["seq"])
    split = ingest.upsert_reviews(early, feed.filter(F.col("seq") > cut), ["seq"])
    columns = ["review_key", "author_name", "text", "stars", "business_response"]
    assert bag(whole, *columns) == bag(split, *columns)


def test_company_merge(spark):
    cur = companies(spark, {"org_id": "111", "name": "Test Biz", "rating": 4.5, "review_count": 100,
                            "categories": ["a"], "role": "mine"})
    inc = spark.createDataFrame([("111", None, 4.8), ("222", "New", None)], "org_id string, name string, rating double")
    out = {r.org_id: r for r in ingest.upsert_companies(cur, inc).collect()}
    assert (out["111"].name, out["111"].rating, out["111"].review_count, out["111"].role) == (
        "Test Biz", 4.8, 100, "tracked")
    assert out["111"].categories == ["a"] and out["222"].role == "tracked"


def test_relations(spark):
    orgs = companies(spark, *[{"org_id": o} for o in "123"])
    none = schemas.empty(spark, "company_relations")
    pairs = spark.createDataFrame([("1", "2"), ("1", "3"), ("1", "2"), ("1", "ghost")], "company_org_id string, competitor_org_id string")
    once = ingest.add_relations(none, pairs, orgs)
    key = ["company_org_id", "competitor_org_id"]
    assert bag(once, *key) == [("1", "2"), ("1", "3")]
    assert bag(ingest.add_relations(once, pairs, orgs), *key) == bag(once, *key)
    new = spark.createDataFrame([("1", "2", 9, "Closest")], "company_org_id string, competitor_org_id string, priority int, notes string")
    up = ingest.upsert_relations(once, new, orgs)
    assert bag(up, *key, "priority", "notes") == [("1", "2", 9, "Closest"), ("1", "3", None, None)]
    left = ingest.remove_relations(up, new)
    assert bag(left, *key) == [("1", "3")]


def test_remove_orgs_cascades(spark):
    revs = reviews(spark, {}, {"org_id": "222"})
    tables = {
        "companies": companies(spark, {"org_id": "111"}, {"org_id": "222"}),
        "company_relations": spark.createDataFrame([("111", "222"), ("222", "111")], "company_org_id string, competitor_org_id string"),
        "reviews": revs,
        "review_embeddings": spark.createDataFrame([(1, [0.0]), (2, [0.0])], "review_id bigint, text_embedding array<float>"),
        "topic_templates": spark.createDataFrame([(10, "111"), (20, "222")], "id bigint, org_id string"),
        "review_topics": spark.createDataFrame([(1, 10), (2, 20), (2, 10)], "review_id bigint, topic_id bigint"),
        "company_scores": spark.createDataFrame([("111", 10), ("222", None)], "org_id string, topic_id bigint"),
    }
    left = ingest.remove_orgs(tables, companies(spark, {"org_id": "111"}))
    assert {n: df.count() for n, df in left.items()} == {
        "companies": 1, "company_relations": 0, "reviews": 1, "review_embeddings": 1,
        "topic_templates": 1, "review_topics": 1, "company_scores": 1}


def test_sync_log(spark):
    log = schemas.empty(spark, "sync_log")
    assert ingest.last_sync(log).count() == 0
    row = spark.createDataFrame(
        [(1, "111", "full", 50, 0, "2025-01-01T08:00:00Z", "2025-01-01T08:05:00Z", "ok")],
        "seq bigint, org_id string, sync_type string, reviews_added bigint, reviews_updated bigint, "
        "started_at string, finished_at string, status string")
    log = ingest.append_sync(log, row)
    assert rows(ingest.last_sync(log), "org_id", "reviews_added", "error_message") == [("111", 50, None)]
    orgs = companies(spark, {"org_id": "111"}, {"org_id": "222"})
    assert bag(ingest.sync_mode(orgs, log)) == [("111", "incremental"), ("222", "full")]
    assert bag(ingest.sync_mode(orgs, log, force_full=True)) == [("111", "full"), ("222", "full")]


def _config(spark):
    return spark.createDataFrame([
        (0, "111", "Mine", "mine", None, [("222", 9, "Closest")],
         [("Цены", ["Наценка", "Стоимость"]), ("Качество", ["Ремонт"])], None),
        (1, "222", "Other", "competitor", "auto_service", None, None, True),
        (2, "333", "Cafe", "tracked", "cafe", None, None, True),
        (3, "444", "Bad", "owner", None, None, None, None),
    ], schemas.CONFIG_COMPANY)


def test_config_document(spark):
    config = configdoc.inherit_topics(configdoc.accepted(_config(spark)))
    assert bag(configdoc.rejected(_config(spark)), "org_id", "role") == [("444", "owner")]
    assert bag(configdoc.company_rows(config), "org_id", "service_type") == [
        ("111", "auto_service"), ("222", "auto_service"), ("333", "cafe")]
    assert bag(configdoc.relation_rows(config)) == [("111", "222", 9, "Closest")]
    assert bag(configdoc.topic_counts(config), "org_id", "parent_topics", "all_topics") == [
        ("111", 2, 5), ("222", 2, 5), ("333", 0, 0)]
    topics = configdoc.topic_rows(config)
    assert topics.count() == 10 == topics.select("id").distinct().count()
    mine = rows(topics.filter("org_id = '111'").orderBy("position"), "name")
    assert [n for n, in mine] == ["Цены", "Наценка", "Стоимость", "Качество", "Ремонт"]


def test_repeated_topic_names_stay_apart(spark):
    config = spark.createDataFrame(
        [(0, "1", "n", "mine", None, None, [("A", ["x", "x"]), ("A", ["x"])], None)], schemas.CONFIG_COMPANY)
    topics = configdoc.topic_rows(configdoc.accepted(config))
    assert topics.count() == 5 == topics.select("id").distinct().count()


def test_replacing_topics_keeps_vectors(spark):
    listed = configdoc.inherit_topics(configdoc.accepted(_config(spark)))
    none = schemas.empty(spark, "topic_templates")
    once = ingest.replace_topics(none, configdoc.topic_rows(listed), listed)
    with_vectors = once.withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    again = ingest.replace_topics(with_vectors, configdoc.topic_rows(listed), listed)
    assert bag(again) == bag(with_vectors)
    fewer = listed.withColumn("topics", F.when(F.col("org_id") != "111", F.col("topics")))
    left = ingest.replace_topics(with_vectors, configdoc.topic_rows(fewer), listed)
    assert left.filter("org_id = '111'").count() == 0 and left.filter("org_id = '222'").count() == 5


def test_normalize(spark):
    raw = spark.createDataFrame([
        ("111", " Ann\n", 'x: url("http://a/i.png")', "http://p/user/abc/", "2025-06-01", True, "4,5", None,
         None, "  body ", [("Лайк", "3"), ("Дизлайк", "x")], ""),
        ("111", "", "none", "/", None, False, None, ["s _full", "s _half", "s _empty", None],
         "spoiler", "body", [("Дизлайк", "2")], " thanks "),
        ("111", None, None, None, None, True, None, ["s _full"], None, None, None, None),
    ], schemas.RAW_REVIEW)
    a, b, c = normalize.normalize_reviews(raw.coalesce(1)).collect()
    assert (a.author_name, a.author_icon_url, a.stars, a.text, a.likes, a.dislikes) == (
        "Ann", "http://a/i.png", 4.5, "body", 3, 0)
    assert a.review_url.endswith("/org/111/reviews?reviews%5BpublicId%5D=abc&utm_source=review")
    assert a.business_response is None
    assert (b.author_name, b.author_icon_url, b.stars, b.text, b.likes, b.dislikes) == (
        None, None, 2.5, "spoiler", 0, 2)
    assert b.review_url is None and b.business_response == "thanks"
    assert (c.stars, c.text, c.likes, c.review_url) == (0.0, None, 0, None)


def test_normalize_companies(spark):
    raw = spark.createDataFrame(
        [("1", " A ", "4,7", "120 reviews", " ", [" x ", "", None]), ("2", None, None, None, None, None)],
        schemas.RAW_COMPANY)
    out = normalize.normalize_companies(raw)
    assert [tuple(r) for r in out.orderBy("org_id").collect()] == [
        ("1", "A", 4.7, 120, None, ["x"]), ("2", None, None, None, None, [])]
    found = spark.createDataFrame([("1",), ("2",), ("2",)], "org_id string")
    assert bag(normalize.total_counts(out, found)) == [("1", 120), ("2", 2)]


def test_integrity(spark):
    tables = {
        "companies": companies(spark, {"org_id": "111"}, {"org_id": "111"}),
        "reviews": reviews(spark, {"review_url": "k"}, {"review_url": "k", "org_id": "x"}),
    }
    assert bag(integrity.orphans(tables)) == [("reviews", "org_id", "x", 1)]
    assert bag(integrity.repeated_keys(tables)) == [("companies", "111", 2), ("reviews", "k", 2)]


def test_null_topic_rows_are_replaced(spark):
    cur = schemas.conform(spark.createDataFrame(
        [("1", None, 5.0, 1, "low"), ("1", 7, 6.0, 1, "low")],
        "org_id string, topic_id bigint, score double, review_count bigint, confidence string"), schemas.SCORES)
    new = cur.filter("topic_id IS NULL").withColumn("score", F.lit(9.0))
    assert bag(ingest.upsert_scores(cur, new), "topic_id", "score") == [(7, 6.0), (None, 9.0)]


def test_unknown_fold_is_refused(spark):
    from starfold.functions.text import contains_caseless

    with pytest.raises(ValueError):
        contains_caseless(F.col("x"), "q", "none")


def test_config_file(spark, tmp_path):
    path = tmp_path / "config.json"
    path.write_text("""{"companies": [
      {"org_id": 111, "name": "Mine", "role": "mine", "competitors": [{"org_id": "222", "priority": 9}],
       "topics": [{"name": "Price", "subtopics": ["Markup", "Cost"]}]},
      {"org_id": "222", "name": "Other", "role": "competitor", "topics": "inherit"},
      {"org_id": "333", "name": "None", "role": "tracked", "service_type": "cafe"}]}""")
    config = configdoc.inherit_topics(configdoc.accepted(configdoc.read_document(spark, str(path))))
    assert bag(configdoc.topic_counts(config), "org_id", "parent_topics", "all_topics") == [
        ("111", 1, 3), ("222", 1, 3), ("333", 0, 0)]
    assert bag(configdoc.relation_rows(config)) == [("111", "222", 9, None)]
    path.write_text("{}")
    with pytest.raises(Exception, match="companies"):
        configdoc.read_document(spark, str(path)).collect()


def test_database_rows(spark):
    from starfold.functions import vectors as vec
    from starfold.sources.database import adopt

    vector = F.array(F.lit(0.5), F.lit(-2.0)).cast("array<float>")
    one = spark.range(1).select(F.lit(7).alias("review_id"), F.lit("m").alias("model"), F.lit("2025-01-01").alias("created_at"))
    blob = adopt("review_embeddings", one.withColumn("text_embedding", vec.encode_f32(vector)))
    text = adopt("review_embeddings", one.withColumn("text_embedding", F.lit("[0.5,-2]")))
    for df in (blob, text):
        r = df.first()
        assert (r.review_id, r.text_embedding, r.response_embedding) == (7, [0.5, -2.0], None)
        assert df.schema.fieldNames() == schemas.REVIEW_VECTORS.fieldNames()
    orgs = spark.createDataFrame([("1", '["a","b"]', "mine")], "org_id string, categories string, role string")
    assert adopt("companies", orgs).first().categories == ["a", "b"]
    tops = spark.createDataFrame([(5, "1", "n")], "id int, org_id string, name string")
    assert adopt("topic_templates", tops).first().position == 5


def test_vectors_are_replaced_by_id(spark):
    cur = schemas.conform(spark.createDataFrame([(1, "m", [1.0]), (2, "m", [2.0])], "review_id bigint, model string, text_embedding array<float>"), schemas.REVIEW_VECTORS)
    new = spark.createDataFrame([(2, "n", [9.0]), (3, "n", [3.0])], "review_id bigint, model string, text_embedding array<float>")
    assert bag(ingest.save_vectors(cur, new), "review_id", "model", "text_embedding") == [
        (1, "m", [1.0]), (2, "n", [9.0]), (3, "n", [3.0])]


def test_malformed_topics_leave_stored_topics_alone(spark):
    texts = spark.createDataFrame([(
        '{"companies": [{"org_id": "1", "name": "A", "role": "mine", "topics": "oops"},'
        ' {"org_id": "2", "name": "B", "role": "mine", "topics": {"name": "x"}},'
        ' {"org_id": "3", "name": "C", "role": "mine", "topics": [{"name": "P", "subtopics": ["s"]}]},'
        ' {"org_id": "4", "name": "D", "role": "mine"}, {"org_id": "5", "name": "E", "role": "owner"}]}',)], "t string")
    config = configdoc.parse_documents(texts)
    assert bag(configdoc.rejected(config), "org_id", "reason") == [("1", "topics"), ("2", "topics"), ("5", "role")]
    stated = configdoc.with_topics(configdoc.inherit_topics(configdoc.accepted(config)))
    stored = schemas.conform(spark.createDataFrame(
        [(k, str(k), None, "old", 0) for k in range(1, 5)],
        "id bigint, org_id string, parent_id bigint, name string, position bigint"), schemas.TOPICS)
    left = ingest.replace_topics(stored, configdoc.topic_rows(stated), stated)
    assert bag(left, "org_id", "name") == [("1", "old"), ("2", "old"), ("3", "P"), ("3", "s")]


def test_relations_keep_their_creation_time(spark):
    orgs = companies(spark, *[{"org_id": o} for o in "123"])
    pairs = spark.createDataFrame([("1", "2"), ("1", "ghost"), ("ghost", "2"), ("1", "ghost")], "company_org_id string, competitor_org_id string")
    assert bag(ingest.rejected_relations(pairs, orgs)) == [("1", "ghost"), ("ghost", "2")]
    old = schemas.conform(pairs.limit(1), schemas.RELATIONS).withColumn("created_at", F.lit("2020-01-01 00:00:00").cast("timestamp"))
    new = spark.createDataFrame([("1", "2", 3, "n"), ("1", "3", 4, "m")], "company_org_id string, competitor_org_id string, priority int, notes string")
    up = ingest.upsert_relations(old, new, orgs).select("competitor_org_id", F.year("created_at").alias("y"))
    got = dict(rows(up, "competitor_org_id", "y"))
    assert got["2"] == 2020 and got["3"] > 2020
    added = ingest.add_relations(schemas.empty(spark, "company_relations"), pairs, orgs)
    assert added.filter("created_at IS NULL").count() == 0


def test_star_bounds_start_with_a_number(spark):
    from starfold.operators.listing import parse_star_range

    assert parse_star_range("1-3★") == (1.0, 3.0) and parse_star_range("4stars") == (4.0, 4.0)
    assert parse_star_range("1_0") == (1.0, 1.0) and parse_star_range(".5-1e0x") == (0.5, 1.0)
    low, high = parse_star_range("-2")
    assert low != low and high == 2.0
