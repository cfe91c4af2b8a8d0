from build import bag, companies, reviews, rows
from pyspark.sql import functions as F

from starfold.operators import listing, summary


def _four(spark):
    return reviews(
        spark,
        {"stars": 5.0, "review_url": "r/1", "business_response": "Thanks"},
        {"stars": 4.0, "text": ""},
        {"stars": 3.0},
        {"stars": 1.0, "text": None},
    )


def test_org_stats(spark):
    orgs = companies(spark, {"org_id": "111", "name": "Biz", "rating": 4.5}, {"org_id": "none"})
    out = {r.org_id: r for r in summary.org_stats(orgs, _four(spark)).collect()}
    a, b = out["111"], out["none"]
    assert (a.total_reviews, a.avg_stars, a.response_rate, a.reviews_with_text) == (4, 3.25, 0.25, 2)
    assert (a.name, a.rating, a.first_date, a.last_date) == ("Biz", 4.5, "2025-06-01", "2025-06-01")
    assert (b.total_reviews, b.avg_stars, b.response_rate, b.reviews_with_text) == (0, 0, 0, 0)
    assert b.first_date is None and b.last_date is None


def test_empty_response_counts_as_response(spark):
    df = reviews(spark, {"business_response": ""}, {})
    orgs = companies(spark, {"org_id": "111"})
    assert summary.org_stats(orgs, df).first().response_rate == 0.5
    assert rows(listing.unanswered(df), "id") == [(2,)]


def test_histogram(spark):
    orgs = companies(spark, {"org_id": "111"}, {"org_id": "none"})
    out = summary.star_histogram(orgs, _four(spark))
    assert dict(rows(out.filter("org_id = '111'"), "star", "review_count")) == {1: 1, 2: 0, 3: 1, 4: 1, 5: 1}
    assert dict(rows(out.filter("org_id = 'none'"), "star", "review_count")) == dict.fromkeys(range(1, 6), 0)
    odd = reviews(spark, {"stars": 4.5}, {"stars": 0.0}, {"stars": None})
    got = dict(rows(summary.star_histogram(orgs, odd).filter("org_id = '111'"), "star", "review_count"))
    assert got == {0: 1, 1: 0, 2: 0, 3: 0, 4: 0, 5: 1, None: 1}


def test_since(spark):
    df = reviews(
        spark, {"stars": 5.0, "date": "2025-01-01"}, {"stars": 3.0, "date": "2025-06-01"},
        {"stars": 4.0, "date": "2025-07-01"}, {"stars": 1.0, "date": None},
    )
    out = summary.org_stats(companies(spark, {"org_id": "111"}), df, since="2025-06-01").first()
    assert (out.total_reviews, out.avg_stars) == (2, 3.5)


def _trend(spark):
    return reviews(
        spark, {"stars": 5.0, "date": "2025-01-15"}, {"stars": 4.0, "date": "2025-01-20"},
        {"stars": 3.0, "date": "2025-02-10"}, {"stars": 2.0, "date": "2025-03-05"},
    )


def test_trends(spark):
    out = rows(summary.trends(_trend(spark), "month"), "period", "review_count", "avg_stars")
    assert out == [("2025-03", 1, 2.0), ("2025-02", 1, 3.0), ("2025-01", 2, 4.5)]
    assert rows(summary.trends(_trend(spark), "quarter"), "period", "review_count") == [("2025-Q1", 4)]
    assert [p for p, in rows(summary.trends(_trend(spark), "week"), "period")] == [
        "2025-W09", "2025-W06", "2025-W03", "2025-W02"]
    assert len(rows(summary.trends(_trend(spark), "month", limit=2), "period")) == 2
    assert rows(summary.trends(_trend(spark), since="2025-02-01", limit=1), "period") == [("2025-03",)]


def test_trends_keep_unreadable_dates(spark):
    df = reviews(spark, {"date": "soon"}, {"date": "2025-01-01", "stars": None}, {"date": None})
    assert rows(summary.trends(df), "period", "review_count", "avg_stars") == [
        ("2025-01", 1, None), (None, 1, 5.0)]


def test_search(spark):
    df = reviews(
        spark, {"text": "Great coffee and atmosphere"}, {"text": "Terrible service"},
        {"text": "Amazing coffee selection", "org_id": "222"},
    )
    assert listing.search_text(df, "coffee").count() == 2
    assert rows(listing.search_text(df, "COFFEE", org_id="222"), "org_id") == [("222",)]
    assert listing.search_text(df, "pizza").count() == 0
    assert listing.search_text(df, "coffee", limit=0).count() == 0


def test_star_ranges(spark):
    df = _four(spark)
    count = lambda s: listing.list_reviews(df, stars=s).count()
    assert [count(s) for s in ("1-3", "5", "x", "1-x", None)] == [2, 1, 0, 0, 4]


def test_listing_order_and_limits(spark):
    df = reviews(
        spark, {"date": None}, {"date": "2025-01-01"}, {"date": "2025-03-01"}, {"date": "2025-03-01"},
        {"date": "2024-01-01", "org_id": "222"},
    )
    assert rows(listing.list_reviews(df, org_id="111"), "id") == [(3,), (4,), (2,), (1,)]
    assert rows(listing.list_reviews(df, limit=2), "org_id", "id") == [("111", 3), ("111", 4), ("222", 5)]


def test_large_limits_keep_every_row(spark, monkeypatch):
    df = reviews(spark, *[{"date": f"2025-01-{1 + i % 28:02d}", "org_id": "ab"[i % 3 == 0]} for i in range(60)])
    want = bag(listing.list_reviews(df, limit=17), "id")
    monkeypatch.setattr(listing, "PRUNED_RANK", 5)
    assert bag(listing.list_reviews(df, limit=17), "id") == want and len(want) == 34


def test_stats_do_not_read_texts_when_a_flag_is_stored(spark, tmp_path):
    df = _four(spark).withColumn("has_text", F.expr("text <> ''"))
    df.write.parquet(str(tmp_path / "r"))
    stored = spark.read.parquet(str(tmp_path / "r"))
    out = summary.org_stats(companies(spark, {"org_id": "111"}), stored)
    assert out.first().reviews_with_text == 2
    scan = [l for l in out._jdf.queryExecution().toString().splitlines() if "ReadSchema" in l][-1]
    assert "has_text" in scan and "text:string" not in scan.replace("has_text", "")


def test_digest(spark):
    df = reviews(
        spark, {"text": "x" * 250, "date": "2025-06-01T10:00:00", "business_response": "y" * 201},
        {"business_response": "", "text": None},
    )
    out = bag(listing.digest(df, responses=True), "id", "date", "text", "has_response", "response")
    assert out == [
        (1, "2025-06-01", "x" * 200 + "…", True, "y" * 200 + "…"), (2, "2025-06-01", None, True, None)]
    assert "response" not in listing.digest(df).columns
    assert listing.digest(df, shorten=False).filter(F.length("text") == 250).count() == 1


def test_companies_and_competitors(spark):
    orgs = companies(
        spark, {"org_id": "1", "name": "B", "role": "mine"}, {"org_id": "2", "name": "Z", "role": "competitor"},
        {"org_id": "3", "name": "A", "role": "competitor"},
    )
    rel = spark.createDataFrame([("1", "2"), ("1", "3")], "company_org_id string, competitor_org_id string")
    assert rows(listing.list_companies(orgs), "name") == [("A",), ("B",), ("Z",)]
    assert rows(listing.list_companies(orgs, "mine"), "org_id") == [("1",)]
    assert rows(listing.competitors_of(orgs, rel, "1"), "org_id") == [("3",), ("2",)]
    assert rows(listing.competitors_of(orgs, rel, "2"), "org_id") == []
    df = reviews(spark, {"stars": 4.0}, {"stars": 5.0}, org="2")
    out = summary.compare(orgs, rel, df, "1").orderBy("rank")
    assert rows(out, "rank", "org_id", "reviews_in_db", "avg_stars") == [
        (0, "1", 0, None), (1, "3", 0, None), (2, "2", 2, 4.5)]


def test_sync_status_defaults(spark):
    from starfold import schemas

    orgs = companies(spark, {"org_id": "111", "name": "A"}, {"org_id": "222", "name": "B"})
    log = spark.createDataFrame(
        [(1, "111", "full", 50, 0, "s", "2025-01-01T08:05:00Z", "ok", None),
         (2, "111", "incremental", 1, 0, "s", "2025-01-02T08:05:00Z", "error", "boom")],
        schemas.SYNC_LOG)
    assert rows(summary.sync_status(orgs, _four(spark), log), "org_id", "reviews_in_db", "last_sync",
                "last_sync_type", "last_status") == [
        ("111", 4, "2025-01-02T08:05:00Z", "incremental", "error"), ("222", 0, "never", "—", "—")]


def test_plans_stay_in_the_jvm_and_push_filters(spark, tmp_path):
    _four(spark).write.parquet(str(tmp_path / "r"))
    df = spark.read.parquet(str(tmp_path / "r"))
    plan = listing.unanswered(df, org_id="111", since="2025-01-01")._jdf.queryExecution().toString()
    assert "EqualTo(org_id,111)" in plan and "GreaterThanOrEqual(date,2025-01-01)" in plan
    assert "TakeOrderedAndProject" in plan and "Python" not in plan
    plan = listing.unanswered(df)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
