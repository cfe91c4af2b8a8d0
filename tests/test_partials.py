"""Statistics from partial sums against the same statistics from reviews."""

import random

from build import bag, batch, companies, reviews
from pyspark.sql import functions as F

from starfold.operators import ingest, partials, summary
from starfold.sources.store import Store

ORDER = ("seq",)


def several_batches(seed):
    dice = random.Random(seed)
    out = []
    for _ in range(4):
        rows = []
        for _ in range(dice.randrange(1, 25)):
            n = dice.randrange(30)
            rows.append({
                "review_url": f"u{n}", "org_id": dice.choice(["111", "222", "333"]),
                "date": dice.choice([None, "2025-01-05", "2025-01-05T23:30:00-05:00", "2024-12-30", "soon", f"2025-0{1 + n % 9}-11"]),
                "stars": dice.choice([None, 1.0, 2.5, 3.0, 5.0]), "text": dice.choice([None, "", "some"]),
                "business_response": dice.choice([None, "", "thanks"]),
            })
        out.append(rows)
    return out


def test_signed_partials_follow_every_upsert(spark):
    orgs = companies(spark, *[{"org_id": o, "name": o, "rating": 4.0} for o in ("111", "222", "333", "444")])
    for seed in (1, 2):
        current = reviews(spark).withColumn("id", F.col("id"))
        parts = None
        for rows in several_batches(seed):
            reduced = ingest.reduce_batch(batch(spark, *rows), ORDER)
            delta = partials.of_batch(current, reduced)
            parts = delta if parts is None else parts.unionByName(delta)
            current = spark.createDataFrame(ingest.merge_reduced(current, reduced).collect(), current.schema)
        parts = spark.createDataFrame(parts.collect(), parts.schema)
        assert bag(partials.org_stats(orgs, parts)) == bag(summary.org_stats(orgs, current))
        assert bag(partials.star_histogram(orgs, parts)) == bag(summary.star_histogram(orgs, current))
        for period in ("month", "week", "quarter"):
            assert bag(partials.trends(parts, period)) == bag(summary.trends(current, period))
        assert bag(partials.trends(parts, "month", limit=1)) == bag(summary.trends(current, "month", limit=1))
        assert bag(partials.review_totals(parts)) == bag(summary.review_totals(current))
        # merged in any grouping they say the same
        merged = partials.merge(partials.merge(parts.filter("reviews > 0")).unionByName(parts.filter("reviews <= 0")))
        assert bag(partials.org_stats(orgs, merged)) == bag(partials.org_stats(orgs, parts))
        assert bag(partials.from_reviews(current).groupBy("org_id").agg(F.sum("reviews"), F.sum("texts"), F.sum("responded"))) == bag(
            parts.groupBy("org_id").agg(F.sum("reviews"), F.sum("texts"), F.sum("responded")))


def test_a_changed_star_moves_and_an_unchanged_row_counts_once(spark):
    one = reviews(spark, {"review_url": "a", "stars": 2.0})
    again = ingest.reduce_batch(batch(spark, {"review_url": "a", "stars": 4.0}), ORDER)
    delta = {(r["star"], r["reviews"]) for r in partials.of_batch(one, again).collect()}
    assert delta == {(2.0, -1), (4.0, 1)}
    same = ingest.reduce_batch(batch(spark, {"review_url": "a", "stars": 2.0}), ORDER)
    assert [r["reviews"] for r in partials.of_batch(one, same).collect()] == [0]
    assert partials.of_batch(one, same.limit(0)).count() == 0


def test_changes_of_a_merge_give_the_same_partials_and_counts(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=2)
    for number, rows in enumerate(several_batches(3)):
        reduced = ingest.reduce_batch(batch(spark, *rows), ORDER)
        known = store.read("reviews")
        store.merge_reviews(reduced, ("s", number))
        changed = store.changes(("s", number))
        assert bag(partials.of_changes(changed)) == bag(partials.of_batch(known, reduced))
        # an org is charged with the rows that named it, also where the review belongs to another one
        want = ingest._counts(reduced.join(known.select("review_key", F.lit(1).alias("_known")), "review_key", "left"), ["org_id"])
        assert bag(ingest.counts_of_changes(changed)) == bag(want)
    assert bag(store.changes(("s", 0)), "review_key") == bag(
        ingest.reduce_batch(batch(spark, *several_batches(3)[0]), ORDER), "review_key")


def test_reports_read_partials_alone(spark, tmp_path):
    parts = partials.from_reviews(reviews(spark, {"review_url": "a"}))
    parts.write.parquet(f"{tmp_path}/p")
    stored = spark.read.schema(partials.SCHEMA).parquet(f"{tmp_path}/p")
    for report in (partials.trends(stored), partials.review_totals(stored)):
        plan = report._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "text#" not in plan
