"""Descriptive statistics of all orgs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starfold.functions import calendar as cal
from starfold.functions import numbers as nm
from starfold.functions import text as tx
from starfold.operators.ingest import last_sync
from starfold.operators.listing import filter_reviews

# Placeholders of the status report, buckets always shown by the histogram.
NEVER = "never"
DASH = "—"
STAR_BUCKETS = (1, 2, 3, 4, 5)


def org_stats(companies: DataFrame, reviews: DataFrame, since: str | None = None) -> DataFrame:
    """Totals of every company: reviews, mean stars, response rate, texts, first and last date.

    A company without reviews keeps its row: zeros, and no period.
    """
    one = F.lit(1)
    agg = filter_reviews(reviews, since=since).groupBy("org_id").agg(
        F.count(one).alias("n"),
        F.avg("stars").alias("mean"),
        F.count("business_response").alias("responded"),
        F.count(F.when(tx.has_text(reviews), one)).alias("texts"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )
    zero = F.lit(0).cast("bigint")
    return companies.select("org_id", "name", "rating").join(agg, "org_id", "left").select(
        "org_id",
        "name",
        "rating",
        F.coalesce("n", zero).alias("total_reviews"),
        nm.round_half_up(F.coalesce("mean", F.lit(0.0)), 2).alias("avg_stars"),
        F.coalesce(nm.round_half_up(F.col("responded") / F.col("n"), 2), F.lit(0.0)).alias("response_rate"),
        F.coalesce("texts", zero).alias("reviews_with_text"),
        "first_date",
        "last_date",
    )


def star_histogram(companies: DataFrame, reviews: DataFrame, since: str | None = None) -> DataFrame:
    """Reviews per company and whole star. Stars 1 to 5 always have a row, others where they occur.

    Reviews without stars are counted under a NULL star.
    """
    found = (
        filter_reviews(reviews, since=since)
        .groupBy("org_id", nm.star_bucket(F.col("stars")).alias("star"))
        .agg(F.count(F.lit(1)).alias("review_count"))
    )
    orgs = companies.select("org_id")
    shown = orgs.select(
        "org_id",
        F.explode(F.array(*[F.lit(s) for s in STAR_BUCKETS])).alias("star"),
        F.lit(0).cast("bigint").alias("review_count"),
    )
    return (
        shown.unionByName(found.join(orgs, "org_id", "left_semi"))
        .groupBy("org_id", "star")
        .agg(F.sum("review_count").alias("review_count"))
    )


def trends(
    reviews: DataFrame,
    period: str = "month",
    org_id: str | None = None,
    since: str | None = None,
    limit: int | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Reviews and mean stars per org and period, newest first; ``limit`` counts periods per org.

    Reviews without a date are left out; dates that cannot be read form a NULL period.
    """
    label = cal.PERIOD_LABELS[period](F.col("_day"))
    dated = filter_reviews(reviews, org_id, since).filter(F.col("date").isNotNull())
    out = (
        dated.select("org_id", "stars", cal.utc_day(F.col("date")).alias("_day"))
        # days are few: stars are summed per day, and the day is read once per row
        .groupBy("org_id", "_day")
        .agg(F.count(F.lit(1)).alias("c"), F.sum("stars").alias("s"), F.count("stars").alias("n"))
        .groupBy("org_id", label.alias("period"))
        .agg(F.sum("c").alias("review_count"), F.round(F.sum("s") / F.nullif(F.sum("n"), F.lit(0).cast("bigint")), 2).alias("avg_stars"))
    )
    newest = F.col("period").desc_nulls_last()
    if limit is not None:
        rank = F.row_number().over(Window.partitionBy("org_id").orderBy(newest))
        out = out.withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank")
    return out.orderBy("org_id", newest) if ordered else out


def review_totals(reviews: DataFrame) -> DataFrame:
    """Number of reviews and plain mean of stars per org."""
    return reviews.groupBy("org_id").agg(
        F.count(F.lit(1)).alias("reviews_in_db"), F.avg("stars").alias("avg_stars")
    )


def compare(
    companies: DataFrame, relations: DataFrame, reviews: DataFrame, org_id: str | None = None
) -> DataFrame:
    """Each company followed by its competitors by name, with stored and counted figures.

    ``rank`` is 0 for the company itself and counts its competitors from 1.
    """
    if org_id is not None:
        companies_in = companies.filter(F.col("org_id") == org_id)
        relations = relations.filter(F.col("company_org_id") == org_id)
    else:
        companies_in = companies
    own = companies_in.select(F.col("org_id").alias("company_org_id"), "org_id", F.lit(0).alias("side"))
    others = relations.select(
        "company_org_id", F.col("competitor_org_id").alias("org_id"), F.lit(1).alias("side")
    ).join(companies_in.select(F.col("org_id").alias("company_org_id")), "company_org_id", "left_semi")
    place = Window.partitionBy("company_org_id").orderBy("side", "name", "org_id")
    listed = own.unionByName(others)
    if org_id is not None:
        reviews = reviews.join(listed.select("org_id").distinct(), "org_id", "left_semi")
    return (
        listed
        .join(companies.select("org_id", "name", "rating", "review_count"), "org_id")
        .join(review_totals(reviews), "org_id", "left")
        .select(
            "company_org_id",
            (F.row_number().over(place) - 1).alias("rank"),
            "org_id",
            "name",
            "rating",
            "review_count",
            F.coalesce("reviews_in_db", F.lit(0).cast("bigint")).alias("reviews_in_db"),
            "avg_stars",
        )
    )


def sync_status(companies: DataFrame, reviews: DataFrame, log: DataFrame) -> DataFrame:
    """Every company with its number of reviews and its last sync."""
    counts = reviews.groupBy("org_id").agg(F.count(F.lit(1)).alias("n"))
    last = last_sync(log).select("org_id", "finished_at", "sync_type", "status")
    return (
        companies.select("org_id", "name", "role")
        .join(counts, "org_id", "left")
        .join(last, "org_id", "left")
        .select(
            "org_id",
            "name",
            "role",
            F.coalesce("n", F.lit(0).cast("bigint")).alias("reviews_in_db"),
            F.coalesce("finished_at", F.lit(NEVER)).alias("last_sync"),
            F.coalesce("sync_type", F.lit(DASH)).alias("last_sync_type"),
            F.coalesce("status", F.lit(DASH)).alias("last_status"),
        )
        .orderBy("name", "org_id")
    )
