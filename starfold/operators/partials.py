"""Descriptive statistics from mergeable partial sums instead of reviews.

A partial is what the reviews of an org, day and star add up to. A batch of upserts becomes
signed partials: a new key adds its row; a known key subtracts what it counted for and
adds what it counts for now. Sums of partials are partials, in any order and grouping, so a
stream appends the few rows of each batch and reports read these alone.

A review keeps its org and date for ever, so the earliest and latest date of an org never
have to be taken back; stars, text and response may move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starfold.functions import calendar as cal
from starfold.functions import numbers as nm
from starfold.functions import text as tx
from starfold.operators.ingest import REVIEW_KEY
from starfold.operators.summary import STAR_BUCKETS

KEYS = ("org_id", "day", "star")
COUNTS = ("reviews", "dated", "responded", "texts")
SCHEMA = (
    "org_id string, day date, star double, reviews bigint, dated bigint, responded bigint, texts bigint,"
    " first_date string, last_date string"
)


def _signed(rows: DataFrame, sign: int) -> DataFrame:
    """One row a review: its partial key, what it counts for, times ``sign``."""
    one = F.lit(sign).cast("bigint")
    when = lambda c: F.when(c, one).otherwise(0).cast("bigint")
    return rows.select(
        "org_id",
        cal.utc_day(F.col("date")).alias("day"),
        F.col("stars").alias("star"),
        one.alias("reviews"),
        when(F.col("date").isNotNull()).alias("dated"),
        when(F.col("business_response").isNotNull()).alias("responded"),
        when(tx.has_text(rows)).alias("texts"),
        F.col("date").alias("first_date"),
        F.col("date").alias("last_date"),
    )


def merge(parts: DataFrame) -> DataFrame:
    """Partials summed per key. A key whose rows have all moved stays with zeros, for its dates."""
    return parts.groupBy(*KEYS).agg(
        *[F.sum(c).alias(c) for c in COUNTS], F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date")
    )


def from_reviews(reviews: DataFrame) -> DataFrame:
    return merge(_signed(reviews, 1))


def of_batch(known: DataFrame, reduced: DataFrame) -> DataFrame:
    """Signed partials of a reduced batch; ``known`` holds the reviews as they were, for its keys at least.

    A known key keeps the org and date of its row; what the batch does not carry stays as well.
    """
    moving = [c for c in ("stars", "text", "business_response") if c in reduced.columns]
    keys = reduced.select(REVIEW_KEY)
    before = known.join(keys, REVIEW_KEY, "left_semi").select(
        REVIEW_KEY, "org_id", "date", "stars", "business_response", tx.has_text(known).alias("has_text")
    )
    incoming = reduced.select(
        REVIEW_KEY,
        *[F.col(c).alias(f"new_{c}") for c in ("org_id", "date")],
        *[F.col(c).alias(f"new_{c}") for c in moving],
    )
    both = incoming.join(before.withColumn("was", F.lit(True)), REVIEW_KEY, "left")
    was = F.coalesce("was", F.lit(False))
    pick = lambda c, old: F.col(f"new_{c}") if c in moving else old
    text = tx.is_filled(F.col("new_text")) if "text" in moving else F.coalesce("has_text", F.lit(False))
    after = both.select(
        F.when(was, F.col("org_id")).otherwise(F.col("new_org_id")).alias("org_id"),
        F.when(was, F.col("date")).otherwise(F.col("new_date")).alias("date"),
        pick("stars", F.col("stars")).alias("stars"),
        pick("business_response", F.col("business_response")).alias("business_response"),
        text.alias("has_text"),
    )
    taken = both.filter(was).select("org_id", "date", "stars", "business_response", "has_text")
    return merge(_signed(after, 1).unionByName(_signed(taken, -1)))


def of_changes(changed: DataFrame) -> DataFrame:
    """The same from the stored reviews that a merged batch named, which carry their ``change``: nothing is joined."""
    kept = ("org_id", "date")
    after = changed.select(*kept, "stars", "business_response", "has_text")
    taken = changed.filter("change.known").select(
        *kept, "change.stars", F.when(F.col("change.responded"), F.lit("")).alias("business_response"), "change.has_text"
    )
    return merge(_signed(after, 1).unionByName(_signed(taken, -1)))


def org_stats(companies: DataFrame, parts: DataFrame) -> DataFrame:
    """``summary.org_stats`` of the reviews that the partials stand for."""
    rated = F.col("star").isNotNull()
    agg = parts.groupBy("org_id").agg(
        F.sum("reviews").alias("n"),
        (F.sum(F.when(rated, F.col("star") * F.col("reviews"))) / F.nullif(F.sum(F.when(rated, F.col("reviews"))), F.lit(0).cast("bigint"))).alias("mean"),
        F.sum("responded").alias("responded"),
        F.sum("texts").alias("texts"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
    )
    zero = F.lit(0).cast("bigint")
    return companies.select("org_id", "name", "rating").join(agg, "org_id", "left").select(
        "org_id",
        "name",
        "rating",
        F.coalesce("n", zero).alias("total_reviews"),
        nm.round_half_up(F.coalesce("mean", F.lit(0.0)), 2).alias("avg_stars"),
        F.coalesce(nm.round_half_up(F.col("responded") / F.nullif(F.col("n"), zero), 2), F.lit(0.0)).alias("response_rate"),
        F.coalesce("texts", zero).alias("reviews_with_text"),
        "first_date",
        "last_date",
    )


def star_histogram(companies: DataFrame, parts: DataFrame) -> DataFrame:
    """``summary.star_histogram``: stars 1 to 5 always, others where they occur."""
    orgs = companies.select("org_id")
    found = parts.groupBy("org_id", nm.star_bucket(F.col("star")).alias("star")).agg(F.sum("reviews").alias("review_count"))
    shown = orgs.select("org_id", F.explode(F.array(*[F.lit(s) for s in STAR_BUCKETS])).alias("star"), F.lit(0).cast("bigint").alias("review_count"))
    held = found.filter("review_count > 0").join(orgs, "org_id", "left_semi")
    return shown.unionByName(held).groupBy("org_id", "star").agg(F.sum("review_count").alias("review_count"))


def trends(parts: DataFrame, period: str = "month", limit: int | None = None) -> DataFrame:
    """``summary.trends``: reviews and mean stars per org and period; unreadable dates form a NULL period."""
    rated = F.col("star").isNotNull()
    stars = F.sum(F.when(rated, F.col("star") * F.col("dated")))
    count = F.nullif(F.sum(F.when(rated, F.col("dated"))), F.lit(0).cast("bigint"))
    out = (
        parts.groupBy("org_id", cal.PERIOD_LABELS[period](F.col("day")).alias("period"))
        .agg(F.sum("dated").alias("review_count"), F.round(stars / count, 2).alias("avg_stars"))
        .filter("review_count > 0")
    )
    newest = F.col("period").desc_nulls_last()
    if limit is not None:
        rank = F.row_number().over(Window.partitionBy("org_id").orderBy(newest))
        out = out.withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank")
    return out.orderBy("org_id", newest)


def review_totals(parts: DataFrame) -> DataFrame:
    """``summary.review_totals``: reviews and plain mean of stars per org."""
    rated = F.col("star").isNotNull()
    mean = F.sum(F.when(rated, F.col("star") * F.col("reviews"))) / F.nullif(F.sum(F.when(rated, F.col("reviews"))), F.lit(0).cast("bigint"))
    return parts.groupBy("org_id").agg(F.sum("reviews").alias("reviews_in_db"), mean.alias("avg_stars")).filter("reviews_in_db > 0")
