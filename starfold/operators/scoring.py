"""Recency-weighted scores: subtopics, parents, companies, and comparison of two companies.

Each level averages the rounded scores of the level below. Scores travel as
whole tenths, so the weighted sums are exact whatever order they are added in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starfold.functions import calendar as cal
from starfold.functions import numbers as nm

# Fixed values.
POINTS_PER_STAR = 2
HIGH_COUNT = 20
MEDIUM_COUNT = 5
MARKED_TENTHS = 5
BETTER = "✅"
WORSE = "❌"


def confidence(count: Column) -> Column:
    return F.when(count >= HIGH_COUNT, "high").when(count >= MEDIUM_COUNT, "medium").otherwise("low")


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def _shown(tenths: Column) -> Column:
    return tenths / F.lit(10.0)


def _mean_of_tenths(total: Column, count: Column) -> Column:
    return F.coalesce(
        F.floor(total / F.nullif(count, F.lit(0)) + F.lit(0.5)).cast("bigint"), _zero()
    )


def topic_levels(
    topics: DataFrame, assignments: DataFrame, reviews: DataFrame, as_of: str
) -> DataFrame:
    """Every topic with its score in tenths and its number of dated reviews.

    Subtopics score their own reviews; parents average their subtopics. Both
    levels come out of one pass over the reviews.
    """
    weight = cal.recency_weight(F.col("date"), as_of)
    weighed = reviews.filter(F.col("date").isNotNull()).select(
        F.col("id").alias("review_id"),
        weight.alias("w"),
        (F.coalesce("stars", F.lit(0.0)) * POINTS_PER_STAR * weight).alias("bw"),
    )
    sums = (
        assignments.select("review_id", F.col("topic_id").alias("id"))
        .join(weighed, "review_id")
        .groupBy("id")
        .agg(F.sum("bw").alias("bw"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))
    )
    is_leaf = F.col("parent_id").isNotNull()
    family = Window.partitionBy(F.coalesce("parent_id", "id"))
    return (
        topics.select("org_id", "id", "parent_id", "name", "position")
        .join(sums, "id", "left")
        .withColumn("t", F.when(is_leaf, F.coalesce(nm.tenths(F.col("bw") / F.col("w")), _zero())))
        .withColumn("k", F.when(is_leaf, F.coalesce("n", _zero())))
        .withColumn("total", F.sum(F.col("t") * F.col("k")).over(family))
        .withColumn("all", F.sum("k").over(family))
        .select(
            "org_id",
            F.col("id").alias("topic_id"),
            "parent_id",
            "name",
            "position",
            F.coalesce("t", _mean_of_tenths(F.col("total"), F.col("all"))).alias("t10"),
            F.coalesce("k", "all", _zero()).alias("review_count"),
        )
    )


def _present(levels: DataFrame, *extra: str) -> DataFrame:
    return levels.select(
        "org_id",
        *extra,
        "topic_id",
        "name",
        _shown(F.col("t10")).alias("score"),
        "review_count",
        confidence(F.col("review_count")).alias("confidence"),
    )


def subtopic_scores(
    topics: DataFrame, assignments: DataFrame, reviews: DataFrame, as_of: str
) -> DataFrame:
    levels = topic_levels(topics, assignments, reviews, as_of)
    return _present(levels.filter(F.col("parent_id").isNotNull()))


def parent_scores(
    topics: DataFrame, assignments: DataFrame, reviews: DataFrame, as_of: str
) -> DataFrame:
    """Parents with ``rank`` from 1 per org, best first, ties in the order of the topic list."""
    best = Window.partitionBy("org_id").orderBy(F.col("t10").desc(), "position", "topic_id")
    levels = topic_levels(topics, assignments, reviews, as_of)
    heads = levels.filter(F.col("parent_id").isNull())
    return _present(heads.withColumn("rank", F.row_number().over(best)), "rank")


def overall_scores(
    companies: DataFrame, topics: DataFrame, assignments: DataFrame, reviews: DataFrame, as_of: str
) -> DataFrame:
    """Company score over rounded parent scores; the name falls back to the org id."""
    levels = topic_levels(topics, assignments, reviews, as_of)
    sums = levels.filter(F.col("parent_id").isNull()).groupBy("org_id").agg(
        F.sum(F.col("t10") * F.col("review_count")).alias("total"), F.sum("review_count").alias("n")
    )
    return companies.select("org_id", "name").join(sums, "org_id", "left").select(
        "org_id",
        F.coalesce("name", "org_id").alias("name"),
        _shown(_mean_of_tenths(F.col("total"), F.col("n"))).alias("overall_score"),
        F.coalesce("n", _zero()).alias("total_reviews"),
    )


def score_rows(
    companies: DataFrame, topics: DataFrame, assignments: DataFrame, reviews: DataFrame, as_of: str
) -> DataFrame:
    """Rows of the score table: subtopics, parents, and the company itself with a NULL topic.

    A parent counts once for itself and once for its company, so one aggregation
    yields all three levels. Companies without topics score 0.
    """
    none = F.lit(None).cast("bigint")
    levels = topic_levels(topics, assignments, reviews, as_of)
    own = F.array("topic_id")
    counted = levels.select(
        "org_id",
        "t10",
        "review_count",
        F.explode(F.when(F.col("parent_id").isNull(), F.concat(own, F.array(none))).otherwise(own)).alias("topic_id"),
    )
    listed = companies.select(
        "org_id", _zero().alias("t10"), _zero().alias("review_count"), none.alias("topic_id")
    )
    mean = _mean_of_tenths(F.col("total"), F.col("n"))
    return (
        counted.unionByName(listed)
        .groupBy("org_id", "topic_id")
        .agg(
            F.sum(F.col("t10") * F.col("review_count")).alias("total"),
            F.sum("review_count").alias("n"),
            F.max("t10").alias("t10"),
        )
        .select(
            "org_id",
            "topic_id",
            _shown(F.when(F.col("topic_id").isNull(), mean).otherwise(F.col("t10"))).alias("score"),
            F.col("n").alias("review_count"),
            confidence(F.col("n")).alias("confidence"),
        )
    )


def compare_scores(heads: DataFrame, pairs: DataFrame) -> DataFrame:
    """Parent scores of two orgs side by side, for each ``(org_a, org_b)`` of ``pairs``.

    Topics meet by name; a topic one side lacks scores 0 there. ``heads`` is the
    result of ``parent_scores``. ``place`` lists the topics of A by rank, then
    those only B has.
    """
    named = heads.groupBy("org_id", "name").agg(
        F.min_by("score", "rank").alias("score"), F.min("rank").alias("rank")
    )
    sides = pairs.select("org_a", "org_b").distinct().select(
        "org_a",
        "org_b",
        F.explode(F.array(
            F.struct(F.lit("a").alias("side"), F.col("org_a").alias("org_id")),
            F.struct(F.lit("b").alias("side"), F.col("org_b").alias("org_id")),
        )).alias("s"),
    ).select("org_a", "org_b", "s.side", "s.org_id")

    def of(side: str, value: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(value)))

    both = sides.join(named, "org_id").groupBy("org_a", "org_b", "name").agg(
        F.coalesce(of("a", "score"), F.lit(0.0)).alias("score_a"),
        F.coalesce(of("b", "score"), F.lit(0.0)).alias("score_b"),
        of("a", "rank").alias("rank_a"),
        of("b", "rank").alias("rank_b"),
    )
    gap = nm.tenths(F.col("score_a")) - nm.tenths(F.col("score_b"))
    order = Window.partitionBy("org_a", "org_b").orderBy(
        F.col("rank_a").asc_nulls_last(), F.col("rank_b").asc(), "name"
    )
    return both.select(
        "org_a",
        "org_b",
        F.row_number().over(order).alias("place"),
        "name",
        "score_a",
        "score_b",
        _shown(gap).alias("delta"),
        F.when(gap >= MARKED_TENTHS, BETTER).when(gap <= -MARKED_TENTHS, WORSE).otherwise("").alias("marker"),
    )
