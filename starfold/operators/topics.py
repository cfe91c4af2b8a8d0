"""Topic hierarchy and topic reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starfold.functions import numbers as nm


def parents(topics: DataFrame) -> DataFrame:
    return topics.filter(F.col("parent_id").isNull())


def subtopics(topics: DataFrame) -> DataFrame:
    return topics.filter(F.col("parent_id").isNotNull())


def hierarchy(topics: DataFrame) -> DataFrame:
    """Each parent with each of its subtopics; a parent without any keeps one row."""
    heads = parents(topics).select(
        "org_id",
        F.col("id").alias("parent_id"),
        F.col("name").alias("parent_name"),
        F.col("position").alias("parent_position"),
    )
    leaves = subtopics(topics).select(
        "parent_id", F.col("id").alias("topic_id"), "name", "position"
    )
    return heads.join(leaves, "parent_id", "left").select(
        "org_id", "parent_id", "parent_name", "parent_position", "topic_id", "name", "position"
    )


def _star_sums(assignments: DataFrame, reviews: DataFrame) -> DataFrame:
    return (
        assignments.select("review_id", "topic_id")
        .join(reviews.select(F.col("id").alias("review_id"), "stars"), "review_id")
        .groupBy("topic_id")
        .agg(F.count(F.lit(1)).alias("n"), F.count("stars").alias("k"), F.sum("stars").alias("s"))
    )


def _with_sums(topics: DataFrame, assignments: DataFrame, reviews: DataFrame) -> DataFrame:
    """Topics with count ``n``, mean ``m`` and count-weighted mean ``w`` (0 where unassigned)."""
    sums = _star_sums(assignments, reviews).withColumnRenamed("topic_id", "id")
    mean = F.coalesce(F.col("s") / F.nullif(F.col("k"), F.lit(0)), F.lit(0.0))
    return (
        topics.drop("embedding")
        .join(sums, "id", "left")
        .withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
        .withColumn("m", mean)
        # With no missing stars the weighted mean is the sum itself, free of rounding.
        .withColumn("w", F.when(F.col("n") == F.col("k"), F.col("s")).otherwise(F.col("m") * F.col("n")))
    )


def topic_stats(topics: DataFrame, assignments: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviews and mean stars of every subtopic."""
    return _with_sums(subtopics(topics), assignments, reviews).select(
        "org_id",
        F.col("id").alias("topic_id"),
        "parent_id",
        "name",
        F.col("n").alias("review_count"),
        nm.round_half_up(F.col("m"), 1).alias("avg_stars"),
    )


def topic_tree(
    topics: DataFrame, assignments: DataFrame, reviews: DataFrame, limit: int | None = None
) -> DataFrame:
    """Parents, most reviewed first (``rank`` from 1 per org), each followed by its subtopics.

    Parent means are weighted by reviews over unrounded subtopic means.
    ``limit`` counts parents per org. Both levels come out of one pass.
    """
    is_leaf = F.col("parent_id").isNotNull()
    head_id = F.coalesce("parent_id", "id")
    family = Window.partitionBy(head_id)
    order = Window.partitionBy("org_id").orderBy(F.col("all").desc(), "head_position", head_id)
    mean = F.coalesce(F.col("weighted") / F.nullif(F.col("all"), F.lit(0)), F.lit(0.0))
    tree = (
        _with_sums(topics, assignments, reviews)
        .withColumn("all", F.coalesce(F.sum(F.when(is_leaf, F.col("n"))).over(family), F.lit(0)))
        .withColumn("weighted", F.sum(F.when(is_leaf, F.col("w"))).over(family))
        .withColumn("head_position", F.max(F.when(~is_leaf, F.col("position"))).over(family))
        .withColumn("rank", F.dense_rank().over(order))
    )
    if limit is not None:
        tree = tree.filter(F.col("rank") <= limit)
    return tree.select(
        "org_id",
        "rank",
        F.when(is_leaf, 1).otherwise(0).alias("level"),
        F.col("id").alias("topic_id"),
        "parent_id",
        "name",
        F.when(is_leaf, F.col("n")).otherwise(F.col("all")).alias("review_count"),
        nm.round_half_up(F.when(is_leaf, F.col("m")).otherwise(mean), 1).alias("avg_stars"),
    )


def topic_tree_nested(
    topics: DataFrame, assignments: DataFrame, reviews: DataFrame, limit: int | None = None
) -> DataFrame:
    """The same report with the subtopics of a parent as a list in document order."""
    flat = topic_tree(topics, assignments, reviews, limit)
    child = F.struct("position", "topic_id", "name", "review_count", "avg_stars")
    lists = (
        flat.filter(F.col("level") == 1)
        .join(topics.select(F.col("id").alias("topic_id"), "position"), "topic_id")
        .groupBy(F.col("parent_id").alias("topic_id"))
        .agg(F.array_sort(F.collect_list(child)).alias("children"))
        .withColumn("children", F.transform("children", lambda c: c.dropFields("position")))
    )
    return (
        flat.filter(F.col("level") == 0)
        .drop("level", "parent_id")
        .join(lists, "topic_id", "left")
        .withColumn("children", F.coalesce("children", F.array().cast(lists.schema["children"].dataType)))
    )


def classified_counts(companies: DataFrame, reviews: DataFrame, assignments: DataFrame) -> DataFrame:
    """Reviews of each company that carry at least one topic."""
    done = (
        reviews.select(F.col("id").alias("review_id"), "org_id")
        .join(assignments.select("review_id"), "review_id", "left_semi")
        .groupBy("org_id")
        .agg(F.count(F.lit(1)).alias("classified"))
    )
    return companies.select("org_id").join(done, "org_id", "left").na.fill(0)
