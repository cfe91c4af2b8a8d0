"""Vector operators: similarity search and assignment of reviews to topics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starfold.functions import text as tx
from starfold.functions import vectors as vec
from starfold.operators.listing import DEFAULT_ROWS, filter_reviews, search_columns

# Defaults of classification and of the similar-reviews report.
THRESHOLD = 0.3
TOPICS_PER_REVIEW = 3
SIMILAR_ROWS = 10

#: Sizes of one block of the blocked classification: reviews and topics that one
#: task multiplies at a time. 4096 float32 vectors of 1536 numbers are 25 MB.
REVIEWS_PER_BLOCK = 4096
TOPICS_PER_BLOCK = 512


def similarity_pairs(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Cosine of the vectors ``a`` of one side and ``b`` of the other for rows that join on ``on``."""
    a = left.withColumn("_na", vec.norm(F.col("a")))
    b = right.withColumn("_nb", vec.norm(F.col("b")))
    sim = vec.cosine(F.col("a"), F.col("b"), F.col("_na"), F.col("_nb"))
    return a.join(b, list(on)).withColumn("similarity", sim).drop("a", "b", "_na", "_nb")


def closest(
    reviews: DataFrame,
    vectors: DataFrame,
    similarity: Column,
    org_id: str | None = None,
    stars: str | None = None,
    limit: int = DEFAULT_ROWS,
) -> DataFrame:
    """``(id, review_key, similarity)`` of the ``limit`` most similar reviews that have text.

    The similarity is computed once per vector, where the vectors are read, and only ids,
    keys and similarities are joined; vectors and texts stay where they are.
    ``similarity`` must be marked non-deterministic, which keeps Spark from moving or repeating it.
    """
    candidates = (
        filter_reviews(reviews, org_id, None, stars)
        .filter(tx.has_text(reviews))
        .select(F.col("id").alias("review_id"), "review_key")
    )
    if org_id is not None and "org_id" in vectors.columns:
        vectors = vectors.filter(F.col("org_id") == org_id)
    scored = vectors.select("review_id", similarity.alias("similarity")).filter(F.col("similarity").isNotNull())
    return (
        scored.join(candidates, "review_id")
        .select(F.col("review_id").alias("id"), "review_key", "similarity")
        .orderBy(F.col("similarity").desc(), F.col("id").asc())
        .limit(limit)
    )


def with_details(best: DataFrame, reviews: DataFrame) -> DataFrame:
    """The listed columns of the reviews found, most similar first."""
    return (
        best.select("id", "similarity")
        .join(reviews.select(*search_columns()), "id")
        .orderBy(F.col("similarity").desc(), F.col("id").asc())
    )


def semantic_search(
    reviews: DataFrame,
    vectors: DataFrame,
    query: Sequence[float],
    org_id: str | None = None,
    stars: str | None = None,
    limit: int = DEFAULT_ROWS,
) -> DataFrame:
    """Reviews most similar to a query vector, by exact cosine over every vector."""
    sim = vec.cosine_to(query)(F.col("text_embedding"))
    return with_details(closest(reviews, vectors, sim, org_id, stars, limit), reviews)


def similar_to_review(
    reviews: DataFrame,
    vectors: DataFrame,
    review_id: int,
    org_id: str | None = None,
    limit: int = SIMILAR_ROWS,
) -> DataFrame:
    """Reviews most similar to a stored one, itself included; empty when it has no vector."""
    wanted = vectors.filter(F.col("review_id") == review_id).select("text_embedding")
    return similar_to_row(reviews, vectors, wanted, org_id, None, limit)


def similar_to_row(
    reviews: DataFrame,
    vectors: DataFrame,
    query: DataFrame,
    org_id: str | None = None,
    stars: str | None = None,
    limit: int = DEFAULT_ROWS,
) -> DataFrame:
    """Search by the vector in the only row and column of ``query``, which is read first; no rows without one."""
    row = query.first()
    if row is None or row[0] is None:
        return with_details(
            reviews.limit(0).select("id", "review_key", F.lit(0.0).alias("similarity")), reviews
        )
    sim = vec.cosine_to(row[0])(F.col("text_embedding"))
    return with_details(closest(reviews, vectors, sim, org_id, stars, limit), reviews)


def has_vectors(vectors: DataFrame) -> bool:
    return not vectors.select("review_id").isEmpty()


def classifiers(topics: DataFrame) -> DataFrame:
    """Topics reviews are assigned to: subtopics that have a vector."""
    return topics.filter(F.col("parent_id").isNotNull() & F.col("embedding").isNotNull()).select(
        "org_id", F.col("id").alias("topic_id"), F.col("embedding").alias("b")
    )


def best_topics(matches: DataFrame, max_topics: int) -> DataFrame:
    """The closest topics of each review, ties by topic id."""
    place = Window.partitionBy("review_id").orderBy(F.col("similarity").desc(), F.col("topic_id"))
    return (
        matches.withColumn("_place", F.row_number().over(place))
        .filter(F.col("_place") <= max_topics)
        .select("review_id", "topic_id", "similarity")
    )


def classify(
    vectors: DataFrame,
    reviews: DataFrame | None,
    topics: DataFrame,
    threshold: float = THRESHOLD,
    max_topics: int = TOPICS_PER_REVIEW,
    method: str = "blocks",
) -> DataFrame:
    """Assign every embedded review to the closest subtopics of its own org.

    Vectors that carry their ``org_id`` need no ``reviews``; others get it from there.
    ``blocks`` compares blocks of vectors with blocks of topics by one matrix product each,
    and shuffles each vector once for each of its org's topic blocks (one up to 512 topics). ``pairs``
    compares pair by pair in the JVM: the plain twin that tests check the blocks with.
    """
    owned = owned_vectors(vectors, reviews)
    if method == "pairs":
        matches = similarity_pairs(owned, classifiers(topics), ["org_id"]).filter(
            F.col("similarity") >= threshold
        )
    elif method == "blocks":
        matches = _classify_blocks(owned, classifiers(topics), threshold, max_topics)
    else:
        raise ValueError(f"unknown method: {method!r}")
    return best_topics(matches, max_topics)


def owned_vectors(vectors: DataFrame, reviews: DataFrame | None) -> DataFrame:
    """``(review_id, org_id, a)``: vectors with the org of their review."""
    if "org_id" in vectors.columns:
        return vectors.select("review_id", "org_id", F.col("text_embedding").alias("a"))
    owner = reviews.select(F.col("id").alias("review_id"), "org_id")
    return vectors.select("review_id", F.col("text_embedding").alias("a")).join(owner, "review_id")


def vector_mismatches(vectors: DataFrame, reviews: DataFrame | None, topics: DataFrame) -> DataFrame:
    """Per org: vectors whose length is that of no topic vector of the org, hence never matched."""
    lengths = classifiers(topics).select("org_id", F.size("b").alias("length")).distinct()
    per = lengths.groupBy("org_id").agg(F.collect_set("length").alias("lengths"))
    own = owned_vectors(vectors, reviews).select("org_id", F.size("a").alias("length"))
    unmatched = ~F.array_contains("lengths", F.col("length"))
    return own.join(per, "org_id").groupBy("org_id").agg(
        F.count(F.lit(1)).alias("vectors"), F.count(F.when(unmatched, 1)).alias("mismatched")
    )


def _classify_blocks(owned: DataFrame, topics: DataFrame, threshold: float, max_topics: int) -> DataFrame:
    """Matches by blocks. An org of any size is cut into blocks of bounded size on both sides.

    Each block pair keeps its best topics per review; the caller picks the best
    over all block pairs.
    """
    def blocks(per_org: DataFrame, size: int, name: str) -> DataFrame:
        return per_org.groupBy("org_id").agg(
            F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name)
        )

    layout = blocks(owned, REVIEWS_PER_BLOCK, "rn").join(
        blocks(topics, TOPICS_PER_BLOCK, "tn"), "org_id"
    )

    def spread(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def slot(key: str, n: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(n).cast("bigint")).cast("int")

    # The layout has one row per org; Spark broadcasts it when it is small.
    left = owned.join(layout, "org_id").select(
        "review_id", "org_id", "a", slot("review_id", "rn").alias("rb"), spread("tn").alias("tb")
    )
    right = topics.join(layout, "org_id").select(
        "org_id", "topic_id", "b", spread("rn").alias("rb"), slot("topic_id", "tn").alias("tb")
    )
    keys = ["org_id", "rb", "tb"]

    def run(reviews_block: pa.Table, topics_block: pa.Table) -> pa.Table:
        return match_block(reviews_block, topics_block, threshold, max_topics)

    return (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInArrow(run, "review_id bigint, topic_id bigint, similarity double")
    )


def match_block(
    reviews: pa.Table, topics: pa.Table, threshold: float, max_topics: int
) -> pa.Table:
    """Best topics of each review of a block. Vectors of unequal length never match."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if reviews.num_rows and topics.num_rows:
        topics = topics.sort_by("topic_id")
        dims = topics["b"].combine_chunks().value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        found.extend(_match_dims(reviews, topics, np.unique(dims), threshold, max_topics))
    empty = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    cols = [np.concatenate(c) for c in zip(*(found or [empty]))]
    return pa.table(dict(zip(("review_id", "topic_id", "similarity"), cols)))


def _match_dims(
    reviews: pa.Table, topics: pa.Table, dims: np.ndarray, threshold: float, max_topics: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    ids, topic_ids = reviews["review_id"].to_numpy(), topics["topic_id"].to_numpy()
    for dim in dims:
        a, fits_a = vec.as_matrix(reviews["a"], int(dim))
        b, fits_b = vec.as_matrix(topics["b"], int(dim))
        if not len(a):
            continue
        scale = np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
        sims = vec.safe_cosine(a @ b.T, scale)
        # Columns are in topic-id order, so a stable sort settles ties by id.
        order = np.argsort(-sims, axis=1, kind="stable")[:, :max_topics]
        best = np.take_along_axis(sims, order, axis=1)
        rows, places = np.nonzero(best >= threshold)
        yield ids[fits_a][rows], topic_ids[fits_b][order[rows, places]], best[rows, places]
