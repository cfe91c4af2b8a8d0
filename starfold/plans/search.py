"""Choice between semantic and text search."""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.functions import vectors as vec
from starfold.operators import embedding, listing, similarity
from starfold.operators.embedding import Embedder
from starfold.sources.store import Store


def search(
    spark: SparkSession,
    reviews: DataFrame,
    vectors: DataFrame,
    text: str,
    embedder: Embedder | None = None,
    semantic: bool = True,
    org_id: str | None = None,
    stars: str | None = None,
    limit: int = listing.DEFAULT_ROWS,
) -> tuple[str, DataFrame]:
    """``("semantic" | "text", rows)``.

    Semantic search needs an embedder and stored vectors. When embedding the
    search text fails, the text search answers instead.
    """
    if semantic and embedder is not None and similarity.has_vectors(vectors):
        try:
            wanted = embedding.embed_query(spark, text, embedder).first()["embedding"]
        except Exception:
            logging.getLogger(__name__).warning("embedding the search text failed", exc_info=True)
        else:
            return "semantic", similarity.semantic_search(reviews, vectors, wanted, org_id, stars, limit)
    return "text", listing.search_text(reviews, text, org_id, stars, limit)


def similar(
    spark: SparkSession,
    reviews: DataFrame,
    vectors: DataFrame,
    review_id: int | None = None,
    text: str | None = None,
    embedder: Embedder | None = None,
    org_id: str | None = None,
    limit: int = similarity.SIMILAR_ROWS,
) -> DataFrame:
    """Reviews similar to a stored review or to a text; a review id takes precedence."""
    if review_id is not None:
        return similarity.similar_to_review(reviews, vectors, review_id, org_id, limit)
    if not text or embedder is None:
        raise ValueError("give a review id, or a text and an embedder")
    wanted = embedding.embed_query(spark, text, embedder)
    return similarity.similar_to_row(reviews, vectors, wanted, org_id, None, limit)


def semantic_in_store(
    store: Store,
    query: list[float],
    org_id: str | None = None,
    stars: str | None = None,
    limit: int = listing.DEFAULT_ROWS,
) -> DataFrame:
    """Semantic search over stored tables. Texts are read from the buckets of the winners only."""
    sim = vec.cosine_to(query)(F.col("text_embedding"))
    best = similarity.closest(
        store.read("reviews"), store.read("review_embeddings"), sim, org_id, stars, limit
    )
    best = store.stage(f"search/{uuid.uuid4().hex}", best)
    return similarity.with_details(best, store.read("reviews", parts=store.touched(best)))
