"""Streamed model: arriving vectors are stored and classified, and a whole model is refreshed org by org.

Both write by key, so a batch that is delivered again leaves the tables as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from starfold import schemas
from starfold.operators import embedding, scoring, similarity
from starfold.operators.embedding import Embedder
from starfold.session import staged
from starfold.sources.orgtable import OrgTable

#: Assignments with the org of their review, which places them.
OWNED_ASSIGNMENTS = StructType([*schemas.ASSIGNMENTS.fields, StructField("org_id", StringType())])


class VectorIngest:
    """``foreachBatch`` step over vectors (review_id, org_id, model, text_embedding, and columns that order them).

    The last vector of a review counts. Its assignments are replaced; those of other reviews stay.
    """

    def __init__(
        self,
        vectors: OrgTable,
        assignments: OrgTable,
        topics: DataFrame,
        order_by: tuple[str, ...],
        threshold: float = similarity.THRESHOLD,
    ):
        self.vectors, self.assignments, self.topics = vectors, assignments, topics
        self.order_by, self.threshold = order_by, threshold

    def __call__(self, rows: DataFrame, batch_id: int) -> None:
        columns = [c for c in rows.columns if c in self.vectors.schema.names and c != "review_id"]
        last = rows.groupBy("review_id").agg(F.max_by(F.struct(*columns), F.struct(*self.order_by)).alias("v"))
        new = staged(last.select("review_id", "v.*"), "vectors")
        now = F.current_timestamp()
        self.vectors.upsert(new.withColumn("created_at", now), "review_id")
        owner = new.select("review_id", "org_id")
        found = similarity.classify(new, None, self.topics, self.threshold).join(owner, "review_id").withColumn("created_at", now)
        self.assignments.replace(staged(found, "assigned"), owner, "review_id")


def refresh_model(
    tables: dict[str, OrgTable],
    companies: DataFrame,
    topics: DataFrame,
    embedder: Embedder,
    as_of: str,
    orgs: DataFrame | None = None,
    threshold: float = similarity.THRESHOLD,
) -> None:
    """Embed the backlog, reassign, and score the orgs named (all by default); other orgs' buckets are not written.

    ``tables``: reviews, review_embeddings, review_topics (with org_id) and company_scores.
    """
    orgs = companies.select("org_id") if orgs is None else orgs.select("org_id").distinct()
    own = lambda rows: rows.join(orgs, "org_id", "left_semi")
    now = F.current_timestamp()
    reviews = own(tables["reviews"].read(orgs))
    vectors = tables["review_embeddings"]
    new = staged(embedding.embed_reviews(reviews, vectors.read(orgs), embedder), "backlog")
    vectors.upsert(new.withColumn("created_at", now), "review_id")
    some_topics = own(topics)
    owner = reviews.select(F.col("id").alias("review_id"), "org_id")
    assigned = similarity.classify(own(vectors.read(orgs)), None, some_topics, threshold)
    assigned = staged(assigned.join(owner, "review_id").withColumn("created_at", now), "assigned")
    tables["review_topics"].replace_orgs(assigned, orgs)
    scores = scoring.score_rows(own(companies), some_topics, assigned.select("review_id", "topic_id", "similarity"), reviews, as_of)
    tables["company_scores"].replace_orgs(scores.withColumn("computed_at", now), orgs)
