"""Whole-model jobs: apply a configuration, embed and classify everything, refresh scores, remove orgs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfold.operators import configdoc, embedding, ingest, normalize, scoring, similarity
from starfold.operators.embedding import Embedder
from starfold.schemas import TABLES
from starfold.sources.store import Store


def apply_config(store: Store, config: DataFrame) -> DataFrame:
    """Store companies, relations and topics of a configuration; returns what is rejected, with the reason.

    The service type of a listed company is overwritten. Applying the same
    document again changes nothing and keeps topic vectors and assignments.
    """
    listed = configdoc.inherit_topics(configdoc.accepted(config))
    now = F.current_timestamp()
    companies = ingest.upsert_companies(
        store.read("companies"),
        configdoc.company_rows(listed).withColumn("created_at", now).withColumn("updated_at", now),
    )
    store.replace("companies", companies)
    known = store.read("companies")
    store.replace(
        "company_relations",
        ingest.upsert_relations(store.read("company_relations"), configdoc.relation_rows(listed), known),
    )
    stated = configdoc.with_topics(listed)
    topics = ingest.replace_topics(store.read("topic_templates"), configdoc.topic_rows(stated), stated)
    store.replace("topic_templates", topics)
    gone = store.read("topic_templates").select(F.col("id").alias("topic_id"))
    for table in ("review_topics", "company_scores"):
        current = store.read(table)
        stays = current.join(gone, "topic_id", "left_semi")
        if table == "company_scores":
            stays = stays.unionByName(current.filter(F.col("topic_id").isNull()))
        store.replace(table, stays)
    return configdoc.rejected(config)


def sync_companies(store: Store, raw: DataFrame, order_by: Sequence[str]) -> None:
    """Clean raw company attributes and merge them into the tracked companies."""
    found = normalize.normalize_companies(raw, extra=order_by).withColumn(
        "updated_at", F.current_timestamp()
    )
    store.replace("companies", ingest.sync_companies(store.read("companies"), found, order_by))


def embed_and_classify(
    store: Store,
    embedder: Embedder,
    threshold: float = similarity.THRESHOLD,
    force: bool = False,
) -> None:
    """Embed the backlog of reviews and topic labels, then reassign every org that has topics."""
    now = F.current_timestamp()
    reviews, vectors = store.read("reviews"), store.read("review_embeddings")
    new = embedding.embed_reviews(reviews, vectors, embedder, force).withColumn("created_at", now)
    if force:
        store.replace("review_embeddings", ingest.save_vectors(vectors, new))
    else:
        store.append("review_embeddings", new)
    topics = store.read("topic_templates")
    store.replace(
        "topic_templates",
        ingest.save_topic_vectors(topics, embedding.embed_topics(topics, embedder, force)),
    )
    topics = store.read("topic_templates")
    assigned = similarity.classify(store.read("review_embeddings"), reviews, topics, threshold)
    store.replace(
        "review_topics",
        ingest.replace_assignments(
            store.read("review_topics"),
            assigned.withColumn("created_at", now),
            reviews,
            similarity.classifiers(topics),
        ),
    )


def refresh_scores(store: Store, as_of: str) -> None:
    """Recompute and store the scores of all companies."""
    fresh = scoring.score_rows(
        store.read("companies"),
        store.read("topic_templates"),
        store.read("review_topics"),
        store.read("reviews"),
        as_of,
    ).withColumn("computed_at", F.current_timestamp())
    store.replace("company_scores", ingest.upsert_scores(store.read("company_scores"), fresh))


def untrack(store: Store, orgs: DataFrame) -> None:
    """Remove orgs and all that hangs on them from every table."""
    tables = {name: store.read(name) for name in TABLES}
    left = ingest.remove_orgs(tables, orgs)
    for name, rows in left.items():
        if name != "reviews":
            store.replace(name, rows)
    lost = tables["reviews"].join(orgs.select("org_id").distinct(), "org_id", "left_semi")
    store.rewrite_reviews(left["reviews"], lost)
