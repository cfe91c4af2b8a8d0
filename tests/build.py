"""Tiny tables for tests."""

from pyspark.sql import functions as F

from starfold import schemas
from starfold.operators import ingest

_DEFAULTS = {
    "author_name": "Test", "date": "2025-06-01", "text": "Good service", "stars": 5.0,
    "likes": 0, "dislikes": 0, "review_url": None, "business_response": None,
}


def reviews(spark, *rows, org="111"):
    """Reviews from dicts over the defaults; ids count from 1, keys are computed."""
    full = []
    for i, row in enumerate(rows, 1):
        r = {"id": i, "org_id": org, **_DEFAULTS, **row}
        full.append(tuple(r.get(f.name) for f in schemas.REVIEWS))
    loose = "review_key string"
    schema = ", ".join(
        loose if f.name == "review_key" else f"{f.name} {f.dataType.simpleString()}" for f in schemas.REVIEWS
    )
    return ingest.with_review_key(spark.createDataFrame(full, schema)).select(
        *[f.name for f in schemas.REVIEWS]
    )


def batch(spark, *rows, org="111"):
    """An incoming batch: rows without id, in the given order (``seq``)."""
    return reviews(spark, *rows, org=org).withColumn("seq", F.col("id")).drop("id")


def companies(spark, *rows):
    names = ["org_id", "name", "rating", "review_count", "address", "categories", "role", "service_type"]
    schema = ("org_id string, name string, rating double, review_count int, address string, "
              "categories array<string>, role string, service_type string")
    return spark.createDataFrame(
        [tuple({"role": "tracked", **r}.get(n) for n in names) for r in rows], schema
    )


def topics(spark, *rows):
    return spark.createDataFrame(
        [(i, o, p, n, pos, e) for i, o, p, n, pos, e in rows],
        "id bigint, org_id string, parent_id bigint, name string, position bigint, embedding array<float>",
    )


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def bag(df, *columns):
    return sorted(rows(df, *(columns or df.columns)), key=repr)
