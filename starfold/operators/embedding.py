"""Embedding of review texts and topic labels through a pluggable embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from starfold.functions import text as tx
from starfold.session import staged

# Fixed values.
BATCH_SIZE = 100


class Embedder(Protocol):
    model: str

    def embed(self, df: DataFrame) -> DataFrame:
        """Rows with ``id`` and ``text``, the text replaced by its ``embedding``; other columns are kept."""


class HashingEmbedder:
    """Unit vectors of hashed word counts, computed in the JVM. Works offline."""

    def __init__(self, dim: int = 256):
        self.dim = dim
        self.model = f"hashing-{dim}"
        self._stages = PipelineModel([
            RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}\p{N}]+"),
            HashingTF(inputCol="words", outputCol="counts", numFeatures=dim),
            Normalizer(inputCol="counts", outputCol="unit", p=2.0),
        ])

    def embed(self, df: DataFrame) -> DataFrame:
        kept = [c for c in df.columns if c != "text"]
        return self._stages.transform(df).select(*kept, vector_to_array("unit", "float32").alias("embedding"))


class BatchEmbedder:
    """Calls ``fn(texts) -> matrix`` with at most ``batch_size`` texts at a time."""

    def __init__(
        self,
        fn: Callable[[list[str]], Sequence[Sequence[float]]],
        model: str,
        batch_size: int = BATCH_SIZE,
    ):
        self.fn, self.model, self.batch_size = fn, model, batch_size

    def embed(self, df: DataFrame) -> DataFrame:
        fn, size = self.fn, self.batch_size
        kept = [f for f in df.schema.fields if f.name != "text"]
        schema = StructType([*kept, StructField("embedding", ArrayType(FloatType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, size):
                    part = batch.slice(start, size)
                    rows = np.asarray(fn(part["text"].to_pylist()), dtype=np.float32)
                    if len(rows) != part.num_rows:
                        raise ValueError("the embedder must return one vector per text")
                    vectors = pa.FixedSizeListArray.from_arrays(rows.ravel(), rows.shape[1])
                    yield pa.RecordBatch.from_arrays(
                        [*(part[f.name] for f in kept), vectors.cast(pa.list_(pa.float32()))], schema.names
                    )

        return df.mapInArrow(run, schema)


def unembedded(reviews: DataFrame, vectors: DataFrame, force: bool = False) -> DataFrame:
    """Reviews with text that have no vector yet; with ``force`` all reviews with text."""
    todo = reviews.filter(tx.has_text(reviews))
    if not force:
        # Ids first, written: Spark knows their size, so a short list is broadcast and no text is moved.
        ids = todo.select("id").join(vectors.select(F.col("review_id").alias("id")), "id", "left_anti")
        todo = todo.join(staged(ids, "backlog"), "id", "left_semi")
    return todo.select("id", "org_id", "text")


def embed_reviews(
    reviews: DataFrame, vectors: DataFrame, embedder: Embedder, force: bool = False
) -> DataFrame:
    """Vectors of the backlog, as rows of the vector table, each with the org of its review."""
    todo = unembedded(reviews, vectors, force)
    return embedder.embed(todo).select(
        F.col("id").alias("review_id"),
        "org_id",
        F.lit(embedder.model).alias("model"),
        F.col("embedding").alias("text_embedding"),
        F.lit(None).cast("array<float>").alias("response_embedding"),
    )


def embed_topics(topics: DataFrame, embedder: Embedder, force: bool = False) -> DataFrame:
    """``(id, embedding)`` of the topic labels that lack a vector; with ``force`` of all labels."""
    todo = topics if force else topics.filter(F.col("embedding").isNull())
    return embedder.embed(todo.select("id", F.col("name").alias("text")))


def embed_query(spark, text: str, embedder: Embedder) -> DataFrame:
    """One row holding the vector of a search text."""
    one = spark.createDataFrame([(0, text)], "id bigint, text string")
    return embedder.embed(one).select("embedding")


def coverage(companies: DataFrame, reviews: DataFrame, vectors: DataFrame, topics: DataFrame) -> DataFrame:
    """Per company: reviews with text, reviews with a vector, topics, topics with a vector."""
    texts = reviews.groupBy("org_id").agg(
        F.count(F.when(tx.has_text(reviews), 1)).alias("reviews_with_text")
    )
    done = (
        reviews.select(F.col("id").alias("review_id"), "org_id")
        .join(vectors.select("review_id"), "review_id", "left_semi")
        .groupBy("org_id")
        .agg(F.count(F.lit(1)).alias("reviews_embedded"))
    )
    labels = topics.groupBy("org_id").agg(
        F.count(F.lit(1)).alias("topics"), F.count("embedding").alias("topics_embedded")
    )
    out = companies.select("org_id")
    for part in (texts, done, labels):
        out = out.join(part, "org_id", "left")
    return out.na.fill(0)
