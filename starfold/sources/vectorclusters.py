"""Vectors in clusters with a bound on their spread, for an exact search that reads the near clusters only.

Every vector goes to the centroid with the largest cosine; a cluster keeps the widest angle
between its centroid and its vectors. By the triangle inequality of angles no vector of a cluster
is closer to a query than the angle to the centroid less that width. A search reads the
most promising clusters first and then, at once, all others that the k-th similarity found does not rule out.

Centroids are fitted on a bounded sample (``SAMPLE`` vectors of the commonest length); vectors that
are NULL, zero or of another length lie in a cluster of their own, which is always read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from starfold.functions import vectors as vec
from starfold.operators import similarity
from starfold.session import staged

SAMPLE, CLUSTERS, ROUNDS = 8_192, 64, 12
#: Cluster of vectors without a direction or of another length.
ODD = -1
#: The first read takes clusters until they hold this many times the rows sought.
FIRST = 4
#: Added to every bound: similarities are rounded to 12 digits.
MARGIN = 1e-9


def centroids(x: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids of unit rows."""
    dice = np.random.default_rng(7)
    c = x[dice.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), c)
    return c


class VectorClusters:
    def __init__(self, spark: SparkSession, path: str, clusters: int = CLUSTERS):
        self.spark, self.path, self.clusters = spark, path.rstrip("/"), clusters

    def create(self, vectors: DataFrame) -> VectorClusters:
        """Write ``vectors`` (review_id, text_embedding and others) by cluster."""
        v = F.col("text_embedding")
        sound = vectors.filter(v.isNotNull() & F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull()))
        common = sound.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").first()
        dim = common["d"] if common else 0
        some = sound.filter(F.size(v) == dim).orderBy(F.xxhash64("review_id"), "review_id").limit(SAMPLE).select(v).toArrow()
        x = vec.as_matrix(some.column(0), dim)[0] if some.num_rows else np.zeros((0, dim))
        self.centres = centroids(x / np.linalg.norm(x, axis=1, keepdims=True), self.clusters) if len(x) else x
        centres = self.centres
        at = vectors.columns.index("text_embedding")
        schema = StructType([*vectors.schema.fields, StructField("cluster", IntegerType()), StructField("angle", DoubleType())])

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cluster, angle = np.full(batch.num_rows, ODD, dtype=np.int32), np.zeros(batch.num_rows)
                column = batch.column(at)
                whole = pa.array([r is not None and None not in r for r in column.to_pylist()]) if column.flatten().null_count else column.is_valid()
                rows = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
                own, fits = vec.as_matrix(column.take(pa.array(rows)), dim)
                rows = rows[fits]
                size = np.linalg.norm(own, axis=1)
                rows, own = rows[size > 0], own[size > 0] / size[size > 0, None]
                if len(rows) and len(centres):
                    near = own @ centres.T
                    cluster[rows] = near.argmax(axis=1)
                    angle[rows] = np.arccos(np.clip(near.max(axis=1), -1, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster), pa.array(angle)], names=schema.names)

        placed = vectors.mapInArrow(assign, schema)
        placed.hint("rebalance", "cluster").write.partitionBy("cluster").parquet(f"{self.path}/vectors")
        self._schema = StructType([f for f in schema if f.name != "cluster"] + [StructField("cluster", IntegerType())])
        wide = self._read(None).groupBy("cluster").agg(F.max("angle").alias("width"), F.count(F.lit(1)).alias("n"))
        #: cluster -> (widest angle, vectors)
        self.widths = {r["cluster"]: (r["width"], r["n"]) for r in wide.collect()}
        return self

    def _read(self, clusters: list[int] | None) -> DataFrame:
        rows = self.spark.read.schema(self._schema).parquet(f"{self.path}/vectors")
        return rows if clusters is None else rows.filter(F.col("cluster").isin(clusters))

    def bounds(self, query: Sequence[float]) -> list[tuple[float, int, int]]:
        """(largest possible cosine, cluster, vectors), most promising first."""
        q = np.asarray(query, dtype=np.float64)
        size = np.linalg.norm(q)
        if len(q) != self.centres.shape[1] or not size:
            return [(math.inf, c, n) for c, (_, n) in sorted(self.widths.items())]
        away = np.arccos(np.clip(self.centres @ (q / size), -1, 1))
        out = [
            (math.inf if c == ODD else math.cos(max(0.0, min(math.pi, away[c] - width))) + MARGIN, c, n)
            for c, (width, n) in self.widths.items()
        ]
        return sorted(out, key=lambda b: (-b[0], b[1]))

    def search(
        self,
        reviews: DataFrame,
        query: Sequence[float],
        org_id: str | None = None,
        stars: str | None = None,
        limit: int = similarity.DEFAULT_ROWS,
    ) -> tuple[DataFrame, list[int]]:
        """``similarity.semantic_search``, and the clusters it read."""
        sim = vec.cosine_to(query)(F.col("text_embedding"))
        order, held, first = self.bounds(query), 0, []
        for bound, cluster, n in order:
            if held >= FIRST * limit and bound < math.inf:
                break
            first.append(cluster)
            held += n
        best = staged(similarity.closest(reviews, self._read(first), sim, org_id, stars, limit), "closest")
        low = best.agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("low")).first()
        least = low["low"] if low["n"] >= limit and limit > 0 else -math.inf
        more = [c for bound, c, _ in order if c not in set(first) and bound >= least]
        if more and limit > 0:
            rest = similarity.closest(reviews, self._read(more), sim, org_id, stars, limit)
            best = best.unionByName(rest).orderBy(F.col("similarity").desc(), F.col("id").asc()).limit(limit)
        return similarity.with_details(best, reviews), sorted(first + (more if limit > 0 else []))
