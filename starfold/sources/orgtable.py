"""Parquet tables split by a hash of the org, of which a change rewrites the orgs' buckets only.

Writing uses dynamic partition overwrite: Spark writes the new buckets beside the old ones and
swaps them when the job commits, so a job may read the buckets that it rewrites. Each
written bucket holds one row without an org, which readers skip; it keeps an emptied bucket in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from starfold import schemas

BUCKETS = 64


class OrgTable:
    """A table whose rows carry ``org_id``. ``buckets`` is fixed when it is created: a bucket is what a change rewrites."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.buckets = spark, path.rstrip("/"), schema, buckets
        self._stored = StructType([*[StructField(f.name, f.dataType) for f in schema], StructField("bucket", IntegerType())])

    def bucket(self, org: str = "org_id") -> Column:
        return F.pmod(F.xxhash64(org), F.lit(self.buckets)).cast("int")

    def create(self, rows: DataFrame | None = None) -> OrgTable:
        """Write the whole table."""
        self._write(rows, list(range(self.buckets)))
        return self

    def touched(self, orgs: DataFrame) -> list[int]:
        """Buckets of the orgs named: at most ``buckets`` numbers."""
        return sorted(r[0] for r in orgs.select(self.bucket().alias("b")).distinct().collect())

    def read(self, orgs: DataFrame | None = None) -> DataFrame:
        """All rows, or those of the buckets that hold the orgs named."""
        return self._read(None if orgs is None else self.touched(orgs))

    def _read(self, parts: list[int] | None) -> DataFrame:
        rows = self.spark.read.schema(self._stored).parquet(self.path)
        if parts is not None:
            rows = rows.filter(F.col("bucket").isin(parts))
        return rows.filter(F.col("org_id").isNotNull()).drop("bucket")

    def replace(self, rows: DataFrame, named: DataFrame, key: str) -> list[int]:
        """The rows of the keys in ``named`` (org_id, ``key``) become ``rows`` (theirs only); returns the buckets rewritten."""
        parts = self.touched(named)
        if parts:
            stays = self._read(parts).join(named.select(key).distinct(), key, "left_anti")
            self._write(stays.unionByName(schemas.conform(rows, self.schema)), parts)
        return parts

    def replace_orgs(self, rows: DataFrame, orgs: DataFrame) -> list[int]:
        """All rows of ``orgs`` become ``rows``."""
        return self.replace(rows, orgs, "org_id")

    def upsert(self, rows: DataFrame, key: str) -> list[int]:
        """Rows by ``key``, the new ones winning; a key stays with its org."""
        return self.replace(rows, rows, key)

    def remove_orgs(self, orgs: DataFrame) -> list[int]:
        return self.replace_orgs(self.spark.createDataFrame([], self.schema), orgs)

    def _write(self, rows: DataFrame | None, parts: list[int]) -> None:
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]
        out = self.spark.range(self.buckets).filter(F.col("id").isin(parts)).select(*empty, F.col("id").cast("int").alias("bucket"))
        if rows is not None:
            out = out.unionByName(schemas.conform(rows, self.schema).withColumn("bucket", self.bucket()))
        (
            out.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket").parquet(self.path)
        )
