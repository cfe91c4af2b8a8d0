"""Reviews in buckets, with the trigrams that each bucket holds, so that a text search skips buckets.

A query's runs between wildcards name trigrams that every hit must hold; only buckets with all of
them are read, and there the same expression as in a plain search decides. A query without a run
of three characters reads all buckets.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.operators import listing

#: Buckets of a table. The more there are, the fewer hold all trigrams of a query.
BUCKETS = 1024
GRAM = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def grams(text: Column) -> Column:
    """Distinct runs of three characters, A-Z in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit("(?s)(?=(.{3}))"), F.lit(1)))


def needed(query: str) -> list[str]:
    """The trigrams that every text matching ``%query%`` holds."""
    runs = re.split("[%_]", query.translate(str.maketrans(_UPPER, _LOWER)))
    return sorted({r[i : i + GRAM] for r in runs for i in range(len(r) - GRAM + 1)})


class TextIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def create(self, reviews: DataFrame) -> TextIndex:
        """Write ``reviews`` by bucket, in date order (so that a bucket holds what was said at one time), and the index."""
        place = F.pmod(F.xxhash64("org_id", F.substring("date", 1, 7)), F.lit(self.buckets)).cast("int")
        rows = reviews.withColumn("bucket", place)
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/rows")
        stored = self.spark.read.parquet(f"{self.path}/rows")
        index = stored.select("bucket", F.explode(grams(F.col("text"))).alias("gram")).distinct()
        # sorted by trigram, so that a lookup reads few row groups
        index.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{self.path}/grams")
        self._schema = stored.schema
        return self

    def candidates(self, query: str) -> list[int] | None:
        """Buckets that may hold a hit, at most ``buckets`` numbers; ``None`` stands for all."""
        wanted = needed(query)
        if not wanted:
            return None
        index = self.spark.read.schema("bucket int, gram string").parquet(f"{self.path}/grams")
        held = index.filter(F.col("gram").isin(wanted)).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
        return sorted(r["bucket"] for r in held.filter(F.col("n") == len(wanted)).collect())

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        stored = self.spark.read.schema(self._schema).parquet(f"{self.path}/rows")
        return (stored if buckets is None else stored.filter(F.col("bucket").isin(buckets))).drop("bucket")

    def search(
        self, query: str, org_id: str | None = None, stars: str | None = None, limit: int | None = listing.DEFAULT_ROWS
    ) -> DataFrame:
        """``listing.search_text`` over the buckets that may hold a hit."""
        return listing.search_text(self.rows(self.candidates(query)), query, org_id, stars, limit)
