"""Two-pass external shuffle into equal shards.

Pass one scatters the records over buckets by a seeded hash, as many buckets as
memory-sized pieces fit into the data. Pass two orders each bucket canonically,
shuffles it (Fisher-Yates, seeded by bucket) and writes it at its place in the
global sequence. Shard ``s`` of ``k`` holds the positions from ``s * n // k`` on,
so shard counts differ by one at most and a slot is the place within the shard.

Edge cases: a NULL text has size 8 and the CRC of no bytes; records are
scattered by id and text; equal records are shuffled like any others; an
empty table gives no shards; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.llm.common import partitions, work_path

LAW = "rows"
SCHEMA = "doc_id long, text string, shard int, slot long"


def record_bytes(text):
    """UTF-8 bytes of the text plus eight for the id."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def _scatter(docs: DataFrame, seed: int) -> DataFrame:
    key = F.xxhash64(F.lit(seed), "doc_id", "text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key.alias("h"))


def write_shards(docs: DataFrame, shards: int, seed: int = 20240229, bucket_bytes: int = 24 << 20) -> str:
    """Shuffle ``docs`` (doc_id, text) into ``shards`` folders of Parquet; returns the path.

    The driver holds one count per bucket, that is one number for ``bucket_bytes`` of data.
    """
    spark = docs.sparkSession
    keyed = _scatter(docs, seed)
    total = docs.agg(F.sum(record_bytes("text"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    keyed = keyed.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    counts = np.zeros(buckets + 1, dtype=np.int64)
    for row in keyed.groupBy("bucket").count().collect():
        counts[row["bucket"] + 1] = row["count"]
    starts = np.cumsum(counts)
    n = int(starts[-1])
    edges = np.array([s * n // shards for s in range(shards)], dtype=np.int64)

    def shuffled(key, bucket):
        number = key[0].as_py()
        order = bucket.select(["h", "doc_id", "text"]).sort_by(
            [("h", "ascending"), ("doc_id", "ascending"), ("text", "ascending")]
        )
        dice = np.random.Generator(np.random.PCG64([seed, number]))
        place = dice.permutation(order.num_rows)
        position = starts[number] + np.arange(order.num_rows)
        shard = np.searchsorted(edges, position, side="right") - 1
        mixed = order.select(["doc_id", "text"]).take(pa.array(place))
        return mixed.append_column("shard", pa.array(shard.astype(np.int32))).append_column(
            "slot", pa.array(position - edges[shard])
        )

    path = work_path(spark, "shards")
    (
        keyed.repartition(max(partitions(spark), 1), "bucket")
        .groupBy("bucket")
        .applyInArrow(shuffled, SCHEMA)
        .sortWithinPartitions("shard", "slot")
        .write.option("compression", "zstd")
        .partitionBy("shard")
        .parquet(path)
    )
    return path


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def digest(written: DataFrame) -> DataFrame:
    """One row per record, from the written shards."""
    return written.select(
        "doc_id",
        record_bytes("text").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit(LAW).alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
