"""Incremental ingestion: new files in a landing folder are merged as they arrive.

Each micro-batch is reduced per review key and merged into the review table in
one step. The rows written say what the batch changed, and from these it is logged
per org, and optionally summed, embedded and classified. Every
table records the batch number it has applied, so a batch that is delivered
again after a failure changes nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from starfold import schemas
from starfold.operators import embedding, ingest, normalize, partials, similarity
from starfold.operators.embedding import Embedder
from starfold.sources.store import Batch, Store

#: Order of the rows of a key inside one batch: by file time, then by place in the file.
RAW_ORDER = ("arrived_at", "file", "block", "line")


CORRUPT = "corrupt_record"


def read_landing(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Raw review attributes, one JSON object a line, from a landing folder.

    A line that is no such object keeps its text in ``corrupt_record``.
    """
    reader = (
        spark.readStream.schema(StructType([*schemas.RAW_REVIEW, StructField(CORRUPT, StringType())]))
        .format("json")
        .option("columnNameOfCorruptRecord", CORRUPT)
    )
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder).select(
        "*",
        F.col("_metadata.file_modification_time").alias("arrived_at"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def keyed_reviews(raw: DataFrame) -> DataFrame:
    """Normalised, keyed reviews of raw rows that carry the columns of ``RAW_ORDER``."""
    return ingest.with_review_key(normalize.normalize_reviews(raw, extra=RAW_ORDER))


def rejected_lines(rejects: DataFrame) -> DataFrame:
    """``(org_id, lines)`` of rejected lines; a line that is no object names its org where its text still does."""
    named = F.nullif(F.regexp_extract(F.col(CORRUPT), r'"org_id"\s*:\s*"([^"\\]*)"', 1), F.lit(""))
    return (
        rejects.select(F.coalesce("org_id", named).alias("org_id")).filter(F.col("org_id").isNotNull())
        .groupBy("org_id").agg(F.count(F.lit(1)).alias("lines"))
    )


def read_partials(spark: SparkSession, folder: str) -> DataFrame:
    """The partials of all batches in ``folder``."""
    return spark.read.schema(partials.SCHEMA).parquet(folder)


class ReviewIngest:
    """What one micro-batch does. ``prepare`` turns a batch into keyed reviews."""

    def __init__(
        self,
        store: Store,
        prepare: Callable[[DataFrame], DataFrame] = keyed_reviews,
        order_by: Sequence[str] = RAW_ORDER,
        embedder: Embedder | None = None,
        threshold: float = similarity.THRESHOLD,
        partials: str | None = None,
    ):
        """``partials`` names a folder that takes the signed partial sums of every batch."""
        self.store, self.prepare, self.order_by = store, prepare, order_by
        self.embedder, self.threshold, self.partials = embedder, threshold, partials

    def __call__(self, rows: DataFrame, batch_id: int) -> None:
        """``foreachBatch`` entry. Batch numbers count per stream, that is per checkpoint."""
        stream = rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        self.apply(rows, (stream or "direct", batch_id))

    def apply(self, rows: DataFrame, batch: Batch) -> None:
        store, (source, number) = self.store, batch
        place, rejects = f"{source}/{number}", None
        if CORRUPT in rows.columns:
            # Lines are numbered where they are read: within a block the numbers follow the file.
            lines = rows.withColumn("line", F.monotonically_increasing_id())
            rows = store.stage(f"arrived/{place}", lines)
            unusable = F.col("org_id").isNull() | F.col(CORRUPT).isNotNull()
            rejects = store.stage(f"rejects/{place}", rows.filter(unusable))
            rows = rows.filter(~unusable).drop(CORRUPT)
        now = F.current_timestamp()
        keyed = self.prepare(rows)
        reduced = ingest.reduce_batch(keyed, self.order_by).withColumn("first_seen_at", now).withColumn("updated_at", now)
        store.merge_reviews(reduced, batch, keyed)
        changed = store.changes(batch)
        self._log(changed, batch, rejects)
        if self.partials is not None:
            self._add_partials(changed, batch)
        if self.embedder is not None:
            self._embed_and_classify(changed, batch)
        for kind in ("arrived", "stored", "vectors"):
            store.unstage(f"{kind}/{place}")

    def _add_partials(self, changed: DataFrame, batch: Batch) -> None:
        """The batch's signed partials, in a partition of their own: a batch delivered again writes the same partition."""
        (
            partials.of_changes(changed).withColumn("source", F.lit(batch[0])).withColumn("number", F.lit(batch[1]))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "number").parquet(self.partials)
        )

    def _log(self, changed: DataFrame, batch: Batch, rejects: DataFrame | None = None) -> None:
        """One log row per org, counted against the table as it was before the batch.

        An org of which the batch holds unreadable lines only gets an ``error`` row; where some lines
        were readable the row stays ``ok`` and says how many were not.
        """
        store = self.store
        counts = ingest.counts_of_changes(changed)
        modes = ingest.sync_mode(counts, store.read("sync_log"))
        stamp: Column = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        done = modes.join(counts, "org_id")
        bad = rejected_lines(rejects) if rejects is not None else changed.sparkSession.createDataFrame([], "org_id string, lines bigint")
        both = done.join(bad, "org_id", "full")
        failed = F.col("sync_type").isNull()
        none = F.lit(0).cast("bigint")
        entries = both.select(
            F.lit(store.manifest("sync_log")["version"] + 1).cast("bigint").alias("seq"),
            "org_id",
            F.coalesce("sync_type", F.lit("incremental")).alias("sync_type"),
            F.coalesce("added", none).alias("reviews_added"),
            F.coalesce("updated", none).alias("reviews_updated"),
            stamp.alias("started_at"),
            stamp.alias("finished_at"),
            F.when(failed, "error").otherwise("ok").alias("status"),
            F.when(F.col("lines") > 0, F.concat(F.col("lines").cast("string"), F.lit(" unreadable lines"))).alias("error_message"),
        )
        store.append("sync_log", entries, batch)

    def _embed_and_classify(self, changed: DataFrame, batch: Batch) -> None:
        """Embed the batch's reviews that have no vector yet, and assign those.

        The batch is staged in narrow form, so the large tables are probed by
        id against a side of known size and never shuffled for one batch.
        """
        store, place = self.store, f"{batch[0]}/{batch[1]}"
        rows = store.stage(f"stored/{place}", changed.select("id", "org_id", "text"))
        vectors = store.read("review_embeddings", store.version_before("review_embeddings", batch))
        done = vectors.select("review_id").join(
            rows.select(F.col("id").alias("review_id")), "review_id", "left_semi"
        )
        new = store.stage(f"vectors/{place}", embedding.embed_reviews(rows, done, self.embedder))
        now = F.current_timestamp()
        store.append("review_embeddings", new.withColumn("created_at", now), batch)
        assigned = similarity.classify(new, rows, store.read("topic_templates"), self.threshold)
        store.append("review_topics", assigned.withColumn("created_at", now), batch)


def start(
    stream: DataFrame, step: ReviewIngest, checkpoint: str, available_now: bool = True, every: str = "1 minute"
) -> StreamingQuery:
    """Run the ingestion on what has arrived and stop, or keep polling ``every`` so often."""
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
