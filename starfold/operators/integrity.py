"""Referential and uniqueness checks: reports of the offending keys, and the split of a batch before it is written."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values: (table, column, referenced table, referenced column) and unique keys.
REFERENCES = (
    ("company_relations", "company_org_id", "companies", "org_id"),
    ("company_relations", "competitor_org_id", "companies", "org_id"),
    ("reviews", "org_id", "companies", "org_id"),
    ("sync_log", "org_id", "companies", "org_id"),
    ("topic_templates", "org_id", "companies", "org_id"),
    ("topic_templates", "parent_id", "topic_templates", "id"),
    ("review_embeddings", "review_id", "reviews", "id"),
    ("review_topics", "review_id", "reviews", "id"),
    ("review_topics", "topic_id", "topic_templates", "id"),
    ("company_scores", "org_id", "companies", "org_id"),
    ("company_scores", "topic_id", "topic_templates", "id"),
)
UNIQUE_KEYS = (
    ("companies", ("org_id",)),
    ("company_relations", ("company_org_id", "competitor_org_id")),
    ("reviews", ("review_key",)),
    ("review_embeddings", ("review_id",)),
    ("review_topics", ("review_id", "topic_id")),
    ("company_scores", ("org_id", "topic_id")),
)


def orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """Values that refer to no row: ``(table_name, column_name, value, row_count)``.

    References are reduced to distinct values before the join, so a value that
    many rows share costs one row.
    """
    parts = []
    for table, column, parent, key in REFERENCES:
        if table not in tables or parent not in tables or column not in tables[table].columns:
            continue
        uses = (
            tables[table].filter(F.col(column).isNotNull())
            .groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("row_count"))
        )
        known = tables[parent].select(F.col(key).alias("value"))
        parts.append(
            uses.join(known, "value", "left_anti").select(
                F.lit(table).alias("table_name"),
                F.lit(column).alias("column_name"),
                F.col("value").cast("string").alias("value"),
                "row_count",
            )
        )
    return reduce(DataFrame.unionByName, parts)


def repeated_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """Keys held by more than one row: ``(table_name, key, row_count)``."""
    parts = []
    for table, columns in UNIQUE_KEYS:
        if table not in tables or not set(columns) <= set(tables[table].columns):
            continue
        present = tables[table].select(*columns).dropna()
        parts.append(
            present.groupBy(*columns).agg(F.count(F.lit(1)).alias("row_count"))
            .filter(F.col("row_count") > 1)
            .select(
                F.lit(table).alias("table_name"),
                F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).alias("key"),
                "row_count",
            )
        )
    return reduce(DataFrame.unionByName, parts)


#: Column of the reasons that a quarantined row carries.
REASONS = "reasons"


def split_batch(
    table: str, batch: DataFrame, tables: dict[str, DataFrame], order_by: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """``batch`` as accepted rows and quarantined rows; the latter say in ``reasons`` which rules they break.

    Rules: references to tables in ``tables`` must be met (NULL refers to nothing; rows of the batch count
    for a table's references to itself), key columns must not be NULL, and of rows with one key the
    first by ``order_by`` is accepted. Both halves come from one pass: every reference joins the distinct
    keys of its parent as a flag, so a hot parent is one row there.
    """
    rows, flags = batch, []
    for n, (child, column, parent, key) in enumerate(REFERENCES):
        if child != table or column not in batch.columns or parent not in tables:
            continue
        known = tables[parent].select(F.col(key).alias(f"_key{n}"))
        if parent == table:
            known = known.unionByName(batch.select(F.col(key).alias(f"_key{n}")))
        known = known.filter(F.col(f"_key{n}").isNotNull()).distinct()
        rows = rows.join(known, F.col(column) == F.col(f"_key{n}"), "left")
        missing = F.col(column).isNotNull() & F.col(f"_key{n}").isNull()
        flags.append(F.when(missing, F.lit(f"{column} not in {parent}")))
    for keyed, columns in UNIQUE_KEYS:
        if keyed == table and set(columns) <= set(batch.columns):
            needed = [c for c in columns if not (table == "company_scores" and c == "topic_id")]
            flags += [F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in needed]
            place = Window.partitionBy(*columns).orderBy(*(order_by or columns))
            complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in needed])
            rows = rows.withColumn("_place", F.when(complete, F.row_number().over(place)))
            flags.append(F.when(F.col("_place") > 1, F.lit(f"{'|'.join(columns)} repeated")))
    judged = rows.select(*batch.columns, F.array_compact(F.array(*flags)).alias(REASONS) if flags else F.array().cast("array<string>").alias(REASONS))
    return judged.filter(F.size(REASONS) == 0).drop(REASONS), judged.filter(F.size(REASONS) > 0)
