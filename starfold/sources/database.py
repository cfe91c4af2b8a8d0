"""Tables kept in a relational database, read into the model's schemas.

The JDBC driver of the database must be on Spark's class path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starfold import schemas
from starfold.functions import vectors as vec


def read_table(
    spark: SparkSession,
    url: str,
    table: str,
    split_on: str | None = None,
    low: int = 0,
    high: int = 0,
    parts: int = 1,
    **options: str,
) -> DataFrame:
    """A database table by JDBC; ``split_on`` names a numeric column to read in ``parts`` ranges.

    Filters and column choices made on the result are pushed into the database.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if split_on is not None:
        reader = reader.options(
            partitionColumn=split_on, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts)
        )
    return adopt(table, reader.load())


def adopt(table: str, rows: DataFrame) -> DataFrame:
    """Database rows in the model's types.

    Vectors may be little-endian float32 bytes or ``[a,b,...]`` text, lists may
    be JSON text, and topic positions default to the row id.
    """
    schema = schemas.TABLES[table]
    found = {f.name: f.dataType for f in rows.schema}

    def column(field: T.StructField) -> Column:
        kind, col = found.get(field.name), F.col(field.name)
        if kind is None:
            if table == "topic_templates" and field.name == "position":
                return F.col("id").cast("bigint").alias("position")
            if table == "sync_log" and field.name == "seq":
                return F.col("id").cast("bigint").alias("seq")
            return F.lit(None).cast(field.dataType).alias(field.name)
        if isinstance(field.dataType, T.ArrayType):
            if isinstance(kind, T.BinaryType):
                col = vec.decode_f32(col)
            elif isinstance(kind, T.StringType) and isinstance(field.dataType.elementType, T.FloatType):
                col = vec.parse_vector_text(col)
            elif isinstance(kind, T.StringType):
                col = F.from_json(col, field.dataType)
        return col.cast(field.dataType).alias(field.name)

    return rows.select(*[column(f) for f in schema])
