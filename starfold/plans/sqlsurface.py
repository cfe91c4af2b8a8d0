"""Free SQL over the model's tables."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.schemas import TABLES
from starfold.sources.store import Store


def query(spark: SparkSession, text: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Run one SQL text with the given tables as views of those names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text)


def stored_tables(store: Store) -> dict[str, DataFrame]:
    """The eight tables of a store under their own names."""
    return {name: store.read(name) for name in TABLES}


def as_json(rows: DataFrame, pretty: bool = False) -> DataFrame:
    """Each row as one JSON object, NULL fields written out."""
    options = {"ignoreNullFields": "false", "pretty": str(pretty).lower()}
    return rows.select(F.to_json(F.struct(*rows.columns), options).alias("json"))


def write_json(rows: DataFrame, folder: str) -> None:
    """A result as JSON lines, NULL fields written out."""
    rows.write.mode("errorifexists").option("ignoreNullFields", "false").json(folder)


def query_json(
    spark: SparkSession, text: str, tables: dict[str, DataFrame], pretty: bool = False
) -> DataFrame:
    """Rows of a SQL text as JSON objects; a text Spark refuses gives one ``{"error": ...}`` row."""
    try:
        return as_json(query(spark, text, tables), pretty)
    except PySparkException as refused:
        message = refused.getMessage() or str(refused)
        return spark.range(1).select(
            F.to_json(F.struct(F.lit(message).alias("error"))).alias("json")
        )
