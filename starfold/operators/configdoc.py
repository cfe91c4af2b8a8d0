"""A nested configuration of companies, competitors and topics, flattened into tables.

Input rows follow ``schemas.CONFIG_COMPANY``: one row per company, ``pos`` being
its place in the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starfold import schemas


_DOCUMENT = (
    "companies array<struct<org_id string, name string, role string, service_type string, "
    "competitors array<struct<org_id string, priority int, notes string>>, topics string>>"
)
INHERIT = "inherit"


def parse_documents(texts: DataFrame) -> DataFrame:
    """Companies of JSON documents, one document per row of the only column.

    ``topics`` is a list, the word ``inherit`` or absent; anything else is ``malformed``
    and says nothing about the company's topics. A document without a ``companies`` list is an error.
    """
    companies = F.from_json(F.col(texts.columns[0]), _DOCUMENT)["companies"]
    checked = F.when(companies.isNotNull(), companies).otherwise(
        F.raise_error(F.lit('a configuration must have a "companies" list'))
    )
    c = F.col("c")
    listed = F.coalesce(F.ltrim(c["topics"]).startswith("["), F.lit(False))
    topics_type = next(f.dataType for f in schemas.CONFIG_COMPANY if f.name == "topics")
    return texts.select(F.posexplode(checked).alias("pos", "c")).select(
        F.col("pos").cast("bigint").alias("pos"),
        *[c[k].alias(k) for k in ("org_id", "name", "role", "service_type", "competitors")],
        F.when(listed, F.from_json(c["topics"], topics_type)).alias("topics"),
        F.coalesce(c["topics"] == INHERIT, F.lit(False)).alias("inherit"),
        (c["topics"].isNotNull() & (c["topics"] != INHERIT) & (~listed | F.from_json(c["topics"], topics_type).isNull())).alias(
            "malformed"
        ),
    )


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """Companies of one configuration file in JSON."""
    return parse_documents(spark.read.text(path, wholetext=True))


def with_defaults(config: DataFrame) -> DataFrame:
    """Absent service type, competitors and topics get their defaults."""
    nothing = F.array()
    types = {f.name: f.dataType for f in schemas.CONFIG_COMPANY}
    return config.select(
        "pos",
        "org_id",
        "name",
        "role",
        F.coalesce("service_type", F.lit(schemas.DEFAULT_SERVICE_TYPE)).alias("service_type"),
        F.coalesce("competitors", nothing.cast(types["competitors"])).alias("competitors"),
        F.coalesce("topics", nothing.cast(types["topics"])).alias("topics"),
        F.coalesce("inherit", F.lit(False)).alias("inherit"),
        _malformed(config).alias("malformed"),
    )


def _malformed(config: DataFrame) -> Column:
    given = F.col("malformed") if "malformed" in config.columns else F.lit(False)
    return F.coalesce(given, F.lit(False))


def _role_ok() -> Column:
    return F.coalesce(F.col("role").isin(*schemas.ROLES), F.lit(False))


def rejected(config: DataFrame) -> DataFrame:
    """Companies whose role is not allowed, and companies whose topics cannot be read, with the reason.

    The latter are listed all the same, but keep the topics they have.
    """
    reason = F.when(~_role_ok(), "role").when(_malformed(config), "topics").alias("reason")
    return config.select("pos", "org_id", "name", "role", reason).filter("reason IS NOT NULL")


def with_topics(config: DataFrame) -> DataFrame:
    """The companies whose topics the document states."""
    return config.filter(~_malformed(config))


def accepted(config: DataFrame) -> DataFrame:
    return with_defaults(config).filter(_role_ok())


def inherit_topics(config: DataFrame) -> DataFrame:
    """Give each inheriting company the topics of the first company of its service type that has any."""
    donors = (
        config.filter(~F.col("inherit") & (F.size("topics") > 0))
        .groupBy("service_type")
        .agg(F.min_by("topics", "pos").alias("donated"))
    )
    nothing = F.array().cast(config.schema["topics"].dataType)
    return (
        config.join(donors, "service_type", "left")
        .withColumn(
            "topics",
            F.when(F.col("inherit"), F.coalesce("donated", nothing)).otherwise(F.col("topics")),
        )
        .select(*config.columns)
    )


def company_rows(config: DataFrame) -> DataFrame:
    """One row per org. Where a document lists an org twice the later entry wins."""
    fields = ("name", "role", "service_type")
    return (
        config.groupBy("org_id")
        .agg(F.max_by(F.struct(*fields), "pos").alias("row"))
        .select("org_id", *[F.col(f"row.{c}").alias(c) for c in fields])
    )


def relation_rows(config: DataFrame) -> DataFrame:
    """One row per pair, the later mention winning."""
    flat = config.select(
        "pos", F.col("org_id").alias("company_org_id"), F.posexplode("competitors").alias("i", "c")
    )
    return (
        flat.groupBy("company_org_id", F.col("c.org_id").alias("competitor_org_id"))
        .agg(F.max_by(F.struct("c.priority", "c.notes"), F.struct("pos", "i")).alias("row"))
        .select("company_org_id", "competitor_org_id", "row.priority", "row.notes")
    )


def topic_id(org_id: Column, parent: Column, name: Column, nth: Column) -> Column:
    """Stable surrogate id of a topic from its org, its labels and its place among equal labels."""
    return F.xxhash64(org_id, F.coalesce(parent, F.lit("")), name, nth.cast("int"))


def topic_rows(config: DataFrame) -> DataFrame:
    """Parents and subtopics with stable ids; ``position`` keeps the order of the document."""
    width = 1 << 31  # no list is as long
    org, no_parent = F.col("org_id"), F.lit(None).cast("string")

    def nth(*label: str) -> Column:
        """Number of earlier entries of the same list that carry the same label."""
        return F.row_number().over(Window.partitionBy(*label[:-1]).orderBy(label[-1])) - 1

    parents = (
        config.groupBy("org_id").agg(F.max_by("topics", "pos").alias("topics"))
        .select("org_id", F.posexplode("topics").alias("i", "t"))
        .withColumn("name", F.col("t.name"))
        .withColumn("nth", nth("org_id", "name", "i"))
        .select("org_id", "i", "t", topic_id(org, no_parent, F.col("name"), F.col("nth")).alias("head"))
    )
    heads = parents.select(
        F.col("head").alias("id"),
        "org_id",
        F.lit(None).cast("bigint").alias("parent_id"),
        F.col("t.name").alias("name"),
        (F.col("i").cast("bigint") * width).alias("position"),
    )
    leaves = parents.select(
        "org_id", "i", "head", F.posexplode("t.subtopics").alias("j", "sub")
    ).withColumn("nth", nth("org_id", "head", "sub", "j")).select(
        topic_id(org, F.col("head").cast("string"), F.col("sub"), F.col("nth")).alias("id"),
        "org_id",
        F.col("head").alias("parent_id"),
        F.col("sub").alias("name"),
        (F.col("i").cast("bigint") * width + F.col("j") + 1).alias("position"),
    )
    return heads.unionByName(leaves)


def topic_counts(config: DataFrame) -> DataFrame:
    """Parent topics (dry run) and parents plus subtopics (applied) of every company."""
    total = F.aggregate(
        "topics", F.lit(0), lambda acc, t: acc + 1 + F.coalesce(F.size(t["subtopics"]), F.lit(0))
    )
    return config.select(
        "org_id", "name", "role", F.size("topics").alias("parent_topics"), total.alias("all_topics")
    )
