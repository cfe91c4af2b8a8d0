"""Table schemas of the review model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Enumerations of the data model.
ROLES = ("mine", "competitor", "tracked")
SYNC_TYPES = ("full", "incremental")
SYNC_STATES = ("ok", "error")
CONFIDENCE_LEVELS = ("high", "medium", "low")

DEFAULT_ROLE = "tracked"
DEFAULT_SERVICE_TYPE = "auto_service"


def _fields(*specs: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in specs])


_S, _L, _I, _D, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampType()
_VEC = T.ArrayType(T.FloatType(), True)

COMPANIES = _fields(
    ("org_id", _S, False),
    ("name", _S, True),
    ("rating", _D, True),
    ("review_count", _I, True),
    ("address", _S, True),
    ("categories", T.ArrayType(_S), True),
    ("role", _S, False),
    ("service_type", _S, True),
    ("created_at", _TS, True),
    ("updated_at", _TS, True),
)

RELATIONS = _fields(
    ("company_org_id", _S, False),
    ("competitor_org_id", _S, False),
    ("priority", _I, True),
    ("notes", _S, True),
    ("created_at", _TS, True),
)

#: ``date`` stays text: filters on it and its extremes are lexical.
REVIEWS = _fields(
    ("id", _L, True),
    ("org_id", _S, False),
    ("review_key", _S, False),
    ("author_name", _S, True),
    ("author_icon_url", _S, True),
    ("author_profile_url", _S, True),
    ("date", _S, True),
    ("text", _S, True),
    ("stars", _D, True),
    ("likes", _I, True),
    ("dislikes", _I, True),
    ("review_url", _S, True),
    ("business_response", _S, True),
    ("first_seen_at", _TS, True),
    ("updated_at", _TS, True),
)

#: Reviews as stored: with a flag that spares readers the text column.
STORED_REVIEWS = T.StructType([*REVIEWS.fields, T.StructField("has_text", T.BooleanType(), True)])

#: What the batch that wrote a stored review changed of it: how many of its rows had the key, their org if it is not the
#: review's, whether the table held the review, and what it counted for then. NULL where the batch did not name the review.
CHANGE = _fields(
    ("rows", _L, True),
    ("org_id", _S, True),
    ("known", T.BooleanType(), True),
    ("stars", _D, True),
    ("responded", T.BooleanType(), True),
    ("has_text", T.BooleanType(), True),
)

SYNC_LOG = _fields(
    ("seq", _L, False),
    ("org_id", _S, True),
    ("sync_type", _S, True),
    ("reviews_added", _L, False),
    ("reviews_updated", _L, False),
    ("started_at", _S, True),
    ("finished_at", _S, True),
    ("status", _S, True),
    ("error_message", _S, True),
)

TOPICS = _fields(
    ("id", _L, False),
    ("org_id", _S, False),
    ("parent_id", _L, True),
    ("name", _S, False),
    ("position", _L, True),
    ("embedding", _VEC, True),
)

REVIEW_VECTORS = _fields(
    ("review_id", _L, False),
    ("org_id", _S, True),
    ("model", _S, False),
    ("text_embedding", _VEC, True),
    ("response_embedding", _VEC, True),
    ("created_at", _TS, True),
)

ASSIGNMENTS = _fields(
    ("review_id", _L, False),
    ("topic_id", _L, False),
    ("similarity", _D, False),
    ("created_at", _TS, True),
)

SCORES = _fields(
    ("org_id", _S, False),
    ("topic_id", _L, True),
    ("score", _D, False),
    ("review_count", _L, False),
    ("confidence", _S, False),
    ("computed_at", _TS, True),
)

TABLES = {
    "companies": COMPANIES,
    "company_relations": RELATIONS,
    "reviews": REVIEWS,
    "sync_log": SYNC_LOG,
    "topic_templates": TOPICS,
    "review_embeddings": REVIEW_VECTORS,
    "review_topics": ASSIGNMENTS,
    "company_scores": SCORES,
}

_SUBTOPICS = T.ArrayType(T.StructType([
    T.StructField("name", _S),
    T.StructField("subtopics", T.ArrayType(_S)),
]))

#: One row per company of a configuration document. ``inherit`` marks a company
#: that takes its topics from another one of the same service type.
CONFIG_COMPANY = T.StructType([
    T.StructField("pos", _L),
    T.StructField("org_id", _S),
    T.StructField("name", _S),
    T.StructField("role", _S),
    T.StructField("service_type", _S),
    T.StructField("competitors", T.ArrayType(T.StructType([
        T.StructField("org_id", _S),
        T.StructField("priority", _I),
        T.StructField("notes", _S),
    ]))),
    T.StructField("topics", _SUBTOPICS),
    T.StructField("inherit", T.BooleanType()),
])

#: Attributes of one review as found on a page, before any cleaning.
RAW_REVIEW = _fields(
    ("org_id", _S, True),
    ("author_text", _S, True),
    ("avatar_style", _S, True),
    ("profile_href", _S, True),
    ("date_content", _S, True),
    ("has_rating_tag", T.BooleanType(), True),
    ("rating_content", _S, True),
    ("star_classes", T.ArrayType(_S), True),
    ("spoiler_text", _S, True),
    ("body_text", _S, True),
    ("reactions", T.ArrayType(T.StructType([
        T.StructField("label", _S),
        T.StructField("count_text", _S),
    ])), True),
    ("response_text", _S, True),
)

RAW_COMPANY = _fields(
    ("org_id", _S, True),
    ("name_text", _S, True),
    ("rating_text", _S, True),
    ("review_count_content", _S, True),
    ("address_text", _S, True),
    ("category_texts", T.ArrayType(_S), True),
)


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the columns of ``schema`` in order, NULL where ``df`` lacks one."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])
