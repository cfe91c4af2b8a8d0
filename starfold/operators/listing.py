"""Row listings over reviews and companies: filters, digests, text search."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starfold.functions import text as tx

# Default sizes of the reports; the number a star bound starts with.
DEFAULT_ROWS = 50
LEADING_NUMBER = re.compile(r"\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)")


def newest_first() -> list[Column]:
    return [F.col("date").desc_nulls_last(), F.col("id").asc()]


def parse_star_range(text: str | None) -> tuple[float | None, float | None]:
    """``"a-b"`` or ``"a"`` to bounds: the number each part starts with.

    What starts with no number becomes NaN, which no row passes.
    """
    if not text:
        return None, None

    def number(part: str) -> float:
        found = LEADING_NUMBER.match(part)
        return float(found[1]) if found else float("nan")

    parts = text.split("-")
    low = number(parts[0])
    return low, number(parts[1]) if len(parts) > 1 else low


def filter_reviews(
    reviews: DataFrame,
    org_id: str | None = None,
    since: str | None = None,
    stars: str | None = None,
) -> DataFrame:
    """Optional predicates, all of which must hold. ``since`` compares as text."""
    if org_id is not None:
        reviews = reviews.filter(F.col("org_id") == org_id)
    if since:
        reviews = reviews.filter(F.col("date") >= since)
    low, high = parse_star_range(stars)
    for bound, keep in ((low, F.col("stars") >= F.lit(low)), (high, F.col("stars") <= F.lit(high))):
        if bound is None:
            continue
        reviews = reviews.filter(F.lit(False) if bound != bound else keep)
    return reviews


#: Spark cuts input partitions to the wanted rows per group up to this rank
#: (spark.sql.optimizer.windowGroupLimitThreshold).
PRUNED_RANK = 1000
SLICES = 256


def _cut(df: DataFrame, limit: int, group: list[str], order: list[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank")


def first_per_org(df: DataFrame, limit: int | None, order: list[Column]) -> DataFrame:
    """At most ``limit`` rows of every org.

    Spark cuts each input partition to ``limit`` rows per org before the
    shuffle (WindowGroupLimit), so a dominant org sends few rows to its task.
    Above the rank Spark does this for, narrow rows are ranked, slices of an org
    first, and the other columns join the winners by id.
    """
    if limit is None:
        return df
    if limit <= PRUNED_RANK:
        return _cut(df, limit, ["org_id"], order)
    narrow = df.select("id", "org_id", "date").withColumn("_slice", F.pmod(F.xxhash64("id"), F.lit(SLICES)))
    first = _cut(_cut(narrow, limit, ["org_id", "_slice"], order), limit, ["org_id"], order)
    return df.join(first.select("id"), "id", "left_semi").select(*df.columns)


def newest(reviews: DataFrame, limit: int | None = None) -> DataFrame:
    """The newest reviews of all, whatever their org."""
    rows = reviews.orderBy(*newest_first())
    return rows if limit is None else rows.limit(limit)


def list_reviews(
    reviews: DataFrame,
    org_id: str | None = None,
    since: str | None = None,
    stars: str | None = None,
    limit: int | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Reviews newest first, for one org or for every org; ``limit`` counts per org."""
    rows = filter_reviews(reviews, org_id, since, stars)
    if org_id is not None:
        return newest(rows, limit) if ordered or limit is not None else rows
    rows = first_per_org(rows, limit, newest_first())
    return rows.orderBy("org_id", *newest_first()) if ordered else rows


def unanswered(
    reviews: DataFrame,
    org_id: str | None = None,
    since: str | None = None,
    stars: str | None = None,
    limit: int | None = DEFAULT_ROWS,
    ordered: bool = True,
) -> DataFrame:
    """Newest reviews without a response. An empty response counts as one."""
    open_ = reviews.filter(F.col("business_response").isNull())
    return list_reviews(open_, org_id, since, stars, limit, ordered).select(
        "id", "org_id", tx.date_part(F.col("date")).alias("date"), "stars", "text", "author_name", "review_url"
    )


def digest(
    reviews: DataFrame,
    org_id: str | None = None,
    since: str | None = None,
    stars: str | None = None,
    limit: int | None = DEFAULT_ROWS,
    shorten: bool = True,
    responses: bool = False,
    ordered: bool = True,
) -> DataFrame:
    """Compact listing: date, stars, shortened text, response flag, optionally the response."""
    cut = tx.truncate if shorten else (lambda c: c)
    response = F.col("business_response")
    out = [
        F.col("id"),
        F.col("org_id"),
        tx.date_part(F.col("date")).alias("date"),
        F.col("stars"),
        cut(F.col("text")).alias("text"),
        response.isNotNull().alias("has_response"),
    ]
    if responses:
        out.append(F.when(tx.is_filled(response), cut(response)).alias("response"))
    return list_reviews(reviews, org_id, since, stars, limit, ordered).select(*out)


def search_columns() -> list[Column]:
    return [
        F.col("id"),
        F.col("org_id"),
        F.col("date"),
        F.col("stars"),
        F.col("text"),
        F.col("author_name"),
        F.col("business_response").isNotNull().alias("has_response"),
    ]


def search_text(
    reviews: DataFrame,
    query: str,
    org_id: str | None = None,
    stars: str | None = None,
    limit: int | None = DEFAULT_ROWS,
    fold: str = "ascii",
) -> DataFrame:
    """Newest reviews whose text contains the query, over all orgs unless one is named."""
    hits = filter_reviews(reviews, org_id, None, stars).filter(
        tx.contains_caseless(F.col("text"), query, fold)
    )
    return newest(hits.select(*search_columns()), limit)


def list_companies(companies: DataFrame, role: str | None = None) -> DataFrame:
    if role is not None:
        companies = companies.filter(F.col("role") == role)
    return companies.orderBy("name", "org_id")


def competitors_of(
    companies: DataFrame, relations: DataFrame, org_id: str | None = None
) -> DataFrame:
    """Competitors with their company columns, by name; of one company or of every company."""
    if org_id is not None:
        relations = relations.filter(F.col("company_org_id") == org_id)
    pairs = relations.select("company_org_id", F.col("competitor_org_id").alias("org_id"))
    return (
        pairs.join(companies, "org_id")
        .select("company_org_id", *companies.columns)
        .orderBy("company_org_id", "name", "org_id")
    )
