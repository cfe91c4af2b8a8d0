"""Raw page attributes to clean review and company rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starfold.functions import numbers as nm
from starfold.functions import text as tx

# Markers found in the raw attributes and the public form of a review's URL.
EMPTY_STAR = "_empty"
HALF_STAR = "_half"
LIKE_LABEL = "Лайк"
DISLIKE_LABEL = "Дизлайк"
AVATAR_PATTERN = r"""url\(["']?(.*?)["']?\)"""
REVIEW_URL = (
    "https://yandex.ru/maps/org/{org_id}/reviews?reviews%5BpublicId%5D={public_id}&utm_source=review"
)


def count_stars(classes: Column) -> Column:
    """Filled stars count one, half stars a half, empty stars nothing."""
    worth = F.transform(
        classes,
        lambda c: F.when(F.coalesce(c.contains(EMPTY_STAR), F.lit(False)), 0.0)
        .when(F.coalesce(c.contains(HALF_STAR), F.lit(False)), 0.5)
        .otherwise(1.0),
    )
    return F.coalesce(F.aggregate(worth, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))


def avatar_url(style: Column) -> Column:
    return F.when(style.rlike(AVATAR_PATTERN), F.regexp_extract(style, AVATAR_PATTERN, 1))


def last_path_element(url: Column) -> Column:
    """What follows the last slash, one trailing slash aside; NULL when nothing does."""
    bare = F.regexp_replace(url, r"/\z", "")
    return F.nullif(F.substring_index(bare, "/", -1), F.lit(""))


def review_url(org_id: Column, profile: Column, template: str = REVIEW_URL) -> Column:
    """NULL when the profile link is NULL, empty or names no id."""
    before, rest = template.split("{org_id}")
    middle, after = rest.split("{public_id}")
    return F.concat(F.lit(before), org_id, F.lit(middle), last_path_element(profile), F.lit(after))


def reaction_count(reactions: Column, label: str) -> Column:
    """Count of the last reaction whose label contains ``label``; 0 when there is none."""
    hits = F.filter(reactions, lambda r: r["label"].contains(label))
    return F.coalesce(nm.leading_int(F.try_element_at(hits, F.lit(-1))["count_text"]), F.lit(0))


def normalize_reviews(
    raw: DataFrame, url_template: str = REVIEW_URL, extra: Sequence[str] = ()
) -> DataFrame:
    """Clean reviews of raw attributes; ``extra`` columns are carried along."""
    c = F.col
    stars = F.when(
        c("has_rating_tag"), F.coalesce(nm.leading_number(c("rating_content")), F.lit(0.0))
    ).otherwise(count_stars(c("star_classes")))
    return raw.select(
        "org_id",
        tx.trim_to_null(c("author_text")).alias("author_name"),
        avatar_url(c("avatar_style")).alias("author_icon_url"),
        c("profile_href").alias("author_profile_url"),
        c("date_content").alias("date"),
        tx.trim_to_null(F.coalesce(c("spoiler_text"), c("body_text"))).alias("text"),
        stars.alias("stars"),
        reaction_count(c("reactions"), LIKE_LABEL).alias("likes"),
        reaction_count(c("reactions"), DISLIKE_LABEL).alias("dislikes"),
        review_url(c("org_id"), c("profile_href"), url_template).alias("review_url"),
        tx.trim_to_null(c("response_text")).alias("business_response"),
        *extra,
    )


def normalize_companies(raw: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Clean companies of raw attributes; ``extra`` columns are carried along."""
    c = F.col
    names = F.filter(F.transform(c("category_texts"), tx.trim_to_null), lambda x: x.isNotNull())
    return raw.select(
        "org_id",
        tx.trim_to_null(c("name_text")).alias("name"),
        nm.first_number(c("rating_text")).alias("rating"),
        nm.leading_int(c("review_count_content")).alias("review_count"),
        tx.trim_to_null(c("address_text")).alias("address"),
        F.coalesce(names, F.array().cast("array<string>")).alias("categories"),
        *extra,
    )


def total_counts(companies: DataFrame, reviews: DataFrame) -> DataFrame:
    """Announced number of reviews per org, or the number found where none was announced."""
    found = reviews.groupBy("org_id").agg(F.count(F.lit(1)).alias("found"))
    announced = F.when(F.col("review_count") != 0, F.col("review_count").cast("bigint"))
    return companies.join(found, "org_id", "left").select(
        "org_id", F.coalesce(announced, F.col("found"), F.lit(0)).alias("total_count")
    )
