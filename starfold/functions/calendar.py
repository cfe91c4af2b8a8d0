"""Calendar expressions over ISO date text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Recency steps in seconds (30-day months) and their weights.
RECENT_SECONDS = 180 * 86400
AGEING_SECONDS = 360 * 86400
RECENT_WEIGHT = 2.0
AGEING_WEIGHT = 1.5
OLD_WEIGHT = 1.0

_PLAIN = r"^\d{4}-\d{2}-\d{2}$"
_TIMED = (
    r"^\d{4}-\d{2}-\d{2}[\sT]*"
    r"(?:([01]\d|2[0-4]):([0-5]\d)(?::([0-5]\d)(?:\.\d+)?)?\s*(?:[Zz]|([+-])(0\d|1[0-4]):([0-5]\d))?\s*)?$"
)


def _calendar_day(text: Column) -> Column:
    """Day named by the first ten characters. Day 30 of February rolls over into March."""
    first = F.concat(F.substring(text, 1, 7), F.lit("-01")).try_cast("date")
    day = F.substring(text, 9, 2).try_cast("int")
    return F.when(day.between(1, 31), F.date_add(first, day - 1))


def _seconds_past_day(text: Column) -> Column:
    """Time of day in seconds, moved to UTC by a trailing zone; may leave the 0..86399 range."""

    def part(group: int) -> Column:
        return F.coalesce(
            F.nullif(F.regexp_extract(text, _TIMED, group), F.lit("")).try_cast("bigint"),
            F.lit(0).cast("bigint"),
        )

    sign = F.when(F.regexp_extract(text, _TIMED, 4) == "-", -1).otherwise(1)
    return part(1) * 3600 + part(2) * 60 + part(3) - sign * (part(5) * 3600 + part(6) * 60)


def _plain_day(text: Column) -> Column:
    """Day of a valid plain ``YYYY-MM-DD``, without regular expressions; NULL for all other text."""
    shape = (
        (F.length(text) == 10)
        & (F.substring(text, 5, 1) == "-")
        & (F.substring(text, 8, 1) == "-")
        & F.substring(text, 10, 1).between("0", "9")
    )
    return F.when(shape, text.try_cast("date"))


def utc_day(text: Column) -> Column:
    """Calendar day in UTC of an ISO date or date-time; NULL when it is not one."""
    day = _calendar_day(text)
    shift = F.floor(_seconds_past_day(text) / 86400).cast("int")
    other = F.when(text.rlike(_PLAIN), day).when(text.rlike(_TIMED), F.date_add(day, shift))
    return F.coalesce(_plain_day(text), other)


def utc_seconds(text: Column) -> Column:
    """Seconds since 1970 in UTC of an ISO date or date-time; NULL when it is not one."""

    def midnight(day: Column) -> Column:
        return F.unix_date(day).cast("bigint") * 86400

    day = _calendar_day(text)
    other = F.when(text.rlike(_PLAIN), midnight(day)).when(
        text.rlike(_TIMED), midnight(day) + _seconds_past_day(text)
    )
    return F.coalesce(midnight(_plain_day(text)), other)


def _padded(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def month_label(day: Column) -> Column:
    return F.concat(_padded(F.year(day), 4), F.lit("-"), _padded(F.month(day), 2))


def week_label(day: Column) -> Column:
    """``YYYY-Www`` with weeks starting on Monday; days before the first Monday are week 00."""
    week = F.floor((F.dayofyear(day) + 6 - F.weekday(day)) / 7)
    return F.concat(_padded(F.year(day), 4), F.lit("-W"), _padded(week, 2))


def quarter_label(day: Column) -> Column:
    return F.concat(_padded(F.year(day), 4), F.lit("-Q"), F.quarter(day).cast("string"))


PERIOD_LABELS = {"month": month_label, "week": week_label, "quarter": quarter_label}


def recency_weight(text: Column, as_of: str) -> Column:
    """Weight of a review by its age at ``as_of`` (ISO text, UTC).

    Future dates count as recent, dates that cannot be read as old.
    """
    age = F.lit(as_of_seconds(as_of)) - utc_seconds(text)
    return (
        F.when(age <= RECENT_SECONDS, RECENT_WEIGHT)
        .when(age <= AGEING_SECONDS, AGEING_WEIGHT)
        .otherwise(OLD_WEIGHT)
    )


def as_of_seconds(as_of: str) -> int:
    from datetime import datetime, timezone

    moment = datetime.fromisoformat(as_of)
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    return int(moment.timestamp())
