"""Text expressions: trimming, truncation, caseless substring search, review identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
KEY_PREFIX = "sha256:"
KEY_TEXT_CHARS = 100
DIGEST_CHARS = 200
ELLIPSIS = "…"


def is_filled(col: Column) -> Column:
    """Neither NULL nor empty."""
    return col.isNotNull() & (col != "")


def has_text(rows: DataFrame) -> Column:
    """Whether a review has text: read from the stored flag where the table keeps one.

    With the flag, counting texts does not read the texts.
    """
    return F.col("has_text") if "has_text" in rows.columns else is_filled(F.col("text"))


def trim_to_null(col: Column) -> Column:
    """Strip Unicode white space; an empty remainder becomes NULL."""
    return F.nullif(
        F.regexp_replace(col, r"^[\s\p{Z}\uFEFF]+|[\s\p{Z}\uFEFF]+$", ""), F.lit("")
    )


def truncate(col: Column, chars: int = DIGEST_CHARS) -> Column:
    """First ``chars`` characters plus an ellipsis, only where the text is longer."""
    return F.when(
        F.length(col) > chars, F.concat(F.substring(col, 1, chars), F.lit(ELLIPSIS))
    ).otherwise(col)


def date_part(col: Column) -> Column:
    """Text up to the first ``T`` of an ISO date."""
    return F.substring_index(col, "T", 1)


def _literal(text: str) -> str:
    """A regular expression for one run of plain characters and ``_`` wildcards."""
    quoted = ["" if not t else "\\Q" + t.replace("\\E", "\\E\\\\E\\Q") + "\\E" for t in text.split("_")]
    return ".".join(quoted)


def contains_caseless(col: Column, query: str, fold: str = "ascii") -> Column:
    """``%query%`` match. ``%`` and ``_`` in the query stay wildcards, a backslash is literal.

    ``fold='ascii'`` ignores case for A-Z only, ``fold='unicode'`` for all letters.
    Runs between ``%`` are found one after the other without backtracking, so
    long texts cost linear time.
    """
    flags = {"ascii": "(?is)", "unicode": "(?isu)"}.get(fold)
    if flags is None:
        raise ValueError(f"unknown fold: {fold!r}")
    runs = [_literal(r) for r in query.split("%") if r]
    if len(runs) > 1:
        return col.rlike(flags + "\\A" + "".join(f"(?>.*?{r})" for r in runs))
    return col.rlike(flags + "".join(runs))


def review_key(org_id: Column, url: Column, author: Column, date: Column, text: Column) -> Column:
    """The review URL where there is one, else a SHA-256 over org, author, date and the text's start.

    The start of the text is counted in code points.
    """
    blank = F.lit("")
    seed = F.concat_ws(
        "|",
        F.coalesce(org_id, blank),
        F.coalesce(author, blank),
        F.coalesce(date, blank),
        F.coalesce(F.substring(text, 1, KEY_TEXT_CHARS), blank),
    )
    return F.when(is_filled(url), url).otherwise(F.concat(F.lit(KEY_PREFIX), F.sha2(seed, 256)))
