"""Series ids, currency pairs and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SERIES_PREFIX = "FX"
QUOTE = "CAD"


def base_currency(series: Column) -> Column:
    known = series.startswith(SERIES_PREFIX) & (F.length(series) == 8)
    return F.when(known, F.substring(series, 3, 3))


def quote_currency(series: Column) -> Column:
    known = series.startswith(SERIES_PREFIX) & (F.length(series) == 8)
    return F.when(known, F.substring(series, 6, 3))


def is_pair_series(series: Column) -> Column:
    """Ids that carry the prefix and end with the quote currency."""
    return series.rlike(f"^{SERIES_PREFIX}(?s:.*){QUOTE}$")


def pair_of_series(series: Column, strict: bool = False) -> Column:
    """``FXUSDCAD`` to ``USD_CAD``; other ids give null, or fail the job when ``strict``."""
    currency = F.substring(series, F.lit(len(SERIES_PREFIX) + 1), F.length(series) - len(SERIES_PREFIX) - len(QUOTE))
    pair = F.concat(currency, F.lit(f"_{QUOTE}"))
    if strict:
        refused = F.raise_error(F.concat(F.lit("not a pair series: "), series)).cast("string")
        return F.when(is_pair_series(series), pair).otherwise(refused)
    return F.when(is_pair_series(series), pair)


def series_of_pair(pair: Column) -> Column:
    """``USD_CAD`` to ``FXUSDCAD``; text that is already a series id, or has no ``_``, is kept."""
    at = F.locate("_", pair)
    split = F.concat(
        F.lit(SERIES_PREFIX), F.substring(pair, F.lit(1), at - 1), F.substring(pair, at + 1, F.length(pair))
    )
    return F.when(at == 0, pair).otherwise(split)


def normal_pair(pair: Column) -> Column:
    return F.upper(F.replace(F.trim(pair), F.lit("/"), F.lit("_")))


def pair_list(text: Column) -> Column:
    """Comma-separated pairs to an array of normal pairs; empty text gives an empty array."""
    parts = F.transform(F.split(text, ","), normal_pair)
    return F.filter(parts, lambda p: p != "")


def pair_label(pair: Column) -> Column:
    return F.replace(pair, F.lit("_"), F.lit("/"))


def series_label(series: Column) -> Column:
    """``USD/CAD`` for readable ids, else the id itself."""
    known = series.startswith(SERIES_PREFIX) & (F.length(series) >= 8)
    return F.when(known, F.concat_ws("/", F.substring(series, 3, 3), F.substring(series, 6, 3))).otherwise(series)


def slug(text: Column) -> Column:
    """A file-name-safe form."""
    return F.btrim(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), F.lit("_"))


def email_key(email: Column) -> Column:
    """A stable 16-digit id of an address."""
    return F.substring(F.sha2(F.lower(F.trim(email)), 256), 1, 16)
