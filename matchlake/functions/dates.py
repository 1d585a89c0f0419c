"""Repair and parsing of match dates kept as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.functions.scalar import as_lit, to_col

# ---- fixed values: date layouts ---------------------------------------------
ISO_LAYOUT = r"^(\d{4})-(\d{2})-(\d{2})"
SLASH_LAYOUT = r"(\d{1,2})/(\d{1,2})/(\d{4})"
# -----------------------------------------------------------------------------


def _iso_parts(text) -> tuple[Column, Column, Column]:
    return tuple(F.regexp_extract(to_col(text), ISO_LAYOUT, i) for i in (1, 2, 3))


def swap_when_month_too_large(text) -> Column:
    """First rule: the middle field cannot be a month, so it is the day."""
    year, mid, last = _iso_parts(text)
    return F.when(mid.try_cast("int") > 12, F.concat_ws("-", year, last, mid)).otherwise(
        to_col(text)
    )


def swap_when_in_future(text, ref_date) -> Column:
    """Second rule: a date after the reference day is swapped if that is a valid date.

    Text that is not a valid date as it stands is left alone.
    """
    year, mid, last = _iso_parts(text)
    iso = F.regexp_extract(to_col(text), ISO_LAYOUT, 0)
    swapped = F.concat_ws("-", year, last, mid)
    return F.when(
        (F.try_to_date(iso) > as_lit(ref_date)) & F.try_to_date(swapped).isNotNull(), swapped
    ).otherwise(to_col(text))


def normalize_match_date(text, ref_date=None) -> Column:
    """Both rules, then a date; null when no valid date results."""
    fixed = swap_when_month_too_large(text)
    if ref_date is not None:
        fixed = swap_when_in_future(fixed, ref_date)
    return F.try_to_date(F.regexp_extract(fixed, ISO_LAYOUT, 0))


def date_repair_reason(text, ref_date=None) -> Column:
    first = swap_when_month_too_large(text)
    reason = F.when(normalize_match_date(text, ref_date).isNull(), F.lit("invalid")).when(
        first != to_col(text), F.lit("swapped")
    )
    if ref_date is not None:
        reason = reason.when(swap_when_in_future(first, ref_date) != first, F.lit("future"))
    return reason.otherwise(F.lit("kept"))


def slash_date(text, day_first: bool = True) -> Column:
    """First d/m/yyyy (or m/d/yyyy) found in a text as ISO text with zero padding."""
    a, b, year = (F.regexp_extract(to_col(text), SLASH_LAYOUT, i) for i in (1, 2, 3))
    day, month = (a, b) if day_first else (b, a)
    return F.when(
        year != "", F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    )


def with_repaired_date(df: DataFrame, column: str = "match_date", ref_date=None) -> DataFrame:
    """Typed ``column``; the text stays in ``<column>_raw`` and the reason beside it."""
    raw = f"{column}_raw"
    return (
        df.withColumnRenamed(column, raw)
        .withColumn(column, normalize_match_date(raw, ref_date))
        .withColumn("date_repair", date_repair_reason(raw, ref_date))
    )
