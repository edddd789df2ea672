"""Numbers, dates and money expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import blank_to_null, strip

NOT_SPECIFIED = "Not specified"


def nan_to_null(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def whole_number(col: Column, kind: str = "double") -> Column:
    """Integer or null: floats are cut, anything unparseable or not finite is null."""
    if kind == "string":
        text = strip(col)
        return F.when(text.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), F.replace(text, F.lit("_"), F.lit("")).try_cast("int"))
    return nan_to_null(col).try_cast("int")


def _grouped(amount: Column) -> Column:
    return F.format_number(amount.cast("bigint"), 0)


def salary_range(low: Column, high: Column, prefix: Column) -> Column:
    """``prefix`` carries its own blank, if any. Zero counts as missing."""
    has_low = F.coalesce(low != 0, F.lit(False))
    has_high = F.coalesce(high != 0, F.lit(False))
    return (
        F.when(has_low & has_high, F.concat(prefix, _grouped(low), F.lit(" - "), F.when(
            F.endswith(prefix, F.lit(" ")), F.lit("")).otherwise(prefix), _grouped(high)))
        .when(has_low, F.concat(prefix, _grouped(low), F.lit("+")))
        .when(has_high, F.concat(F.lit("Up to "), prefix, _grouped(high)))
        .otherwise(F.lit(NOT_SPECIFIED))
    )


def salary_with_currency(low: Column, high: Column, currency: Column) -> Column:
    return salary_range(low, high, F.concat(F.coalesce(blank_to_null(currency), F.lit("USD")), F.lit(" ")))


def salary_in_dollars(text: Column, low: Column, high: Column) -> Column:
    """A ready-made text wins over the bounds."""
    return F.coalesce(blank_to_null(strip(text)), salary_range(low, high, F.lit("$")))


def date_from_epoch(seconds: Column) -> Column:
    return F.when(seconds != 0, F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd"))


def date_prefix(text: Column) -> Column:
    return F.substring(blank_to_null(text), 1, 10)


def date_before_t(text: Column) -> Column:
    """Day part of an ISO timestamp, else the first ten characters."""
    clean = strip(blank_to_null(text))
    return F.when(F.contains(clean, F.lit("T")), F.split_part(clean, F.lit("T"), F.lit(1))).otherwise(
        F.substring(clean, 1, 10))


def tolerant_timestamp(text: Column) -> Column:
    """Timestamp or null; a full day is required, so a bare year is not a date."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), text.try_cast("timestamp"))
