"""Date and timestamp parsing and differences as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from accessloom.functions.text import strip

# FILETIME ticks (100 ns) of 1970-01-01 and of the years 1 and 10000.
FILETIME_UNIX_EPOCH = 116444736000000000
FILETIME_MIN = -504911232000000000
FILETIME_END = 2650467744000000000


def _spreadsheet_serial(text: Column) -> Column:
    number = F.when(text.rlike("^[0-9]{5}$"), text.cast("int"))
    return F.when((number > 30000) & (number < 80000), F.date_add(F.lit("1899-12-30").cast("date"), number))


def flexible_date(raw: Column) -> Column:
    """Spreadsheet serial day, then ISO, then month/day/year, then day/month/year; else null."""
    text = strip(raw)
    iso = F.when(text.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.try_to_date(text, "yyyy-M-d"))
    slashed = text.rlike("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$")
    return F.coalesce(
        _spreadsheet_serial(F.regexp_replace(text, "^0+(?=[0-9])", "")),
        iso,
        F.when(slashed, F.try_to_date(text, "M/d/yyyy")),
        F.when(slashed, F.try_to_date(text, "d/M/yyyy")),
    )


def flexible_date_error(raw: Column) -> Column:
    text = strip(raw)
    return F.when((text != "") & flexible_date(raw).isNull(), F.concat(F.lit("UNPARSEABLE_DATE:"), text))


def _ticks(raw: Column) -> Column:
    return strip(raw).try_cast("bigint")


def _ticks_in_range(ticks: Column) -> Column:
    return (ticks >= FILETIME_MIN) & (ticks < FILETIME_END)


def filetime_timestamp(raw: Column) -> Column:
    ticks = _ticks(raw)
    micros = F.floor((F.when(_ticks_in_range(ticks), ticks) - F.lit(FILETIME_UNIX_EPOCH)).cast("decimal(20,0)") / 10)
    return F.timestamp_micros(micros.cast("bigint"))


def filetime_error(raw: Column) -> Column:
    text, ticks = strip(raw), _ticks(raw)
    whole_number = text.rlike("^[+-]?[0-9]+$")
    return (
        F.when(text.isNull() | (text == ""), F.lit(None).cast("string"))
        .when(~whole_number, F.concat(F.lit("UNPARSEABLE_FILETIME:"), text))
        .when(ticks.isNull() | ~_ticks_in_range(ticks), F.concat(F.lit("FILETIME_OUT_OF_RANGE:"), text))
    )


def iso_timestamp(raw: Column) -> Column:
    """ISO-8601 date or date-time with optional fraction and zone; anything else -> null."""
    shape = "^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?(Z|[+-][0-9]{2}:[0-9]{2})?)?$"
    return F.when(raw.rlike(shape), raw.try_cast("timestamp"))


def whole_days_between(earlier: Column, later: Column) -> Column:
    """Completed 24-hour days, rounded down."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000)).cast("int")


def hours_between(earlier: Column, later: Column) -> Column:
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return micros / F.lit(3_600_000_000.0)
