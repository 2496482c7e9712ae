"""Dates written by people, month spans, clocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline import fixed
from sieveline.functions.bind import bind
from sieveline.functions.patterns import SPACES

DAY_MICROS = 86_400_000_000


def micros(moment: Column) -> Column:
    """Microseconds on the clock; a time without a zone is read in the session's."""
    return F.unix_micros(moment.cast("timestamp"))


def month_index(moment: Column) -> Column:
    """Months since year zero, January = 0."""
    return F.year(moment) * 12 + F.month(moment) - 1


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).cast("int")


def parse_month(raw: Column, year_only_month: int, as_of: Column) -> Column:
    """Month index of a written date; null when it cannot be read.

    Reads a month name and year, month/year, year-month, a bare year (``year_only_month`` decides the
    month, 0 for starts and 11 for ends) and the words for "still there".
    """
    spaced = F.regexp_replace(F.regexp_replace(raw, f"^[{SPACES}]+|[{SPACES}]+$", ""), "[.,]", " ")
    named = r"(?i)^([a-z]{3,9}) *'?(\d{2}|\d{4})$"
    month_first = r"^(\d{1,2}) *[/\-] *(\d{4})$"
    year_first = r"^(\d{4}) *[/\-] *(\d{1,2})$"

    def read(text: Column) -> Column:
        name = F.substring(F.lower(F.regexp_extract(text, named, 1)), 1, 3)
        name_month = F.nullif(F.array_position(F.array(*[F.lit(m) for m in fixed.MONTHS]), name), F.lit(0)).cast("int")
        year = _number(text, named, 2)
        full_year = F.when(year < 100, year + 2000).otherwise(year)
        return (
            F.when(text == "", F.lit(None).cast("int"))
            .when(text.rlike(fixed.PRESENT_PATTERN), month_index(as_of))
            .when(text.rlike(named), full_year * 12 + name_month - 1)
            .when(text.rlike(month_first) & _number(text, month_first, 1).between(1, 12),
                  _number(text, month_first, 2) * 12 + _number(text, month_first, 1) - 1)
            .when(text.rlike(year_first) & _number(text, year_first, 2).between(1, 12),
                  _number(text, year_first, 1) * 12 + _number(text, year_first, 2) - 1)
            .when(text.rlike(r"^\d{4}$"), text.cast("int") * 12 + year_only_month)
        )

    return bind(F.regexp_replace(spaced, f"[{SPACES}]+", " "), read)


def role_span(start_raw: Column, end_raw: Column, as_of: Column) -> Column:
    """struct(first, last, months) of a role, both ends included; null if unread or inverted."""
    ends = F.struct(
        parse_month(start_raw, 0, as_of).alias("first"),
        parse_month(F.coalesce(end_raw, F.lit("present")), 11, as_of).alias("last"),
    )
    return bind(
        ends,
        lambda e: F.when(
            e["last"] >= e["first"],
            F.struct(e["first"].alias("first"), e["last"].alias("last"), (e["last"] - e["first"] + 1).alias("months")),
        ),
    )


def duration_text(months: Column) -> Column:
    years, rest = F.floor(months / 12), months % 12
    return (
        F.when(months.isNull(), F.lit("duration unknown"))
        .when(years == 0, F.concat(rest.cast("string"), F.lit("m")))
        .when(rest == 0, F.concat(years.cast("string"), F.lit("y")))
        .otherwise(F.concat(years.cast("string"), F.lit("y "), rest.cast("string"), F.lit("m")))
    )


def whole_days(since: Column, now: Column) -> Column:
    """Days gone by on the exact clock, rounded down."""
    return F.floor((micros(now) - micros(since)) / DAY_MICROS).cast("int")


def older_than(since: Column, days: Column, now: Column) -> Column:
    return micros(now) - micros(since) >= days * F.lit(DAY_MICROS)


def minutes_after(moment: Column, minutes: Column) -> Column:
    return F.timestamp_micros((micros(moment) + minutes.cast("bigint") * 60_000_000).cast("bigint"))


def local_date(moment: Column) -> Column:
    """Calendar date at +05:30."""
    return F.to_date(F.from_utc_timestamp(moment, fixed.LOCAL_ZONE))


def weeks_left(target_date: Column, now: Column) -> Column:
    """Whole weeks to the end of the target day at +05:30, never below zero."""
    deadline = F.to_utc_timestamp(F.to_timestamp(F.concat(target_date.cast("string"), F.lit(" 23:59:59"))), fixed.LOCAL_ZONE)
    weeks = F.floor((micros(deadline) - micros(now)) / (7 * DAY_MICROS))
    return F.greatest(F.lit(0), weeks).cast("int")


def long_date(day: Column) -> Column:
    return F.date_format(day, "d MMMM yyyy")


def backoff_seconds(retry: Column) -> Column:
    """Doubling delay of the n-th retry; null once retries are used up."""
    delay = F.least(F.lit(float(fixed.BACKOFF_MAX_SECONDS)), F.lit(fixed.BACKOFF_FIRST_SECONDS) * F.pow(F.lit(2.0), retry - 1))
    return F.when(retry.between(1, fixed.MAX_TRANSIENT_RETRIES), delay.cast("int"))


def half_up(number: Column, places: int) -> Column:
    scale = float(10**places)
    return F.floor(number * scale + 0.5) / scale
