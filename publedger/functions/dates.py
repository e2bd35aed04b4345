"""Dates, clock times and periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from publedger.functions.numbers import col, half_up

#: Spreadsheet day numbers outside this range are not treated as dates.
SERIAL_MIN, SERIAL_MAX, SERIAL_EPOCH = 40_000, 50_000, 25_569

# The ordinal words a period label uses for its quarters.
QUARTER_WORDS = (("ראשון", 1), ("שני([^ם]|$)", 2), ("שלישי", 3), ("רביעי", 4))


def iso_day(c: Column | str) -> Column:
    """Date from the first ten characters of an ISO text; null when they are no real day."""
    head = F.substring(col(c), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd"))


def parse_diary_date(c: Column | str) -> Column:
    """ISO prefix, day-first ``d/m/y`` or ``d.m.y``, or a spreadsheet day number, as a date."""
    text = F.trim(col(c).cast("string"))
    day_first = r"^(\d{1,2})[./](\d{1,2})[./](\d{2,4})"
    year = F.regexp_extract(text, day_first, 3)
    full_year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).when(F.length(year) == 4, year)
    built = F.concat_ws(
        "-",
        full_year,
        F.lpad(F.regexp_extract(text, day_first, 2), 2, "0"),
        F.lpad(F.regexp_extract(text, day_first, 1), 2, "0"),
    )
    serial = F.when(text.rlike(r"^\d{5}(\.\d+)?$"), text).try_cast("double")
    return (
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))
        .when(text.rlike(day_first) & full_year.isNotNull(), F.try_to_date(built, "yyyy-MM-dd"))
        .when(
            (serial >= SERIAL_MIN) & (serial <= SERIAL_MAX),
            F.date_from_unix_date((F.floor(serial) - F.lit(SERIAL_EPOCH)).cast("int")),
        )
    )


def parse_diary_time(c: Column | str) -> Column:
    """``HH:MM`` out of a clock text, an ISO timestamp, or a day fraction in [0, 1)."""
    text = F.trim(col(c).cast("string"))
    clock = r"(?:^|T| )(\d{1,2}):(\d{2})"
    hour = F.regexp_extract(text, clock, 1)
    fraction = F.when(text.rlike(r"^0(\.\d+)?$|^\.\d+$"), text).try_cast("double")
    minutes = half_up(fraction * F.lit(1440.0))
    as_clock = F.concat(
        F.lpad((F.floor(minutes / 60) % 24).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((minutes % 60).cast("string"), 2, "0"),
    )
    return F.when(fraction.isNotNull(), as_clock).when(
        text.rlike(clock) & (hour.try_cast("int") <= 23),
        F.concat(F.lpad(hour, 2, "0"), F.lit(":"), F.regexp_extract(text, clock, 2)),
    )


def minutes_of(c: Column | str) -> Column:
    """Minutes since midnight of an ``HH:MM`` text."""
    text = col(c)
    return F.when(
        text.rlike(r"^\d{2}:\d{2}$"),
        F.substring(text, 1, 2).try_cast("int") * 60 + F.substring(text, 4, 2).try_cast("int"),
    )


def quarter_of(c: Column | str) -> Column:
    day = col(c)
    return F.concat(F.date_format(day, "yyyy"), F.lit("-Q"), F.quarter(day).cast("string"))


def month_of(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM")


def quarter_index(c: Column | str) -> Column:
    """Quarters on one number line, so a run of them is a plain sequence."""
    day = col(c)
    return F.year(day) * 4 + F.quarter(day) - 1


def quarter_label(index: Column) -> Column:
    """The ``YYYY-Qn`` label of a quarter index."""
    return F.concat(F.floor(index / 4).cast("string"), F.lit("-Q"), (index % 4 + 1).cast("string"))


def is_weekend(c: Column | str) -> Column:
    """Friday or Saturday."""
    return F.dayofweek(col(c)).isin(6, 7)


def published_quarters(label: Column | str) -> Column:
    """Quarter labels a period text says it covers, as an array.

    Ordinal words name the end points and everything between is covered; a year alone
    covers all four quarters; no year covers none.
    """
    text = col(label)
    year = F.regexp_extract(text, r"(\d{4})", 1)
    named = [F.when(text.rlike(pattern), F.lit(q)) for pattern, q in QUARTER_WORDS]
    low = F.coalesce(F.least(*named), F.lit(1))
    high = F.coalesce(F.greatest(*named), F.lit(4))
    labels = F.transform(F.sequence(low, high), lambda q: F.concat(year, F.lit("-Q"), q.cast("string")))
    return F.when(text.rlike(r"\d{4}"), labels).otherwise(F.array().cast("array<string>"))


def days_between(earlier: Column | str, later: Column | str) -> Column:
    """Whole days from the first text or date to the second; null if either is no day."""
    return F.datediff(iso_day(col(later).cast("string")), iso_day(col(earlier).cast("string")))


def usable_clock(start: Column | str = "start_time", end: Column | str = "end_time") -> Column:
    """Whether a row states a clock time a clock rule may use.

    A missing start, a start equal to its end, and 00:00 (the all-day marker) are refused;
    a missing end is fine.
    """
    s, e = col(start), col(end)
    return s.isNotNull() & ~s.eqNullSafe(e) & (s != F.lit("00:00"))
