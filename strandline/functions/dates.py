"""Dates in the formats of sequencing records: parsing, rendering, ordinals.

Defined results: a text in none of the formats gives null; two-digit years follow the pivot of their
format.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first days of the ordinals, and the pivots of two-digit years.
DAY_ONE = "1997-01-07"
FIRST_YEAR = 1997
PIVOT_YYMMDD, PIVOT_ORACLE, PIVOT_MMDDYY = 80, 80, 50
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def _year(two: Column, pivot: int, at_pivot_is_old: bool) -> Column:
    number = two.cast("int")
    old = (number >= pivot) if at_pivot_is_old else (number > pivot)
    return F.when(F.length(two) == 4, number).otherwise(number + F.when(old, 1900).otherwise(2000))


def _date(year: Column, month: Column, day: Column) -> Column:
    text = F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int"))
    return F.try_to_date(text, "yyyy-MM-dd")


def month_number(name: Column) -> Column:
    """1..12 of an English month name or its first three letters."""
    table = F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m[:3].lower(), i)))
    return F.try_element_at(table, F.lower(F.substring(name, 1, 3)))


def parse_date(text: Column) -> Column:
    """A date from ``yymmdd``, ``dd-MON-yy[yy]``, ``m/d/yy[yy]``, ``dd/Mon/yy``, ``Mon d yyyy [hh:mm]``, ``Month d, yyyy``, ``yyyy-mm-dd``, epoch seconds, or the words today, tomorrow and yesterday."""
    t = F.trim(text)
    g = lambda pattern, i: F.regexp_extract(t, pattern, i)
    six, oracle, slash = r"^(\d\d)(\d\d)(\d\d)\z", r"^(\d{1,2})-([A-Za-z]{3})-(\d{4}|\d\d)\z", r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d\d)\z"
    barcode, words, iso = r"^(\d{1,2})/([A-Za-z]{3})/(\d{4}|\d\d)\z", r"^([A-Za-z]{3,9})\s+(\d{1,2}),?\s+(\d{4})(?:\s+\d{1,2}:\d\d.*)?\z", r"^(\d{4})-(\d\d)-(\d\d)\z"
    return (
        F.when(F.lower(t) == "today", F.current_date())
        .when(F.lower(t) == "tomorrow", F.date_add(F.current_date(), 1))
        .when(F.lower(t) == "yesterday", F.date_sub(F.current_date(), 1))
        .when(t.rlike(six), _date(_year(g(six, 1), PIVOT_YYMMDD, True), g(six, 2), g(six, 3)))
        .when(t.rlike(oracle), _date(_year(g(oracle, 3), PIVOT_ORACLE, False), month_number(g(oracle, 2)), g(oracle, 1)))
        .when(t.rlike(slash), _date(_year(g(slash, 3), PIVOT_MMDDYY, False), g(slash, 1), g(slash, 2)))
        .when(t.rlike(barcode), _date(_year(g(barcode, 3), PIVOT_MMDDYY, False), month_number(g(barcode, 2)), g(barcode, 1)))
        .when(t.rlike(words), _date(g(words, 3), month_number(g(words, 1)), g(words, 2)))
        .when(t.rlike(iso), _date(g(iso, 1), g(iso, 2), g(iso, 3)))
        .when(t.rlike(r"^\d{8,11}\z"), F.to_date(F.timestamp_seconds(t.try_cast("bigint"))))
    )


def parse_mmddyy(text: Column) -> Column:
    """A date from ``mmddyy``, whose six digits alone cannot be told from ``yymmdd``."""
    six = r"^(\d\d)(\d\d)(\d\d)\z"
    part = lambda i: F.regexp_extract(F.trim(text), six, i)
    return F.when(F.trim(text).rlike(six), _date(_year(part(3), PIVOT_MMDDYY, False), part(1), part(2)))


#: Rendered forms by name.
RENDERED = {
    "short": lambda d: F.date_format(d, "MMM dd yyyy"),
    "long": lambda d: F.date_format(d, "MMMM dd, yyyy"),
    "long_one_digit": lambda d: F.date_format(d, "MMMM d, yyyy"),
    "yymmdd": lambda d: F.date_format(d, "yyMMdd"),
    "mmddyy": lambda d: F.date_format(d, "MMddyy"),
    "yyyymmdd": lambda d: F.date_format(d, "yyyyMMdd"),
    "dashed": lambda d: F.date_format(d, "yyyy-MM-dd"),
    "stamp": lambda d: F.date_format(d, "yyyy-MM-dd_HH.mm.ss"),
    "oracle": lambda d: F.upper(F.date_format(d, "d-MMM-yyyy")),
    "slashed": lambda d: F.date_format(d, "M/d/yyyy"),
    "barcode": lambda d: F.date_format(d, "dd/MMM/yyyy"),
}


def noon_epoch(d: Column) -> Column:
    """Seconds since the epoch at noon of the date in the session's time zone."""
    return F.unix_timestamp(d.cast("date").cast("timestamp")) + 43_200


def day_number(d: Column) -> Column:
    return F.date_diff(d.cast("date"), F.lit(DAY_ONE).cast("date")) + 1


def day_of_number(n: Column) -> Column:
    return F.date_add(F.lit(DAY_ONE).cast("date"), (n - 1).cast("int"))


def week_number(d: Column, offset: int = 0) -> Column:
    return F.floor((F.date_diff(d.cast("date"), F.lit(DAY_ONE).cast("date")) + offset) / 7)


def day_of_week_number(n: Column) -> Column:
    return F.date_add(F.lit(DAY_ONE).cast("date"), (n * 7).cast("int"))


def month_ordinal(d: Column) -> Column:
    return 12 * (F.year(d) - FIRST_YEAR) + F.month(d)


def month_label(n: Column) -> Column:
    """``m/yy`` of a month ordinal."""
    return F.format_string("%d/%02d", (F.pmod(n - 1, F.lit(12)) + 1).cast("int"), F.pmod(F.lit(FIRST_YEAR) + F.floor((n - 1) / 12), F.lit(100)).cast("int"))


def days_ago(d: Column) -> Column:
    return F.date_diff(F.current_date(), d.cast("date"))
