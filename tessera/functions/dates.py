"""Column functions on dates: whole years and months, intervals of inexact dates, windows, dates in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_years(born: Column, at: Column) -> Column:
    """Completed years; someone born on 29 February completes one on 1 March of other years."""
    before = (F.month(at) * 100 + F.dayofmonth(at)) < (F.month(born) * 100 + F.dayofmonth(born))
    return F.year(at) - F.year(born) - before.cast("int")


def whole_months(start: Column, end: Column) -> Column:
    """Completed months from start to end."""
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    return months - (F.dayofmonth(end) < F.dayofmonth(start)).cast("int")


def days_left(until: Column, today: Column) -> Column:
    """Days until a date; null once it is past."""
    days = F.datediff(until, today)
    return F.when(days >= 0, days)


def shifted(date: Column, years: Column | int) -> Column:
    """The same day in another year; 29 February becomes 28 (F16)."""
    return F.add_months(date, (F.lit(years) if isinstance(years, int) else years) * 12)


def earliest(year: Column, month: Column, day: Column) -> Column:
    """The first date that a date without a day may be."""
    return F.make_date(year, month, F.coalesce(day, F.lit(1)))


def latest(year: Column, month: Column, day: Column) -> Column:
    """The last date that a date without a day may be."""
    return F.coalesce(F.make_date(year, month, day), F.last_day(F.make_date(year, month, F.lit(1))))


def written_date(text: Column, year: Column | None = None) -> Column:
    """The first date written as year, month and day, or as month and day of the given year; null if there is none."""
    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(text, r"(?:(\d{4})\s*年)?\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日", i), F.lit("")).cast("int")

    own = F.coalesce(part(1), year) if year is not None else part(1)
    return F.try_to_date(F.concat_ws("-", own.cast("string"), F.lpad(part(2).cast("string"), 2, "0"), F.lpad(part(3).cast("string"), 2, "0")), "yyyy-MM-dd")


def sentence_with(text: Column, word: str) -> Column:
    """The first sentence that has a word."""
    return F.get(F.filter(F.split(text, "[。；;\n]"), lambda s: s.contains(word)), F.lit(0))


def between_markers(text: Column, start: str, end: str) -> Column:
    """What stands between two markers; to the end if the second is missing; null without the first."""
    at = F.locate(start, text)
    rest = F.substring(text, at + len(start), F.length(text))
    stop = F.locate(end, rest)
    return F.when(at > 0, F.when(stop > 0, F.substring(rest, F.lit(1), stop - 1)).otherwise(rest))
