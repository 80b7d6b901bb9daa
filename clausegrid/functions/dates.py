"""Dates and durations as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Taken where nothing tells the day.
UNKNOWN_DAY = "2020-01-01"


def five_years_before(day: Column) -> Column:
    """The same day five years earlier; 29 February becomes 28 February."""
    return F.add_months(day, -60)


def expires(moment: Column, days: int = 90) -> Column:
    """The moment that many days later."""
    return moment + F.expr(f"interval {int(days)} days")


def _first_of(year: Column) -> Column:
    return F.make_date(year.cast("int"), F.lit(1), F.lit(1))


def decision_day(given: Column, citation: Column) -> Column:
    """A given ISO day, else the first of a given year, else of the citation's year, else UNKNOWN_DAY."""
    day = F.when(given.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(given, F.lit("yyyy-MM-dd")).cast("date"))
    year = F.when(given.rlike(r"^\d{4}$"), _first_of(given))
    cited = F.nullif(F.regexp_extract(citation, r"(?:^|[^0-9A-Za-z_])(20\d{2})(?:[^0-9A-Za-z_]|$)", 1), F.lit(""))
    return F.coalesce(day, year, _first_of(cited), F.lit(UNKNOWN_DAY).cast("date"))


def case_day(case: Column) -> Column:
    """The first day of the year that a case id starts with, else UNKNOWN_DAY."""
    return F.coalesce(_first_of(F.nullif(F.regexp_extract(case, r"^(\d{4})", 1), F.lit(""))), F.lit(UNKNOWN_DAY).cast("date"))


def pdf_moment(stamp: Column) -> Column:
    """A document's D:YYYYMMDDHHmmSS or D:YYYYMMDD as ISO text, empty if it is neither."""
    digits = F.regexp_replace(stamp, r"^D:", "")
    long = F.try_to_timestamp(F.substring(digits, 1, 14), F.lit("yyyyMMddHHmmss"))
    short = F.try_to_timestamp(F.substring(digits, 1, 8), F.lit("yyyyMMdd"))
    return F.coalesce(F.date_format(F.coalesce(long, short), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))


def duration_label(ms: Column) -> Column:
    """1.23s from a second on, halves of a hundredth up, else 450ms."""
    return F.when(ms >= 1000, F.format_string("%.2fs", ms / 1000.0)).otherwise(F.concat(ms.cast("long").cast("string"), F.lit("ms")))


def offset_label(ms: Column) -> Column:
    """A step's distance from the start with a plus sign; a hyphen without one."""
    return F.coalesce(F.concat(F.lit("+"), duration_label(ms)), F.lit("-"))


def tick_interval(span_ms: Column, ticks: int = 6) -> Column:
    """The least of 1, 2, 2.5, 5 and 10 times a power of ten that makes at most ``ticks`` intervals of the span."""
    raw = span_ms / float(ticks)
    magnitude = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    out = magnitude * 10
    for factor in (5.0, 2.5, 2.0, 1.0):
        out = F.when(magnitude * factor >= raw, magnitude * factor).otherwise(out)
    return out


def ruler_ticks(span_ms: Column) -> Column:
    """The places of the ticks of a span in per cent, 0 first, none beyond 99."""
    step = tick_interval(span_ms)
    every = F.transform(F.sequence(F.lit(0), F.lit(12)), lambda k: k * step)
    inside = F.filter(every, lambda t: (t == 0) | ((t < span_ms) & (t / span_ms * 100 <= 99)))
    return F.transform(inside, lambda t: t / span_ms * 100)
