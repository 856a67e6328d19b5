"""Dates: flexible parsing, spans of dates in text, months between, spans as text. 'Now' is always given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.lists import bound_as

MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_YEAR = r"(?:19|20)[0-9]{2}"
#: A date: a named month with a year of four digits or two behind an apostrophe, a month and a year in digits, a day, or a year.
#: The glances ahead at three letters or a digit change no match; they spare most places of a text the whole list of months.
DATE = rf"(?:(?=[jfmasond][aepuco][nbrylgptvc]){_MONTH}[., -]{{0,3}}(?:{_YEAR}|['’][0-9]{{2}})|(?=[0-9])(?:(?:0?[1-9]|1[0-2])[/-]{_YEAR}|{_YEAR}[/-](?:1[0-2]|0[1-9])(?:-[0-3][0-9])?|{_YEAR}))"
#: Words for the present.
PRESENT = r"(?:present|current(?:ly)?|now|today|ongoing|till (?:date|now)|to date)"
_UNTIL = r"\s*(?:[-–—]|to|until|till)\s*"
#: From a date, if not since one, until a date or the present; blanks alone join two dates, unless the second begins a span of its own
#: ('Harbour 2042  1986 - 1988' is from 1986).
SPAN = rf"(?i)\b(?:since +{DATE}|(?:from +)?{DATE}(?:{_UNTIL}|\s+(?!{DATE}(?:{_UNTIL}{DATE}|(?:{_UNTIL}|\s+){PRESENT})\b))(?:{DATE}|{PRESENT}))\b"


def seconds_between(a: Column, b: Column) -> Column:
    """b - a in seconds, of timestamps with or without zone."""
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / F.lit(1e6)


def days_before(c: Column, now: str) -> Column:
    """Whole days from ``c`` to ``now``."""
    return F.floor(seconds_between(c, F.lit(now).cast("timestamp")) / 86400)


def _date(t: Column) -> Column:
    """The day that a lower-case text in the form of ``DATE`` names; the first where it gives no day or month; null before 1980.

    Parts are cut out by place and only digits are cast: a cast that fails costs far more than all else here.
    """
    part = lambda at, n: F.substring(t, at, n).cast("int")
    first = lambda y, m: F.make_date(y, m, F.lit(1))
    named = ((F.instr(F.lit(MONTHS), F.substring(t, 1, 3)) + 2) / 3).cast("int")
    tens = bound_as("int", part(-2, 2), lambda y: y + F.when(y < 50, 2000).otherwise(1900))
    day = (
        F.when(t >= "a", first(F.when(t.contains("'") | t.contains("’"), tens).otherwise(part(-4, 4)), named))
        .when(F.length(t) == 4, first(part(1, 4), F.lit(1)))
        .when(F.substring(t, 2, 1).isin("/", "-"), first(part(-4, 4), part(1, 1)))
        .when(F.substring(t, 3, 1).isin("/", "-"), first(part(-4, 4), part(1, 2)))
        .when(t.rlike("-[0-9]{2}-[0-9]{2}$"), F.try_to_timestamp(t, F.lit("yyyy-MM-dd")).cast("date"))
        .otherwise(first(part(1, 4), part(6, 2)))
    )
    return bound_as("date", day, lambda d: F.when(F.year(d) >= 1980, d))


def parse(c: Column, now: str) -> Column:
    """A date in one of the usual forms (``DATE``); words for the present mean ``now``; years before 1980 and other texts give null."""

    def read(t: Column) -> Column:
        return F.when(t.rlike(f"^{PRESENT}$"), F.lit(now).cast("date")).when(t.rlike(f"^{DATE}$"), _date(t))

    return bound_as("date", F.lower(F.trim(c)), read)


def ends_of(span: Column, now: str) -> Column:
    """``struct(start, end, current)`` of a text that ``SPAN`` matches, or of one date, which is a start; nulls for others."""

    def read(t: Column) -> Column:
        return bound_as(kind, F.regexp_extract_all(t, F.lit(DATE), F.lit(0)), lambda dates: bound_as(kind, t.startswith("since") | ((F.right(t, F.lit(1)) > "9") & t.rlike(f"{PRESENT}$")), lambda current: ends(dates, current)))

    def ends(dates: Column, current: Column) -> Column:
        nth = lambda i: bound_as("date", F.get(dates, F.lit(i)), _date)
        return F.struct(nth(0).alias("start"), F.when(current, F.lit(now).cast("date")).otherwise(nth(1)).alias("end"), current.alias("current"))

    kind = "struct<start:date,end:date,current:boolean>"
    return bound_as(kind, F.lower(F.trim(span)), read)


def range_of(c: Column, now: str) -> Column:
    """``struct(start, end)`` of a text such as 'Jan 2019 - Present'."""
    sides = lambda i: parse(F.regexp_extract(c, "^ *(.+?) *(?: to |–|—| - |(?<=[0-9])-(?![0-9]{2}(?:-|$))) *(.+?) *$", i), now)
    return F.struct(sides(1).alias("start"), sides(2).alias("end"))


def months(a: Column, b: Column) -> Column:
    """Calendar months from a to b, never negative."""
    return F.greatest(F.lit(0), (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a))


def span_text(days: Column) -> Column:
    """Days as years, months of mean length and days."""
    y = F.floor(days / 365.25)
    left = days - y * 365.25
    m = F.floor(left / 30.436875)
    d = F.floor(left - m * 30.436875)
    return F.concat(y.cast("string"), F.lit(" years "), m.cast("string"), F.lit(" months "), d.cast("string"), F.lit(" days"))
