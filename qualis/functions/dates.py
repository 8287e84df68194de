"""Mixed-format date parsing for the date-like column test."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import strip

# Layouts tried in order; the first that parses wins. Month-first comes before
# day-first, so 03/02/2024 reads as 2 March. Months, days and hours take one or two
# digits; a time, its seconds and fraction, and a zone are optional. A bare 4-digit year
# parses. Before, a week day in front, the letters of an ordinal (5th) and a zone name at the
# end (UTC, GMT, Z) are taken off, and month names get a capital.
_CLOCKS = ("[' 'H:mm[:ss[.SSSSSS]][XXX]]", "' 'h:mm[:ss]' 'a")
_DAYS = ("yyyy-M-d", "yyyy/M/d", "yyyy.M.d",
         "M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy", "M.d.yyyy", "d.M.yyyy",
         "MMM d[','] yyyy", "MMMM d[','] yyyy", "d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy")
DATE_FORMATS = (
    *(day + clock for day in _DAYS for clock in _CLOCKS),
    "yyyy-M-d'T'H:mm[:ss[.SSSSSS]][XXX]",
    "yyyyMMdd",
    "yyyy",
    # month and year, time of day, two-digit years, year first with a month name
    "MMM yyyy", "MMMM yyyy", "yyyy-M", "yyyy/M", "M/yyyy", "H:mm[:ss[.SSSSSS]]", "h:mm[:ss]' 'a",
    *(day + clock for day in ("M/d/yy", "d/M/yy", "M-d-yy", "d-M-yy", "d-MMM-yy", "d MMM yy",
                              "yyyy MMM d", "yyyy MMMM d", "yyyy-MMM-d") for clock in _CLOCKS),
)
_WEEKDAY = r"^(?i)(mon|tue|tues|wed|weds|thu|thur|thurs|fri|sat|sun|monday|tuesday|wednesday|thursday|friday|saturday|sunday)\.?,?\s+"
_ORDINAL = r"(?i)\b(\d{1,2})(st|nd|rd|th)\b"
_ZONE = r"(?i)(?<=\d)\s*(utc|gmt|z)$"


def _plain(s: Column) -> Column:
    """The value without week day, ordinal letters and zone name, month names as Jan or January."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, _WEEKDAY, ""), _ORDINAL, "$1"), _ZONE, "")
    month = F.regexp_extract(out, r"(?i)\b((?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*)", 1)
    return F.when(month != "", F.replace(out, month, F.initcap(month))).otherwise(out)


def parse_date_mixed(c: Column) -> Column:
    s = _plain(strip(c.cast("string")))
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(fmt)) for fmt in DATE_FORMATS])
