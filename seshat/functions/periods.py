"""Fiscal periods named in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seshat.functions.text import contains_any, text

# Phrases that mark a quarter's and a year's figures.
QUARTER_MARKERS = ("three months ended", "quarter ended", "quarterly", "q1", "q2", "q3", "q4", "first quarter", "second quarter", "third quarter", "fourth quarter")
ANNUAL_MARKERS = ("year ended", "twelve months ended", "fiscal year", "annual")


def year_tokens(c: Column | str) -> Column:
    """Distinct years, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text(c)), F.lit(r"(?<!\d)(?:fy\s*)?((?:19|20)\d{2})(?!\d)"), F.lit(1)))


def quarter_tokens(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text(c)), F.lit(r"\bq([1-4])\b"), F.lit(1)))


def periods_overlap(a: Column | str, b: Column | str) -> Column:
    """True unless years, or quarters of one year, exclude each other (D3)."""
    ya, yb, qa, qb = year_tokens(a), year_tokens(b), quarter_tokens(a), quarter_tokens(b)
    empty = (F.length(F.trim(text(a))) == 0) | (F.length(F.trim(text(b))) == 0)
    known = (F.size(ya) > 0) & (F.size(yb) > 0)
    years = known & ~F.arrays_overlap(ya, yb)
    quarters = (F.size(qa) > 0) & (F.size(qb) > 0) & ~F.arrays_overlap(qa, qb)
    return empty | ~(years | quarters)


def granularity(c: Column | str) -> Column:
    """quarter, annual or unknown, by what the period says."""
    low = F.lower(F.trim(text(c)))
    quarter = low.rlike(r"\bq[1-4]\b") | contains_any(low, ("quarter", "three months"))
    annual = contains_any(low, ("fy", "fiscal year", "year end")) | low.rlike(r"\b(?:19|20)\d{2}\b")
    return F.when(quarter, "quarter").when(annual, "annual").otherwise("unknown")


def marked_granularity(c: Column | str) -> Column:
    low = F.lower(text(c))
    return F.when(contains_any(low, QUARTER_MARKERS), "quarter").when(contains_any(low, ANNUAL_MARKERS), "annual").otherwise("unknown")


def is_multi_period(query: Column | str, period: Column | str) -> Column:
    """Whether a computation spans periods."""
    low = F.lower(text(query))
    span = F.contains(low, F.lit(" from ")) & F.contains(low, F.lit(" to "))
    return (F.size(year_tokens(query)) >= 2) | (F.size(year_tokens(period)) >= 2) | contains_any(low, ("year-over-year", "yoy", " vs ", " versus ", " between ")) | span
