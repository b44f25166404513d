"""Day counts, fiscal years and discount factors as JVM column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _leap(y: Column) -> Column:
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def _feb29(y: Column) -> Column:
    return F.when(_leap(y), F.make_date(y, F.lit(2), F.lit(29)))


def yearfrac(a: Column, b: Column, day_count: str = "actual/actual") -> Column:
    """Years between two dates, in either order.

    actual/365 divides the days by 365. actual/actual divides by the length of the year within one calendar year, by
    366 if a 29 February lies between dates at most one year apart, else by the mean length of the years touched.
    """
    lo, hi = F.least(a, b), F.greatest(a, b)
    days = F.datediff(hi, lo).cast("double")
    if day_count == "actual/365":
        return days / F.lit(365.0)
    if day_count != "actual/actual":
        raise ValueError(f"unknown day count {day_count!r}")
    ya, yb = F.year(lo), F.year(hi)
    turn = F.when((F.month(lo) == 2) & (F.dayofmonth(lo) == 29), F.make_date(ya + 1, F.lit(3), F.lit(1))).otherwise(F.make_date(ya + 1, F.month(lo), F.dayofmonth(lo)))
    inside = F.coalesce(_feb29(ya).between(lo, hi), F.lit(False)) | F.coalesce(_feb29(yb).between(lo, hi), F.lit(False))
    short = F.when(ya == yb, F.when(_leap(ya), 366.0).otherwise(365.0)).otherwise(F.when(inside, 366.0).otherwise(365.0))
    whole = F.datediff(F.make_date(yb + 1, F.lit(1), F.lit(1)), F.make_date(ya, F.lit(1), F.lit(1))).cast("double") / (yb - ya + 1)
    return days / F.when(hi <= turn, short).otherwise(whole)


def as_rate(rate: Column) -> Column:
    """A rate of one or more is a percentage."""
    return F.when(rate >= 1, rate / 100).otherwise(rate)


def fiscal_year(d: Column, end_month: int) -> Column:
    """The year in which the fiscal year of a date ends."""
    return F.year(d) + F.when(F.month(d) > end_month, 1).otherwise(0)


def decade(iso: Column) -> Column:
    """Decade of an ISO date text, such as 2020s; null where it does not begin with a year."""
    return F.concat(F.nullif(F.regexp_extract(iso, r"^(\d{3})\d", 1), F.lit("")), F.lit("0s"))


def serial_day(d: Column) -> Column:
    """Spreadsheet serial of a date in the 1900 system."""
    return F.datediff(d, F.lit("1899-12-30").cast("date"))


def column_letters(n: Column) -> Column:
    """Letters of a column number up to three of them."""
    def letter(k: Column) -> Column:
        return F.char(F.lit(64) + k)

    one, two = (n - 1) % 26 + 1, F.floor((n - 1) / 26)
    b, c = (two - 1) % 26 + 1, F.floor((two - 1) / 26)
    return F.concat(F.when(c > 0, letter(c)).otherwise(""), F.when(two > 0, letter(b)).otherwise(""), letter(one))
