"""Discounting: period ends, factors under several conventions, present values and reading conventions back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.finance import yearfrac

TIMINGS, DAY_COUNTS = ["end", "mid", "mid-year"], ["actual/actual", "actual/365"]


def with_period_ends(df: DataFrame, keys: list[str], start: str, out: str = "period_end") -> DataFrame:
    """Period starts to ends: a day before the next start; the last gets the rounded median gap in months."""
    w = Window.partitionBy(*keys).orderBy(start)
    gaps = df.withColumn("_next", F.lead(start).over(w))
    typical = gaps.groupBy(*keys).agg(F.median(F.datediff("_next", F.col(start))).alias("_gap"))
    months = F.greatest(F.lit(1), F.bround(F.coalesce("_gap", F.lit(30.44)) / 30.44)).cast("int")
    last = F.date_add(F.add_months(F.col(start), months), -1)
    return gaps.join(typical, keys).withColumn(out, F.coalesce(F.date_add("_next", -1), last)).drop("_next", "_gap")


def factor(df: DataFrame, keys: list[str], end: str, rate: Column, valuation: Column, timing: str = "end", day_count: str = "actual/actual", terminal: Column | None = None, out: str = "factor") -> DataFrame:
    """Discount factor of each period: 0 on or before the valuation date and after the terminal date.

    ``mid`` discounts from the middle day of a period (half days dropped), a period starting the day after the one
    before it ends or, the first, 90 days before its end, and not before the valuation date; ``mid-year`` takes half
    a year off. The period before counts even if its own factor is 0.
    """
    e = F.col(end)
    if timing == "mid":
        before = F.lag(end).over(Window.partitionBy(*keys).orderBy(end))
        start = F.greatest(F.coalesce(F.date_add(before, 1), F.date_sub(e, 90)), valuation)
        t = yearfrac(valuation, F.date_add(start, F.floor(F.datediff(e, start) / 2).cast("int")), day_count)
    else:
        t = yearfrac(valuation, e, day_count) - (0.5 if timing == "mid-year" else 0.0)
    dead = (e <= valuation) if terminal is None else (e <= valuation) | (e > terminal)
    return df.withColumn(out, F.when(dead, F.lit(0.0)).otherwise(F.pow(1 + rate, -t)))


def present_value(df: DataFrame, keys: list[str], flow: str, factor_col: str = "factor") -> DataFrame:
    """PV, the undiscounted sum of the periods that count, and how many do not."""
    live = F.col(factor_col) != 0
    return df.groupBy(*keys).agg(
        F.sum(F.col(flow) * F.col(factor_col)).alias("pv"), F.sum(F.when(live, F.col(flow))).alias("undiscounted"),
        F.count_if(~live).alias("n_excluded"),
    )


def running_pv(df: DataFrame, keys: list[str], order: str, flow: str, factor_col: str = "factor") -> DataFrame:
    """Cumulative PV, null from the first period on whose flow is unknown."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    known = F.count(flow).over(w) == F.count(F.lit(1)).over(w)
    return df.withColumn("cum_pv", F.when(known, F.sum(F.col(flow) * F.col(factor_col)).over(w)))


def npv_by_position(df: DataFrame, keys: list[str], order: str, flow: str, rate: float) -> DataFrame:
    """NPV as spreadsheets count it: the first flow is one period away."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_n", n).groupBy(*keys).agg(F.sum(F.col(flow) / F.pow(F.lit(1 + rate), F.col("_n"))).alias("npv"))


def xnpv(df: DataFrame, keys: list[str], when: str, flow: str, rate: float) -> DataFrame:
    """Dated NPV over days / 365 from the first date."""
    first = F.min(when).over(Window.partitionBy(*keys))
    t = F.datediff(F.col(when), first) / 365.0
    return df.withColumn("_t", t).groupBy(*keys).agg(F.sum(F.col(flow) / F.pow(F.lit(1 + rate), F.col("_t"))).alias("xnpv"))


def read_back(df: DataFrame, keys: list[str], end: str, factor_col: str, valuation: Column, tolerance: float = 1e-9) -> DataFrame:
    """The convention and rate that reproduce all factors strictly between 0 and 1: keys, timing, day_count, rate.

    Each timing and day count is solved for the rate at the earliest live period and kept if it gives every live
    factor within ``tolerance``; of several the first in the order of ``TIMINGS`` and ``DAY_COUNTS`` wins.
    """
    live = (F.col(factor_col) > 0) & (F.col(factor_col) < 1) & (F.col(end) > valuation)
    e = F.col(end)
    before = F.lag(end).over(Window.partitionBy(*keys).orderBy(end))
    start = F.greatest(F.coalesce(F.date_add(before, 1), F.date_sub(e, 90)), valuation)
    seen = df.withColumn("_mid", F.date_add(start, F.floor(F.datediff(e, start) / 2).cast("int"))).filter(live)
    # one row a convention, so the day count is one expression however many conventions there are
    ways = F.array(*[
        F.struct(F.lit(2 * i + j).alias("_order"), F.lit(t).alias("timing"), F.lit(dc).alias("day_count"), (F.col("_mid") if t == "mid" else e).alias("_at"), F.lit(0.5 if t == "mid-year" else 0.0).alias("_off"))
        for i, t in enumerate(TIMINGS) for j, dc in enumerate(DAY_COUNTS)
    ])
    allc = seen.select(*keys, end, factor_col, F.explode(ways).alias("w")).select(*keys, end, factor_col, "w.*")
    years = F.when(F.col("day_count") == "actual/365", yearfrac(valuation, F.col("_at"), "actual/365")).otherwise(yearfrac(valuation, F.col("_at")))
    allc = allc.withColumn("_t", years - F.col("_off"))
    solved = allc.groupBy(*keys, "_order", "timing", "day_count").agg(F.min_by(F.struct(factor_col, "_t"), end).alias("x"))
    solved = solved.withColumn("rate", F.when(F.col("x._t") > 0, F.pow(F.col(f"x.{factor_col}"), -1 / F.col("x._t")) - 1)).drop("x")
    worst = allc.join(solved, [*keys, "_order", "timing", "day_count"]).groupBy(*keys, "_order", "timing", "day_count", "rate").agg(
        F.max(F.abs(F.pow(1 + F.col("rate"), -F.col("_t")) - F.col(factor_col))).alias("worst")
    )
    fits = worst.filter(F.col("worst") <= tolerance)
    return fits.groupBy(*keys).agg(F.min_by(F.struct("timing", "day_count", "rate"), "_order").alias("b")).select(*keys, "b.*")
