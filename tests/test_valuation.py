"""Day counts against a plain version, read-back round trips, and a discounted workbook end to end."""

from datetime import date, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions.finance import as_rate, column_letters, fiscal_year, yearfrac
from gridloom.functions.formula import column_letters as letters
from gridloom.operators.cashflow import factor, read_back
from gridloom.operators.rowmap import detect_layout, line_items
from gridloom.operators.valuation import catalogue, period_dates, pv_cells, scenarios
from gridloom.sources.ooxml import load_workbooks, split_records, write_workbook
from gridloom.tables import materialise


def leap(y):
    return y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)


def plain_yearfrac(a, b):
    a, b = sorted((a, b))
    turn = date(a.year + 1, 3, 1) if (a.month, a.day) == (2, 29) else date(a.year + 1, a.month, a.day)
    if b > turn:
        years = [366 if leap(y) else 365 for y in range(a.year, b.year + 1)]
        return (b - a).days / (sum(years) / len(years))
    if a.year == b.year:
        return (b - a).days / (366 if leap(a.year) else 365)
    return (b - a).days / (366 if any(leap(y) and a <= date(y, 2, 29) <= b for y in (a.year, b.year)) else 365)


days = st.dates(date(1990, 1, 1), date(2060, 12, 31))


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(days, days), min_size=30, max_size=60))
def test_yearfrac(spark, pairs):
    pairs += [(date(2024, 2, 29), date(2025, 2, 28)), (date(2024, 2, 29), date(2025, 3, 1)), (date(2023, 3, 1), date(2024, 2, 29)), (date(2020, 1, 1), date(2020, 1, 1))]
    df = spark.createDataFrame(pairs, "a date, b date").select("a", "b", yearfrac(F.col("a"), F.col("b")).alias("y"))
    assert all(r.y == pytest.approx(plain_yearfrac(r.a, r.b), abs=1e-12) for r in df.collect())


def test_small_functions(spark):
    df = spark.range(1, 1500).select("id", column_letters(F.col("id")).alias("c"))
    assert all(r.c == letters(r.id) for r in df.collect())
    one = spark.createDataFrame([(date(2026, 7, 1), 7.25), (date(2026, 6, 30), 0.07)], "d date, r double").select(fiscal_year(F.col("d"), 6).alias("fy"), as_rate(F.col("r")).alias("r"))
    assert [(r.fy, r.r) for r in one.collect()] == [(2027, 0.0725), (2026, 0.07)]


@pytest.mark.parametrize("timing", ["end", "mid", "mid-year"])
@pytest.mark.parametrize("dc", ["actual/actual", "actual/365"])
def test_read_back_round_trip(spark, timing, dc):
    ends = [("k", date(2025, 9, 30) + timedelta(days=91 * i)) for i in range(12)]
    df = factor(spark.createDataFrame(ends, "k string, e date"), ["k"], "e", F.lit(0.087), F.lit("2025-08-15").cast("date"), timing, dc)
    got = read_back(df, ["k"], "e", "factor", F.lit("2025-08-15").cast("date")).collect()
    assert [(r.timing, r.day_count) for r in got] == [(timing, dc)] and got[0].rate == pytest.approx(0.087, abs=1e-9)


def test_catalogue(spark, tmp_path):
    n, vd, rate = range(8), date(2025, 6, 30), 0.0725
    ends = [date(2025 + i, 6, 30) for i in n]
    flows = [0.0, *[100.0 + 5 * i for i in n][1:]]
    fac = [0.0 if d <= vd else (1 + rate) ** -plain_yearfrac(vd, d) for d in ends]
    c = [(1, 1, None, "Valuation date"), (1, 3, None, vd), *[(3, 4 + i, None, d) for i, d in enumerate(ends)], (5, 1, None, "Distributions"), *[(5, 4 + i, None, v) for i, v in enumerate(flows)],
         (6, 1, None, "Discount factor"), *[(6, 4 + i, None, f) for i, f in enumerate(fac)], (8, 1, None, "Equity value"), (8, 4, "=SUMPRODUCT(D5:K5,D6:K6)", sum(a * b for a, b in zip(flows, fac))), (9, 1, None, "Not a PV"), (9, 4, "=SUMPRODUCT(D5:K5,D5:K5)", 1.0)]
    (tmp_path / "v.xlsx").write_bytes(write_workbook({"DCF": c}))
    t = split_records(load_workbooks(spark, str(tmp_path)))
    cells = materialise(t["cells"], 1)
    lay = materialise(detect_layout(cells), 1)
    lines = materialise(line_items(cells, lay), 1)
    got = catalogue(cells, lines, lay, t["names"]).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.row, r.cf_row, r.df_row, r.reproduces, r.timing, r.day_count, r.valuation_date) == (8, 5, 6, True, "end", "actual/actual", vd) and r.rate == pytest.approx(rate, abs=1e-9)
    found = spark.createDataFrame(got)
    sc = {round(x["shift"], 4): x.pv for x in scenarios(found, pv_cells(cells), period_dates(cells, lines, lay), [-0.01, 0.0, 0.01]).collect()}
    assert sc[0.0] == pytest.approx(r.value, rel=1e-9) and sc[-0.01] > sc[0.0] > sc[0.01]
