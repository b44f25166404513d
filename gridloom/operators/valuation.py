"""Valuations found in workbooks: PV cells, the conventions behind their factors, whether they reproduce, scenarios."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.finance import as_rate
from gridloom.functions.formula import FormulaError, area, calls, tree
from gridloom.operators.cashflow import factor, present_value, read_back, with_period_ends
from gridloom.operators.identities import tolerance
from gridloom.operators.rowmap import SHEET

PV = ["workbook_id", "sheet", "row", "col"]
RANGES = "workbook_id string, sheet string, `row` int, col int, a_sheet string, a_row int, b_sheet string, b_row int, c1 int, c2 int"
END_LABEL = r"(?i)period\s*end|end\s*(?:of\s*)?(?:date|period)|^end$"
VALUATION_LABEL = r"(?i)valuation\s*date|val[_ ]?date|date of valuation"


def sumproducts(cells: DataFrame) -> DataFrame:
    """Formulas that multiply two rows of equal columns: the cell and both rows."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for w, s, r, c, f in zip(pdf.workbook_id, pdf.sheet, pdf["row"], pdf["col"], pdf.formula):
                try:
                    found = [x for x in calls(tree(f)) if x.name == "SUMPRODUCT" and len(x.args) == 2]
                except FormulaError:
                    continue
                for x in found:
                    ab = [area(a[0][1]) if len(a) == 1 and a[0][0] == "ref" else None for a in x.args]
                    if all(y and y.r1 == y.r2 and y.c1 < y.c2 for y in ab) and (ab[0].c1, ab[0].c2) == (ab[1].c1, ab[1].c2):
                        out.append((w, s, r, c, ab[0].sheet or s, ab[0].r1, ab[1].sheet or s, ab[1].r1, ab[0].c1, ab[0].c2))
            yield pd.DataFrame(out, columns=["workbook_id", "sheet", "row", "col", "a_sheet", "a_row", "b_sheet", "b_row", "c1", "c2"])

    f = cells.filter(F.upper("formula").contains("SUMPRODUCT(")).select(*PV, "formula")
    return f.mapInPandas(run, RANGES).distinct()


def _row_of(cells: DataFrame, name: str) -> DataFrame:
    return cells.select("workbook_id", F.col("sheet").alias(f"{name}_sheet"), F.col("row").alias(f"{name}_row"), F.col("col").alias("at"), F.col("value_num").alias(f"{name}_value"))


def pv_cells(cells: DataFrame) -> DataFrame:
    """Periods of every cell that multiplies a cash-flow row by a factor row: flow and factor by column.

    A factor row lies within 0 and 1 with at least three values strictly inside; a blank factor is 0. Of two rows that
    could both be factors, or none, nothing is said.
    """
    pairs = sumproducts(cells).withColumn("at", F.explode(F.sequence("c1", "c2")))
    both = pairs.join(_row_of(cells, "a"), ["workbook_id", "a_sheet", "a_row", "at"], "left").join(_row_of(cells, "b"), ["workbook_id", "b_sheet", "b_row", "at"], "left")
    w = Window.partitionBy(*PV, "a_sheet", "a_row", "b_sheet", "b_row")

    def is_factor(v: str) -> Column:
        return (F.min(v).over(w) >= 0) & (F.max(v).over(w) <= 1) & (F.count_if((F.col(v) > 0) & (F.col(v) < 1)).over(w) >= 3)

    marked = both.withColumn("fa", F.coalesce(is_factor("a_value"), F.lit(False))).withColumn("fb", F.coalesce(is_factor("b_value"), F.lit(False))).filter("fa <> fb")
    pick = lambda a, b: F.when(F.col("fa"), F.col(a)).otherwise(F.col(b))
    return marked.select(
        *PV, pick("b_sheet", "a_sheet").alias("cf_sheet"), pick("b_row", "a_row").alias("cf_row"), pick("a_sheet", "b_sheet").alias("df_sheet"), pick("a_row", "b_row").alias("df_row"),
        "at", F.coalesce(pick("b_value", "a_value"), F.lit(0.0)).alias("flow"), F.coalesce(pick("a_value", "b_value"), F.lit(0.0)).alias("factor"),
    )


def period_dates(cells: DataFrame, lines: DataFrame, layouts: DataFrame) -> DataFrame:
    """End date of every timeline column: a row labelled as period ends that fills four fifths of it, else the header.

    Headers on the first of months are period starts; their ends are derived.
    """
    span = layouts.filter("tl_first is not null").select(*SHEET, "header_row", "tl_first", "tl_last", "periods")
    d = cells.filter("value_kind = 'date'").join(span, SHEET).filter("col between tl_first and tl_last")
    named = lines.filter(F.col("label").rlike(END_LABEL)).select(*SHEET, "row")
    rows = d.groupBy(*SHEET, "row", "header_row", "periods").agg(F.count(F.lit(1)).alias("n")).join(named.withColumn("named", F.lit(True)), [*SHEET, "row"], "left")
    good = rows.filter((F.col("named") & (F.col("n") >= 0.8 * F.col("periods"))) | (F.col("row") == F.col("header_row")))
    best = good.groupBy(*SHEET).agg(F.min_by("row", F.struct(F.when(F.col("named") & (F.col("n") >= 0.8 * F.col("periods")), 0).otherwise(1), "row")).alias("row"))
    ends = d.join(best, [*SHEET, "row"]).select(*SHEET, "col", "value_date")
    starts = ends.groupBy(*SHEET).agg(F.bool_and(F.dayofmonth("value_date") == 1).alias("starts"))
    both = with_period_ends(ends, SHEET, "value_date").join(starts, SHEET)
    return both.select(*SHEET, F.col("col").alias("at"), F.when(F.col("starts"), F.col("period_end")).otherwise(F.col("value_date")).alias("period_end"))


def valuation_dates(cells: DataFrame, lines: DataFrame, names: DataFrame) -> DataFrame:
    """Candidate valuation dates of a workbook in order: cells that names point to first, then labelled rows."""
    d = cells.filter("value_kind = 'date'").select(*SHEET, "row", "col", "value_date")
    ref = r"^=?(?:'((?:[^']|'')+)'|([^'!]+))!\$?([A-Z]{1,3})\$?(\d+)$"
    addr = F.concat(F.regexp_extract("ref", ref, 3), F.regexp_extract("ref", ref, 4))
    sheet = F.when(F.regexp_extract("ref", ref, 1) != "", F.replace(F.regexp_extract("ref", ref, 1), F.lit("''"), F.lit("'"))).otherwise(F.regexp_extract("ref", ref, 2))
    named = names.filter(F.col("name").rlike(VALUATION_LABEL)).select("workbook_id", sheet.alias("sheet"), addr.alias("addr"), "name")
    by_name = named.join(cells.filter("value_kind = 'date'").select(*SHEET, "addr", "value_date"), [*SHEET, "addr"]).select("workbook_id", F.lit(0).alias("k"), F.col("name").alias("o"), "value_date")
    labelled = d.join(lines.filter(F.col("label").rlike(VALUATION_LABEL)).select(*SHEET, "row"), [*SHEET, "row"])
    by_label = labelled.groupBy(*SHEET, "row").agg(F.min_by("value_date", "col").alias("value_date")).select("workbook_id", F.lit(1).alias("k"), F.format_string("%s!%08d", "sheet", "row").alias("o"), "value_date")
    order = F.row_number().over(Window.partitionBy("workbook_id").orderBy("k", "o"))
    return by_name.unionByName(by_label).select("workbook_id", "value_date", order.alias("choice"))


def catalogue(cells: DataFrame, lines: DataFrame, layouts: DataFrame, names: DataFrame) -> DataFrame:
    """Every PV cell with its rows, saved value, recomputed PV, and the convention that gives its factors.

    ``reproduces`` says whether flows times factors give the saved value. Rate, valuation date, timing and day count
    are those of the first candidate date under which one convention gives all live factors; null if there is none.
    """
    flows = pv_cells(cells)
    keys = [*PV, "cf_sheet", "cf_row", "df_sheet", "df_row"]
    pv = flows.groupBy(*keys).agg(F.sum(F.col("flow") * F.col("factor")).alias("pv"), F.count(F.lit(1)).alias("n_periods"))
    saved = cells.select(*PV, F.col("value_num").alias("value"))
    dated = flows.join(period_dates(cells, lines, layouts).withColumnRenamed("sheet", "df_sheet"), ["workbook_id", "df_sheet", "at"])
    cand = dated.join(valuation_dates(cells, lines, names), "workbook_id")
    got = read_back(cand, [*keys, "choice", "value_date"], "period_end", "factor", F.col("value_date"))
    first = got.groupBy(*keys).agg(F.min_by(F.struct(F.col("value_date").alias("valuation_date"), "timing", "day_count", F.round("rate", 12).alias("rate")), "choice").alias("c")).select(*keys, "c.*")
    out = pv.join(saved, PV).join(first, keys, "left")
    return out.withColumn("reproduces", F.coalesce(F.abs(F.col("pv") - F.col("value")) <= tolerance(F.abs("value")), F.lit(False)))


def scenarios(found: DataFrame, flows: DataFrame, dates: DataFrame, shifts: list[float]) -> DataFrame:
    """PV of each catalogued cell with its rate moved by ``shifts`` (in parts of one), under its own convention."""
    keys = [*PV, "cf_sheet", "cf_row", "df_sheet", "df_row"]
    rated = found.filter("rate is not null").select(*keys, "valuation_date", "timing", "day_count", F.explode(F.array(*[F.lit(float(s)) for s in shifts])).alias("shift"), "rate")
    base = flows.select(*keys, "at", "flow").join(dates.withColumnRenamed("sheet", "df_sheet"), ["workbook_id", "df_sheet", "at"]).join(rated, keys)
    parts = None
    for timing in ("end", "mid", "mid-year"):
        for dc in ("actual/actual", "actual/365"):
            own = base.filter((F.col("timing") == timing) & (F.col("day_count") == dc))
            f = factor(own, [*keys, "shift"], "period_end", as_rate(F.col("rate") + F.col("shift")), F.col("valuation_date"), timing, dc)
            parts = f if parts is None else parts.unionByName(f)
    return present_value(parts, [*keys, "shift"], "flow").select(*keys, "shift", "pv")
