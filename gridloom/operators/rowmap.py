"""From cells to layouts, line items and formula families, all workbooks at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.formula import relative
from gridloom.operators.timeline import fill_down, periodicity

MIN_TIMELINE, SCAN_COLS, SAMPLES, FAMILIES = 4, 8, 3, 3
SHEET = ["workbook_id", "sheet"]


def _is_text() -> Column:
    return (F.col("value_kind").isin("text", "error")) & (F.trim("value") != "")


def timeline_runs(dates: DataFrame) -> DataFrame:
    """The timeline of every sheet by its ``dates`` (row, col, value_date): row, span, periods and dates in order (``ds``)."""
    most = dates.groupBy(*SHEET, "row").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_TIMELINE)
    header = most.groupBy(*SHEET).agg(F.max_by("row", F.struct("n", -F.col("row"))).alias("row"))
    head = dates.join(header, [*SHEET, "row"])
    island = F.col("col") - F.row_number().over(Window.partitionBy(*SHEET).orderBy("col"))
    runs = head.withColumn("i", island).groupBy(*SHEET, "row", "i").agg(
        F.count(F.lit(1)).alias("periods"), F.min("col").alias("tl_first"), F.max("col").alias("tl_last"), F.min("value_date").alias("period_start"),
        F.max("value_date").alias("period_end"), F.array_sort(F.collect_list(F.struct("col", "value_date"))).alias("ds"),
    ).filter(F.col("periods") >= MIN_TIMELINE)
    return runs.groupBy(*SHEET).agg(F.max_by(F.struct("row", "periods", "tl_first", "tl_last", "period_start", "period_end", "ds"), F.struct("periods", -F.col("tl_first"))).alias("t")).select(*SHEET, "t.*")


def detect_layout(cells: DataFrame) -> DataFrame:
    """Per sheet: header row and span of the timeline, its periods, the label column and the units column.

    The timeline is the longest run of neighbouring dates (four at least, the first of equals) in the row with most
    dates (the first of equals). Labels stand in the column left of it with the most and longest text, units in a
    column right of the labels with short repeated text in at least a fifth as many rows. Sheets without a timeline
    look for labels in the first eight columns used. Blank sheets give no row.
    """
    best = timeline_runs(cells.filter("value_kind = 'date'").select(*SHEET, "row", "col", "value_date"))
    gaps = best.select(*SHEET, F.explode(F.expr("transform(sequence(1, size(ds) - 1), i -> datediff(ds[i].value_date, ds[i - 1].value_date))")).alias("g"))
    timeline = best.join(gaps.groupBy(*SHEET).agg(periodicity(F.median("g")).alias("periodicity")), SHEET, "left")

    used = cells.filter("value is not null or formula is not null").groupBy(*SHEET).agg(F.min("col").alias("first_used"))
    per = cells.filter(_is_text()).groupBy(*SHEET, "col").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.length(F.trim("value"))).alias("len"), F.countDistinct(F.trim("value")).alias("kinds"))
    limit = F.coalesce(F.col("tl_first") - 1, F.col("first_used") + SCAN_COLS - 1)
    cand = used.join(timeline.select(*SHEET, "tl_first"), SHEET, "left").join(per, SHEET).filter(F.col("col") <= limit)
    score = F.col("n") * F.least("len", F.lit(20.0))
    label = cand.groupBy(*SHEET).agg(F.max_by(F.struct("col", "n"), F.struct(score, -F.col("col"))).alias("l")).select(*SHEET, F.col("l.col").alias("label_col"), F.col("l.n").alias("n_labels"))
    unit = cand.join(label, SHEET).filter((F.col("col") > F.col("label_col")) & (F.col("n") >= 0.2 * F.col("n_labels")) & (F.col("len") <= 12) & (F.col("kinds") <= 0.6 * F.col("n")))
    units = unit.groupBy(*SHEET).agg(F.max_by("col", F.struct("n", -F.col("col"))).alias("units_col"))
    return used.select(*SHEET).join(timeline.drop("ds").withColumnRenamed("row", "header_row"), SHEET, "left").join(label.drop("n_labels"), SHEET, "left").join(units, SHEET, "left")


def shown(value: Column, kind: Column) -> Column:
    """A sample as text: whole numbers without decimals, others to four significant digits, text cut at 40.

    Beyond four digits before the point, or four zeros after it, a number is shown with an exponent of two digits. Halves in
    the last digit, as written in decimals, go up.
    """
    ten, x = F.lit(10.0), value.try_cast("double")
    digits = F.lit(3) - F.floor(F.log10(F.abs(x)))
    near = F.round(x * F.pow(ten, digits)) / F.pow(ten, digits)
    power = F.floor(F.log10(F.abs(near)))
    digitised = lambda c: F.call_function("format_number", c, F.lit("0.########"))
    exponent = F.concat(digitised(F.round(near / F.pow(ten, power), 3)), F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    text = F.when((x == F.floor(x)) & (F.abs(x) < 1e12), x.cast("bigint").cast("string")).when((power < -4) | (power >= 4), exponent).otherwise(digitised(near))
    return F.when(kind == "num", text).otherwise(F.substring(value, 1, 40))


def families(cells: DataFrame) -> DataFrame:
    """Relative patterns of each row's formulas with how many cells share them and where: the row's families by rank."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(r1c1=[relative(f, r, c) for f, r, c in zip(pdf.formula, pdf["row"], pdf["col"])])[["workbook_id", "sheet", "row", "col", "addr", "r1c1"]]

    f = cells.filter("formula is not null").select(*SHEET, "row", "col", "addr", "formula").mapInPandas(run, "workbook_id string, sheet string, `row` int, col int, addr string, r1c1 string")
    one = f.groupBy(*SHEET, "row", "r1c1").agg(F.count(F.lit(1)).alias("n_cells"), F.min_by("addr", "col").alias("first_addr"), F.max_by("addr", "col").alias("last_addr"), F.min("col").alias("_c"))
    return one.withColumn("rank", F.row_number().over(Window.partitionBy(*SHEET, "row").orderBy(F.desc("n_cells"), "_c"))).drop("_c")


def data_cells(cells: DataFrame, layouts: DataFrame) -> DataFrame:
    """Cells with ``is_data``: text left of or in the label column and in the units column names the line, the rest is data."""
    c = cells.join(layouts.select(*SHEET, "label_col", "units_col"), SHEET, "left")
    numeric = F.coalesce(F.col("value_kind") == "num", F.lit(False))
    in_label = F.coalesce((F.col("col") < F.col("label_col")) | (F.col("col") == F.col("label_col")) & ~numeric, F.lit(False))
    in_units = F.coalesce((F.col("col") == F.col("units_col")) & ~numeric, F.lit(False))
    return c.withColumn("is_data", ~in_label & ~in_units).withColumn("_label", in_label & ~in_units).withColumn("_units", in_units)


def line_items(cells: DataFrame, layouts: DataFrame) -> DataFrame:
    """One row per line that holds data: section, label, units, counts and up to three samples.

    The label joins the texts of the label area, or is the row's first other text; a row of labels only is a section
    heading for the rows below it.
    """
    c = data_cells(cells, layouts).withColumn("_shown", F.coalesce(shown(F.col("value"), F.col("value_kind")), F.col("formula")))
    data = F.col("is_data")
    some = data & F.col("value").isNotNull() & ~((F.col("value_kind") == "num") & (F.col("value_num") == 0))
    pick = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.struct("col", "_shown", "addr"))))
    rows = c.groupBy(*SHEET, "row").agg(
        F.array_join(F.transform(pick(F.col("_label") & F.col("_shown").isNotNull()), lambda x: x["_shown"]), " ").alias("_l"),
        F.max_by(F.when(F.col("_units"), F.col("_shown")), F.when(F.col("_units"), F.col("col"))).alias("units"),
        F.count_if(data & F.col("formula").isNotNull()).cast("int").alias("n_formula"), F.count_if(data & F.col("formula").isNull()).cast("int").alias("n_const"),
        F.min_by(F.when(data & (F.col("value_kind") == "text"), F.substring(F.trim("value"), 1, 60)), F.when(data & (F.col("value_kind") == "text") & (F.trim("value") != ""), F.col("col"))).alias("_first"),
        F.slice(pick(some), 1, SAMPLES).alias("_s"),
    )
    rows = rows.withColumn("label", F.when(F.col("_l") != "", F.col("_l")).otherwise(F.coalesce("_first", F.lit(""))))
    bare = (F.col("n_formula") == 0) & (F.col("n_const") == 0)
    filled = fill_down(rows, SHEET, ["row"], F.when(bare & (F.col("label") != ""), F.col("label")), "section")
    samples = F.array_join(F.transform("_s", lambda x: F.concat(F.regexp_extract(x["addr"], r"^([A-Z]+)", 1), F.lit("="), x["_shown"])), ", ")
    return filled.filter(~bare).select(*SHEET, "row", F.coalesce("section", F.lit("")).alias("section"), "label", F.coalesce("units", F.lit("")).alias("units"), "n_formula", "n_const", samples.alias("samples"))


def map_text(lines: DataFrame, fams: DataFrame) -> DataFrame:
    """The human row map, one text line a line item, in order of sheet and row."""
    text = F.concat(F.col("r1c1"), F.lit(" x"), F.col("n_cells").cast("string"), F.lit(" ("), F.when(F.col("n_cells") > 1, F.concat("first_addr", F.lit(".."), "last_addr")).otherwise(F.col("first_addr")), F.lit(")"))
    top = fams.groupBy(*SHEET, "row").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= FAMILIES, F.struct("rank", text.alias("t"))))), lambda x: x["t"]), "; ").alias("p"), F.max("rank").alias("n"))
    p = F.concat("p", F.when(F.col("n") > FAMILIES, F.concat(F.lit("; +"), (F.col("n") - FAMILIES).cast("string"), F.lit(" more patterns"))).otherwise(""))
    line = F.concat(F.lit("r"), F.col("row").cast("string"), F.lit(" "), F.when(F.col("label") == "", "?").otherwise(F.col("label")), F.lit(" ["), "units", F.lit("] f="), F.col("n_formula").cast("string"), F.lit(" c="), F.col("n_const").cast("string"),
                    F.when(F.col("p").isNotNull(), F.concat(F.lit(" | "), p)).otherwise(""), F.when(F.col("samples") != "", F.concat(F.lit(" | eg "), "samples")).otherwise(""))
    return lines.join(top, [*SHEET, "row"], "left").select(*SHEET, "row", line.alias("text"))
