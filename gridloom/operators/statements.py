"""Financial statements out of line items: linear terms of formulas, structure, role bindings and identity results."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.formula import Call, FormulaError, area, relative, tree
from gridloom.functions.ontology import IDENTITIES, ROLES, coefficients, identity_parts, named_roles
from gridloom.operators.identities import best_signs, residuals, tolerance
from gridloom.operators.rowmap import SHEET, timeline_runs
from gridloom.tables import broadcast_if_small, materialise

SPANS = "workbook_id string, sheet string, `row` int, sign int, t_sheet string, r1 int, r2 int, delta int, in_sum boolean"
Span = tuple[int, str, int, int, int, bool]
#: A row: terms of its dominant formula, whether it holds anything, its cells' columns and values, and those that are dates.
HELD = ("workbook_id string, sheet string, `row` int, terms array<struct<sign: int, t_sheet: string, r1: int, r2: int, delta: int, in_sum: boolean>>, "
        "used boolean, cols array<int>, vals array<double>, dates array<struct<col: int, value_date: date>>")
HELD_TYPES = {
    "workbook_id": pa.string(), "sheet": pa.string(), "row": pa.int32(),
    "terms": pa.list_(pa.struct([("sign", pa.int32()), ("t_sheet", pa.string()), ("r1", pa.int32()), ("r2", pa.int32()), ("delta", pa.int32()), ("in_sum", pa.bool_())])),
    "used": pa.bool_(), "cols": pa.list_(pa.int32()), "vals": pa.list_(pa.float64()), "dates": pa.list_(pa.struct([("col", pa.int32()), ("value_date", pa.date32())])),
}
#: Rows of Python objects that are handed over at once.
PIECE = 5_000
#: A sum over more rows than this is no list of terms where terms are listed one by one (fixed value).
MAX_TERMS = 300
#: Sums over more rows than ``MAX_TERMS`` + 1 add blocks of 2**8 rows, each added up once.
BLOCK_BITS = 8


def linear_terms(formula: str, sheet: str, col: int) -> list[tuple[int, str, int, int, bool]] | None:
    """(sign, sheet, row, columns to the right, inside a SUM) of a formula that only adds and subtracts cells; None else."""
    spans = linear_spans(formula, sheet, col)
    return spans and [(sign, t, r, delta, in_sum) for sign, t, a, b, delta, in_sum in spans for r in range(a, b + 1)]


def linear_spans(formula: str, sheet: str, col: int, most: int | None = MAX_TERMS) -> list[Span] | None:
    """The same with (first row, last row) in place of each row; ``most`` None lets sums be of any length."""
    spans = _spans(formula)
    if spans is None or most is not None and any(b - a > most for _, _, a, b, _, _ in spans):
        return None
    return [(sign, t or sheet, a, b, c - col, in_sum) for sign, t, a, b, c, in_sum in spans]


@lru_cache(1 << 14)
def _spans(formula: str) -> list[tuple[int, str | None, int, int, int, bool]] | None:
    try:
        items = tree(formula)
    except FormulaError:
        return None
    out: list[tuple[int, str | None, int, int, int, bool]] = []

    def cells(text: str, sign: int, in_sum: bool) -> bool:
        a = area(text)
        if a is None or a.c1 != a.c2 or a.whole_row or not in_sum and a.r1 != a.r2:
            return False
        out.append((sign, a.sheet, a.r1, a.r2, a.c1, in_sum))
        return True

    def add(parts: list, outer: int, in_sum: bool) -> bool:
        sign, need = outer, True
        stack = [outer]
        for x in parts:
            if isinstance(x, Call):
                if x.name != "SUM" or not need or not all(add(a, sign, True) for a in x.args):
                    return False
                need = False
            elif x[0] == "ref":
                if not need or not cells(x[1], sign, in_sum):
                    return False
                need = False
            elif x[0] == "op" and x[1] in "+-":
                sign = stack[-1] * (-1 if x[1] == "-" else 1) * (1 if not need else sign * stack[-1])
                need = True
            elif x[0] == "open" and need:
                stack.append(sign)
            elif x[0] == "close" and len(stack) > 1:
                stack.pop()
            else:
                return False
        return not need

    return out if add(items, 1, False) and out else None


def dominant_formulas(cells: DataFrame, fams: DataFrame) -> DataFrame:
    """First formula of each row's largest family."""
    top = fams.filter("rank = 1").select(*SHEET, "row", F.col("first_addr").alias("addr"))
    return cells.filter("formula is not null").select(*SHEET, "row", "col", "addr", "formula").join(top, [*SHEET, "row", "addr"], "left_semi")


def terms(formulas: DataFrame) -> DataFrame:
    """Linear terms of rows, one row a term; rows whose formula is not linear give none.

    Ranges leave Python as ranges: their rows are listed by Spark, as a batch of formulas may have millions of terms.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(w, s, r, *t) for w, s, r, c, f in zip(pdf.workbook_id, pdf.sheet, pdf["row"], pdf["col"], pdf.formula) for t in linear_spans(f, s, c) or []]
            yield pd.DataFrame(rows, columns=["workbook_id", "sheet", "row", "sign", "t_sheet", "r1", "r2", "delta", "in_sum"])

    spans = formulas.select(*SHEET, "row", "col", "formula").mapInPandas(run, SPANS)
    return spans.select(*SHEET, "row", "sign", "t_sheet", F.explode(F.sequence("r1", "r2")).alias("t_row"), "delta", "in_sum")


def structure(t: DataFrame) -> DataFrame:
    """What rows are by their terms: subtotal, link, consolidation, previous (reads one column back), or other linear."""
    own = t.groupBy(*SHEET, "row").agg(
        F.count(F.lit(1)).alias("n_terms"), F.min("delta").alias("lo"), F.max("delta").alias("hi"), F.min("sign").alias("_s"),
        F.countDistinct(F.when(F.col("t_sheet") != F.col("sheet"), F.col("t_sheet"))).alias("n_other"), F.count_if(F.col("t_sheet") == F.col("sheet")).alias("n_own"),
    )
    return own.select(*SHEET, "row", "n_terms", _kind().alias("kind"))


def _kind() -> Column:
    return (
        F.when((F.col("n_terms") == 1) & (F.col("lo") == -1), "previous").when((F.col("n_terms") == 1) & (F.col("lo") == 0) & (F.col("_s") == 1), "link")
        .when((F.col("lo") == 0) & (F.col("hi") == 0) & (F.col("n_other") >= 2) & (F.col("n_own") == 0), "consolidation")
        .when((F.col("lo") == 0) & (F.col("hi") == 0) & (F.col("n_terms") >= 2), "subtotal").otherwise("linear")
    )


def corkscrews(t: DataFrame) -> DataFrame:
    """Roll-forwards: a closing row of opening plus moves whose opening row is the closing one column back."""
    prev = t.filter("delta = -1").select(*SHEET, F.col("row").alias("opening"), F.col("t_sheet").alias("c_sheet"), F.col("t_row").alias("closing"))
    closing = t.filter("delta = 0 and sheet = t_sheet").select(*SHEET, F.col("row").alias("closing"), F.col("t_row").alias("opening"))
    pair = closing.join(prev.filter("c_sheet = sheet").drop("c_sheet"), [*SHEET, "closing", "opening"])
    apart = prev.filter("c_sheet = sheet and opening = closing").select(*SHEET, "closing", F.lit(None).cast("int").alias("opening"))
    return pair.select(*SHEET, "closing", "opening").unionByName(apart).distinct()


def link_sources(t: DataFrame, kinds: DataFrame) -> DataFrame:
    """Row at the end of each chain of links, however long, by pointer doubling; chains that run into a cycle end nowhere.

    A round doubles how far each link points, so rounds are the logarithm of the longest chain. Links that still point at
    a link once as many steps are covered as there are links are on or before a cycle.
    """
    link = t.join(kinds.filter("kind = 'link'").select(*SHEET, "row"), [*SHEET, "row"], "left_semi").select("workbook_id", "sheet", "row", F.col("t_sheet").alias("s_sheet"), F.col("t_row").alias("s_row"))
    link = materialise(link)
    out, steps, most = link, 1, link.groupBy("workbook_id").count().agg(F.max("count")).first()[0] or 0
    still = link.select("workbook_id", F.col("sheet").alias("s_sheet"), F.col("row").alias("s_row"))
    while steps <= most and not out.join(still, ["workbook_id", "s_sheet", "s_row"], "left_semi").isEmpty():
        nxt = out.select("workbook_id", F.col("sheet").alias("s_sheet"), F.col("row").alias("s_row"), F.col("s_sheet").alias("n_sheet"), F.col("s_row").alias("n_row"))
        out = materialise(out.join(nxt, ["workbook_id", "s_sheet", "s_row"], "left").select("workbook_id", "sheet", "row", F.coalesce("n_sheet", "s_sheet").alias("s_sheet"), F.coalesce("n_row", "s_row").alias("s_row")))
        steps *= 2
    return out.join(still, ["workbook_id", "s_sheet", "s_row"], "left_anti")


def row_values(cells: DataFrame, layouts: DataFrame) -> DataFrame:
    """Values of every row by date of its sheet's timeline: a blank is 0, a text or an error unknown; totals are left out."""
    span = layouts.filter("tl_first is not null").select(*SHEET, "header_row", "tl_first", "tl_last")
    c = cells.join(span, SHEET).filter("col between tl_first and tl_last")
    head = c.filter("row = header_row and value_kind = 'date'").select(*SHEET, "col", F.col("value_date").alias("period"))
    body = c.filter("row <> header_row")
    rows = body.select(*SHEET, "row").distinct()
    v = F.when(F.col("value").isNull(), 0.0).when(F.col("value_kind").isin("num", "bool"), F.col("value_num"))
    return rows.join(head, SHEET).join(body.select(*SHEET, "row", "col", F.struct(v.alias("v")).alias("x")), [*SHEET, "row", "col"], "left").select(
        *SHEET, "row", "period", F.when(F.col("x").isNull(), 0.0).otherwise(F.col("x.v")).alias("value"))


def subtotal_results(t: DataFrame, kinds: DataFrame, values: DataFrame) -> DataFrame:
    """Every subtotal and consolidation held against its parts' saved values: max_residual, n_failing, status."""
    own = kinds.filter("kind in ('subtotal', 'consolidation')").select(*SHEET, "row", "n_terms")
    part = t.join(own, [*SHEET, "row"]).join(values.select("workbook_id", F.col("sheet").alias("t_sheet"), F.col("row").alias("t_row"), "period", "value"), ["workbook_id", "t_sheet", "t_row"])
    total = values.join(own, [*SHEET, "row"]).select(*SHEET, "row", "n_terms", "period", F.lit(-1).alias("sign"), "value")
    return _held_against(part.select(*SHEET, "row", "n_terms", "period", "sign", "value").unionByName(total))


def _held_against(both: DataFrame) -> DataFrame:
    """Results of subtotals whose parts count with their signs and whose own values count as -1."""
    return _results(both.filter("value is not null").select(*SHEET, "row", "n_terms", "period", "sign", "value", F.abs("value").alias("scale"), F.lit(1).alias("n")))


def _results(parts: DataFrame) -> DataFrame:
    """The same of parts that are one value each or ``n`` of them added up, ``scale`` the largest."""
    res = parts.groupBy(*SHEET, "row", "n_terms", "period").agg(F.sum(F.col("sign") * F.col("value")).alias("residual"), F.max("scale").alias("scale"), F.sum("n").alias("n")).filter("n = n_terms + 1")
    tol = tolerance(F.max("scale").over(Window.partitionBy(*SHEET, "row")))
    marked = res.withColumn("bad", F.abs("residual") > tol)
    out = marked.groupBy(*SHEET, "row").agg(F.max(F.abs("residual")).alias("max_residual"), F.count_if("bad").alias("n_failing"), F.count(F.lit(1)).alias("n_periods"))
    return out.withColumn("status", F.when(F.col("n_failing") == 0, "holds").otherwise("fails"))


def _dominant(rows: list[tuple[int, str, str | None]], row: int) -> list[tuple[int, str]]:
    """Column and formula of what ``families`` and ``dominant_formulas`` keep of one row's formulas (column, formula, address)."""
    groups: dict[str, list] = {}
    for c, f, addr in rows:
        groups.setdefault(relative(f, row, c), [0, c, addr])[0] += 1
    _, _, first = min(groups.values(), key=lambda g: (-g[0], g[1]))
    return [(c, f) for c, f, addr in rows if addr is not None and addr == first]


def _row_of(key: tuple, cols: list, formulas: list, addrs: list, used: list, dated: list, dates: list, vals: list) -> tuple:
    book, sheet, row = key
    fs = [(c, f, a) for c, f, a in zip(cols, formulas, addrs) if f is not None and c is not None]
    found = row is not None and any(_spans(f) for _, f, _ in fs)  # else no formula of the row has terms
    got = [t for c, f in _dominant(fs, row) for t in linear_spans(f, sheet, c, None) or []] if found else []
    return book, sheet, row, got, any(used), cols, vals, [(c, d) for c, is_date, d in zip(cols, dated, dates) if is_date]


def held_rows(cells: DataFrame, newest: str | None = None) -> DataFrame:
    """Every row with its terms, values and dates (``HELD``), out of one exchange of the cells.

    Of several copies of a cell the one with the greatest ``newest`` counts.
    """
    is_date = F.coalesce(F.col("value_kind") == "date", F.lit(False))
    few = cells.select(
        *SHEET, "row", "col", *([newest] if newest else []), "formula", F.when(F.col("formula").isNotNull(), F.col("addr")).alias("addr"), (F.col("value").isNotNull() | F.col("formula").isNotNull()).alias("used"), is_date.alias("dated"), F.when(is_date, F.col("value_date")).alias("value_date"),
        F.when(F.col("value").isNull(), 0.0).when(F.col("value_kind").isin("num", "bool"), F.col("value_num")).alias("v"),
    ).repartition(*SHEET, "row")
    if newest:
        few = few.withColumn("_n", F.row_number().over(Window.partitionBy(*SHEET, "row", "col").orderBy(F.desc(newest)))).filter("_n = 1")

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for c in batch.columns[:3]:
                a, b = c[1:], c[:-1]
                same = pc.or_kleene(pc.equal(a, b), pc.and_(pc.is_null(a), pc.is_null(b)))
                new[1:] |= ~pc.fill_null(same, False).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new).tolist()
            firsts = zip(*(c.take(pa.array(starts)).to_pylist() for c in batch.columns[:3]))
            columns = [c.to_pylist() for c in batch.columns[3:]]
            for first, a, b in zip(firsts, starts, [*starts[1:], batch.num_rows]):
                part = [c[a:b] for c in columns]
                if first == key:
                    for x, y in zip(held, part):
                        x += y
                    continue
                if key is not None:
                    yield _row_of(key, *held)
                key, held = first, part
        if key is not None:
            yield _row_of(key, *held)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = rows(batches)
        while piece := list(islice(out, PIECE)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*piece), HELD_TYPES.values())], names=list(HELD_TYPES))

    ordered = few.sortWithinPartitions(*SHEET, "row", "col")
    return ordered.select(*SHEET, "row", "col", "formula", "addr", "used", "dated", "value_date", "v").mapInArrow(run, HELD)


def held_subtotals(rows: DataFrame) -> DataFrame:
    """``subtotal_results`` out of ``held_rows``: a row's values by period travel as arrays, and each row is joined once."""
    dates = rows.filter("size(dates) > 0").select(*SHEET, "row", F.explode("dates").alias("x")).select(*SHEET, "row", "x.*")
    used = rows.filter("used").select(*SHEET).distinct()
    span = timeline_runs(dates).select(*SHEET, F.col("row").alias("header_row"), "tl_first", "tl_last", "ds").join(used, SHEET, "left_semi")
    value = lambda h: F.when(F.array_contains("cols", h["col"]), F.get("vals", F.array_position("cols", h["col"]).cast("int") - 1)).otherwise(0.0)
    valued = rows.select(*SHEET, "row", "cols", "vals").join(span, SHEET).filter("row <> header_row").filter(F.exists("cols", lambda c: c.between(F.col("tl_first"), F.col("tl_last"))))
    valued = valued.select("workbook_id", F.col("sheet").alias("t_sheet"), F.col("row").alias("t_row"), F.transform("ds", lambda h: h["value_date"]).alias("period"), F.transform("ds", value).alias("value"))

    deltas, total = F.transform("terms", lambda x: x["delta"]), F.struct(F.lit(-1).alias("sign"), F.col("sheet").alias("t_sheet"), F.col("row").alias("r1"), F.col("row").alias("r2"), F.lit(0).alias("delta"), F.lit(False).alias("in_sum"))
    other = F.filter(F.transform("terms", lambda x: x["t_sheet"]), lambda s: s != F.col("sheet"))
    kinds = rows.filter("size(terms) > 0").select(
        *SHEET, "row", "terms", F.aggregate("terms", F.lit(0).cast("bigint"), lambda n, x: n + x["r2"] - x["r1"] + 1).alias("n_terms"), F.array_min(deltas).alias("lo"), F.array_max(deltas).alias("hi"), F.array_min(F.transform("terms", lambda x: x["sign"])).alias("_s"),
        F.size(F.array_distinct(other)).alias("n_other"), F.size(F.filter("terms", lambda x: x["t_sheet"] == F.col("sheet"))).alias("n_own"),
    ).filter(_kind().isin("subtotal", "consolidation"))
    spans = kinds.select(*SHEET, "row", "n_terms", F.explode(F.concat("terms", F.array(total))).alias("x")).select(*SHEET, "row", "n_terms", "x.sign", "x.t_sheet", "x.r1", "x.r2")
    few, many = spans.filter(F.col("n_terms") <= MAX_TERMS + 1), spans.filter(F.col("n_terms") > MAX_TERMS + 1)
    part = few.select(*SHEET, "row", "n_terms", "sign", "t_sheet", F.explode(F.sequence("r1", "r2")).alias("t_row"))
    both = part.join(valued, ["workbook_id", "t_sheet", "t_row"]).select(*SHEET, "row", "n_terms", "sign", "period", "value").repartition(*SHEET, "row")
    each = both.select(*SHEET, "row", "n_terms", "sign", F.explode(F.arrays_zip("period", "value")).alias("x")).select(*SHEET, "row", "n_terms", "sign", "x.*")
    out = _held_against(each)
    return out if many.isEmpty() else out.unionByName(_held_long(materialise(many), valued))


def _held_long(spans: DataFrame, valued: DataFrame) -> DataFrame:
    """The same for sums over many rows: whole blocks of rows are added up once, whatever the number of sums that hold them.

    ``spans`` has r1 and r2 and the sheet they lie on, ``valued`` a row's values by period. A sum over rows that are not
    all there has no result, as one of fewer rows.
    """
    size, key = 1 << BLOCK_BITS, ["workbook_id", "t_sheet"]
    sheets = materialise(spans.select(*key).distinct())
    there = materialise(valued.join(broadcast_if_small(sheets, sheets.count()), key, "left_semi"))
    ends = there.groupBy(*key).agg(F.min("t_row").alias("lo"), F.max("t_row").alias("hi"))
    first, last = F.shiftright(F.col("r1") + (size - 1), BLOCK_BITS), F.shiftright(F.col("r2") + 1, BLOCK_BITS) - 1  # whole blocks
    cut = spans.join(ends, key).filter("r1 >= lo and r2 <= hi").withColumn("first", first).withColumn("last", last)
    whole = F.col("first") <= F.col("last")
    run = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    single = F.when(whole, F.concat(run(F.col("r1"), F.col("first") * size - 1), run((F.col("last") + 1) * size, F.col("r2")))).otherwise(run(F.col("r1"), F.col("r2")))
    by_period = lambda df, *c: df.select(*c, F.explode(F.arrays_zip("period", "value")).alias("x")).select(*c, "x.*").filter("value is not null")
    own = [*SHEET, "row", "n_terms", "sign"]
    rows = by_period(cut.withColumn("t_row", F.explode(single)).join(there, [*key, "t_row"]), *own).withColumn("scale", F.abs("value")).withColumn("n", F.lit(1).cast("bigint"))
    asked = cut.filter(whole).withColumn("block", F.explode(F.sequence("first", "last"))).select(*own, "t_sheet", "block")
    block = there.withColumn("block", F.shiftright("t_row", BLOCK_BITS)).join(asked.select(*key, "block").distinct(), [*key, "block"], "left_semi")
    block = by_period(block, *key, "block").groupBy(*key, "block", "period").agg(F.sum("value").alias("value"), F.max(F.abs("value")).alias("scale"), F.count(F.lit(1)).alias("n"))
    blocks = asked.join(block, [*key, "block"]).select(*own, "period", "value", "scale", "n")
    return _results(rows.unionByName(blocks))


#: How sheet names name a block.
BLOCK_SHEETS = {
    "income_statement": "p ?&? ?l|pnl|income|profit",
    "balance_sheet": r"balance|\bbs\b",
    "cash_flow": r"cash ?flow|\bcf\b",
    "debt": "debt|loan",
    "fixed_assets": "asset|capex|fixed",
    "equity": "equity|retained",
    "revenue": "revenue|sales",
    "capex": "capex",
    "sources_uses": "sources",
    "distributions": "dcf|valuation|distribution",
}


def _block_sheet(block: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in BLOCK_SHEETS.items() for x in kv]), block)


def label_bindings(lines: DataFrame, kinds: DataFrame) -> DataFrame:
    """One line for each role of each workbook, by label: rows on a sheet named like the block first, totals before others.

    Roles that several lines may play take all lines between the opening and the closing row of their schedule.
    """
    spark = lines.sparkSession
    roles = spark.createDataFrame([(r.name, r.block) for r in ROLES.values()], "role string, block string")
    hit = lines.filter("label <> ''").select(*SHEET, "row", "label", F.explode(named_roles(F.col("label"))).alias("role"))
    hit = hit.join(F.broadcast(roles), "role").join(kinds.select(*SHEET, "row", "kind", "n_terms"), [*SHEET, "row"], "left")
    here = F.coalesce(F.lower("sheet").rlike("(?i)") & F.expr("lower(sheet) rlike pattern"), F.lit(False))
    scored = hit.withColumn("pattern", _block_sheet(F.col("block"))).withColumn("here", here)
    exact = F.length("label")
    single = scored.filter(~F.col("role").endswith("*"))
    return single.groupBy("workbook_id", "role", "block").agg(
        F.max_by(F.struct("sheet", "row", "label"), F.struct("here", F.coalesce(F.col("kind").isin("subtotal", "consolidation"), F.lit(False)), -exact, -F.col("row"), "sheet")).alias("x")
    ).select("workbook_id", "role", "block", "x.*", F.lit("label").alias("bound_by"))


def many_bindings(bound: DataFrame, t: DataFrame) -> DataFrame:
    """Lines of the roles several may play: the terms of the closing row (or total) but its opening."""
    closing = {"debt_movements*": ("debt_closing", "debt_opening"), "fa_movements*": ("fa_closing", "fa_opening"), "re_movements*": ("re_closing", "re_opening"), "rev_segments*": ("rev_total", "")}
    parts = None
    for role, (top, opening) in closing.items():
        c = bound.filter(F.col("role") == top).select("workbook_id", "sheet", "row", "block")
        found = t.filter("delta = 0").join(c, [*SHEET, "row"]).select("workbook_id", F.lit(role).alias("role"), "block", F.col("t_sheet").alias("sheet"), F.col("t_row").alias("row"), F.col("sign").alias("own_sign"))
        o = bound.filter(F.col("role") == opening).select("workbook_id", "sheet", "row")
        found = found.join(o, [*SHEET, "row"], "left_anti")
        parts = found if parts is None else parts.unionByName(found)
    return parts


def identity_results(bound: DataFrame, many: DataFrame, values: DataFrame) -> DataFrame:
    """Each identity of each workbook: status holds, fails or unbound, convention, largest residual, periods, kind.

    An identity is unbound where a role has no line or no period knows all parts. It is evaluated under both signs
    of its free roles, and the better convention is kept; it fails if a residual exceeds the tolerance. One of single
    scope is evaluated by period on one sheet, on the rows' totals over two. One of coverage is not_evaluated.
    """
    spark = bound.sparkSession
    parts = F.broadcast(identity_parts(spark))  # 25 identities of a few roles
    lines = bound.select("workbook_id", "role", "sheet", "row", F.lit(1).alias("own_sign")).unionByName(many.select("workbook_id", "role", "sheet", "row", "own_sign"))
    used = parts.join(lines, "role")
    need = parts.groupBy("identity").agg(F.count(F.lit(1)).alias("n_roles"))
    books = bound.select("workbook_id").distinct()
    full = used.groupBy("workbook_id", "identity").agg(F.countDistinct("role").alias("n"), F.count(F.lit(1)).alias("n_lines"), F.countDistinct("sheet").alias("n_sheets")).join(need, "identity").filter("n = n_roles")
    rows = used.join(full.select("workbook_id", "identity", "n_lines", "n_sheets"), ["workbook_id", "identity"]).join(values, ["workbook_id", "sheet", "row"]).withColumn("coef", F.col("coef") * F.col("own_sign"))
    apart = (F.col("scope") == "single") & (F.col("n_sheets") > 1)
    total = F.when(F.count("value") == F.count(F.lit(1)), F.sum("value")).alias("value")
    totals = rows.filter(apart).groupBy([c for c in rows.columns if c not in ("period", "value")]).agg(total).withColumn("period", F.lit(None).cast("date"))
    rows = rows.filter(~apart).unionByName(totals)
    flexed = rows.withColumn("convention", F.explode(F.when(F.col("identity").isin([i.key for i in IDENTITIES.values() if i.flex]), F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(1)))))
    flexed = flexed.withColumn("coef", F.col("coef") * F.when(F.col("flex"), F.col("convention")).otherwise(1)).filter("value is not null")
    res = flexed.groupBy("workbook_id", "identity", "convention", "n_lines", "period").agg(F.sum(F.col("coef") * F.col("value")).alias("residual"), F.max(F.abs("value")).alias("scale"), F.count(F.lit(1)).alias("n")).filter("n = n_lines")
    worst = res.groupBy("workbook_id", "identity", "convention").agg(F.max(F.abs("residual")).alias("max_residual"), F.max("scale").alias("scale"), F.count(F.lit(1)).alias("n_periods"))
    best = worst.groupBy("workbook_id", "identity").agg(F.min_by(F.struct("convention", "max_residual", "scale", "n_periods"), F.struct("max_residual", -F.col("convention"))).alias("b")).select("workbook_id", "identity", "b.*")
    fixed = F.array(*[F.struct(F.lit(i.key).alias("identity"), F.lit(i.block).alias("block"), F.lit(i.kind).alias("kind")) for i in IDENTITIES.values()])
    every = books.select("workbook_id", F.explode(fixed).alias("i")).select("workbook_id", "i.*")
    out = every.join(best, ["workbook_id", "identity"], "left")
    coverage = F.col("identity").isin([i.key for i in IDENTITIES.values() if i.scope == "coverage"])
    status = F.when(coverage, "not_evaluated").when(F.col("max_residual").isNull(), "unbound").when(F.col("max_residual") <= tolerance(F.col("scale")), "holds").otherwise("fails")
    return out.withColumn("status", status).drop("scale")


__all__ = ["best_signs", "coefficients", "corkscrews", "dominant_formulas", "held_rows", "held_subtotals", "identity_results", "label_bindings", "linear_spans", "linear_terms", "link_sources", "many_bindings", "residuals", "row_values", "structure", "subtotal_results", "terms"]
