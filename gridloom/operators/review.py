"""What a reviewer asks of a model: candidate inputs, valuation results, selectors, classes of rows, stale cells, tables."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.arithmetic import count_cells, read_areas, recompute, step_areas, with_blanks
from gridloom.functions.formula import Area, FormulaError, tokens
from gridloom.operators.rowmap import SHEET
from gridloom.tables import broadcast_if_small, materialise

KEY = ["workbook_id", "sheet", "row"]

# Wordings by which inputs and results are found.
WORDS = {
    "rate": r"discount\s*rate|\bwacc\b|cost of (equity|capital)|hurdle|required return|\bk[ed]\b",
    "date": r"valuation\s*date|val\W*date|\bvd\b",
    "terminal": r"term\w*\W*(val\w*\W*)?date|terminal",
}
RESULT = r"equity value|enterprise value|\bev\b|\bnpv\b|\bxnpv\b|present value|\bpv\b|total valuation|valuation\b"
NO_RESULT, STILL_RESULT = r"date|rate|factor|multiple|period|/", r"value|\bn?pv\b"
COUNTER = r"\b(?:period|year|quarter|month|counter)s?\b"
SELECTOR_READERS, SELECTOR_CELLS, TYPED_RATIO = 10, 20, 3

# Label evidence, each table first match first: pattern, subclass (and fewest cells).
TERMINAL = r"terminal\s*(?:value|val\b|growth|multiple|cash|year|period|date|\)|$)|\btv\b|exit multiple|perpetuity"
TERMINAL_SUB = [(r"growth|perpetuity", "terminal growth"), (r"multiple", "exit multiple"), (r"", "terminal value")]
DISCOUNTING = [
    (r"discount factor|discounting factor", "discount factor", 1), (r"discount rate|\bwacc\b", "discount rate", 1),
    (r"mid[- ]?(period|year)|discount(ing)? (convention|timing)|periods? to discount", "timing", 1),
    (r"^valuation date|^date of valuation|^as at date", "valuation date", 1), (r"^present value|^pv\b|present value \(|\bpv of\b", "present value", 3),
    (r"cost of (equity|debt|capital)", "discount rate build-up", 1),
]
DEBT_FUNDING = r"drawdown|fund(ed|ing)?|facility|repay|refinanc"
CASHFLOW = r"cash ?flow|fcf|ebitda|ebit\b|distribution|dividend|capex|capital expenditure|tax paid|working capital|revenue|opex|operating cost"
# Cash-flow words and what they are called in full.
FULL_WORDS = {"capex": "capital expenditure", "fcf": "free cash flow", "cashflow": "cash flow", "opex": "operating cost"}
TIMELINE = r"\b(?:period|date|year|quarter|month|flag|counter)s?\b|days in"
ASSUMPTIONS = [
    (r"wacc|discount|cost of (equity|debt|capital)|\bbeta\b|premium|gearing|risk", "discount rate"), (r"valuation date", "valuation date"), (r"terminal|perpetuity|exit multiple", "terminal growth"),
    (r"\btax", "tax"), (r"\bcpi\b|inflation|indexation|escalat", "inflation / CPI"), (r"growth", "growth"), (r"volume|traffic|price|toll|tariff|units|demand|quantity|occupancy|throughput", "volume / price"),
    (r"opex|operating|cost|margin|capex|capital expenditure|maintenance|working capital|overhead|salary|wage", "operating"),
    (r"debt|interest|loan|equity|dividend|distribution|drawdown|repayment|facility|financ|cash", "financing"),
]
CALCULATIONS = [(r"volume|traffic|price|toll|tariff|units|demand|quantity", "volume / price"), (r"index|cpi|inflation|escalat", "indexation"), (r"debt|interest|loan|repayment|drawdown|facility", "debt schedule"), (r"\btax", "tax"), (r"balance|opening|closing", "balance")]
BRIDGE = [(r"debt|borrowing|loan", "debt"), (r"cash", "cash"), (r"deferred|consideration", "deferred consideration"), (r"distribution|dividend", "distribution payable"), (r"minorit|non-controlling", "minorities")]


def first_of(label: Column, table: list, default: str) -> Column:
    out = F.when(F.lit(False), "")
    for pattern, name, *_ in table:
        out = out.when(label.rlike(f"(?i){pattern}") if pattern else F.lit(True), name)
    return out.otherwise(default)


def typed() -> Column:
    """An input row: typed values, and at least three times as many as formulas."""
    return (F.col("n_const") > 0) & (F.col("n_const") >= TYPED_RATIO * F.col("n_formula"))


def candidate_cells(cells: DataFrame, lines: DataFrame, layouts: DataFrame, names: DataFrame, what: str, limit: int = 12) -> DataFrame:
    """Cells that look like a ``rate``, valuation ``date`` or ``terminal`` date, at most ``limit`` a workbook, in order.

    Names come first, then labelled rows with their first fitting cell right of the units; a terminal date is no
    valuation date. A cell listed under its name is not listed again.
    """
    fits = (F.col("value_num") > 0) & (F.col("value_num") < 1) & (F.col("value_kind") == "num") if what == "rate" else F.col("value_kind") == "date"
    hit = lambda c: c.rlike(f"(?i){WORDS[what]}") & (~c.rlike(f"(?i){WORDS['terminal']}") if what == "date" else F.lit(True))
    good = cells.filter(fits).select(*KEY, "col", "addr", "value")
    ref = F.regexp_replace(F.regexp_replace("ref", r"^=|\$", ""), "''", "'")
    where = names.select("workbook_id", "name", F.regexp_extract(ref, r"^'?(.*?)'?![A-Z]+\d+$", 1).alias("sheet"), F.regexp_extract(ref, r"!([A-Z]+\d+)$", 1).alias("addr"))
    by_name = where.filter(hit(F.replace("name", F.lit("_"), F.lit(" ")))).join(good, ["workbook_id", "sheet", "addr"]).select(*KEY, "col", "addr", "value", F.col("name").alias("ref"), F.lit(0).alias("k"), F.col("name").alias("o"))
    edge = layouts.select(*SHEET, F.coalesce("units_col", "label_col", F.lit(0)).alias("edge"))
    rows = lines.filter(hit(F.col("label"))).select(*KEY).join(edge, SHEET).join(good, KEY).filter("col > edge")
    first = rows.groupBy(*KEY).agg(F.min_by(F.struct("col", "addr", "value"), "col").alias("x")).select(*KEY, "x.*")
    by_label = first.join(by_name.select(*KEY, "col"), [*KEY, "col"], "left_anti").select(*KEY, "col", "addr", "value", F.concat("sheet", F.lit("!"), "addr").alias("ref"), F.lit(1).alias("k"), F.format_string("%s!%08d", "sheet", "row").alias("o"))
    n = F.row_number().over(Window.partitionBy("workbook_id").orderBy("k", "o"))
    return by_name.unionByName(by_label).withColumn("choice", n).filter(F.col("choice") <= limit).drop("k", "o")


def valuation_outputs(cells: DataFrame, lines: DataFrame, layouts: DataFrame) -> DataFrame:
    """Cells that look like a valuation: labelled so, the row's first formula right of the label with a figure other than 0."""
    named = lines.filter(F.col("label").rlike(f"(?i){RESULT}") & ~(F.col("label").rlike(f"(?i){NO_RESULT}") & ~F.col("label").rlike(f"(?i){STILL_RESULT}"))).select(*KEY, "label")
    c = cells.filter("formula is not null and value_kind = 'num' and value_num <> 0").join(named, KEY).join(layouts.select(*SHEET, F.coalesce("label_col", F.lit(0)).alias("edge")), SHEET).filter("col > edge")
    return c.groupBy(*KEY, "label").agg(F.min_by(F.struct("col", "addr", "value_num", "formula"), "col").alias("x")).select(*KEY, "label", "x.*")


def date_valued(cells: DataFrame, layouts: DataFrame) -> DataFrame:
    """Rows whose first four values right of the label are all dates."""
    c = cells.filter("value is not null").join(layouts.select(*SHEET, F.coalesce("label_col", F.lit(0)).alias("edge")), SHEET).filter("col > edge")
    first = c.withColumn("_n", F.row_number().over(Window.partitionBy(*KEY).orderBy("col"))).filter("_n <= 4")
    return first.groupBy(*KEY).agg(F.bool_and(F.col("value_kind") == "date").alias("dates")).filter("dates").drop("dates")


def selectors(cells: DataFrame, lines: DataFrame, layouts: DataFrame, edges: DataFrame) -> DataFrame:
    """Scenario selectors: 2 to 20 whole numbers from 0 to 99 that ten or more lookup rows read, no counter and no timeline."""
    lookup = cells.filter(F.col("formula").rlike(r"(?i)(?:INDEX|CHOOSE|OFFSET|MATCH)\(")).select("workbook_id", F.col("sheet").alias("src_sheet"), F.col("row").alias("src_row")).distinct()
    read = edges.join(lookup, ["workbook_id", "src_sheet", "src_row"], "left_semi").groupBy("workbook_id", F.col("dst_sheet").alias("sheet"), F.col("dst_row").alias("row")).agg(F.count(F.lit(1)).alias("n_readers"))
    named = lines.filter(~F.col("label").rlike(f"(?i){COUNTER}")).select(*KEY, "label")
    head = layouts.filter("header_row is not null").select(*SHEET, F.col("header_row").alias("row"))
    values = cells.filter("value_kind = 'num'").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_values"), F.bool_and((F.col("value_num") == F.floor("value_num")) & F.col("value_num").between(0, 99)).alias("small"))
    return read.filter(F.col("n_readers") >= SELECTOR_READERS).join(named, KEY).join(head, KEY, "left_anti").join(values, KEY).filter(F.col("small") & F.col("n_values").between(2, SELECTOR_CELLS)).drop("small")


FEATURES = {"role": "string", "bridge_term": "string", "is_buildup": "boolean", "is_exp_factor": "boolean", "is_terminal_input": "boolean", "is_part": "boolean", "is_timeline_row": "boolean", "is_dates": "boolean", "selector": "string", "in_cf_lineage": "boolean"}


def classify(rows: DataFrame) -> DataFrame:
    """Class, subclass and rule of each row by the first of twelve rules that answers.

    ``rows`` has label, n_formula, n_const and any of the columns of ``FEATURES``, absent ones counting as null: what
    the discounting itself calls the row, the bridge term it alone feeds, and so on. Extra columns pass through.
    """
    for name, kind in FEATURES.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    label, n = F.coalesce("label", F.lit("")), F.col("n_formula") + F.col("n_const")
    is_typed = F.coalesce(typed(), F.lit(False))
    said = lambda p: label.rlike(f"(?i){p}")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    got = lambda rule, cls, sub: F.struct(F.lit(cls).alias("class") if isinstance(cls, str) else cls.alias("class"), (F.lit(sub) if isinstance(sub, str) else sub).alias("subclass"), F.lit(rule).alias("rule"))
    discounting = F.when(F.lit(False), got("discounting label", "discounting", ""))
    for p, sub, least in DISCOUNTING:
        discounting = discounting.when(said(p) & (n >= least), got("discounting label", "discounting", sub))
    flow = said(CASHFLOW) & ~is_typed & yes("in_cf_lineage")
    word = F.lower(F.regexp_extract(label, f"(?i)({CASHFLOW})", 1))
    named = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in FULL_WORDS.items() for x in kv]), word), word)
    rules = [
        F.when(F.col("role").isNotNull(), got("role", F.split_part("role", F.lit("/"), F.lit(1)), F.split_part("role", F.lit("/"), F.lit(2)))),
        F.when(F.col("bridge_term").isNotNull(), got("bridge", "bridge", F.coalesce(F.nullif(first_of(F.concat(label, F.lit(" "), F.col("bridge_term")), BRIDGE, ""), F.lit("")), F.when(is_typed, "bridge input").otherwise("bridge calculation")))),
        F.when(yes("is_buildup"), got("discounting graph", "discounting", "discount rate build-up")).when(yes("is_exp_factor"), got("discounting graph", "discounting", "discount factor")),
        F.when(said(TERMINAL) & (said(r"\bdate\b") | yes("is_dates")), got("terminal", "timeline", "terminal date")).when(said(TERMINAL), got("terminal", "terminal", first_of(label, TERMINAL_SUB, "terminal value"))).when(yes("is_terminal_input"), got("terminal", "terminal", "terminal input")),
        discounting,
        F.when(yes("is_part") & ~is_typed, got("part", "cashflow", "cash flow part")),
        F.when(yes("is_timeline_row"), got("timeline structure", "timeline", "period dates")).when(yes("is_dates"), got("timeline structure", "timeline", "dates")),
        F.when(F.col("selector").isNotNull(), got("scenario", "assumption", "scenario-selected")),
        F.when(flow & said(DEBT_FUNDING), got("cash flow", "calculation", "debt schedule")).when(flow, got("cash flow", "cashflow", named)),
        F.when(said(TIMELINE) & (n >= 3), got("timeline label", "timeline", F.lower(F.regexp_extract(label, f"(?i)({TIMELINE})", 1)))),
        F.when(is_typed, got("assumption", "assumption", first_of(label, ASSUMPTIONS, "other"))),
        got("default", "calculation", first_of(label, CALCULATIONS, "calculation")),
    ]
    return rows.withColumn("_c", F.coalesce(*rules)).select("*", "_c.class", "_c.subclass", "_c.rule").drop("_c")


PLAIN = "workbook_id string, sheet string, `row` int, col int, n int, t_sheet string, r1 int, r2 int, c1 int, c2 int"
BAD = "workbook_id string, sheet string, `row` int, col int, formula string, saved double, computed double, n_operands int"
HELD = f"{BAD}, state string"
CELL = [*KEY, "col"]
#: A tile is 2**8 rows high and as many columns wide; a range of more than so many cells is no step of a circle (fixed values).
TILE_BITS, STEP_CELLS = 8, 100
#: Areas are joined with their cells by strips of a column, 2**6 rows high.
STRIP_BITS = 6
STRIP = "workbook_id string, t_sheet string, t_col int, strip int, rows array<int>, vals array<double>"
MOST_INT = 2**31 - 1
#: So many names of sheets are sent to the cells.
SENT_SHEETS = 50_000
#: Rows of Python objects that are handed over at once.
PIECE = 20_000


def _pieces(rows: Iterable[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows as tables of bounded size: a batch of formulas may read millions of cells."""
    rows = iter(rows)
    while piece := list(islice(rows, PIECE)):
        yield pd.DataFrame(piece, columns=columns)


def _names(schema: str) -> list[str]:
    return [c.split(" ")[0].strip("`") for c in schema.split(", ")]


def _is_stale(saved: float | None, got: tuple[float, float] | None, rel: float, absolute: float) -> bool:
    return got is not None and saved is not None and abs(got[0] - saved) > max(absolute, rel * max(abs(got[0]), abs(saved)), 1e-3 * got[1])


class _Tile:
    """The cells of one tile of a sheet, and what can be told about its formulas from them alone."""

    def __init__(self, key: tuple, columns: list[list], hops: int) -> None:
        self.book, self.sheet, *first = key
        self.whole, self.hops = None not in key, hops
        self.top, self.left = (first[0] >> TILE_BITS, first[1] >> TILE_BITS) if self.whole else (None, None)
        self.columns = rows, cols, _, _, values = columns
        self.values = _Blanks(zip(zip(repeat(self.sheet), rows, cols), values))
        self.unknown = _by_column(p[1:] for p, v in self.values.items() if v is None) if self.whole and None in values else {}

    def inside(self, a: Area) -> bool:
        return (not a.sheet or a.sheet == self.sheet) and a.r1 >> TILE_BITS == a.r2 >> TILE_BITS == self.top and a.c1 >> TILE_BITS == a.c2 >> TILE_BITS == self.left

    def results(self, rel: float, absolute: float) -> Iterator[tuple]:
        """Rows of ``HELD``: stale cells, those whose circles lead out (open), and formulas that read other tiles (far)."""
        bad = []
        for r, c, f, saved, _ in zip(*self.columns):
            areas = read_areas(f) if saved is not None else None
            if not areas:
                continue
            if not self.whole or not all(map(self.inside, areas)):
                yield self.book, self.sheet, r, c, f, saved, None, None, "far"
                continue
            if self.unknown and any(_within(self.unknown, a) for a in areas):
                continue
            got = recompute(f, self.sheet, self.values)
            if _is_stale(saved, got, rel, absolute):
                bad.append((r, c, f, saved, got[0], count_cells(areas, self.sheet)))
        state = self.circles({x[:2] for x in bad}) if bad else {}
        for r, c, f, saved, v, n in bad:
            if (at := state.get((r, c), "stale")) != "circular":
                yield self.book, self.sheet, r, c, f, saved, v, n, at

    def circles(self, bad: set[tuple[int, int]]) -> dict[tuple[int, int], str]:
        """Of the ``bad`` cells those that read themselves within the hops (circular) and those that might by way of other tiles (open)."""
        formulas = {(r, c): f for r, c, f in zip(*self.columns[:3]) if f is not None}
        placed = _by_column(formulas)
        nexts: dict[tuple[int, int], list] = {}
        leaving = set()
        for at, f in formulas.items():
            nexts[at] = [p for a in step_areas(f, STEP_CELLS) if not a.sheet or a.sheet == self.sheet for p in _within(placed, a)]
            if not all(map(self.inside, step_areas(f, STEP_CELLS))):
                leaving.add(at)
        readers = Counter(p for ps in nexts.values() for p in ps)
        free = [p for p in nexts if not readers[p]]
        looped = set(nexts)  # what is left once cells that no cell left reads are taken away lies on or behind a circle
        while free:
            looped.discard(at := free.pop())
            for p in nexts[at]:
                readers[p] -= 1
                if not readers[p]:
                    free.append(p)
        state = {}
        for at in bad if leaving else bad & looped:
            front = {at}
            for hop in range(self.hops):
                if hop < self.hops - 1 and front & leaving:
                    state[at] = "open"
                front = {p for q in front for p in nexts[q]}
                if at in front:
                    state[at] = "circular"
                    break
        return state


def _by_column(cells: Iterable[tuple[int, int]]) -> dict[int, list[tuple[int, int]]]:
    """Cells in order by column."""
    out: dict[int, list[tuple[int, int]]] = {}
    for p in cells:
        out.setdefault(p[1], []).append(p)
    for ps in out.values():
        ps.sort()
    return out


def _within(cells: dict[int, list[tuple[int, int]]], a: Area) -> list[tuple[int, int]]:
    """Those of the cells that lie in an area, whatever its sheet."""
    out = []
    for c in range(a.c1, a.c2 + 1):
        if c in cells:
            ps = cells[c]
            out += ps[bisect_left(ps, (a.r1, c)) : bisect_right(ps, (a.r2, c))]
    return out


class _Blanks(dict):
    """Values by cell; cells that are not there count as 0."""

    def __missing__(self, cell: tuple) -> float:
        return 0.0


def _tiles(batches: Iterable[pa.RecordBatch], hops: int) -> Iterator[_Tile]:
    """Tiles out of rows that come in order of tiles: workbook, sheet, row and column, then what a tile keeps."""
    key, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        book, sheet, row, col = batch.columns[:4]
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for c in (book, sheet, pc.shift_right(row, TILE_BITS), pc.shift_right(col, TILE_BITS)):
            new[1:] |= pc.fill_null(pc.not_equal(c[1:], c[:-1]), True).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new).tolist()
        columns = [c.to_pylist() for c in batch.columns[2:]]
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            first = (book[a].as_py(), sheet[a].as_py(), columns[0][a], columns[1][a])
            part = [c[a:b] for c in columns]
            if key is not None and None not in (*key, *first) and key[:2] == first[:2] and all(x >> TILE_BITS == y >> TILE_BITS for x, y in zip(key[2:], first[2:])):
                for x, y in zip(held, part):
                    x += y
                continue
            if key is not None:
                yield _Tile(key, held, hops)
            key, held = first, part
    if key is not None:
        yield _Tile(key, held, hops)


def stale_cells(cells: DataFrame, rel: float = 1e-6, absolute: float = 1e-6, hops: int = 4, newest: str | None = None) -> DataFrame:
    """Plain formulas whose saved value is not what the saved values they read give: saved, computed, operands.

    A blank counts as 0; a formula that reads a text, error or date is not tested. Differences within the tolerance or
    a thousandth of the largest operand are none. Cells that reach themselves within ``hops`` steps are circular. Of
    several copies of a cell the one with the greatest ``newest`` counts.

    Cells are brought together once, by tiles of their sheet, and formulas that read their own tile are settled there.
    Only formulas that read other tiles or sheets, and circles that lead there, are joined with the cells they read.
    """
    saved = F.when(F.col("formula").isNotNull() & (F.col("value_kind") == "num"), F.col("value_num"))
    operand = F.when(F.col("value").isNull(), 0.0).when(F.col("value_kind").isin("num", "bool"), F.col("value_num"))
    few = cells.select(*CELL, *([newest] if newest else []), "formula", saved.alias("saved"), operand.alias("_v"))
    tile = [*SHEET, "_y", "_x"]
    placed = few.withColumn("_y", F.shiftright("row", TILE_BITS)).withColumn("_x", F.shiftright("col", TILE_BITS)).repartition(*tile)
    if newest:
        placed = placed.withColumn("_n", F.row_number().over(Window.partitionBy(*tile, "row", "col").orderBy(F.desc(newest)))).filter("_n = 1")
    ordered = placed.sortWithinPartitions(*tile).select(*CELL, "formula", "saved", "_v")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (x for t in _tiles(batches, hops) for x in t.results(rel, absolute))
        while piece := list(islice(rows, PIECE)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*piece), HELD_TYPES)], names=_names(HELD))

    held = materialise(ordered.mapInArrow(run, HELD))
    settled = held.filter("state = 'stale'").drop("state")
    if held.filter("state <> 'stale'").isEmpty():
        return settled
    live = _Live(few, newest)
    other = materialise(_recomputed(held.filter("state = 'far'"), live, rel, absolute).unionByName(held.filter("state = 'open'").drop("state")))
    return settled.unionByName(other.join(circular_cells(live, other.select(*CELL), hops), CELL, "left_anti"))


class _Live:
    """Cells by sheet, of several copies the newest one."""

    def __init__(self, few: DataFrame, newest: str | None) -> None:
        self.few, self.newest, self.whole = few, newest, None

    def newest_of(self, cells: DataFrame, by: list[str]) -> DataFrame:
        cells = cells.withColumn("strip", F.shiftright("row", STRIP_BITS)).repartition(*by)
        if self.newest:
            cells = cells.withColumn("_n", F.row_number().over(Window.partitionBy(*dict.fromkeys([*by, "row", "col"])).orderBy(F.desc(self.newest)))).filter("_n = 1")
        return cells.select(*CELL, "strip", "formula", "_v")

    def on(self, sheets: DataFrame, by: list[str]) -> DataFrame:
        """Cells of some sheets at least, by some columns; all are brought together, once, where the sheets are too many to be sent to the cells."""
        sheets = materialise(sheets.select(*SHEET).distinct())
        if (n := sheets.count()) <= SENT_SHEETS:
            return self.newest_of(self.few.join(broadcast_if_small(sheets, n), SHEET, "left_semi"), by)
        if self.whole is None:
            self.whole = materialise(self.newest_of(self.few, CELL))
        return self.whole.repartition(*by)


HELD_TYPES = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string()]


def _recomputed(formulas: DataFrame, live: _Live, rel: float, absolute: float) -> DataFrame:
    """Stale ones of the ``formulas``, joined with the cells they read wherever those are.

    An area is cut into strips as far as its columns are filled, and meets the filled cells only, so ranges of any size
    cost what stands in them. A formula's values reach Python one after the other, by area and in the area's order. The
    number of operands is that of all cells, blanks included, as far as an integer goes.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from _pieces(((w, s, r, c, n, a.sheet or s, a.r1, a.r2, a.c1, a.c2) for w, s, r, c, f in zip(pdf.workbook_id, pdf.sheet, pdf["row"], pdf["col"], pdf.formula) for n, a in enumerate(read_areas(f) or ())), _names(PLAIN))

    def strip_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = _starts(batch.columns[:4]) if batch.num_rows else []
            if starts:
                ends = pa.array([*starts, batch.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([*(c.take(ends[:-1]) for c in batch.columns[:4]), pa.ListArray.from_arrays(ends, batch.column(4)), pa.ListArray.from_arrays(ends, batch.column(5))], names=_names(STRIP))

    areas = materialise(formulas.select(*CELL, "formula").mapInPandas(run, PLAIN))
    by = [*SHEET, "col", "strip"]
    cells = live.on(areas.select("workbook_id", F.col("t_sheet").alias("sheet")), by).sortWithinPartitions(*by, "row").select(*by, "row", "_v")
    filled = materialise(cells.mapInArrow(strip_of, STRIP))  # a strip may come in two pieces
    column = filled.groupBy("workbook_id", "t_sheet", "t_col").agg(F.min("strip").alias("lo"), F.max("strip").alias("hi"))
    asked = areas.join(column.groupBy("workbook_id", "t_sheet").agg(F.max("t_col").alias("last_col")), ["workbook_id", "t_sheet"]).filter("c1 <= last_col").withColumn("t_col", F.explode(F.sequence("c1", F.least("c2", "last_col"))))
    strips = asked.join(column, ["workbook_id", "t_sheet", "t_col"]).withColumn("lo", F.greatest("lo", F.shiftright("r1", STRIP_BITS))).withColumn("hi", F.least("hi", F.shiftright("r2", STRIP_BITS))).filter("lo <= hi").withColumn("strip", F.explode(F.sequence("lo", "hi")))
    both = strips.join(filled, ["workbook_id", "t_sheet", "t_col", "strip"])
    inside = (F.get("rows", F.lit(0)) >= F.col("r1")) & (F.element_at("rows", -1) <= F.col("r2"))
    skipped, kept = F.size(F.filter("rows", lambda y: y < F.col("r1"))), F.filter("rows", lambda y: y.between(F.col("r1"), F.col("r2")))
    both = both.withColumn("kept", F.when(inside, F.col("rows")).otherwise(kept)).filter("size(kept) > 0")
    met = both.select(*CELL, "n", "strip", "t_col", F.when(inside, F.col("vals")).otherwise(F.slice("vals", skipped + 1, F.size("kept"))).alias("vals"), F.col("kept").alias("rows"))
    heads = formulas.select(*CELL, F.lit(-1).alias("n"), "formula", "saved")  # before what the formula reads
    rows = heads.unionByName(met, allowMissingColumns=True).repartition(*CELL).sortWithinPartitions(*CELL, "n", "strip", "t_col")

    def stale(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for w, s, r, c, f, saved, values in _asked(batches):
            got = recompute(f, s, lambda a, n: _in_order(a, values.get(n, [])))  # noqa: B023
            if _is_stale(saved, got, rel, absolute):
                yield w, s, r, c, f, saved, got[0], min(count_cells(read_areas(f), s), MOST_INT)

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = stale(batches)
        while piece := list(islice(out, PIECE)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*piece), HELD_TYPES)], names=_names(BAD))

    return rows.select(*CELL, "n", "t_col", "rows", "vals", "formula", "saved").mapInArrow(compute, BAD)


def _in_order(a: Area, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[float]:
    """Values of an area, row after row, out of (columns, rows, values) of its strips."""
    if not parts:
        return with_blanks(a, None, [])
    cols, rows, vals = parts[0] if len(parts) == 1 else map(np.concatenate, zip(*parts))
    if a.c1 != a.c2 or (np.diff(rows) < 0).any():
        order = np.lexsort((cols, rows))
        cols, rows, vals = cols[order], rows[order], vals[order]
    return with_blanks(a, (int(rows[0]), int(cols[0])), vals.tolist())


def _starts(columns: list[pa.Array]) -> list[int]:
    """Where rows begin that are not equal to the one before in these columns; nulls are equal."""
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        same = pc.or_kleene(pc.equal(c[1:], c[:-1]), pc.and_(pc.is_null(c[1:]), pc.is_null(c[:-1])))
        new[1:] |= ~pc.fill_null(same, False).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new).tolist()


def _asked(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Formulas with (columns, rows, values) of each of their areas' strips, out of a formula's row and those of its strips.

    A formula with an unknown operand is left out.
    """
    head, values, known = None, {}, True
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _starts(batch.columns[:5])
        firsts = zip(*(batch.column(c).take(pa.array(starts)).to_pylist() for c in (*CELL, "n", "formula", "saved")))
        cols, rows, vals = (batch.column(c) for c in ("t_col", "rows", "vals"))
        for (*cell, n, formula, saved), a, b in zip(firsts, starts, [*starts[1:], batch.num_rows]):
            if n < 0:
                if head is not None and known:
                    yield *head, values
                head, values, known = (*cell, formula, saved), {}, True
                continue
            part = vals[a:b].flatten()
            known = known and not part.null_count
            if known:
                many = pc.list_value_length(rows[a:b]).to_numpy(zero_copy_only=False)
                values.setdefault(n, []).append((np.repeat(cols[a:b].to_numpy(zero_copy_only=False), many), rows[a:b].flatten().to_numpy(), part.to_numpy()))
    if head is not None and known:
        yield *head, values


def circular_cells(live: _Live, start: DataFrame, hops: int = 4) -> DataFrame:
    """Of the ``start`` cells those that read themselves within ``hops`` steps (ranges of up to 100 cells).

    Only formulas that were reached are read, and each step is written to the shared folder.
    """
    away = ["o_sheet", "o_row", "o_col"]
    schema = "workbook_id string, sheet string, `row` int, col int, o_sheet string, o_row int, o_col int"

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from _pieces(((w, a.sheet or s, y, x, *o) for w, s, f, *o in zip(pdf.workbook_id, pdf.sheet, pdf.formula, pdf.o_sheet, pdf.o_row, pdf.o_col) for a in step_areas(f, STEP_CELLS) for y in range(a.r1, a.r2 + 1) for x in range(a.c1, a.c2 + 1)), _names(schema))

    at = start.select(*CELL, F.col("sheet").alias("o_sheet"), F.col("row").alias("o_row"), F.col("col").alias("o_col"))
    found = None
    for _ in range(hops):
        if found is not None and at.isEmpty():
            break
        formulas = live.on(at, CELL).filter("formula is not null").select(*CELL, "formula")
        at = materialise(at.join(formulas, CELL).select("workbook_id", "sheet", "formula", *away).mapInPandas(run, schema).distinct())
        home = at.filter("sheet = o_sheet and row = o_row and col = o_col").select(*CELL)
        found = home if found is None else found.unionByName(home)
    return found.distinct()


def table_summaries(cells: DataFrame, least: int = 50) -> DataFrame:
    """Blocks of at least ``least`` neighbouring rows without formulas and with the same columns: span and what each column holds."""
    rows = cells.groupBy(*KEY).agg(F.count("formula").alias("f"), F.array_sort(F.collect_set("col")).alias("cols")).filter("f = 0")
    island = F.col("row") - F.row_number().over(Window.partitionBy(*SHEET, "cols").orderBy("row"))
    blocks = rows.withColumn("i", island)
    size = F.count(F.lit(1)).over(Window.partitionBy(*SHEET, "cols", "i"))
    kept = blocks.withColumn("n_rows", size).filter(F.col("n_rows") >= least).withColumn("first_row", F.min("row").over(Window.partitionBy(*SHEET, "cols", "i"))).select(*KEY, "first_row", "n_rows")
    c = cells.join(kept, KEY)
    return c.groupBy(*SHEET, "first_row", "n_rows", "col").agg(
        F.count_if(F.col("value_kind") == "date").alias("n_dates"), F.count_if(F.col("value_kind") == "num").alias("n_numbers"), F.countDistinct("value").alias("n_distinct"),
        F.min("value_date").alias("first_date"), F.max("value_date").alias("last_date"), F.min("value_num").alias("least"), F.max("value_num").alias("most"),
    )


def anonymise(formulas: DataFrame, sheets: DataFrame, names: DataFrame) -> DataFrame:
    """Formulas with sheets as S1.. in workbook order, names as NAME1.., texts blanked and telling numbers as ``#``.

    ``formulas`` has workbook_id and formula. Whole numbers up to 1000 stay. Sheets that are not the workbook's are X;
    what cannot be parsed becomes ``?``. The maps are those of one workbook and travel with its rows.
    """
    s = sheets.select("workbook_id", "sheet", "sheet_pos").distinct().withColumn("t", F.concat(F.lit("S"), F.row_number().over(Window.partitionBy("workbook_id").orderBy("sheet_pos", "sheet")).cast("string")))
    sm = s.groupBy("workbook_id").agg(F.map_from_entries(F.collect_list(F.struct(F.lower("sheet").alias("k"), "t"))).alias("sm"))
    n = names.select("workbook_id", F.lower("name").alias("k")).dropna().distinct().withColumn("t", F.concat(F.lit("NAME"), F.row_number().over(Window.partitionBy("workbook_id").orderBy("k")).cast("string")))
    nm = n.groupBy("workbook_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "t"))).alias("nm"))

    def one(f: str, sheet_of: dict, name_of: dict) -> str:
        try:
            toks = tokens(f)
        except FormulaError:
            return "?"
        out = []
        for kind, text in toks:
            if kind == "text":
                text = '"…"'
            elif kind == "number":
                v = float(text)
                text = text if v == int(v) and abs(v) <= 1000 else "#"
            elif kind in ("ref", "name"):
                head, bang, tail = text.rpartition("!")
                if bang:
                    head = sheet_of.get(head.strip("'").replace("''", "'").lower(), "X")
                if kind == "name" and tail.upper() not in ("TRUE", "FALSE"):
                    tail = name_of.get(tail.lower(), "NAME")
                text = head + bang + tail
            elif kind == "array":
                text = "{…}"
            out.append(text)
        return "=" + "".join(out)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [one(f, dict(a) if a is not None else {}, dict(b) if b is not None else {}) for f, a, b in zip(pdf.formula, pdf.sm, pdf.nm)]
            yield pd.DataFrame({"workbook_id": pdf.workbook_id, "formula": pdf.formula, "shown": got})

    rows = formulas.select("workbook_id", "formula").dropna().distinct()
    return rows.join(sm, "workbook_id", "left").join(nm, "workbook_id", "left").mapInPandas(run, "workbook_id string, formula string, shown string")
