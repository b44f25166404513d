"""A small three-statement model: terms, structure, bindings and identities, base and broken."""

from datetime import date

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom.functions.formula import column_letters, relative
from gridloom.functions.ontology import IDENTITIES, ROLES, coefficients
from gridloom.operators.rowmap import detect_layout, families, line_items
from gridloom.operators.statements import (corkscrews, dominant_formulas, held_rows, held_subtotals, identity_results, label_bindings, linear_spans, linear_terms, link_sources, many_bindings, row_values, structure, subtotal_results, terms)
from gridloom.plans import catalog, workbooks
from gridloom.tables import materialise
from gridloom.sources.ooxml import load_workbooks, split_records, write_workbook

DAYS = [date(2026 + i, 6, 30) for i in range(5)]


def model(broken: bool = False, negative: bool = True) -> bytes:
    def sheet(rows):
        cells = [(2, 4 + i, None, d) for i, d in enumerate(DAYS)]
        for r, label, formula, vals in rows:
            cells.append((r, 1, None, label))
            cells += [(r, 4 + i, formula and formula(column_letters(4 + i), column_letters(3 + i)), v) for i, v in enumerate(vals)]
        return cells

    n = range(5)
    s = -1 if negative else 1
    rev, cost, dep = [100.0 + 10 * i for i in n], [s * (40.0 + i) for i in n], [s * 12.0 for _ in n]
    ebitda = [a + s * b if not negative else a + b for a, b in zip(rev, cost)] if negative else [a - b for a, b in zip(rev, cost)]
    ebit = [a + b if negative else a - b for a, b in zip(ebitda, dep)]
    pnl = sheet([
        (4, "Revenue", None, rev), (5, "Operating costs", None, cost), (6, "EBITDA", lambda c, p: f"={c}4+{c}5" if negative else f"={c}4-{c}5", ebitda), (7, "Depreciation", None, dep),
        (8, "EBIT", lambda c, p: f"={c}6+{c}7" if negative else f"={c}6-{c}7", ebit),
    ])
    assets, debt = [500.0 + i for i in n], [300.0 - 5 * i for i in n]
    bs = sheet([(4, "Fixed assets", None, [a - 50 for a in assets]), (5, "Cash", None, [50.0] * 5), (6, "Total assets", lambda c, p: f"=SUM({c}4:{c}5)", assets),
                (8, "Total liabilities", None, debt), (9, "Total equity", None, [a - d - (7.0 if broken and i == 3 else 0) for i, (a, d) in enumerate(zip(assets, debt))])])
    op = [310.0, *[300.0 - 5 * i for i in range(4)]]
    dd = sheet([(4, "Opening debt", lambda c, p: f"={p}6", op), (5, "Repayments", None, [b - a for a, b in zip(op, debt)]), (6, "Closing debt", lambda c, p: f"=SUM({c}4:{c}5)", debt), (7, "Debt link", lambda c, p: f"={c}6", debt)])
    return write_workbook({"PnL": pnl, "BalanceSheet": bs, "Debt": dd})


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    known = {}

    def load(**kw):
        key = tuple(sorted(kw.items()))
        if key not in known:
            d = tmp_path_factory.mktemp("books")
            (d / "m.xlsx").write_bytes(model(**kw))
            c = materialise(split_records(load_workbooks(spark, str(d)))["cells"], 1)
            lay = materialise(detect_layout(c), 1)
            tt = materialise(terms(dominant_formulas(c, families(c))), 1)
            known[key] = (c, lay, materialise(line_items(c, lay), 1), tt, materialise(structure(tt), 1), materialise(row_values(c, lay), 1))
        return known[key]

    return load


def test_linear_terms():
    assert linear_terms("=D4+D5-'X y'!D6", "S", 4) == [(1, "S", 4, 0, False), (1, "S", 5, 0, False), (-1, "X y", 6, 0, False)]
    assert linear_terms("=SUM(D4:D6)-(D7-C8)", "S", 4) == [(1, "S", 4, 0, True), (1, "S", 5, 0, True), (1, "S", 6, 0, True), (-1, "S", 7, 0, False), (1, "S", 8, -1, False)]
    assert linear_terms("=-D4", "S", 4) == [(-1, "S", 4, 0, False)]
    assert linear_terms("=D4*2", "S", 4) is None and linear_terms("=SUM(D4:F4)", "S", 4) is None and linear_terms("=IF(D4,1,2)", "S", 4) is None and linear_terms("=D4+(", "S", 4) is None


def test_ontology_is_whole():
    assert len(ROLES) == 44 and len(IDENTITIES) == 26
    assert coefficients(IDENTITIES["cf_net"]) == {"cfo": 1, "cfi": 1, "cff": 1, "cf_net": -1} and coefficients(IDENTITIES["bs_rollforward"]) == {}
    assert IDENTITIES["bs_balance"].flex == ("liabilities", "equity") and IDENTITIES["su_balance"].scope == "single" and IDENTITIES["bs_total_le"].flex == ()
    assert all(r in ROLES for i in IDENTITIES.values() for r in coefficients(i))


def test_structure_and_subtotals(tables):
    c, lay, lines, t, kinds, values = tables()
    k = {(r.sheet, r.row): r.kind for r in kinds.collect()}
    assert k["PnL", 6] == "subtotal" and k["Debt", 4] == "previous" and k["Debt", 7] == "link" and k["BalanceSheet", 6] == "subtotal"
    assert [(r.closing, r.opening) for r in corkscrews(t).collect()] == [(6, 4)]
    assert {(r.row, r.s_row) for r in link_sources(t, kinds).collect()} == {(7, 6)}
    assert {(r.sheet, r.row, r.status) for r in subtotal_results(t, kinds, values).collect()} == {("PnL", 6, "holds"), ("PnL", 8, "holds"), ("BalanceSheet", 6, "holds"), ("Debt", 6, "holds")}


@pytest.mark.parametrize(("kw", "want"), [({}, "holds"), ({"negative": False}, "holds"), ({"broken": True}, "fails")])
def test_identities(tables, kw, want):
    c, lay, lines, t, kinds, values = tables(**kw)
    bound = materialise(label_bindings(lines, kinds), 1)
    got = {r.identity: r for r in identity_results(bound, many_bindings(bound, t), values).collect()}
    assert len(got) == 26
    assert got["pnl_ebitda"].status == "holds" and got["pnl_ebit"].status == "holds" and got["bs_balance"].status == want
    assert got["debt_roll"].status == "holds" and got["cf_net"].status == "unbound" and got["pnl_ebitda"].convention == (1 if kw.get("negative", True) else -1)
    if kw.get("broken"):
        assert got["bs_balance"].max_residual == pytest.approx(7.0)


def test_labels_bind_on_sheets_of_any_name(spark):
    lines = spark.createDataFrame(
        [("w", "Funding", 4, "Total sources"), ("w", "Funding", 9, "Total uses"), ("w", "Works", 5, "Total capex"), ("w", "Alpha", 3, "Revenue"), ("w", "PnL", 8, "Revenue")], "workbook_id string, sheet string, `row` int, label string")
    kinds = spark.createDataFrame([("w", "Alpha", 3, "subtotal", 2)], "workbook_id string, sheet string, `row` int, kind string, n_terms int")
    got = {r.role: (r.sheet, r.row) for r in label_bindings(lines, kinds).collect()}
    assert got["sources"] == ("Funding", 4) and got["uses"] == ("Funding", 9) and got["capex_total"] == ("Works", 5)
    assert got["revenue"] == ("PnL", 8)  # a sheet named like the block still goes first, even before a total elsewhere


@pytest.mark.parametrize(("sheet", "uses", "want"), [("A", [6.0, 4.0], "fails"), ("A", [4.0, 6.0], "holds"), ("B", [6.0, 4.0], "holds"), ("B", [6.0, 5.0], "fails")])
def test_sources_and_uses_are_evaluated(spark, sheet, uses, want):
    bound = spark.createDataFrame([("w", "sources", "sources_uses", "A", 4), ("w", "uses", "sources_uses", sheet, 9)], "workbook_id string, role string, block string, sheet string, `row` int")
    many = spark.createDataFrame([], "workbook_id string, role string, sheet string, `row` int, own_sign int")
    values = spark.createDataFrame([("w", s, r, d, v) for s, r, vs in (("A", 4, [4.0, 6.0]), (sheet, 9, uses)) for d, v in zip(DAYS, vs)], "workbook_id string, sheet string, `row` int, period date, value double")
    got = {r.identity: r.status for r in identity_results(bound, many, values).collect()}
    assert got["su_balance"] == want and got["bs_rollforward"] == "not_evaluated" and got["cf_net"] == "unbound"


def test_long_chains_of_links_end_at_their_source(spark):
    """Chains longer than any fixed number of hops, and one that runs into a cycle."""
    n = 300
    links = [("w", "S", i + 1, 1, "S", i, 0, False) for i in range(1, n)] + [("v", "S", 1, 1, "S", 2, 0, False), ("v", "S", 2, 1, "S", 1, 0, False), ("v", "S", 3, 1, "S", 1, 0, False)]
    t = spark.createDataFrame(links, "workbook_id string, sheet string, `row` int, sign int, t_sheet string, t_row int, delta int, in_sum boolean")
    got = {(r.workbook_id, r.row): r.s_row for r in link_sources(t, structure(t)).collect()}
    assert got == {("w", i): 1 for i in range(2, n + 1)}


def _odd_cells(spark):
    """Sheets with timelines in other columns, a repeated date, unknown and blank parts, a long sum, older copies, no address, no sheet."""
    rows = {}

    def put(sheet, row, col, value=None, formula=None, kind="num", addr="x", at=2):
        num, day = (value, None) if kind == "num" else (None, value if kind == "date" else None)
        addr = f"{column_letters(col)}{row}" if addr == "x" else addr
        rows[sheet, row, col, at] = ("w", sheet, row, col, addr, formula, None if value is None else str(value), kind, num, day, at)

    for sheet, first, days in (("A", 4, DAYS5), ("B", 6, DAYS5), ("C", 4, [*DAYS5[:3], DAYS5[1], DAYS5[4]]), (None, 4, DAYS5)):
        for i, d in enumerate(days):
            put(sheet, 2, first + i, d, kind="date")
            put(sheet, 3, first + i, 1.0 + i)
            put(sheet, 4, first + i, 2.0)
            col = column_letters(first + i)
            put(sheet, 5, first + i, 3.0 + i, f"=SUM({col}3:{col}4)")
    put("A", 3, 5, 70.0, at=1)  # an older copy
    put("B", 4, 8, "n/a", kind="text")
    put("B", 4, 9, None)
    for i in range(5):
        put("A", 7, 4 + i, 6.0 + 2 * i, f"=A!{column_letters(4 + i)}5+B!{column_letters(4 + i)}5")  # columns of B are others of its dates: part of the row is moved
        put("A", 8, 4 + i, 6.0 + 2 * i, f"=B!{column_letters(4 + i)}5+C!{column_letters(4 + i)}5")
        put("A", 400, 4 + i, 9.0, f"=SUM({column_letters(4 + i)}10:{column_letters(4 + i)}310)")
        put("A", 10 + 60 * i, 4, 1.0)
        put("A", 401, 4 + i, 3.0, f"=SUM({column_letters(4 + i)}3:{column_letters(4 + i)}4)", addr=None)
        put("A", 402, 4 + i, 3.0, f"={column_letters(4 + i)}3+{column_letters(4 + i)}3" if i < 3 else "=A1*2", addr="Z1")
        put("A", 403, 4 + i, 3.0, f"=A{i + 1}+B{i + 2}*2" if i else "=D3-D4")
    return spark.createDataFrame(list(rows.values()), "workbook_id string, sheet string, `row` int, col int, addr string, formula string, value string, value_kind string, value_num double, value_date date, loaded_at int")


DAYS5 = [date(2025 + i, 6, 30) for i in range(5)]


def test_held_rows_give_the_same_subtotals(spark):
    cells = _odd_cells(spark)
    live = materialise(cells.filter("loaded_at = 2"), 1)
    t = materialise(terms(dominant_formulas(live, families(live))), 1)
    want = sorted((r.sheet, r.row, r.max_residual, r.n_failing, r.n_periods, r.status) for r in subtotal_results(t, structure(t), row_values(live, detect_layout(live))).collect())
    held = held_rows(cells, newest="loaded_at")
    got = sorted((r.sheet, r.row, r.max_residual, r.n_failing, r.n_periods, r.status) for r in held_subtotals(materialise(held)).collect())
    assert got == want and len(got) >= 6
    assert {("A", 5, 0.0, 0, 5, "holds"), ("B", 5, 2.0, 1, 4, "fails")} <= set(got)
    assert held._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # the cells move once


def test_long_sums_leave_python_as_ranges(spark):
    """A batch of sums over 301 rows had its three million terms in one Python worker at once."""
    assert linear_spans("=SUM(D1:D301)-D400", "S", 4) == [(1, "S", 1, 301, 0, True), (-1, "S", 400, 400, 0, False)]
    f = spark.range(2000).selectExpr("'w' workbook_id", "'S' sheet", "cast(id + 400 as int) row", "4 col", "'=SUM(D1:D301)' formula")
    out = terms(f)
    assert out.count() == 2000 * 301 and out.columns == ["workbook_id", "sheet", "row", "sign", "t_sheet", "t_row", "delta", "in_sum"]


def test_query_writes_one_table_of_rows_before_its_result(spark, tmp_path, monkeypatch):
    """It wrote all cells with texts it doesn't need, layouts, line items it never read, and every term."""
    cells = _odd_cells(spark).withColumn("value_text", F.lit(None).cast("string"))
    cells.write.parquet(str(tmp_path / "cells.parquet"))
    written = []
    for module in (catalog, workbooks):
        monkeypatch.setattr(module, "materialise", lambda df, *a: written.append(df.columns) or materialise(df, *a))
    got = {(r.sheet, r.row): (r.max_residual, r.n_failing, r.n_periods, r.status) for r in workbooks.QUERIES["subtotal_results"](spark, str(tmp_path)).collect()}
    assert written == [["workbook_id", "sheet", "row", "terms", "used", "cols", "vals", "dates"]]
    assert got["A", 5] == (0.0, 0, 5, "holds") and got["B", 5] == (2.0, 1, 4, "fails") and ("A", 400) not in got  # most of its rows are not there


def test_relative_forms_of_odd_references():
    assert [relative(f, 2, 2) for f in ("=A0+$B$3", "='a!b'!C3:D$4*2", "=0:0+$A:B", "=(", "=A1+(#")] == ["=R[-2]C[-1]+R3C2", "='a!b'!R[1]C[1]:R4C[2]*2", "=R[-2]:R[-2]+C1:C", "=(", "=R[-1]C[-1]+(#"]


def _long_sums(spark):
    """Sums over more rows than 301, of own and other rows, with a blank, a text and a missing row; a whole column."""
    rows = {}

    def put(sheet, row, col, value=None, formula=None, kind="num"):
        num, day = (value, None) if kind == "num" else (None, value if kind == "date" else None)
        rows[sheet, row, col] = ("w", sheet, row, col, f"{column_letters(col)}{row}", formula, None if value is None else str(value), kind, num, None, day)

    for sheet, gap in (("A", 0), ("B", 1500)):
        for i, d in enumerate(DAYS5):
            c = column_letters(4 + i)
            put(sheet, 2, 4 + i, d, kind="date")
            for r in range(3, 2003):
                if r != gap:
                    put(sheet, r, 4 + i, float(r % 89 + i))
            if sheet == "A":
                put(sheet, 700, 4, "n/a", kind="text")
                put(sheet, 701, 5, None)
            added = lambda a, b: float(sum(rows[sheet, r, 4 + i][8] or 0.0 for r in range(a, b + 1) if (sheet, r, 4 + i) in rows))  # noqa: B023, E731
            for at, a, b in ((3000, 3, 304), (3001, 3, 2002), (3002, 256, 767), (3003, 255, 1100), (3004, 701, 1003), (3005, 3, 303), (3006, 900, 2500)):
                put(sheet, at, 4 + i, added(a, b) + (5.0 if i == 2 else 0.0), f"=SUM({c}{a}:{c}{b})")
            put(sheet, 3100, 4 + i, added(3, 1200) - added(1300, 1310), f"=SUM({c}3:{c}700,{c}701:{c}1200)-SUM({c}1300:{c}1310)")
            put(sheet, 3101, 4 + i, 0.0, f"=SUM({c}:{c})")
    df = spark.createDataFrame(list(rows.values()), "workbook_id string, sheet string, `row` int, col int, addr string, formula string, value string, value_kind string, value_num double, value_text string, value_date date")
    return df.selectExpr("*", "timestamp'2026-01-01 00:00:00' loaded_at")


LONG_SUMS = {("A", 3000): (1, 5), ("A", 3001): (1, 4), ("A", 3002): (1, 4), ("A", 3003): (1, 4), ("A", 3004): (1, 5), ("A", 3005): (1, 5), ("B", 3000): (1, 5), ("B", 3002): (1, 5), ("B", 3003): (1, 5), ("B", 3004): (1, 5), ("B", 3005): (1, 5)}


def test_sums_over_any_number_of_rows_are_held_against_their_parts(spark, tmp_path):
    """A sum over more than 301 rows had no result."""
    _long_sums(spark).coalesce(1).write.parquet(str(tmp_path / "cells.parquet"))
    out = workbooks.QUERIES["subtotal_results"](spark, str(tmp_path))
    got = {(r.sheet, r.row): r for r in out.collect()}
    assert {k: (r.n_failing, r.n_periods) for k, r in got.items()} == LONG_SUMS | {("A", 3100): (0, 4), ("B", 3100): (0, 5)}
    assert all(r.max_residual == pytest.approx(5.0 if r.n_failing else 0.0, abs=1e-6) and r.status == ("fails" if r.n_failing else "holds") for r in got.values())
    assert linear_spans("=SUM(D1:D302)", "S", 4) is None and linear_spans("=SUM(D1:D302)", "S", 4, None) == [(1, "S", 1, 302, 0, True)]  # terms listed one by one stay as their SQL has them


def test_verdicts_of_long_sums_agree_with_sql(spark, tmp_path):
    """Both sides left out sums over more than 301 rows."""
    _long_sums(spark).coalesce(1).write.parquet(str(tmp_path / "cells.parquet"))
    df = workbooks.QUERIES["subtotal_verdicts"](spark, str(tmp_path))
    with duckdb.connect() as con:
        con.execute("SET TimeZone = 'UTC'")
        con.execute(f"CREATE VIEW cells AS SELECT * FROM '{tmp_path}/cells.parquet/*.parquet'")
        res = con.execute(workbooks.ORACLES["subtotal_verdicts"])
        want = sorted(dict(zip([c[0] for c in res.description], r)).items() for r in res.fetchall())
    got = {(r.sheet, r.row): (r.n_failing, r.n_periods) for r in df.collect()}
    plain = {k: v for k, v in got.items() if k[1] < 3100}  # SQL reads sums of one range
    assert plain == LONG_SUMS and sorted(sorted(r.asDict().items()) for r in df.collect() if r.row < 3100) == sorted(map(sorted, want))
