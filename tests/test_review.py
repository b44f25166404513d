from datetime import date

import duckdb
import pytest

from gridloom.functions.arithmetic import count_cells, read_areas, reads, recompute
from gridloom.operators.review import anonymise, candidate_cells, classify, stale_cells, table_summaries, valuation_outputs
from gridloom.operators.rowmap import detect_layout, line_items
from gridloom.plans import workbooks
from gridloom.sources.ooxml import load_workbooks, split_records, write_workbook
from gridloom.tables import materialise


def test_recompute():
    v = {("S", 1, 1): 4.0, ("S", 2, 1): 5.0, ("O x", 1, 1): 3.0}
    assert recompute("=A1+A2*2", "S", v)[0] == 14 and recompute("=SUM(A1:A2,-'O x'!A1)/2%", "S", v)[0] == 300 and recompute("=(A1-A2)^2", "S", v)[0] == 1
    assert recompute("=A1/(A2-5)", "S", v) is None and recompute("=A9", "S", v) is None and recompute("=A1:A2+1", "S", v) is None
    assert reads("=A1+SUM(B1:B2)", "S") == [("S", 1, 1), ("S", 1, 2), ("S", 2, 2)]
    assert [reads(f, "S") for f in ("=IF(A1,1,2)", "=A1^2^3", "=-A1^2", "=A1&A2", "=A1:A900", "=SUM(")] == [None, None, None, None, None, []]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("books")
    days = [date(2025 + i, 6, 30) for i in range(5)]
    c = [(1, 1, None, "Valuation date"), (1, 4, None, date(2025, 6, 30)), (2, 1, None, "WACC"), (2, 4, None, 0.08), *[(4, 4 + i, None, x) for i, x in enumerate(days)], (5, 1, None, "Tariff"), *[(5, 4 + i, None, 2.0) for i in range(5)],
         (6, 1, None, "Revenue"), *[(6, 4 + i, f"={x}5*10", 20.0 if i != 2 else 25.0) for i, x in enumerate("DEFGH")], (7, 1, None, "Equity value"), (7, 4, "=SUM(D6:H6)", 105.0), (8, 1, None, "Loop"), (8, 4, "=D9+1", 9.0), (9, 1, None, "Loop back"), (9, 4, "=D8*2", 1.0)]
    table = [(1 + i, k, None, v) for i in range(60) for k, v in ((1, f"item {i % 4}"), (2, float(i)))]
    (d / "m.xlsx").write_bytes(write_workbook({"Val": c, "Table": table}, {"Disc_rate": "Val!$D$2", "Other": "Val!$D$5"}))
    t = split_records(load_workbooks(spark, str(d)))
    cells = materialise(t["cells"], 1)
    lay = materialise(detect_layout(cells), 1)
    return t, cells, lay, materialise(line_items(cells, lay), 1)


def test_candidates_and_outputs(tables):
    t, cells, lay, lines = tables
    got = [(r.ref, r.choice) for r in candidate_cells(cells, lines, lay, t["names"], "date").collect()]
    assert got == [("Val!D1", 1)]
    assert [(r.ref, r.value) for r in candidate_cells(cells, lines, lay, t["names"], "rate").orderBy("choice").collect()] == [("Val!D2", "0.08")]
    assert [(r.row, r.value_num) for r in valuation_outputs(cells, lines, lay).collect()] == [(7, 105.0)]


def test_stale_and_tables(tables):
    _, cells, _, _ = tables
    assert [(r.row, r.col, r.saved, r.computed) for r in stale_cells(cells).collect()] == [(6, 6, 25.0, 20.0)]
    got = {r.col: (r.n_rows, r.n_distinct, r.n_numbers) for r in table_summaries(cells).collect()}
    assert got == {1: (60, 4, 0), 2: (60, 60, 60)}


def test_classify(spark):
    rows = [("Discount factor", 5, 0, None, False), ("Terminal growth", 0, 1, None, False), ("Water tariff", 0, 5, None, False), ("Opening balance", 5, 0, None, False), ("Revenue", 5, 0, None, True), ("Debt drawdown revenue", 5, 0, None, True), ("Period end", 0, 5, None, False), ("x", 5, 0, "outcome/value", False), (None, 0, 0, None, None)]
    df = spark.createDataFrame(rows, "label string, n_formula int, n_const int, role string, in_cf_lineage boolean")
    got = [(r["class"], r.subclass) for r in classify(df).collect()]
    assert got == [("discounting", "discount factor"), ("terminal", "terminal growth"), ("assumption", "volume / price"), ("calculation", "balance"), ("cashflow", "revenue"), ("calculation", "debt schedule"), ("timeline", "period"), ("outcome", "value"), ("calculation", "calculation")]


def test_anonymise(spark, tables):
    t, *_ = tables
    wb = t["sheets"].first().workbook_id
    f = spark.createDataFrame([(wb, "='Table'!A1+Disc_rate*1234.5+IF(Val!$D$2>12,\"Wombat\",Secret)"), (wb, "=A1+("), (wb, None)], "workbook_id string, formula string")
    got = {r.formula: r.shown for r in anonymise(f, t["sheets"], t["names"]).collect()}
    assert got == {"='Table'!A1+Disc_rate*1234.5+IF(Val!$D$2>12,\"Wombat\",Secret)": "=S2!A1+NAME1*#+IF(S1!$D$2>12,\"…\",NAME)", "=A1+(": "=A1+("}


def test_stale_cells_across_tiles_and_sheets(spark):
    """Operands on other sheets, far down and far right, circles by way of them, unknown operands, and older copies."""
    n, s = "num", "workbook_id string, sheet string, `row` int, col int, formula string, value string, value_kind string, value_num double, loaded_at int"
    c = [("A", 1, 1, None, 2.0, n), ("A", 300, 1, None, 3.0, n), ("A", 1, 300, None, 5.0, n), ("B", 1, 1, None, 7.0, n), ("B", 2, 1, None, None, "text"),
         ("A", 2, 1, "=A1*A300", 9.0, n), ("A", 3, 1, "=A1*A300", 6.0, n), ("A", 4, 1, "=A1+KN1+B!A1", 9.0, n), ("A", 5, 1, "=B!A2+1", 9.0, n), ("A", 6, 1, "=A1*A!A1*2", 9.0, n),
         ("A", 7, 1, "=B!A7+1", 9.0, n), ("B", 7, 1, "=A!A7*2", 1.0, n), ("A", 8, 1, "=A9+1", 9.0, n), ("A", 9, 1, "=A8*2", 1.0, n), ("A", 10, 1, "=A7+B!A9", 1.0, n), ("A", 11, 1, "=SUM(A250:A310)", 8.0, n)]
    rows = [("w", sh, r, k, f, "x" if kind == "text" else str(v), kind, v, 2) for sh, r, k, f, v, kind in c] + [("w", "A", 1, 1, None, "100", n, 100.0, 1)] + [("v", "A", 1, 1, "=A1+1", "1", n, 1.0, 1), ("v", None, 2, 1, "=A1+1", "5", n, 5.0, 1)]
    df = spark.createDataFrame(rows, s)
    got = sorted((r.workbook_id, r.sheet or "", r.row, r.computed, r.n_operands) for r in stale_cells(df, newest="loaded_at").collect())
    assert got == [("v", "", 2, 1.0, 1), ("w", "A", 2, 6.0, 2), ("w", "A", 4, 14.0, 3), ("w", "A", 6, 8.0, 1), ("w", "A", 10, 9.0, 2), ("w", "A", 11, 3.0, 61)]


def test_materialise_leaves_no_shuffle_files(spark):
    """A query of many steps had the shuffle files of all of them on disk at once."""
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    had = files.getAllFiles().size()
    out = materialise(spark.range(1000).repartition(3).groupBy("id").count())
    assert files.getAllFiles().size() <= had and out.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before


def test_cells_are_counted_once():
    areas = ["=SUM(A1:C4,B3:D6,A1)", "=SUM(A1:A500,A400:A600,B1:B2)", "=A1*A1", "=SUM(A:A,1:1)", "=SUM(A1:B2)+SUM(T!A1:B2,S!B2:C3)"]
    assert [count_cells(read_areas(f), "S") for f in areas] == [20, 602, 1, 1_048_576 + 16_383, 11]
    for f in (areas[0], areas[1], areas[4]):
        assert count_cells(read_areas(f), "S") == len(set(reads(f, "S")))


def test_ranges_of_any_size_are_recomputed(spark):
    """Formulas over ranges of more than 400 cells were left out."""
    n, s = "num", "workbook_id string, sheet string, `row` int, col int, formula string, value string, value_kind string, value_num double"
    c = [("A", i, k, None, float(i), n) for i in range(1, 1201) for k in (1, 2)] + [("A", 900, 3, None, None, "text"), ("A", 901, 3, None, 1.0, n), ("D", 700, 1, None, -2.0, n), ("D", 5, 9000, None, 4.0, n), ("D", 1_048_576, 16_384, None, 0.5, n)]
    f = [("=SUM(A1:A401)", 80601.0, 401), ("=SUM(A1:A1200)/2", 360300.0, 1200), ("=SUM(A1:B20)+SUM(A1:B230)-A2", 420.0 + 53130 - 2, 460), ("=SUM(A1:A500,A400:A600)", 125250.0 + 100500, 600), ("=MAX(A100:B1300)", 1200.0, 2402), ("=MIN(A1:A5000)", 0.0, 5000), ("=SUM(D!A:A)", -2.0, 1_048_576),
         ("=SUM(D!5:5)*2", 8.0, 16_384), ("=SUM(D!A1:XFD1048576)", 2.5, 2**31 - 1), ("=ABS(A7:A900)-3", 4.0, 894), ("=ABS(D!A1:A900)-3", -3.0, 900), ("=SUM(B1:B700,E!B1:B700)", 245350.0, 1400)]
    untested = ["=SUM(C1:C1200)", "=A1:A900", "=SUM(A1:A900+1)", "=(A1:A900)*2", "=SUM(F!A:A)*0/0"]
    for i, (x, v, _) in enumerate(f):
        c += [("A", 2000 + i, 4, x, v + 1000.0 + abs(v) / 5, n), ("A", 2000 + i, 5, x, v, n)]
    c += [("A", 3000 + i, 4, x, 5e9, n) for i, x in enumerate(untested)]
    df = spark.createDataFrame([("w", sh, r, k, x, "x" if kind == "text" else None if v is None else str(v), kind, v) for sh, r, k, x, v, kind in c], s)
    got = sorted((r.formula, r.computed, r.n_operands) for r in stale_cells(df).collect())
    assert got == sorted(f)


def test_long_ranges_agree_with_sql(spark, tmp_path):
    """The query's SQL has no longest range."""
    rows = [("w", "S", i, k, None, str(i / 7), "num", i / 7) for i in range(1, 3001) for k in (1, 2) if i % 5] + [("w", "S", i, 4, f"=SUM(A{i}:A{i * 9})", str(x := i * 11.5), "num", x) for i in range(1, 331)] + [("w", "S", i, 5, f"=SUM(B{i}:B2990)", "1", "num", 1.0) for i in (2, 7, 300, 2800)]
    df = spark.createDataFrame(rows, "workbook_id string, sheet string, `row` int, col int, formula string, value string, value_kind string, value_num double")
    df = df.selectExpr("*", "cast(null as string) addr", "cast(null as string) value_text", "cast(null as date) value_date", "timestamp'2026-01-01 00:00:00' loaded_at")
    df.coalesce(1).write.parquet(str(tmp_path / "cells.parquet"))
    got = workbooks.QUERIES["stale_cells"](spark, str(tmp_path))
    with duckdb.connect() as con:
        con.execute("SET TimeZone = 'UTC'")
        con.execute(f"CREATE VIEW cells AS SELECT * FROM '{tmp_path}/cells.parquet/*.parquet'")
        want = con.execute(workbooks.ORACLES["stale_cells"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and max(r.n_operands for r in got.collect()) == 2989
