from datetime import date

import pytest

from gridloom.functions.formula import area, column_letters, column_number, moved, relative, shape, tokens, tree
from gridloom.operators.dependencies import Saved, dependency_edges, formula_reads, meets
from gridloom.operators.rowmap import detect_layout, families, line_items, map_text
from gridloom.sources.ooxml import load_workbooks, read_workbook, split_records, write_workbook


def test_addresses():
    assert [column_letters(n) for n in (1, 26, 27, 702, 703)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(column_number(column_letters(n)) == n for n in range(1, 2000))
    assert area("'It''s'!$B$3:A1").sheet == "It's" and area("B3:A1").r2 == 3 and area("[1]S!A1") is None and area("A:C").r2 == 1_048_576


def test_relative_and_moved():
    assert relative("=A1+$B2*SUM(C$1:C3)", 3, 3) == "=R[-2]C[-2]+R[-1]C2*SUM(R1C:RC)"
    assert relative("=Sheet1!D4&\"A1\"", 4, 4) == '=Sheet1!RC&"A1"'
    assert moved("=A1+$B$2+Sum(A:A)", 1, 2) == "=C2+$B$2+Sum(C:C)"
    assert shape("=A1+$BC2") == "=#1+#2"
    assert "".join(t for _, t in tokens("=IF(A1>=1,\"x,y\",'a b'!C3:D4)")) == "IF(A1>=1,\"x,y\",'a b'!C3:D4)"
    assert tree("=SUM(A1,(B1+C1)*2)")[0].name == "SUM"


def test_reads():
    v = {("S", 1, 1): 2.0, ("S", 5, 2): "x", ("S", 6, 2): "y", ("S", 7, 2): "x"}
    s = Saved(v, {"k": "S!$A$1"})
    assert formula_reads(s, "S", "=OFFSET(B2,A1,0)") == [("S", 4, 4, "offset"), ("S", 1, 1, "direct")]
    got = formula_reads(s, "S", '=SUMIFS(C5:C7,B5:B7,"x")')
    assert ("S", 5, 7, "inactive") in got and ("S", 7, 7, "active") in got and ("S", 6, 6, "active") not in got
    assert formula_reads(s, "S", "=INDEX(C5:C7,MATCH(\"y\",B5:B7,0))")[1] == ("S", 6, 6, "active")
    assert formula_reads(s, "S", "=CHOOSE(k,D1,D2)") == [("S", 1, 1, "direct"), ("S", 1, 1, "inactive"), ("S", 2, 2, "direct")]
    assert formula_reads(s, "S", "=A1:A900") == [("S", 1, 301, "direct")]
    assert formula_reads(s, "S", "=A1+(") is None
    assert s.evaluate(tree("=2+3*4"), "S") == 20.0  # left to right, without precedence


@pytest.mark.parametrize(("v", "crit", "hit"), [(5.0, ">=5", True), (4.0, "<>4", False), ("Abc", "a*", True), ("Abc", "<>a?c", False), (None, "x", False), (1.0, 1.0, True)])
def test_criteria(v, crit, hit):
    assert meets(v, crit) is hit


def _book() -> bytes:
    days = [date(2025, 6, 30), date(2026, 6, 30), date(2027, 6, 30), date(2028, 6, 30)]
    c = [(1, 1, None, "Model"), *[(2, 4 + i, None, d) for i, d in enumerate(days)], (3, 1, None, "Revenue block")]
    c += [(4, 1, None, "Volume"), (4, 2, None, "m"), *[(4, 4 + i, None, 10.0 + i) for i in range(4)]]
    c += [(5, 1, None, "Price"), (5, 2, None, "m"), *[(5, 4 + i, None, 2.5) for i in range(4)]]
    c += [(6, 1, None, "Revenue"), (6, 2, None, "m"), *[(6, 4 + i, f"={x}4*{x}5", (10.0 + i) * 2.5) for i, x in enumerate("DEFG")]]
    c += [(7, 1, None, "Check"), (7, 2, None, "m"), (7, 4, "=D6=25", True), (7, 5, "=1/0", "#DIV/0!")]
    return write_workbook({"Inputs": c, "It's": [(1, 1, None, "Copy"), (1, 2, "='Inputs'!D6", 25.0), (2, 1, None, "rest"), (2, 2, "=B1+Rate", 26.0)]}, {"Rate": "Inputs!$D$5"})


def test_workbook_end_to_end(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(_book())
    (tmp_path / "copy.xlsx").write_bytes(_book())
    (tmp_path / "~$a.xlsx").write_bytes(b"lock")
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    rec = load_workbooks(spark, str(tmp_path)).cache()
    assert rec.filter("kind = 'error'").count() == 1 and rec.filter("kind = 'sheet'").count() == 2
    t = split_records(rec)
    lay = {r.sheet: r for r in detect_layout(t["cells"]).collect()}
    a = lay["Inputs"]
    assert (a.header_row, a.tl_first, a.tl_last, a.periods, a.periodicity, a.label_col, a.units_col) == (2, 4, 7, 4, "annual", 1, 2)
    assert lay["It's"].header_row is None
    layouts = detect_layout(t["cells"])
    lines = line_items(t["cells"], layouts)
    got = {(r.sheet, r.row): r for r in lines.collect()}
    assert got["Inputs", 6].section == "Revenue block" and got["Inputs", 6].n_formula == 4 and got["Inputs", 6].samples == "D=25, E=27.5, F=30"
    fam = {(r.sheet, r.row, r["rank"]): (r.r1c1, r.n_cells) for r in families(t["cells"]).collect()}
    assert fam["Inputs", 6, 1] == ("=R[-2]C*R[-1]C", 4)
    edges = {tuple(r) for r in dependency_edges(t["cells"], layouts, lines, t["names"]).drop("workbook_id").collect()}
    assert ("Inputs", 6, "Inputs", 4, "direct") in edges and ("It's", 1, "Inputs", 6, "direct") in edges and ("It's", 2, "Inputs", 5, "direct") in edges
    text = [r.text for r in map_text(lines, families(t["cells"])).filter("sheet = 'Inputs' and row = 6").collect()]
    assert text == ["r6 Revenue [m] f=4 c=0 | =R[-2]C*R[-1]C x4 (D6..G6) | eg D=25, E=27.5, F=30"]


def test_reader_details():
    cells = [c for c in read_workbook(_book(), "w") if c["kind"] == "cell"]
    by = {(c["sheet"], c["addr"]): c for c in cells}
    assert by["Inputs", "D7"]["value"] == "1" and by["Inputs", "D7"]["value_kind"] == "bool"
    assert by["Inputs", "E7"]["value"] == "#DIV/0!" and by["Inputs", "D2"]["value_date"] == date(2025, 6, 30)


def test_edges_whose_targets_depend_on_values(spark, tmp_path):
    """OFFSET, conditional sums, INDEX with MATCH, CHOOSE and whole rows get their targets from saved values of any sheet."""
    days = [(2, 4 + i, None, date(2025 + i, 6, 30)) for i in range(4)]
    label = lambda r, t: (r, 1, None, t)
    data = [*days, *[label(r, f"item {k}") for r, k in ((5, "x"), (6, "y"), (7, "x"), (8, "z"))], *[(r, 2, None, k) for r, k in ((5, "x"), (6, "y"), (7, "x"), (8, "z"))], *[(r, 4 + i, None, float(r + i)) for r in range(5, 9) for i in range(4)]]
    use = [*days, label(4, "shift"), (4, 4, None, 2.0), label(5, "key"), (5, 4, None, "y"), label(6, "moved"), (6, 4, "=OFFSET(Data!D5,D4,0)", 7.0), label(7, "sum"), (7, 4, '=SUMIFS(Data!D5:D8,Data!B5:B8,"x")', 12.0),
           label(8, "found"), (8, 4, "=INDEX(Data!D5:D8,MATCH(D5,Data!B5:B8,0))", 6.0), label(9, "choice"), (9, 4, "=CHOOSE(pick,Data!D5,Data!D8)", 8.0), label(10, "rows"), (10, 4, "=SUM(Data!5:6)", 1.0), label(11, "odd"), (11, 4, "=SUM((", 1.0)]
    (tmp_path / "m.xlsx").write_bytes(write_workbook({"Data": data, "Use": use}, {"pick": "step", "step": "Use!$D$4"}))
    t = split_records(load_workbooks(spark, str(tmp_path)))
    layouts = detect_layout(t["cells"])
    lines = line_items(t["cells"], layouts)
    got = {(r.src_row, r.dst_sheet, r.dst_row): r.kind for r in dependency_edges(t["cells"], layouts, lines, t["names"]).filter("src_sheet = 'Use'").collect()}
    assert {k[1:]: v for k, v in got.items() if k[0] == 6} == {("Data", 7): "offset", ("Use", 4): "direct"}
    assert {k[2]: v for k, v in got.items() if k[0] == 7} == {5: "active", 6: "inactive", 7: "active", 8: "inactive"}
    assert {k[1:]: v for k, v in got.items() if k[0] == 8} == {("Data", 5): "inactive", ("Data", 6): "active", ("Data", 7): "inactive", ("Data", 8): "inactive", ("Use", 5): "direct"}
    assert {k[1:]: v for k, v in got.items() if k[0] == 9} == {("Data", 5): "inactive", ("Data", 8): "direct", ("Use", 4): "direct"}
    assert {k[1:]: v for k, v in got.items() if k[0] == 10} == {("Data", 5): "direct", ("Data", 6): "direct"} and not any(k[0] == 11 for k in got)
