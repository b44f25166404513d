"""Following values: decomposition, parts, aggregates of checks, terms of formulas, and the portfolio operators' awkward inputs."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from gridloom.operators import binding, portfolio, trace
from gridloom.operators.relational import choose


@pytest.mark.parametrize(("expr", "want"), [
    ("=A1+B1-C1", [("+", "A1"), ("+", "B1"), ("-", "C1")]), ("=-A1+SUM(B1:B3,C1-D1)", [("-", "A1"), ("+", "SUM(B1:B3,C1-D1)")]), ("=(A1-B1)*2-'a-b'!C1", [("+", "(A1-B1)*2"), ("-", "'a-b'!C1")]), ('="x-y"&A1', [("+", '"x-y"&A1')]), ("=A1+(", None), ("=", None),
])
def test_terms_at_top_level(expr, want):
    assert trace.split_top(expr) == want


def test_formula_in_words():
    labels = {("S", 4): "Volume", ("It's", 5): "Price"}
    assert trace.in_words("=D4*'It''s'!D5+D9", labels, "S") == "[Volume]*[Price]+D9" and trace.in_words("=D4*(", labels, "S") == "[Volume]*("


TERM = "grp string, node string, child string, sign int"


def test_decomposition(spark):
    rows = [("g", "equity", "ev", 1), ("g", "equity", "debt", -1), ("g", "ev", "pv", 1), ("g", "ev", "debt", 1), ("g", "pv", "flow", 1), ("g", "debt", "loan", 1), ("h", "equity", "a0", 1), *[("h", f"a{i}", f"a{i + 1}", -1) for i in range(9)]]
    terms = spark.createDataFrame(rows, TERM)
    tops = spark.createDataFrame([("g", "equity"), ("h", "equity"), ("k", "lone")], "grp string, top string")
    got = {(r.grp, r.node): (r.sign, r.kind) for r in trace.decompose(tops, terms, spark.createDataFrame([("g", "pv")], "grp string, node string")).collect()}
    assert got == {("g", "pv"): (1, "pv"), ("g", "loan"): (0, "item"), ("h", "a5"): (-1, "undecomposable"), ("k", "lone"): (1, "item")}
    assert {r.node for r in trace.parts(tops.filter("grp = 'h'"), terms).collect()} == {"a2"}
    assert trace.decompose(tops.limit(0), terms, tops.select("grp", F.col("top").alias("node"))).count() == 0
    leaves = portfolio.leaf_terms(terms.filter("grp = 'g'"), tops.filter("grp = 'g'"))
    assert {(r.leaf, r.coef) for r in leaves.collect()} == {("flow", 1), ("loan", 0)}


def test_aggregates_of_checks(spark):
    checks = spark.createDataFrame([("w", "S", 1), ("w", "S", 2), ("w", "S", 2)], "workbook_id string, sheet string, `row` int")
    reads = spark.createDataFrame([("w", "S", 5, "S", 1), ("w", "S", 5, "S", 2), ("w", "T", 6, "S", 5), ("w", "T", 7, "S", 5), ("w", "T", 7, "S", 9), ("w", "T", 8, "T", 8), ("v", "S", 5, "S", 1)], "workbook_id string, sheet string, `row` int, t_sheet string, t_row int")
    assert {(r.sheet, r.row, r["round"]) for r in trace.aggregate_checks(checks, reads).collect()} == {("S", 1, 0), ("S", 2, 0), ("S", 5, 1), ("T", 6, 2)}


def test_verdicts_of_checks(spark):
    lines = spark.createDataFrame([("w", "S", i, t) for i, t in enumerate(["Check a", "error b", "Integrity", "check d", "Revenue", None])], "workbook_id string, sheet string, `row` int, label string")
    cells = spark.createDataFrame([("w", "S", 0, "num", 1e-9), ("w", "S", 1, "num", 2.0), ("w", "S", 2, "bool", 1.0), ("w", "S", 2, "bool", 1.0), ("w", "S", 3, "text", None), ("w", "S", 4, "num", 5.0)], "workbook_id string, sheet string, `row` int, value_kind string, value_num double")
    assert {r.row: r.verdict for r in trace.check_verdicts(lines, cells).collect()} == {0: "holds", 1: "fails", 2: "holds", 3: "unclear"}


def test_names_of_unlabelled_lines(spark):
    lines = spark.createDataFrame([("w", "It's", 5, None), ("w", "It's", 6, " "), ("w", "It's", 7, "Tariff"), ("w", "It's", 8, None)], "workbook_id string, sheet string, `row` int, label string")
    names = spark.createDataFrame([("w", "Zeta", "'It''s'!$D$5"), ("w", "Alpha", "='IT''S'!$D$5:$G$5"), ("w", "Wide", "'It''s'!$D$6:$D$7"), ("w", "Ext", "'[B.xlsx]It''s'!$D$8"), ("w", "Bad", "#REF!"), ("w", "Named", "'It''s'!$D$7"), ("w", None, None)], "workbook_id string, name string, ref string")
    assert {r.row: r.shown for r in portfolio.named_lines(lines, names).collect()} == {5: "Alpha", 6: None, 7: "Tariff", 8: None}


def test_small_portfolio_operators(spark):
    df = spark.createDataFrame([("a", 1, None, "x"), ("a", 1, "low", "x"), ("a", 1, "high", "y"), ("a", 1, "odd", "z"), ("b", 1, "info", "x")], "k string, i int, severity string, kind string")
    assert [(r.k, r.kind, r.severity, r.place) for r in portfolio.ordered_findings(df, ["k"]).orderBy("k", "place").collect()] == [("a", "y", "high", 1), ("a", "x", "low", 2), ("a", "z", "odd", 3), ("b", "x", "info", 1)]
    assert portfolio.page(df, ["k"], [F.col("kind")], 0).count() == 2
    assert [r.c for r in spark.range(1).select(F.explode(F.array(*[choose(F.lit(k), F.lit("p"), F.lit("q")) for k in (0, 1, 2, 3)])).alias("c")).collect()] == [None, "p", "q", None]
    got = [tuple(r.x) for r in spark.createDataFrame([("1e3",), (" 12 % ",), ("2026-01-31 00:00",), ("Rate_1",), ("2026-13-45",), ("?",), (None,)], "v string").select(portfolio.typed_value(F.col("v")).alias("x")).collect() if r.x is not None]
    assert got == [("number", 1000.0, None), ("percent", 0.12, None), ("date", None, date(2026, 1, 31)), ("name", None, None)]


def test_roles_by_all_orders(spark):
    rows = [("w", 1, 1, 0, 2, 0), ("w", 2, 2, 2, 0, 0), ("w", 3, 3, 0, 0, 2), ("v", 7, 1, 0, 0, 0), ("v", 8, 2, 0, 0, 0), ("v", 9, 3, 0, 0, 0), ("u", 1, 1, 2, 2, 2), ("u", 2, 2, 0, 0, 0)]
    df = spark.createDataFrame(rows, "k string, `row` int, o int, cfo int, cfi int, cff int")
    got = {r.k: (r.cfo, r.cfi, r.cff, r.score) for r in binding.assign_roles(df, ["k"], "row", ["cfo", "cfi", "cff"], "o").collect()}
    assert got == {"w": (2, 1, 3, 6), "v": (7, 8, 9, 0)}
    with pytest.raises(ValueError):
        binding.assign_roles(df, ["k"], "row", ["cfo"], "o")


def test_balance_anchor(spark):
    triples = spark.createDataFrame([("w", 10, 4, 7, 1, 1, 3), ("w", 20, 1, 2, 1, 1, 5), ("w", 4, 10, 7, 1, -1, 3), ("v", 3, 1, 2, 1, 1, 2), ("v", 6, 4, 5, 1, 1, 2)], "k string, a int, b int, c int, sign_b int, sign_c int, n_periods int")
    labels = spark.createDataFrame([("w", 10, "Total assets"), ("w", 4, "Total equity"), ("w", 7, "Total liabilities"), ("w", 20, None)], "k string, `row` int, label string")
    got = {r.k: (r.assets, r.liabilities, r.equity, r.how, r.alternates) for r in binding.balance_anchor(triples, labels, ["k"]).collect()}
    assert got == {"w": (10, 7, 4, "label", 0), "v": (3, 1, 2, "value", 1)}
    assert binding.balance_anchor(triples.limit(0), labels, ["k"]).count() == 0


def test_chains_of_totals(spark):
    feeds = spark.createDataFrame([("g", "npat", "pbt"), ("g", "npat", "zz"), ("g", "pbt", "ebit"), ("g", "ebit", "pbt"), *[("h", f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)]], "grp string, node string, before string")
    starts = spark.createDataFrame([("g", "npat"), ("h", "n00"), ("k", "alone")], "grp string, start string")
    got = {}
    for r in binding.chain_back(starts, feeds).orderBy("step").collect():
        got.setdefault(r.grp, []).append(r.node)
    assert got["g"] == ["npat", "pbt", "ebit"] and len(got["h"]) == 13 and got["k"] == ["alone"]
