"""Catalogue queries on small tables made here, where their SQL shares a cut or there is none."""

from datetime import datetime

from gridloom.plans import catalog

EDGE = "edge_id long, workbook_id string, src_sheet string, src_row int, dst_sheet string, dst_row int, kind string, built_at timestamp"


def write(spark, at, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(at / f"{name}.parquet"))


def write_edges(spark, at, links):
    write(spark, at, "edges", [(i, "w", a, 1, b, 1, "direct", datetime(2026, 1, 1)) for i, (a, b) in enumerate(links)], EDGE)


def test_cone_follows_the_frontier_to_its_end(spark, tmp_path):
    chain = ["Inputs", *[f"S{i}" for i in range(1, 10)]]
    write_edges(spark, tmp_path, zip(chain, chain[1:]))
    write(spark, tmp_path, "sheets", [("w", c, datetime(2026, 1, 1)) for c in chain], "workbook_id string, sheet string, loaded_at timestamp")
    r = catalog.QUERIES["cone_share"](spark, str(tmp_path)).first()
    assert (r.n_cone, r.max_depth, r.share) == (10, 9, 1.0)


def test_spellings_of_a_sheet_are_one_node(spark, tmp_path):
    write_edges(spark, tmp_path, [("inputs ", "Debt"), ("'INPUTS'", " debt"), ("Debt", "DEBT"), ("debt", "Tax")])
    write(spark, tmp_path, "sheets", [("w", c, datetime(2026, 1, 1)) for c in ("Inputs", "Debt", "Tax")], "workbook_id string, sheet string, loaded_at timestamp")
    run = lambda name: catalog.QUERIES[name](spark, str(tmp_path)).collect()
    assert {(r.node, r.size) for r in run("sheet_scc_flags")} == {("Inputs", 1), ("Debt", 1), ("Tax", 1)}
    assert {(r.node, r.n_in, r.n_out) for r in run("sheet_roles")} == {("Inputs", 0, 1), ("Debt", 1, 1), ("Tax", 1, 0)}
    assert {(r.src_sheet, r.dst_sheet, r.n_live) for r in run("sheet_flows")} == {("Inputs", "Debt", 2), ("Debt", "Tax", 1)}
    assert {(r.node, r.depth) for r in run("closure_depth")} == {("Inputs", 0), ("Debt", 1), ("Tax", 2)}


def test_sums_take_the_live_cells_of_every_sheet(spark, tmp_path):
    old, new = datetime(2026, 1, 1), datetime(2026, 1, 2)
    rows = [("w", "Inputs", 1, 3, 1.0, old), ("w", "Inputs", 1, 3, 2.0, new), ("w", "Inputs", 1, 4, 5.0, old), ("w", "Debt", 1, 1, 4.0, old), ("w", "Debt", 1, 2, None, old)]
    write(spark, tmp_path, "cells", rows, "workbook_id string, sheet string, `row` int, col int, value_num double, loaded_at timestamp")
    got = {r.sheet: (r.n, r.known, r.strict) for r in catalog.QUERIES["strict_vs_known_sum"](spark, str(tmp_path)).collect()}
    assert got == {"Inputs": (2, 7.0, 7.0), "Debt": (2, 4.0, None)}
