"""Queries of the general data problems, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.hierarchy import sheet_hierarchy
from gridloom.operators.orphans import orphan_references, orphan_report
from gridloom.operators.skew import balanced_counts, balanced_join
from gridloom.operators.units import common_quantities, converted
from gridloom.operators.widen import widen_register
from gridloom.tables import read

HEAVY_SHARE = 0.05


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return converted(read(spark, d, "cells"), read(spark, d, "line_items"), read(spark, d, "sheets"), read(spark, d, "unit_refs"))


def p2_by_unit(spark: SparkSession, d: str) -> DataFrame:
    """Figures per unit recorded, those already in the common unit included."""
    q = common_quantities(read(spark, d, "cells"), read(spark, d, "line_items"), read(spark, d, "sheets"), read(spark, d, "unit_refs"))
    return q.groupBy("unit_code", "common_code").agg(F.count(F.lit(1)).alias("n_cells"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(read(spark, d, "line_items"), read(spark, d, "edges"), read(spark, d, "defined_names"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(p3_found(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return sheet_hierarchy(read(spark, d, "sheets"), read(spark, d, "edges"))


def _heavy(df: DataFrame, table: str, key: str, spread: list[str]) -> DataFrame:
    found = balanced_counts(df, [key], spread).filter((F.col("share") >= HEAVY_SHARE) & F.col(key).isNotNull())
    return found.select(F.lit(table).alias("table_name"), F.col(key).cast("string").alias("key_value"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    cells = _heavy(read(spark, d, "cells"), "cells", "sheet", ["workbook_id", "row", "col", "loaded_at"])
    return cells.unionByName(_heavy(read(spark, d, "edges"), "edges", "dst_row", ["edge_id", "built_at"]))


def p5_sheet_profile(spark: SparkSession, d: str) -> DataFrame:
    """Per sheet name: its cells as delivered, how many hold formulas, and the deliveries of sheets so named.

    The matching side is copied only to the shards of heavy names, and the sums over shards add up.
    """
    cells = read(spark, d, "cells").select("workbook_id", "sheet", "row", "col", "loaded_at", "formula")
    sheets = read(spark, d, "sheets").groupBy("sheet").agg(F.count(F.lit(1)).alias("n_deliveries"))
    joined = balanced_join(cells, sheets, ["sheet"], ["workbook_id", "row", "col", "loaded_at"])
    return joined.groupBy("sheet").agg(F.count(F.lit(1)).alias("n_cells"), F.count("formula").alias("n_formulas"), F.max("n_deliveries").alias("n_deliveries"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    wide = widen_register(read(spark, d, "cells"), read(spark, d, "register_attrs"))
    return wide.select("workbook_id", "row", "asset_code", "asset_class", "site", "cost_cents", "insured_cents", "in_service", "life_months", "active")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p2_by_unit, p3_found, p3_report, p4_found, p5_found, p5_sheet_profile, p6_found)
}

_KEY = "lower(trim(CASE WHEN regexp_matches(trim({0}), '^''.*''$') THEN replace(trim({0})[2:-2], '''''', '''') ELSE trim({0}) END))"

ORACLES: dict[str, str] = {
    "p4_found": f"""
        WITH RECURSIVE s AS (
            SELECT workbook_id w, {_KEY.format('sheet')} k, max(sheet) sheet FROM sheets GROUP BY 1, 2),
        par AS (
            SELECT DISTINCT c.w, c.sheet child, p.sheet parent FROM edges e
            JOIN s p ON p.w = e.workbook_id AND p.k = {_KEY.format('e.src_sheet')}
            JOIN s c ON c.w = e.workbook_id AND c.k = {_KEY.format('e.dst_sheet')}
            WHERE p.sheet <> c.sheet AND lower(trim(coalesce(e.kind, ''))) <> 'inactive'),
        walk AS (
            SELECT w, sheet node, sheet cur, [sheet] path, false closed FROM s
            UNION ALL
            SELECT k.w, k.node, q.parent, list_append(k.path, q.parent), list_contains(k.path, q.parent)
            FROM walk k JOIN par q ON q.w = k.w AND q.child = k.cur WHERE NOT k.closed),
        ends AS (
            SELECT w, node, arg_max(path, len(path)) path, bool_or(closed) cyc FROM walk GROUP BY 1, 2),
        pairs AS (
            SELECT DISTINCT w, node, unnest(path) anc FROM ends),
        n AS (SELECT w, anc, count(*) n FROM pairs WHERE anc <> node GROUP BY 1, 2)
        SELECT e.w AS workbook_id, e.node AS sheet,
            CASE WHEN cyc THEN list_min(path[list_position(path, path[-1]):]) ELSE path[-1] END AS root_sheet,
            CAST(CASE WHEN cyc THEN -1 ELSE len(path) - 1 END AS INTEGER) AS depth,
            CASE WHEN cyc THEN '' ELSE array_to_string(list_reverse(path), ' > ') END AS path,
            CAST(coalesce(n.n, 0) AS INTEGER) AS n_desc
        FROM ends e LEFT JOIN n ON n.w = e.w AND n.anc = e.node""",
    "p5_found": """
        SELECT 'cells' AS table_name, sheet AS key_value FROM cells WHERE sheet IS NOT NULL
        GROUP BY sheet HAVING count(*) >= 0.05 * (SELECT count(*) FROM cells)
        UNION ALL
        SELECT 'edges', CAST(dst_row AS VARCHAR) FROM edges WHERE dst_row IS NOT NULL
        GROUP BY dst_row HAVING count(*) >= 0.05 * (SELECT count(*) FROM edges)""",
    "p5_sheet_profile": """
        SELECT c.sheet, c.n_cells, c.n_formulas, s.n_deliveries
        FROM (SELECT sheet, count(*) n_cells, count(formula) n_formulas FROM cells GROUP BY 1) c
        JOIN (SELECT sheet, count(*) n_deliveries FROM sheets GROUP BY 1) s USING (sheet)""",
}
