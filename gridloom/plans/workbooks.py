"""Workbook-level operators over the stored cells. SQL reads no formula in general; where it can be told what the formulas
of the tables say, it says the same, the others are tested on written workbooks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import dependencies, identities, review, rowmap, statements, threeway, valuation
from gridloom.functions.ontology import ROLES
from gridloom.plans.catalog import LAYOUT, LIVE_CELLS, Tables, live_cells, sql_says, typed, typed_cells
from gridloom.tables import materialise

def _cells(t: Tables) -> DataFrame:
    return typed_cells(t)


def _mapped(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = _cells(t)
    lay = materialise(rowmap.detect_layout(c))
    return c, lay, materialise(rowmap.line_items(c, lay))


def row_map(t: Tables) -> DataFrame:
    return _mapped(t)[2]


def line_labels(t: Tables) -> DataFrame:
    """Section, label and units of every line."""
    return _mapped(t)[2].select(*rowmap.SHEET, "row", "section", "label", "units")


def role_bindings(t: Tables) -> DataFrame:
    """The line each role of each workbook is bound to by its label."""
    c, lay, lines = _mapped(t)
    kinds = materialise(statements.structure(_terms(c)))
    return statements.label_bindings(lines, kinds).select("workbook_id", "role", "block", "sheet", "row", "label")


def map_text(t: Tables) -> DataFrame:
    c, _, lines = _mapped(t)
    return rowmap.map_text(lines, rowmap.families(c))


def formula_families(t: Tables) -> DataFrame:
    return rowmap.families(live_cells(t, "addr", "formula"))


def dependency_edges(t: Tables) -> DataFrame:
    c, lay, lines = _mapped(t)
    return dependencies.dependency_edges(c, lay, lines, t.defined_names.select("workbook_id", "name", "ref").dropna())


def _terms(c: DataFrame) -> DataFrame:
    return materialise(statements.terms(statements.dominant_formulas(c, rowmap.families(c))))


def row_structure(t: Tables) -> DataFrame:
    return statements.structure(_terms(_cells(t)))


def corkscrew_rows(t: Tables) -> DataFrame:
    return statements.corkscrews(_terms(_cells(t)))


def subtotal_results(t: Tables) -> DataFrame:
    return statements.held_subtotals(materialise(statements.held_rows(typed(t.cells), newest="loaded_at")))


def subtotal_verdicts(t: Tables) -> DataFrame:
    """Which subtotals hold against their parts, without the residuals, whose last digits depend on the order of adding."""
    return subtotal_results(t).select(*rowmap.SHEET, "row", "n_failing", "n_periods", "status")


def identity_results(t: Tables) -> DataFrame:
    c, lay, lines = _mapped(t)
    tt = _terms(c)
    kinds = materialise(statements.structure(tt))
    bound = materialise(statements.label_bindings(lines, kinds))
    return statements.identity_results(bound, statements.many_bindings(bound, tt), statements.row_values(c, lay))


def value_triples(t: Tables) -> DataFrame:
    """Rows a = b + c of every sheet with a timeline."""
    c, lay, _ = _mapped(t)
    return identities.value_triples(statements.row_values(c, lay), ["workbook_id", "sheet"], "row", "period", "value")


def _roles(t: Tables) -> DataFrame:
    c, lay, lines = _mapped(t)
    kinds = materialise(statements.structure(_terms(c)))
    return materialise(threeway.role_values(statements.label_bindings(lines, kinds), statements.row_values(c, lay)))


def statement_lines(t: Tables) -> DataFrame:
    return threeway.statements(_roles(t))


def statement_checks(t: Tables) -> DataFrame:
    return threeway.checks(materialise(threeway.statements(_roles(t))))


def statement_years(t: Tables) -> DataFrame:
    return threeway.by_year(threeway.statements(_roles(t)))


def statement_modes(t: Tables) -> DataFrame:
    return threeway.modes(threeway.statements(_roles(t)))


def statement_residuals(t: Tables) -> DataFrame:
    roles = _roles(t)
    return threeway.residual_components(materialise(threeway.statements(roles)), roles)


def valuation_catalogue(t: Tables) -> DataFrame:
    c, lay, lines = _mapped(t)
    return valuation.catalogue(c, lines, lay, t.defined_names.select("workbook_id", "name", "ref").dropna())


def stale_cells(t: Tables) -> DataFrame:
    return review.stale_cells(typed(t.cells), newest="loaded_at")


def candidate_rates(t: Tables) -> DataFrame:
    c, lay, lines = _mapped(t)
    return review.candidate_cells(c, lines, lay, t.defined_names.select("workbook_id", "name", "ref").dropna(), "rate")


def classified_rows(t: Tables) -> DataFrame:
    """Lines with their class; what only a traced valuation can tell is left open."""
    c, lay, lines = _mapped(t)
    head = lay.filter("header_row is not null").select("workbook_id", "sheet", F.col("header_row").alias("row"), F.lit(True).alias("is_timeline_row"))
    dates = review.date_valued(c, lay).withColumn("is_dates", F.lit(True))
    keys = ["workbook_id", "sheet", "row"]
    return review.classify(lines.join(head, keys, "left").join(dates, keys, "left")).select(*keys, "label", "class", "subclass", "rule")


def table_summaries(t: Tables) -> DataFrame:
    return review.table_summaries(_cells(t))


def anonymised_formulas(t: Tables) -> DataFrame:
    names = t.defined_names.select("workbook_id", "name").dropna()
    return review.anonymise(t.cells.select("workbook_id", "formula"), t.sheets.select("workbook_id", "sheet", "sheet_pos"), names)


def _query(f: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: f(Tables(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _query(f)
    for f in (row_map, line_labels, role_bindings, map_text, formula_families, dependency_edges, row_structure, corkscrew_rows, subtotal_results, subtotal_verdicts, identity_results, value_triples, statement_lines, statement_checks, statement_years, statement_modes, statement_residuals, valuation_catalogue, stale_cells, candidate_rates, classified_rows, table_summaries, anonymised_formulas)
}

_REF = r"\$?[A-Z]{1,3}\$?[0-9]+"
_COL = "CASE WHEN length({0}) = 1 THEN ascii({0}) - 64 ELSE (ascii({0}[1]) - 64) * 26 + ascii({0}[2]) - 64 END"


def _relative(ref: str) -> str:
    """SQL for one reference without dollar signs as seen from ``row`` and ``col``."""
    letters, number = f"regexp_extract({ref}, '([A-Z]+)', 1)", f"CAST(regexp_extract({ref}, '([0-9]+)', 1) AS INTEGER)"
    part = lambda k, there, here: f"CASE WHEN {there} = {here} THEN '{k}' ELSE '{k}[' || ({there} - {here}) || ']' END"
    return f"({part('R', number, 'row')} || {part('C', _COL.format(letters), 'col')})"


#: Formulas of live cells with their relative form, families and dominant formulas.
FAMILIES = rf"""{LIVE_CELLS}, f AS (SELECT workbook_id, sheet, row, col, addr, formula, array_to_string(list_transform(list_zip(string_split(regexp_replace(formula, '{_REF}', chr(1), 'g'), chr(1)), regexp_extract_all(formula, '{_REF}')), lambda z: z[1] || coalesce({_relative('z[2]')}, '')), '') r1c1 FROM live WHERE formula IS NOT NULL),
    fam AS (SELECT workbook_id, sheet, row, r1c1, count(*) n_cells, arg_min(addr, col) first_addr, arg_max(addr, col) last_addr, min(col) c FROM f GROUP BY 1, 2, 3, 4),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY workbook_id, sheet, row ORDER BY n_cells DESC, c) AS INTEGER) rank FROM fam),
    top AS (SELECT f.* FROM f JOIN ranked r ON r.rank = 1 AND r.workbook_id = f.workbook_id AND r.sheet = f.sheet AND r.row = f.row AND r.first_addr = f.addr)"""
_FAMILY_PARTS = FAMILIES.removeprefix(LIVE_CELLS).lstrip(", ")
#: What formulas read: rows of the own sheet by single references and ranges of one column.
_SPAN = r"^=SUM\(([A-Z]+)([0-9]+):([A-Z]+)([0-9]+)\)$"
_PAIR = r"^=([A-Z]+)([0-9]+)\*([A-Z]+)([0-9]+)$"

#: A name's reference to rows of one sheet, in A1 notation.
_NAMED = r"^(?:''((?:[^'']|'''')+)''|([^''!\[\]]+))!\$?[A-Za-z]{1,3}\$?([0-9]+)(?::\$?[A-Za-z]{1,3}\$?([0-9]+))?$"


def _num(pattern: str, k: int) -> str:
    return f"CAST(nullif(regexp_extract(formula, '{pattern}', {k}), '') AS INTEGER)"


def _cell(pattern: str, letters: int, number: int) -> str:
    return f"{{r: {_num(pattern, number)}, c: {_COL.format(f"regexp_extract(formula, '{pattern}', {letters})")}}}"


#: Typed cells with the number each counts as; what a formula of the tables reads, cell by cell.
_NUMBERS = f"""{LAYOUT}, n AS (SELECT workbook_id w, sheet s, row r, col c, formula, value, kind, CASE WHEN kind IN ('num', 'bool') THEN coalesce(value_num, CASE WHEN kind = 'num' THEN TRY_CAST(value AS DOUBLE) END) END num FROM kinds),
    lo AS (SELECT *, least({_num(_SPAN, 2)}, {_num(_SPAN, 4)}) a, greatest({_num(_SPAN, 2)}, {_num(_SPAN, 4)}) b FROM n WHERE formula IS NOT NULL)"""

#: Lines with section, label and units, as their cells say.
_LINES = f"""{LAYOUT}, a_ AS (SELECT k.*, coalesce(k.col < l.label_col OR k.col = l.label_col AND k.kind <> 'num', false) lab, coalesce(k.col = l.units_col AND k.kind <> 'num', false) un, coalesce(CASE WHEN k.kind <> 'num' THEN left(k.value, 40) WHEN TRY_CAST(k.value AS DOUBLE) = floor(TRY_CAST(k.value AS DOUBLE)) AND abs(TRY_CAST(k.value AS DOUBLE)) < 1e12 THEN CAST(CAST(TRY_CAST(k.value AS DOUBLE) AS BIGINT) AS VARCHAR) ELSE format('{{:.4g}}', round(TRY_CAST(k.value AS DOUBLE) * pow(10, 3 - floor(log10(abs(TRY_CAST(k.value AS DOUBLE)))))) / pow(10, 3 - floor(log10(abs(TRY_CAST(k.value AS DOUBLE)))))) END, k.formula) shown FROM kinds k LEFT JOIN layout l ON l.workbook_id = k.workbook_id AND l.sheet = k.sheet),
    b_ AS (SELECT workbook_id, sheet, row, string_agg(shown, ' ' ORDER BY col) FILTER (lab AND NOT un AND shown IS NOT NULL) l, arg_max(shown, col) FILTER (un) u, count(*) FILTER (NOT lab AND NOT un AND formula IS NOT NULL) nf, count(*) FILTER (NOT lab AND NOT un AND formula IS NULL) nc,
        arg_min(left(trim(value), 60), col) FILTER (NOT lab AND NOT un AND kind = 'text' AND trim(value) <> '') f FROM a_ GROUP BY 1, 2, 3),
    c_ AS (SELECT *, coalesce(nullif(l, ''), f, '') label, nf = 0 AND nc = 0 bare FROM b_),
    d_ AS (SELECT *, last_value(CASE WHEN bare AND label <> '' THEN label END IGNORE NULLS) OVER (PARTITION BY workbook_id, sheet ORDER BY row ROWS UNBOUNDED PRECEDING) sec FROM c_),
    line_ AS (SELECT workbook_id, sheet, row, coalesce(sec, '') section, label, coalesce(u, '') units FROM d_ WHERE NOT bare)"""


def _says(pattern: str) -> str:
    """A role's pattern in SQL, which has no look-ahead: what must not follow is a condition of its own."""
    return sql_says(pattern, "lower(trim(label))")


_HERE = "CASE block " + " ".join(f"WHEN '{b}' THEN regexp_matches(lower(sheet), '{p}')" for b, p in statements.BLOCK_SHEETS.items()) + " ELSE false END"

ORACLES: dict[str, str] = {
    "line_labels": f"WITH {_LINES} SELECT workbook_id, sheet, row, section, label, units FROM line_",
    "role_bindings": f"""WITH {_LINES}, {_FAMILY_PARTS}, k_ AS (SELECT workbook_id, sheet, row FROM (SELECT *, least({_num(_SPAN, 2)}, {_num(_SPAN, 4)}) a, greatest({_num(_SPAN, 2)}, {_num(_SPAN, 4)}) b, {_COL.format(f"regexp_extract(formula, '{_SPAN}', 1)")} - col d FROM top WHERE regexp_matches(formula, '{_SPAN}') AND regexp_extract(formula, '{_SPAN}', 1) = regexp_extract(formula, '{_SPAN}', 3)) WHERE d = 0 AND b > a AND b - a <= 300),
        hit_ AS ({" UNION ALL ".join(f"SELECT workbook_id, sheet, row, label, '{r.name}' AS role, '{r.block}' AS block FROM line_ WHERE label <> '' AND {_says(r.vocab)}" for r in ROLES.values() if not r.name.endswith("*"))}),
        rank_ AS (SELECT h.*, row_number() OVER (PARTITION BY h.workbook_id, role, block ORDER BY {_HERE.replace("sheet)", "h.sheet)")} DESC, (k.row IS NOT NULL) DESC, length(label), h.row, h.sheet DESC) n FROM hit_ h LEFT JOIN k_ k ON k.workbook_id = h.workbook_id AND k.sheet = h.sheet AND k.row = h.row)
        SELECT workbook_id, role, block, sheet, row, label FROM rank_ WHERE n = 1""",
    "subtotal_verdicts": f"""WITH {_NUMBERS}, {_FAMILY_PARTS},
        kind_ AS (SELECT workbook_id w, sheet s, row r, least({_num(_SPAN, 2)}, {_num(_SPAN, 4)}) a, greatest({_num(_SPAN, 2)}, {_num(_SPAN, 4)}) b FROM top WHERE regexp_matches(formula, '{_SPAN}') AND regexp_extract(formula, '{_SPAN}', 1) = regexp_extract(formula, '{_SPAN}', 3) AND {_COL.format(f"regexp_extract(formula, '{_SPAN}', 1)")} = col),
        sub AS (SELECT *, b - a + 1 k FROM kind_ WHERE b > a), span AS (SELECT workbook_id w, sheet s, header_row h, tl_first f, tl_last l FROM layout WHERE tl_first IS NOT NULL),
        own AS (SELECT n.*, h FROM n JOIN span USING (w, s) WHERE c BETWEEN f AND l), head_ AS (SELECT own.w, own.s, own.c, coalesce(d.d, NULL) period FROM own JOIN dated d ON d.workbook_id = w AND d.sheet = s AND d.row = r AND d.col = c WHERE r = h AND kind = 'date'),
        body AS (SELECT * FROM own WHERE r <> h), rows_ AS (SELECT DISTINCT w, s, r FROM body),
        vals AS (SELECT x.w, x.s, x.r, q.period, CASE WHEN y.w IS NULL OR y.value IS NULL THEN 0 ELSE y.num END v FROM rows_ x JOIN head_ q USING (w, s) LEFT JOIN body y ON y.w = x.w AND y.s = x.s AND y.r = x.r AND y.c = q.c),
        both_ AS (SELECT u.w, u.s, u.r, u.k, v.period, 1 g, v.v FROM sub u JOIN vals v ON v.w = u.w AND v.s = u.s AND v.r BETWEEN u.a AND u.b UNION ALL SELECT u.w, u.s, u.r, u.k, v.period, -1, v.v FROM sub u JOIN vals v ON v.w = u.w AND v.s = u.s AND v.r = u.r),
        res AS (SELECT w, s, r, k, period, sum(g * v) x, max(abs(v)) m FROM both_ WHERE v IS NOT NULL GROUP BY 1, 2, 3, 4, 5 HAVING count(*) = k + 1), tol AS (SELECT w, s, r, greatest(1e-6, 1e-6 * max(m)) t FROM res GROUP BY 1, 2, 3)
        SELECT w AS workbook_id, s AS sheet, r AS row, count(*) FILTER (abs(x) > t) AS n_failing, count(*) AS n_periods, CASE WHEN count(*) FILTER (abs(x) > t) = 0 THEN 'holds' ELSE 'fails' END AS status FROM res JOIN tol USING (w, s, r) GROUP BY 1, 2, 3""",
    "stale_cells": f"""WITH RECURSIVE {_NUMBERS}, p AS (SELECT w, s, r, c, formula, num, unnest(list_distinct(CASE WHEN regexp_matches(formula, '{_PAIR}') THEN [{_cell(_PAIR, 1, 2)}, {_cell(_PAIR, 3, 4)}] ELSE list_transform(range(a, b + 1), lambda i: {{r: CAST(i AS INTEGER), c: {_COL.format(f"regexp_extract(formula, '{_SPAN}', 1)")}}}) END)) q FROM lo WHERE kind = 'num' AND num IS NOT NULL AND (regexp_matches(formula, '{_PAIR}') OR regexp_matches(formula, '{_SPAN}'))),
        v AS (SELECT p.w, p.s, p.r, p.c, p.formula, p.num saved, p.q.r qr, p.q.c qc, CASE WHEN t.w IS NULL OR t.value IS NULL THEN 0 ELSE t.num END x FROM p LEFT JOIN n t ON t.w = p.w AND t.s = p.s AND t.r = p.q.r AND t.c = p.q.c),
        e AS (SELECT w, s, r, c, formula, saved, list(x ORDER BY qr, qc) xs, max(abs(x)) big FROM v GROUP BY 1, 2, 3, 4, 5, 6 HAVING count(x) = count(*)),
        g AS (SELECT *, CASE WHEN formula LIKE '=SUM%' THEN list_reduce(xs, lambda i, j: i + j) WHEN len(xs) = 1 THEN xs[1] * xs[1] ELSE xs[1] * xs[2] END computed FROM e),
        bad AS (SELECT * FROM g WHERE abs(computed - saved) > greatest(1e-6, 1e-6 * greatest(abs(computed), abs(saved)), 1e-3 * big)),
        l0 AS (SELECT DISTINCT w, s, r, c, unnest(CASE WHEN regexp_matches(formula, '{_SPAN}') THEN CASE WHEN b - a < 100 THEN list_transform(range(a, b + 1), lambda i: {{r: CAST(i AS INTEGER), c: {_COL.format(f"regexp_extract(formula, '{_SPAN}', 1)")}}}) END ELSE list_transform(regexp_extract_all(formula, '[A-Z]{{1,3}}[0-9]+'), lambda z: {{r: CAST(regexp_extract(z, '([0-9]+)', 1) AS INTEGER), c: {_COL.format("regexp_extract(z, '([A-Z]+)', 1)")}}}) END) t FROM lo),
        walk AS (SELECT DISTINCT w, s, r r0, c c0, r, c, 0 d FROM bad UNION SELECT k.w, k.s, k.r0, k.c0, l.t.r, l.t.c, k.d + 1 FROM walk k JOIN l0 l ON l.w = k.w AND l.s = k.s AND l.r = k.r AND l.c = k.c WHERE k.d < 4),
        loops AS (SELECT DISTINCT w, s, r0, c0 FROM walk WHERE d > 0 AND r = r0 AND c = c0)
        SELECT bad.w AS workbook_id, bad.s AS sheet, bad.r AS row, bad.c AS col, formula, saved, computed, CAST(len(xs) AS INTEGER) AS n_operands FROM bad LEFT JOIN loops o ON o.w = bad.w AND o.s = bad.s AND o.r0 = bad.r AND o.c0 = bad.c WHERE o.w IS NULL""",
    "formula_families": f"WITH {FAMILIES} SELECT workbook_id, sheet, row, r1c1, n_cells, first_addr, last_addr, rank FROM ranked",
    "row_structure": f"""WITH {FAMILIES}, s AS (SELECT *, least({_num(_SPAN, 2)}, {_num(_SPAN, 4)}) a, greatest({_num(_SPAN, 2)}, {_num(_SPAN, 4)}) b, {_COL.format(f"regexp_extract(formula, '{_SPAN}', 1)")} - col d FROM top WHERE regexp_matches(formula, '{_SPAN}') AND regexp_extract(formula, '{_SPAN}', 1) = regexp_extract(formula, '{_SPAN}', 3))
        SELECT workbook_id, sheet, row, CAST(b - a + 1 AS BIGINT) AS n_terms, CASE WHEN a = b AND d = -1 THEN 'previous' WHEN a = b AND d = 0 THEN 'link' WHEN d = 0 AND b > a THEN 'subtotal' ELSE 'linear' END AS kind FROM s WHERE b - a <= 300""",
    "dependency_edges": rf"""WITH {LAYOUT}, c AS (SELECT k.*, coalesce(k.col < l.label_col OR k.col = l.label_col AND k.kind <> 'num' OR k.col = l.units_col AND k.kind <> 'num', false) named FROM kinds k LEFT JOIN layout l ON l.workbook_id = k.workbook_id AND l.sheet = k.sheet),
        data AS (SELECT DISTINCT workbook_id, sheet, row FROM c WHERE NOT named), f AS (SELECT DISTINCT workbook_id, sheet, row, formula FROM c WHERE NOT named AND formula IS NOT NULL),
        n AS (SELECT workbook_id w, lower(name) k, regexp_replace(max(ref), '^=', '') ref FROM defined_names WHERE name IS NOT NULL AND ref IS NOT NULL AND workbook_id IS NOT NULL GROUP BY 1, 2),
        m AS (SELECT w, k, CASE WHEN regexp_extract(ref, '{_NAMED}', 1) <> '' THEN replace(regexp_extract(ref, '{_NAMED}', 1), repeat(chr(39), 2), chr(39)) ELSE regexp_extract(ref, '{_NAMED}', 2) END s, CAST(regexp_extract(ref, '{_NAMED}', 3) AS INTEGER) a, CAST(coalesce(nullif(regexp_extract(ref, '{_NAMED}', 4), ''), regexp_extract(ref, '{_NAMED}', 3)) AS INTEGER) b FROM n WHERE regexp_matches(ref, '{_NAMED}') AND NOT contains(ref, '[')),
        q AS (SELECT f.workbook_id, f.sheet, f.row, m.s t_sheet, unnest(range(least(a, b), least(greatest(a, b), least(a, b) + 300) + 1)) t FROM f JOIN m ON m.w = f.workbook_id AND m.k = lower(regexp_extract(formula, '(?:>|\+)([A-Za-z]+)', 1))),
        r AS (SELECT workbook_id, sheet, row, unnest(CASE WHEN regexp_matches(formula, '{_SPAN}') THEN range(least({_num(_SPAN, 2)}, {_num(_SPAN, 4)}), least(greatest({_num(_SPAN, 2)}, {_num(_SPAN, 4)}), least({_num(_SPAN, 2)}, {_num(_SPAN, 4)}) + 300) + 1) ELSE list_transform(regexp_extract_all(formula, '[A-Z]{{1,3}}([0-9]+)', 1), lambda x: CAST(x AS INTEGER)) END) t FROM f),
        u AS (SELECT workbook_id, sheet, row, sheet AS t_sheet, t FROM r UNION ALL SELECT * FROM q)
        SELECT DISTINCT u.workbook_id, u.sheet AS src_sheet, u.row AS src_row, u.t_sheet AS dst_sheet, CAST(u.t AS INTEGER) AS dst_row, 'direct' AS kind FROM u JOIN data d ON d.workbook_id = u.workbook_id AND d.sheet = u.t_sheet AND d.row = u.t WHERE NOT (u.t = u.row AND u.t_sheet = u.sheet)""",
    "anonymised_formulas": r"""WITH n AS (SELECT workbook_id w, lower(name) k, 'NAME' || row_number() OVER (PARTITION BY workbook_id ORDER BY lower(name)) t FROM (SELECT DISTINCT workbook_id, lower(name) name FROM defined_names WHERE workbook_id IS NOT NULL AND name IS NOT NULL)),
        x AS (SELECT DISTINCT workbook_id, formula, regexp_extract(formula, '(?:>|\+)([A-Z][a-z]+)', 1) word FROM cells WHERE formula IS NOT NULL AND workbook_id IS NOT NULL)
        SELECT x.workbook_id, formula, CASE WHEN word = '' THEN formula ELSE replace(formula, word, coalesce(n.t, 'NAME')) END AS shown FROM x LEFT JOIN n ON n.w = x.workbook_id AND n.k = lower(word)""".replace("\\\\", "\\"),
}
