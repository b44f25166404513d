"""Queries of the portfolio operators with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import text
from gridloom.operators import graphs, identities, portfolio, relational, review, rowmap
from gridloom.plans.catalog import E1, FLOWS, G, LAYOUT, LIVE_CELLS, LIVE_LINES, NATION_MONTH, TIE_ROWS, Tables, _region_parts, edges_once, flows, live_cells, live_lines, nation_month, query, sheet_graph, sql_key, typed_cells
from gridloom.streaming import ingest
from gridloom.tables import BLANKS, materialise, sheet_key, trimmed

BLANKLESS = "(label IS NULL OR trim(label) = '')"
REF = r"^=?(?:''((?:[^'']|'''')+)''|([^''!\[\]]+))!\$?[A-Za-z]{1,3}\$?([0-9]+)(?::\$?[A-Za-z]{1,3}\$?([0-9]+))?$"


@query(f"""WITH {LIVE_LINES}, r AS (SELECT workbook_id, name, trim(ref) ref FROM defined_names WHERE regexp_matches(trim(ref), '{REF}') AND NOT contains(ref, '[')),
    n AS (SELECT workbook_id, name, CASE WHEN regexp_extract(ref, '{REF}', 1) <> '' THEN replace(regexp_extract(ref, '{REF}', 1), repeat(chr(39), 2), chr(39)) ELSE regexp_extract(ref, '{REF}', 2) END s, TRY_CAST(regexp_extract(ref, '{REF}', 3) AS INTEGER) a, TRY_CAST(nullif(regexp_extract(ref, '{REF}', 4), '') AS INTEGER) b FROM r),
    best AS (SELECT workbook_id w, {sql_key('s')} k, a, min(name) name FROM n WHERE b IS NULL OR b = a GROUP BY 1, 2, 3)
    SELECT l.workbook_id, l.sheet, l.row, CASE WHEN {BLANKLESS} THEN best.name ELSE label END AS shown FROM lines l LEFT JOIN best ON best.w = l.workbook_id AND best.k = {sql_key('l.sheet')} AND best.a = l.row""")
def named_lines(t: Tables) -> DataFrame:
    return portfolio.named_lines(live_lines(t).select("workbook_id", "sheet", "row", "label"), t.defined_names).drop("label")


@query(f"WITH {LIVE_LINES} SELECT workbook_id, sheet, row FROM lines WHERE regexp_matches(label, '(?i)check|error|integrity')")
def check_rows(t: Tables) -> DataFrame:
    return live_lines(t).filter(portfolio.is_check(F.col("label"))).select("workbook_id", "sheet", "row")


@query("SELECT DISTINCT workbook_id FROM sheets WHERE lower(workbook_id) LIKE '%wb000000%'")
def models_by_folder(t: Tables) -> DataFrame:
    """Models whose name holds a text, whatever its case."""
    return t.sheets.filter(F.lower("workbook_id").contains("WB000000".lower())).select("workbook_id").distinct()


@query(f"WITH {LIVE_LINES} SELECT workbook_id, sheet, section, min(row) AS first_row, count(*) AS n_lines FROM lines GROUP BY 1, 2, 3")
def section_list(t: Tables) -> DataFrame:
    return live_lines(t).groupBy("workbook_id", "sheet", "section").agg(F.min("row").alias("first_row"), F.count(F.lit(1)).alias("n_lines"))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, coalesce(sum(CAST(round(value * 1000) AS BIGINT)), 0)::BIGINT AS amount FROM events GROUP BY 1, 2")
def usage_by_day(t: Tables) -> DataFrame:
    return portfolio.usage(t.events.withColumn("v", F.round(F.col("value") * 1000).cast("long")), "ts", ["event_type"], "v")


@query("""SELECT p_brand AS brand, min(CASE WHEN n = need THEN p_size END) AS "column" FROM (SELECT p_brand, p_size, count(DISTINCT p_type) n FROM part GROUP BY 1, 2) JOIN (SELECT p_brand, count(DISTINCT p_type) need FROM part GROUP BY 1) USING (p_brand) GROUP BY 1""")
def single_column_block(t: Tables) -> DataFrame:
    """Brands as blocks, types as their parts, sizes as columns: the first size all types of a brand come in."""
    return portfolio.single_column(t.part, ["p_brand"], "p_type", "p_size").withColumnRenamed("p_brand", "brand")


@query(f"""WITH {TIE_ROWS}, s AS (SELECT DISTINCT "row" r, "row" // 10 nat FROM t), n AS (SELECT nat, count(*) k FROM s GROUP BY 1) SELECT nat, k AS n_lines, CASE WHEN k > 1 THEN 0 ELSE 1 END::BIGINT AS n_open, k > 1 AS covered FROM n""")
def line_coverage(t: Tables) -> DataFrame:
    """Rows of nations, some kept twice: a nation is covered if every row of it equals another up to sign, or does not move."""
    nm = nation_month(t).select("nat", "p", "v")
    rows = nm.select("nat", (F.col("nat") * 10).alias("row"), "p", "v").unionByName(nm.filter("nat % 2 = 0").select("nat", (F.col("nat") * 10 + 1).alias("row"), "p", (-F.col("v")).alias("v"))).unionByName(nm.filter("nat % 3 = 0").select("nat", (F.col("nat") * 10 + 2).alias("row"), "p", "v"))
    ties = identities.tied_rows(rows, [], "row", "p", "v").select("row", F.floor(F.col("row") / 10).cast("int").alias("nat"))
    static = identities.row_scale(rows, ["nat", "row"], "v").filter("is_static")
    return portfolio.coverage(rows, ties, static, ["nat"], ["nat", "row"])


@query("""WITH f AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'fails' WHEN 'O' THEN 'stale' ELSE 'unbound' END kind, CASE left(o_orderpriority, 1) WHEN '1' THEN 'high' WHEN '2' THEN 'medium' WHEN '3' THEN 'low' ELSE 'info' END severity FROM orders),
    g AS (SELECT o_custkey, kind, min(CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END) r FROM f GROUP BY 1, 2)
    SELECT o_custkey, kind, ['high', 'medium', 'low', 'info'][r] AS severity, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY r, kind) AS INTEGER) AS place FROM g""")
def findings_in_order(t: Tables) -> DataFrame:
    """Orders as findings of their customers."""
    kind = F.when(F.col("o_orderstatus") == "F", "fails").when(F.col("o_orderstatus") == "O", "stale").otherwise("unbound")
    head = F.substring("o_orderpriority", 1, 1)
    severity = F.when(head == "1", "high").when(head == "2", "medium").when(head == "3", "low").otherwise("info")
    return portfolio.ordered_findings(t.orders.select("o_custkey", kind.alias("kind"), severity.alias("severity")), ["o_custkey"])


@query(f"""WITH {LIVE_LINES}, s AS (SELECT workbook_id, sheet, min(sheet_pos) pos FROM sheets GROUP BY 1, 2)
    SELECT workbook_id, sheet, row, place FROM (SELECT l.workbook_id, l.sheet, l.row, CAST(row_number() OVER (PARTITION BY l.workbook_id ORDER BY s.pos NULLS FIRST, l.sheet, l.row) AS INTEGER) place FROM lines l LEFT JOIN s ON s.workbook_id = l.workbook_id AND s.sheet = l.sheet) WHERE place <= 1000""")
def lines_page(t: Tables) -> DataFrame:
    """A page of each model's lines in workbook order; a page of more than 1000 is asked for and held to that."""
    pos = t.sheets.groupBy("workbook_id", "sheet").agg(F.min("sheet_pos").alias("pos"))
    return portfolio.page(live_lines(t).select("workbook_id", "sheet", "row").join(pos, ["workbook_id", "sheet"], "left"), ["workbook_id"], [F.asc_nulls_first("pos"), F.col("sheet"), F.col("row")], 5000).drop("pos")


@query(f"""WITH {NATION_MONTH}, s AS (SELECT reg, p, CAST(sum(CAST(v AS DECIMAL(28,2))) AS DOUBLE) v FROM nm GROUP BY 1, 2), x AS (SELECT reg, p, abs(v - v * CASE WHEN year(p) = 1998 THEN 1.01 ELSE 1.0 END) r FROM s)
    SELECT reg, (SELECT y.p FROM x y WHERE y.reg = x.reg ORDER BY y.r DESC, y.p LIMIT 1) AS worst_period, min(CASE WHEN r > 1 THEN p END) AS first_failing FROM x GROUP BY 1""")
def residual_peaks(t: Tables) -> DataFrame:
    res = identities.residuals(_region_parts(t, F.when(F.year("p") == 1998, 1.01).otherwise(1.0)), ["reg"], "p", "coef", "v", 2)
    return portfolio.residual_peaks(res, ["reg"], "p", F.lit(1.0))


@query("SELECT workbook_id, latest, CAST(row_number() OVER (ORDER BY latest DESC NULLS LAST, workbook_id) AS INTEGER) AS place FROM (SELECT workbook_id, max(loaded_at) latest FROM sheets GROUP BY 1)")
def models_newest_first(t: Tables) -> DataFrame:
    return portfolio.newest_first(t.sheets, "workbook_id", "loaded_at")


@query("SELECT s, count(DISTINCT workbook_id) AS n_models FROM (SELECT workbook_id, lower(trim(sheet)) s FROM sheets UNION ALL SELECT workbook_id, lower(trim(name)) FROM defined_names) WHERE length(s) >= 4 GROUP BY 1")
def scanner_union(t: Tables) -> DataFrame:
    """The strings no report may show, of all models together, with how many models hold each."""
    own = t.sheets.select("workbook_id", F.lower(F.trim("sheet")).alias("s")).unionByName(t.defined_names.select("workbook_id", F.lower(F.trim("name")).alias("s")))
    return own.filter("length(s) >= 4").groupBy("s").agg(F.countDistinct("workbook_id").alias("n_models"))


@query(rf"""WITH v AS (SELECT DISTINCT trim(value, '{BLANKS}') v FROM cells WHERE value IS NOT NULL), k AS (SELECT v, CASE WHEN regexp_full_match(v, '[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?') THEN 'number' WHEN regexp_full_match(v, '[-+]?[0-9]*\.?[0-9]+ ?%') THEN 'percent'
    WHEN regexp_matches(v, '^[0-9]{{4}}-[0-9][0-9]-[0-9][0-9]') AND TRY_CAST(left(v, 10) AS DATE) IS NOT NULL THEN 'date' WHEN regexp_matches(v, '^[\p{{L}}_]') THEN 'name' END kind FROM v)
    SELECT kind, count(*) AS n, count(CASE WHEN kind = 'number' THEN TRY_CAST(v AS DOUBLE) WHEN kind = 'percent' THEN TRY_CAST(regexp_extract(v, '^([-+]?[0-9]*\.?[0-9]+) ?%$', 1) AS DOUBLE) END) AS n_numbers, min(CASE WHEN kind = 'date' THEN TRY_CAST(left(v, 10) AS DATE) END) AS first_day,
    max(CASE WHEN kind = 'percent' THEN TRY_CAST(regexp_extract(v, '^([-+]?[0-9]*\.?[0-9]+) ?%$', 1) AS DOUBLE) / 100 END) AS most_percent FROM k GROUP BY 1""")
def resolved_values(t: Tables) -> DataFrame:
    """What the distinct values of cells are, read as a reference is."""
    v = t.cells.filter("value is not null").select(trimmed(F.col("value")).alias("v")).distinct().select(portfolio.typed_value(F.col("v")).alias("x")).select("x.*")
    return v.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("number").alias("n_numbers"), F.min("day").alias("first_day"), F.max(F.when(F.col("kind") == "percent", F.col("number"))).alias("most_percent"))


SHEET_REF, OWN_REF = r"""("[^"]*"|(''[^'']*''|[\p{L}_][\p{L}\p{N}_.]*)![$A-Z0-9:]+)""", r"(^|[^A-Za-z0-9_.$])(\$?[A-Z]{1,3}\$?[0-9]+)"


@query(rf"""WITH {LIVE_CELLS}, f AS (SELECT workbook_id, sheet, row, regexp_replace(regexp_replace(formula, '{SHEET_REF}', ' ', 'g'), '[A-Za-z0-9_.]+\(', '(', 'g') t FROM live WHERE formula IS NOT NULL AND NOT regexp_matches(formula, '(?i)\b(INDIRECT|OFFSET)\(')),
    x AS (SELECT workbook_id, sheet, row, unnest(regexp_extract_all(replace(t, ':', ' : '), '{OWN_REF}', 2)) r FROM f)
    SELECT DISTINCT workbook_id, sheet, row, TRY_CAST(regexp_extract(r, '([0-9]+)$', 1) AS INTEGER) AS read_row FROM x WHERE TRY_CAST(regexp_extract(r, '([0-9]+)$', 1) AS INTEGER) IS NOT NULL""")
def rows_read(t: Tables) -> DataFrame:
    return portfolio.rows_read(live_cells(t, "formula").filter("formula is not null"))


@query(f"""WITH {G} SELECT grp, CAST(to_json(list({{src: src, dst: dst}} ORDER BY src, dst)) AS VARCHAR) AS graph FROM g GROUP BY 1""")
def graph_json(t: Tables) -> DataFrame:
    """The links between the sheets of each model as one JSON text."""
    return sheet_graph(t).groupBy("grp").agg(F.to_json(F.array_sort(F.collect_list(F.struct("src", "dst")))).alias("graph"))


AT = "1998-09-30"


@query(f"WITH {FLOWS} SELECT segment, coalesce(sum(CASE WHEN period_end = DATE '{AT}' THEN flow END), 0) AS amount FROM flows GROUP BY 1")
def flow_at_valuation(t: Tables) -> DataFrame:
    return portfolio.period_amount(flows(t), ["segment"], "period_end", "flow", F.lit(AT).cast("date"))


@query("""WITH r AS (SELECT n_regionkey reg, n_nationkey nat, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE -1 END s FROM nation), c AS (SELECT c_custkey cust, c_nationkey nat, CASE WHEN c_acctbal < 0 THEN -1 ELSE 1 END s FROM customer)
    SELECT CAST(reg AS VARCHAR) AS top, count(*) AS n_leaves, CAST(sum(coalesce(r.s * c.s, r.s)) AS BIGINT) AS net FROM r LEFT JOIN c USING (nat) GROUP BY 1""")
def subtotal_leaves(t: Tables) -> DataFrame:
    """Regions as totals of nations, nations as totals of customers, some subtracted: the leaves with their signs."""
    sign = lambda c: F.when(c, 1).otherwise(-1).alias("sign")
    k = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    g = F.lit("g").alias("grp")
    links = t.nation.select(g, k("r", "n_regionkey").alias("node"), k("n", "n_nationkey").alias("child"), sign(F.col("n_nationkey") % 2 == 0))
    links = links.unionByName(t.customer.select(g, k("n", "c_nationkey").alias("node"), k("c", "c_custkey").alias("child"), sign(F.col("c_acctbal") >= 0)))
    leaves = portfolio.leaf_terms(links, t.nation.select(g, k("r", "n_regionkey").alias("top")).distinct())
    return leaves.groupBy(F.substring("top", 2, 9).alias("top")).agg(F.count(F.lit(1)).alias("n_leaves"), F.sum("coef").alias("net"))


@query(f"""WITH {E1}, {LIVE_LINES} SELECT e.edge_id, e.src_row, e.dst_row, e.kind, a.label AS src_label, b.label AS dst_label FROM e LEFT JOIN lines a ON a.workbook_id = e.workbook_id AND a.sheet = e.src_sheet AND a.row = e.src_row LEFT JOIN lines b ON b.workbook_id = e.workbook_id AND b.sheet = e.dst_sheet AND b.row = e.dst_row""")
def edge_labels(t: Tables) -> DataFrame:
    return portfolio.labelled_edges(edges_once(t), live_lines(t)).select("edge_id", "src_row", "dst_row", "kind", "src_label", "dst_label")


@query(f"""WITH {E1}, {LIVE_LINES}, a AS (SELECT workbook_id, src_sheet sheet, src_row "row", count(*) n FROM e GROUP BY 1, 2, 3), b AS (SELECT workbook_id, dst_sheet sheet, dst_row "row", count(*) n FROM e GROUP BY 1, 2, 3)
    SELECT l.workbook_id, l.sheet, l.row, coalesce(a.n, 0) AS n_reads, coalesce(b.n, 0) AS n_read_by FROM lines l LEFT JOIN a ON a.workbook_id = l.workbook_id AND a.sheet = l.sheet AND a.row = l.row LEFT JOIN b ON b.workbook_id = l.workbook_id AND b.sheet = l.sheet AND b.row = l.row""")
def row_readers(t: Tables) -> DataFrame:
    return portfolio.reader_counts(live_lines(t).select("workbook_id", "sheet", "row"), edges_once(t))


@query(f"""WITH {LIVE_CELLS}, v AS (SELECT workbook_id, sheet, row, col, value_num v FROM live WHERE value_kind = 'num' AND value_num IS NOT NULL), m AS (SELECT *, max(col) OVER (PARTITION BY workbook_id, sheet, row) mc FROM v),
    p AS (SELECT workbook_id, sheet, row, max(mc) c, sum(CASE WHEN col = mc THEN v END) l, sum(v) s, count(*) n FROM m GROUP BY 1, 2, 3 HAVING count(*) > 2), q AS (SELECT workbook_id, sheet, c, count(*) n, count(*) FILTER (abs(s - l - l) <= 1e-6 * greatest(abs(l), 1.0)) f FROM p GROUP BY 1, 2, 3),
    b AS (SELECT workbook_id, sheet, max(c) c FROM q WHERE n >= 3 AND 2 * f > n GROUP BY 1, 2), h AS (SELECT workbook_id, sheet, min(col) c FROM live WHERE value_kind = 'text' AND contains(lower(value), 'total') AND row <= 8 AND col > 2 GROUP BY 1, 2), k AS (SELECT DISTINCT workbook_id, sheet FROM v)
    SELECT k.workbook_id, k.sheet, coalesce(h.c, b.c) AS total_col, CASE WHEN h.c IS NOT NULL THEN 'heading' ELSE 'sum' END AS how FROM k LEFT JOIN h USING (workbook_id, sheet) LEFT JOIN b USING (workbook_id, sheet) WHERE coalesce(h.c, b.c) IS NOT NULL""")
def total_columns(t: Tables) -> DataFrame:
    c = live_cells(t, "value", "value_kind", "value_num")
    values = c.filter("value_kind = 'num' and value_num is not null")
    headers = c.filter("value_kind = 'text' and `row` <= 8 and col > 2").withColumnRenamed("value", "text")
    return portfolio.total_columns(values, headers, ["workbook_id", "sheet"], "row", "col", "value_num")


@query(f"""WITH {G}, n AS (SELECT w grp, name node FROM sn UNION SELECT grp, unnest([src, dst]) FROM g), t AS (SELECT DISTINCT grp, unnest([src, dst]) node FROM g), l AS (SELECT grp, count(*) m FROM g GROUP BY 1)
    SELECT n.grp, count(*) AS n_nodes, count(*) FILTER (t.node IS NULL) AS n_isolated, coalesce(max(l.m), 0) AS n_links, CASE WHEN count(*) > 1 THEN round(coalesce(max(l.m), 0) / (count(*) * (count(*) - 1)), 6) ELSE 0.0 END AS density FROM n LEFT JOIN t ON t.grp = n.grp AND t.node = n.node LEFT JOIN l ON l.grp = n.grp GROUP BY 1""")
def sheet_density(t: Tables) -> DataFrame:
    w = t.sheets.filter("workbook_id is not null and sheet is not null").select("workbook_id", "sheet", sheet_key(F.col("sheet")).alias("k"), "loaded_at")
    nodes = w.groupBy("workbook_id", "k").agg(F.max_by("sheet", F.struct("loaded_at", "sheet")).alias("node")).select(F.col("workbook_id").alias("grp"), "node")
    return portfolio.graph_figures(nodes, sheet_graph(t))


@query(f"WITH {LIVE_LINES} SELECT workbook_id, sheet, count(*) AS n_rows, count(*) FILTER (n_const > 0 AND n_const >= 3 * n_formula) AS n_typed, CASE WHEN 2 * count(*) FILTER (n_const > 0 AND n_const >= 3 * n_formula) > count(*) THEN 'assumption' ELSE 'calculation' END AS class FROM lines GROUP BY 1, 2")
def collapsed_sheets(t: Tables) -> DataFrame:
    return portfolio.typed_majority(live_lines(t), ["workbook_id", "sheet"])


@query(f"""WITH RECURSIVE {G}, w AS (SELECT DISTINCT grp, src node FROM g WHERE {sql_key('src')} = 'inputs' UNION SELECT g.grp, g.dst FROM w JOIN g ON g.grp = w.grp AND g.src = w.node), n AS (SELECT DISTINCT grp, unnest([src, dst]) node FROM g) SELECT grp, node FROM n ANTI JOIN w USING (grp, node)""")
def out_of_reach(t: Tables) -> DataFrame:
    """Sheets that no way from the inputs leads to."""
    g = sheet_graph(t)
    return portfolio.beyond(g.filter(sheet_key(F.col("src")) == "inputs").select("grp", F.col("src").alias("node")), g, g.select("grp", F.explode(F.array("src", "dst")).alias("node")))





# ---------------------------------------------------------------- scalar functions

SCC = f"""{G}, r_ AS (SELECT grp, src a, dst b FROM g UNION SELECT r_.grp, r_.a, g.dst FROM r_ JOIN g ON g.grp = r_.grp AND g.src = r_.b), n_ AS (SELECT DISTINCT grp, unnest([src, dst]) node FROM g),
    scc AS (SELECT n_.grp, n_.node, least(n_.node, coalesce(min(x.b), n_.node)) c FROM n_ LEFT JOIN r_ x ON x.grp = n_.grp AND x.a = n_.node AND EXISTS (SELECT 1 FROM r_ y WHERE y.grp = x.grp AND y.a = x.b AND y.b = x.a) GROUP BY 1, 2),
    h AS (SELECT DISTINCT g.grp, p.c a, q.c b FROM g JOIN scc p ON p.grp = g.grp AND p.node = g.src JOIN scc q ON q.grp = g.grp AND q.node = g.dst WHERE p.c <> q.c),
    d AS (SELECT DISTINCT grp, c, 0 k FROM scc UNION SELECT d.grp, h.b, d.k + 1 FROM d JOIN h ON h.grp = d.grp AND h.a = d.c)"""


@query(f"WITH RECURSIVE {SCC} SELECT scc.grp, scc.node, CAST(max(d.k) AS INTEGER) AS layer FROM scc JOIN d ON d.grp = scc.grp AND d.c = scc.c GROUP BY 1, 2")
def sheet_layers(t: Tables) -> DataFrame:
    """Longest-path layers of sheets, circular groups being one node."""
    return graphs.layers(sheet_graph(t))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN lower(trim(p_brand)) = lower(trim(p_brand)) WHEN p_partkey % 3 = 1 THEN abs(p_size - p_size) < 1e-9 ELSE lower(trim(CAST(p_size AS VARCHAR))) = lower(trim(p_brand)) END AS same FROM part""")
def same_loosely(t: Tables) -> DataFrame:
    """Brands in other letters, sizes as text and as number, a size against a brand."""
    k = F.col("p_partkey") % 3
    a = F.when(k == 0, F.concat(F.lit("  "), F.upper("p_brand"))).otherwise(F.col("p_size").cast("string"))
    b = F.when(k == 1, F.col("p_size").cast("double").cast("string")).otherwise(F.col("p_brand"))
    return t.part.select("p_partkey", relational.loosely_equal(a, b).alias("same"))


@query("""SELECT DISTINCT sheet, array_to_string(regexp_extract_all(regexp_replace(sheet, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), '|') AS parts FROM sheets WHERE sheet IS NOT NULL""")
def sheet_name_parts(t: Tables) -> DataFrame:
    return t.sheets.filter("sheet is not null").select("sheet", F.array_join(text.name_tokens(F.col("sheet")), "|").alias("parts")).distinct()


@query("SELECT DISTINCT workbook_id, 'M' || left(sha256(workbook_id), 8) AS token FROM sheets WHERE workbook_id IS NOT NULL")
def model_tokens(t: Tables) -> DataFrame:
    return t.sheets.filter("workbook_id is not null").select("workbook_id", text.model_token(F.col("workbook_id")).alias("token")).distinct()


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, 'FY' || year(o_orderdate) AS annual, strftime(o_orderdate, '%b-%y') AS monthly FROM orders")
def period_labels(t: Tables) -> DataFrame:
    d = t.orders.select(F.to_date("o_orderdate").alias("d")).distinct()
    return d.select("d", text.period_label(F.col("d"), F.lit("annual")).alias("annual"), text.period_label(F.col("d"), F.lit("monthly")).alias("monthly"))


@query(r"""WITH x AS (SELECT DISTINCT '/in/' || coalesce(sheet, '') || '?<' || workbook_id || '>. ' path, coalesce(sheet, '') || '?<' || workbook_id || '>. ' base FROM sheets WHERE workbook_id IS NOT NULL), y AS (SELECT path, regexp_extract(path, '([^/\\]*)$', 1) b FROM x)
    SELECT path, left(regexp_replace(regexp_replace(b, '[<>:"/\\|?*]', '_', 'g'), '^[. ]+|[. ]+$', '', 'g'), 120) AS name FROM y""")
def safe_names(t: Tables) -> DataFrame:
    """File names made of sheet names with marks no file system takes."""
    path = F.concat(F.lit("/in/"), F.coalesce("sheet", F.lit("")), F.lit("?<"), F.col("workbook_id"), F.lit(">. "))
    return t.sheets.filter("workbook_id is not null").select(path.alias("path")).distinct().select("path", ingest.safe_name(F.col("path")).alias("name"))


@query(f"""WITH {LAYOUT}, c AS (SELECT k.workbook_id, k.sheet, k.row, k.col, k.kind, row_number() OVER (PARTITION BY k.workbook_id, k.sheet, k.row ORDER BY k.col) n FROM kinds k JOIN layout l ON l.workbook_id = k.workbook_id AND l.sheet = k.sheet WHERE k.value IS NOT NULL AND k.col > coalesce(l.label_col, 0))
    SELECT workbook_id, sheet, row FROM c WHERE n <= 4 GROUP BY 1, 2, 3 HAVING bool_and(kind = 'date')""")
def rows_of_dates(t: Tables) -> DataFrame:
    """Rows whose first four values right of the label are all dates."""
    c = typed_cells(t)
    return review.date_valued(c, materialise(rowmap.detect_layout(c))).select("workbook_id", "sheet", "row")
