"""The reference operators as queries over the stored tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.finance import as_rate, decade, fiscal_year, serial_day, yearfrac
from gridloom.functions.ontology import ROLES, named_roles
from gridloom.operators import cashflow, diagnostics, graphs, identities, relational, review, rowmap, threeway, timeline
from gridloom.tables import materialise, read, sheet_key

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Stored tables by name."""

    def __init__(self, spark: SparkSession, d: str) -> None:
        self.spark, self.d = spark, d

    def __getattr__(self, name: str) -> DataFrame:
        return read(self.spark, self.d, name)


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with its SQL."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, d: f(Tables(spark, d))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def money(c: str) -> Column:
    """Exact cents, so sums do not depend on their order."""
    return F.col(c).cast("decimal(18,2)")


def r(c: Column, k: int = 4) -> Column:
    return F.round(c.cast("double"), k)


# ---------------------------------------------------------------- cells, line items, census

LIVE_CELLS = """live AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY workbook_id, sheet, row, col ORDER BY loaded_at DESC) rn FROM cells) WHERE rn = 1)"""


def live_cells(t: Tables, *cols: str) -> DataFrame:
    """The newest copy of every cell, with only the columns asked for."""
    keys = ["workbook_id", "sheet", "row", "col"]
    w = Window.partitionBy(*keys).orderBy(F.desc("loaded_at"))
    return t.cells.select(*keys, *cols, "loaded_at").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "loaded_at")


LINE_ORDER = ["loaded_at", "deleted_at", "label", "section", "units", "n_formula", "n_const"]
LIVE_LINES = f"""lines AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY workbook_id, sheet, row ORDER BY {", ".join(f"{c} DESC NULLS LAST" for c in LINE_ORDER)}) rn FROM line_items) WHERE rn = 1 AND deleted_at IS NULL)"""


def live_lines(t: Tables) -> DataFrame:
    """The newest copy of every line that is not deleted; of equally new ones a deletion holds, then the greater texts."""
    w = Window.partitionBy("workbook_id", "sheet", "row").orderBy(*[F.desc_nulls_last(c) for c in LINE_ORDER])
    return t.line_items.withColumn("_n", F.row_number().over(w)).filter("_n = 1 and deleted_at is null").drop("_n")


TYPED_COLUMNS = ["addr", "formula", "value", "value_kind", "value_num", "value_text", "value_date"]


def typed_cells(t: Tables) -> DataFrame:
    """Newest copies with the type a value shows where the loader gave none, once computed: the layout reads them several times."""
    return materialise(typed(live_cells(t, *TYPED_COLUMNS)))


def typed(c: DataFrame) -> DataFrame:
    """Cells with the type their value shows where the loader gave none."""
    guess = F.when(F.col("value_kind").isNotNull(), F.col("value_kind")).when(F.col("value").startswith("#"), "error").when(F.col("value").try_cast("double").isNotNull(), "num").when(F.col("value").rlike(r"^\d{4}-\d\d-\d\d$"), "date").otherwise("text")
    c = c.withColumn("value_kind", guess).withColumn("value_num", F.coalesce("value_num", F.when(F.col("value_kind") == "num", F.col("value").try_cast("double"))))
    return c.withColumn("value_date", F.coalesce("value_date", F.when(F.col("value_kind") == "date", F.to_date(F.substring("value", 1, 10)))))


#: Typed cells and the layout of every sheet, said again in SQL.
LAYOUT = f"""{LIVE_CELLS}, kinds AS (SELECT workbook_id, sheet, row, col, formula, value, value_num, value_date, coalesce(value_kind, CASE WHEN starts_with(value, '#') THEN 'error' WHEN TRY_CAST(value AS DOUBLE) IS NOT NULL THEN 'num' WHEN regexp_full_match(value, '[0-9]{{4}}-[0-9][0-9]-[0-9][0-9]') THEN 'date' ELSE 'text' END) kind FROM live),
    dated AS (SELECT workbook_id, sheet, row, col, coalesce(value_date, TRY_CAST(left(value, 10) AS DATE)) d FROM kinds WHERE kind = 'date'),
    header AS (SELECT workbook_id, sheet, row FROM (SELECT workbook_id, sheet, row, row_number() OVER (PARTITION BY workbook_id, sheet ORDER BY count(*) DESC, row) k FROM dated GROUP BY 1, 2, 3 HAVING count(*) >= 4) WHERE k = 1),
    head AS (SELECT d.*, d.col - row_number() OVER (PARTITION BY d.workbook_id, d.sheet ORDER BY d.col) i FROM dated d JOIN header USING (workbook_id, sheet, row)),
    spans AS (SELECT workbook_id, sheet, row, i, count(*) periods, min(col) tl_first, max(col) tl_last, min(d) period_start, max(d) period_end FROM head GROUP BY 1, 2, 3, 4 HAVING count(*) >= 4),
    line AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY workbook_id, sheet ORDER BY periods DESC, tl_first) k FROM spans) WHERE k = 1),
    gaps AS (SELECT workbook_id, sheet, median(g) gap FROM (SELECT h.workbook_id, h.sheet, date_diff('day', lag(d) OVER (PARTITION BY h.workbook_id, h.sheet ORDER BY h.col), d) g FROM head h JOIN line l ON l.workbook_id = h.workbook_id AND l.sheet = h.sheet AND l.i = h.i) WHERE g IS NOT NULL GROUP BY 1, 2),
    used AS (SELECT workbook_id, sheet, min(col) first_used FROM kinds WHERE value IS NOT NULL OR formula IS NOT NULL GROUP BY 1, 2),
    texts AS (SELECT workbook_id, sheet, col, count(*) n, avg(length(trim(value))) len, count(DISTINCT trim(value)) kinds FROM kinds WHERE kind IN ('text', 'error') AND trim(value) <> '' GROUP BY 1, 2, 3),
    cand AS (SELECT x.* FROM texts x JOIN used u ON u.workbook_id = x.workbook_id AND u.sheet = x.sheet LEFT JOIN line l ON l.workbook_id = x.workbook_id AND l.sheet = x.sheet WHERE x.col <= coalesce(l.tl_first - 1, u.first_used + 7)),
    label AS (SELECT workbook_id, sheet, col label_col, n n_labels FROM (SELECT *, row_number() OVER (PARTITION BY workbook_id, sheet ORDER BY n * least(len, 20.0) DESC, col) k FROM cand) WHERE k = 1),
    unit AS (SELECT workbook_id, sheet, col units_col FROM (SELECT c.*, row_number() OVER (PARTITION BY c.workbook_id, c.sheet ORDER BY c.n DESC, c.col) k FROM cand c JOIN label b ON b.workbook_id = c.workbook_id AND b.sheet = c.sheet WHERE c.col > b.label_col AND c.n >= 0.2 * b.n_labels AND c.len <= 12 AND c.kinds <= 0.6 * c.n) WHERE k = 1),
    layout AS (SELECT u.workbook_id, u.sheet, l.row header_row, l.periods, l.tl_first, l.tl_last, l.period_start, l.period_end, CASE WHEN gap IS NULL THEN NULL WHEN abs(gap - 1) <= 1 THEN 'daily' WHEN abs(gap - 7) <= 1 THEN 'weekly' WHEN abs(gap - 30) <= 3 THEN 'monthly' WHEN abs(gap - 91) <= 9.1 THEN 'quarterly'
        WHEN abs(gap - 182) <= 18.2 THEN 'half-yearly' WHEN abs(gap - 365) <= 36.5 THEN 'annual' ELSE '~' || CAST(CAST(gap AS BIGINT) AS VARCHAR) || '-day' END periodicity, b.label_col, x.units_col
        FROM used u LEFT JOIN line l ON l.workbook_id = u.workbook_id AND l.sheet = u.sheet LEFT JOIN gaps g ON g.workbook_id = u.workbook_id AND g.sheet = u.sheet LEFT JOIN label b ON b.workbook_id = u.workbook_id AND b.sheet = u.sheet LEFT JOIN unit x ON x.workbook_id = u.workbook_id AND x.sheet = u.sheet)"""


@query("""SELECT c_nationkey AS nation, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS col, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def cells_from_orders(t: Tables) -> DataFrame:
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_nationkey").alias("nation"), (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).cast("long").alias("col")).agg(F.sum(money("o_totalprice")).cast("double").alias("value"))


@query(f"""WITH {LAYOUT}, d AS (SELECT k.*, coalesce(k.col < l.label_col OR k.col = l.label_col AND k.kind <> 'num', false) in_label, coalesce(k.col = l.units_col AND k.kind <> 'num', false) in_units FROM kinds k LEFT JOIN layout l ON l.workbook_id = k.workbook_id AND l.sheet = k.sheet)
    SELECT workbook_id, sheet, row, CAST(count(*) FILTER (formula IS NOT NULL) AS INTEGER) AS n_formula, CAST(count(*) FILTER (formula IS NULL) AS INTEGER) AS n_const FROM d WHERE NOT in_label AND NOT in_units GROUP BY 1, 2, 3""")
def line_item_map(t: Tables) -> DataFrame:
    """Lines of every sheet with their formulas and constants right of labels and units."""
    c = typed_cells(t)
    return rowmap.line_items(c, materialise(rowmap.detect_layout(c))).select("workbook_id", "sheet", "row", "n_formula", "n_const")


@query(f"WITH {LAYOUT} SELECT workbook_id, sheet, header_row, tl_first, tl_last, periods, period_start, period_end, periodicity, label_col, units_col FROM layout")
def layout_detect(t: Tables) -> DataFrame:
    return rowmap.detect_layout(typed_cells(t))


@query(f"""WITH {LIVE_CELLS} SELECT sheet, count(*) AS n_cells, count(*) FILTER (formula IS NOT NULL) AS n_formula, count(*) FILTER (value_kind = 'date') AS n_date, count(*) FILTER (value_kind = 'num') AS n_num,
    count(*) FILTER (value_kind = 'text') AS n_text, count(*) FILTER (value_kind = 'error') AS n_error, max(row) AS max_row, max(col) AS max_col FROM live GROUP BY 1""")
def census_by_sheet(t: Tables) -> DataFrame:
    """What the live cells of each sheet name hold."""
    k = {k: F.count_if(F.coalesce(F.col("value_kind") == k, F.lit(False))).alias(f"n_{k}") for k in ("date", "num", "text", "error")}
    return live_cells(t, "formula", "value_kind").groupBy("sheet").agg(F.count(F.lit(1)).alias("n_cells"), F.count("formula").alias("n_formula"), *k.values(), F.max("row").alias("max_row"), F.max("col").alias("max_col"))


@query("""WITH m AS (SELECT DISTINCT c_mktsegment s, CAST(o_orderdate AS DATE) d FROM orders JOIN customer ON o_custkey = c_custkey),
    g AS (SELECT s, date_diff('day', d, lead(d) OVER (PARTITION BY s ORDER BY d)) gap FROM m), q AS (SELECT s, median(gap) gap FROM g GROUP BY 1)
    SELECT s AS segment, gap, CASE WHEN gap IS NULL THEN '?' WHEN abs(gap - 1) <= 1 THEN 'daily' WHEN abs(gap - 7) <= 1 THEN 'weekly' WHEN abs(gap - 30) <= 3 THEN 'monthly' WHEN abs(gap - 91) <= 9.1 THEN 'quarterly'
    WHEN abs(gap - 182) <= 18.2 THEN 'half-yearly' WHEN abs(gap - 365) <= 36.5 THEN 'annual' ELSE '~' || CAST(CAST(gap AS BIGINT) AS VARCHAR) || '-day' END AS name FROM q""")
def periodicity(t: Tables) -> DataFrame:
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("segment"), F.to_date("o_orderdate").alias("d"))
    return timeline.typical_gap(o, ["segment"], "d").withColumn("name", timeline.periodicity(F.col("gap")))


@query("""WITH d AS (SELECT DISTINCT user_id u, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) d FROM events), i AS (SELECT u, d, d - row_number() OVER (PARTITION BY u ORDER BY d) g FROM d),
    x AS (SELECT u, min(d) a, max(d) b, count(*) n FROM i GROUP BY u, g)
    SELECT u AS user_id, a AS run_start, b AS run_end, n FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY n DESC, a) k FROM x) WHERE k = 1""")
def timeline_runs(t: Tables) -> DataFrame:
    return timeline.longest_run(t.events, ["user_id"], F.unix_date(F.to_date("ts")))


@query(f"WITH {LAYOUT} SELECT workbook_id, sheet, header_row, tl_first AS first_col, periods AS n_dates FROM layout WHERE header_row IS NOT NULL")
def layout_header_row(t: Tables) -> DataFrame:
    return rowmap.detect_layout(typed_cells(t)).filter("header_row is not null").select("workbook_id", "sheet", "header_row", F.col("tl_first").alias("first_col"), F.col("periods").alias("n_dates"))


@query("""WITH one AS (SELECT workbook_id, sheet, row, max(section) section FROM line_items GROUP BY 1, 2, 3)
    SELECT workbook_id, sheet, row, last_value(section IGNORE NULLS) OVER (PARTITION BY workbook_id, sheet ORDER BY row ROWS UNBOUNDED PRECEDING) AS section FROM one""")
def section_fill(t: Tables) -> DataFrame:
    one = t.line_items.groupBy("workbook_id", "sheet", "row").agg(F.max("section").alias("s"))
    return timeline.fill_down(one, ["workbook_id", "sheet"], ["row"], F.col("s"), "section").drop("s")


@query("""WITH x AS (SELECT 'p_name' AS column_name, p_name v FROM part UNION ALL SELECT 'p_brand', p_brand FROM part UNION ALL SELECT 'p_type', p_type FROM part)
    SELECT column_name, count(*) AS n, round(avg(length(v)), 6) AS avg_len, round(count(*) * least(avg(length(v)), 20.0), 4) AS score, round(count(DISTINCT v) / count(*), 6) AS distinct_ratio FROM x WHERE v IS NOT NULL AND v <> '' GROUP BY 1""")
def label_column_score(t: Tables) -> DataFrame:
    s = timeline.column_scores(t.part, ["p_name", "p_brand", "p_type"])
    return s.select("column_name", "n", r(F.col("avg_len"), 6).alias("avg_len"), r(F.col("score")).alias("score"), r(F.col("distinct_ratio"), 6).alias("distinct_ratio"))


@query("""SELECT c_nationkey AS nation, o_orderkey, rank FROM (SELECT c_nationkey, o_orderkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) rank FROM orders JOIN customer ON o_custkey = c_custkey) WHERE rank <= 3""")
def sample_topk(t: Tables) -> DataFrame:
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("nation"), "o_orderkey", "o_totalprice")
    return timeline.top_k(o, ["nation"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).drop("o_totalprice")


# ---------------------------------------------------------------- edges

def sql_key(c: str) -> str:
    """The compared form of a sheet name, as :func:`sheet_key` makes it."""
    plain = f"trim({c})"
    return f"lower(trim(CASE WHEN {plain} LIKE chr(39) || '%' || chr(39) AND length({plain}) > 1 THEN replace({plain}[2:-2], repeat(chr(39), 2), chr(39)) ELSE {plain} END))"


#: Edges with every sheet written as in sheets (newest delivery), else by its key.
E_ALL = f"""sn AS (SELECT w, k, name FROM (SELECT workbook_id w, {sql_key('sheet')} k, sheet AS name, row_number() OVER (PARTITION BY workbook_id, {sql_key('sheet')} ORDER BY loaded_at DESC NULLS LAST, sheet DESC) n FROM sheets WHERE workbook_id IS NOT NULL AND sheet IS NOT NULL) WHERE n = 1),
    e0 AS (SELECT DISTINCT x.edge_id, x.workbook_id, coalesce(a.name, {sql_key('x.src_sheet')}) src_sheet, x.src_row, coalesce(b.name, {sql_key('x.dst_sheet')}) dst_sheet, x.dst_row, lower(trim(x.kind)) AS kind
        FROM edges x LEFT JOIN sn a ON a.w = x.workbook_id AND a.k = {sql_key('x.src_sheet')} LEFT JOIN sn b ON b.w = x.workbook_id AND b.k = {sql_key('x.dst_sheet')})"""
E1 = f"{E_ALL}, e AS (SELECT * FROM e0)"


def one_spelling(t: Tables, e: DataFrame) -> DataFrame:
    """Edges with every sheet written as in ``sheets`` (newest delivery), else by its key: names agree whatever their case, outer blanks and quotes."""
    named = t.sheets.select("workbook_id", "sheet", sheet_key(F.col("sheet")).alias("k"), "loaded_at").filter("workbook_id is not null and sheet is not null")
    names = named.groupBy("workbook_id", "k").agg(F.max_by("sheet", F.struct("loaded_at", "sheet")).alias("name"))
    for c in ("src_sheet", "dst_sheet"):
        e = e.withColumn("k", sheet_key(F.col(c))).join(names, ["workbook_id", "k"], "left").withColumn(c, F.coalesce("name", "k")).drop("k", "name")
    return e


def edges_once(t: Tables) -> DataFrame:
    e = t.edges.select("edge_id", "workbook_id", "src_sheet", "src_row", "dst_sheet", "dst_row", F.lower(F.trim("kind")).alias("kind")).distinct()
    return one_spelling(t, e).distinct()


def _most(t: Tables, node: str, other: str) -> DataFrame:
    e = edges_once(t).filter(F.col("kind").isin("direct", "offset", "active"))
    return relational.connections(e, ["workbook_id", f"{node}_sheet", f"{node}_row"], f"{other}_sheet", 15)


@query(f"""WITH {E1} SELECT workbook_id, dst_sheet, dst_row, count(*) AS n_edges, count(DISTINCT src_sheet) AS n_others FROM e WHERE kind IN ('direct', 'offset', 'active') GROUP BY 1, 2, 3 ORDER BY n_edges DESC, 1, 2, 3 LIMIT 15""")
def most_read(t: Tables) -> DataFrame:
    return _most(t, "dst", "src")


@query(f"""WITH {E1} SELECT workbook_id, src_sheet, src_row, count(*) AS n_edges, count(DISTINCT dst_sheet) AS n_others FROM e WHERE kind IN ('direct', 'offset', 'active') GROUP BY 1, 2, 3 ORDER BY n_edges DESC, 1, 2, 3 LIMIT 15""")
def most_reading(t: Tables) -> DataFrame:
    return _most(t, "src", "dst")


@query(f"""WITH {E1} SELECT workbook_id, src_sheet, dst_sheet, count(*) FILTER (kind IN ('direct', 'offset', 'active')) AS n_live, count(*) FILTER (kind IS NULL OR kind NOT IN ('direct', 'offset', 'active')) AS n_other FROM e WHERE src_sheet <> dst_sheet GROUP BY 1, 2, 3""")
def sheet_flows(t: Tables) -> DataFrame:
    live = F.coalesce(F.col("kind").isin("direct", "offset", "active"), F.lit(False))
    return edges_once(t).filter("src_sheet <> dst_sheet").groupBy("workbook_id", "src_sheet", "dst_sheet").agg(F.count_if(live).alias("n_live"), F.count_if(~live).alias("n_other"))


@query(f"""WITH {E1} SELECT kind, count(*) AS n FROM e GROUP BY 1""")
def edge_kinds(t: Tables) -> DataFrame:
    return edges_once(t).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {E1}, k AS (SELECT *, CASE kind WHEN 'direct' THEN 3 WHEN 'offset' THEN 3 WHEN 'active' THEN 2 WHEN 'inactive' THEN 1 ELSE 0 END w FROM e WHERE kind IS NOT NULL)
    SELECT workbook_id, src_sheet, src_row, dst_sheet, kind FROM (SELECT *, row_number() OVER (PARTITION BY workbook_id, src_sheet, src_row, dst_sheet ORDER BY w DESC, edge_id) n FROM k) WHERE n = 1""")
def edge_strength(t: Tables) -> DataFrame:
    return relational.strongest_kind(edges_once(t).filter("kind is not null"), ["workbook_id", "src_sheet", "src_row", "dst_sheet"], F.col("kind"), F.col("edge_id"))


@query("""WITH p AS (SELECT o_orderkey k, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice * 2 END v FROM orders WHERE o_orderstatus = 'F')
    SELECT o_orderkey, CASE WHEN p.k IS NULL THEN o_totalprice ELSE p.v END AS o_totalprice FROM orders LEFT JOIN p ON p.k = o_orderkey""")
def what_if_patch(t: Tables) -> DataFrame:
    patch = t.orders.filter("o_orderstatus = 'F'").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, None).otherwise(F.col("o_totalprice") * 2).alias("o_totalprice"))
    return relational.overlay(t.orders.select("o_orderkey", "o_totalprice"), patch, ["o_orderkey"], "o_totalprice")


@query(r"""SELECT DISTINCT workbook_id, sheet, row FROM line_items WHERE lower(label) LIKE '%loan\_%' ESCAPE '\' OR lower(section) LIKE '%loan\_%' ESCAPE '\'""")
def label_search(t: Tables) -> DataFrame:
    like = relational.like_text("loan_")
    return t.line_items.filter(F.lower("label").like(like) | F.lower("section").like(like)).select("workbook_id", "sheet", "row").distinct()


@query("""SELECT 'qty' AS what, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n FROM lineitem WHERE l_quantity >= 25
    UNION ALL SELECT 'brand', CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE), count(*) FROM part WHERE lower(trim(p_brand)) LIKE 'brand#_2'
    UNION ALL SELECT 'type', CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE), count(*) FROM part WHERE NOT lower(trim(p_type)) LIKE '%brass%'""")
def criterion_match(t: Tables) -> DataFrame:
    def total(df: DataFrame, name: str, hit: Column, v: str) -> DataFrame:
        return df.filter(hit).agg(F.lit(name).alias("what"), F.sum(money(v)).cast("double").alias("total"), F.count(F.lit(1)).alias("n"))

    out = total(t.lineitem, "qty", relational.criterion(F.col("l_quantity"), ">=25"), "l_extendedprice")
    out = out.unionByName(total(t.part, "brand", relational.criterion(F.col("p_brand"), "brand#?2"), "p_retailprice"))
    return out.unionByName(total(t.part, "type", relational.criterion(F.col("p_type"), "<>*brass*"), "p_retailprice"))


@query("""WITH x AS (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) p FROM orders)
    SELECT o_custkey, o_orderkey, CAST(p AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY p) n FROM x WHERE o_orderpriority = '1-URGENT') WHERE n = 1""")
def index_match(t: Tables) -> DataFrame:
    hit = F.col("o_orderpriority") == "1-URGENT"
    return relational.first_match(t.orders, ["o_custkey"], hit, ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "position")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN o_orderstatus WHEN 2 THEN o_orderpriority WHEN 3 THEN CAST(o_custkey AS VARCHAR) END AS chosen FROM orders""")
def choose_branch(t: Tables) -> DataFrame:
    args = [F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_custkey").cast("string")]
    return t.orders.select("o_orderkey", relational.choose(F.col("o_orderkey") % 4, *args).alias("chosen"))


MONTH = "o_orderdate >= '1997-03-01' and o_orderdate < '1997-04-01'"


@query(f"SELECT c_custkey FROM customer SEMI JOIN (SELECT o_custkey FROM orders WHERE {MONTH}) ON o_custkey = c_custkey")
def pick_list_semi(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.filter(MONTH), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query(f"SELECT c_custkey FROM customer ANTI JOIN (SELECT o_custkey FROM orders WHERE {MONTH}) ON o_custkey = c_custkey")
def unregistered_anti(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.filter(MONTH), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("""SELECT 'customer' AS kind, c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal FROM supplier
    UNION ALL SELECT 'nation', CAST(n_nationkey AS BIGINT), n_name, NULL FROM nation""")
def portfolio_union(t: Tables) -> DataFrame:
    c = t.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    s = t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    n = t.nation.select(F.lit("nation").alias("kind"), F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    return c.unionByName(s).unionByName(n, allowMissingColumns=True)


# ---------------------------------------------------------------- graphs over sheets

G = f"""{E_ALL}, g AS (SELECT DISTINCT workbook_id grp, src_sheet src, dst_sheet dst FROM e0 WHERE src_sheet <> dst_sheet AND coalesce(kind, '') <> 'inactive')"""


def sheet_graph(t: Tables) -> DataFrame:
    live = F.coalesce(F.lower(F.trim("kind")), F.lit("")) != "inactive"
    pairs = one_spelling(t, t.edges.filter(live).select("workbook_id", "src_sheet", "dst_sheet").distinct())
    return pairs.filter("src_sheet <> dst_sheet").select(F.col("workbook_id").alias("grp"), F.col("src_sheet").alias("src"), F.col("dst_sheet").alias("dst")).distinct()


def reach(depth: int) -> str:
    """Sheets reached from those called Inputs, level by level."""
    return f"""WITH RECURSIVE {G}, w AS (SELECT DISTINCT grp, src node, 0 d FROM g WHERE {sql_key('src')} = 'inputs' UNION SELECT g.grp, g.dst, w.d + 1 FROM w JOIN g ON g.grp = w.grp AND g.src = w.node WHERE w.d < {depth})"""


REACH = reach(6)
#: A workbook has 70 sheets at most, so no shortest way is longer.
CONE = reach(70)


def _from_inputs(t: Tables, **kw: int) -> DataFrame:
    g = sheet_graph(t)
    return graphs.closure(g.filter(sheet_key(F.col("src")) == "inputs").select("grp", F.col("src").alias("node")), g, **kw)


@query(f"{REACH} SELECT grp, node, min(d) AS depth FROM w GROUP BY 1, 2")
def closure_depth(t: Tables) -> DataFrame:
    return _from_inputs(t, depth=6)


@query(f"""{REACH}, full_ AS (SELECT grp, node, min(d) d FROM w GROUP BY 1, 2) SELECT grp, count(*) AS n_hidden FROM full_ WHERE d > 2 GROUP BY 1""")
def closure_hidden(t: Tables) -> DataFrame:
    full = _from_inputs(t, depth=6)
    return graphs.hidden_by(full, full.filter("depth <= 2"), "grp", ["grp"])


@query()
def closure_budget(t: Tables) -> DataFrame:
    """At most four sheets a workbook, by outgoing edges at each level."""
    return _from_inputs(t, depth=6, budget=4)


@query(f"""{CONE}, a AS (SELECT grp, count(DISTINCT s) n FROM (SELECT grp, src s FROM g UNION ALL SELECT grp, dst FROM g) GROUP BY 1)
    SELECT w.grp, count(DISTINCT node) AS n_cone, max(d_) AS max_depth, round(count(DISTINCT node) / max(a.n), 6) AS share FROM (SELECT grp, node, min(d) d_ FROM w GROUP BY 1, 2) w JOIN a ON a.grp = w.grp GROUP BY 1""")
def cone_share(t: Tables) -> DataFrame:
    g = sheet_graph(t)
    every = g.select("grp", F.explode(F.array("src", "dst")).alias("s")).groupBy("grp").agg(F.countDistinct("s").alias("n"))
    cone = _from_inputs(t).groupBy("grp").agg(F.count(F.lit(1)).alias("n_cone"), F.max("depth").alias("max_depth"))
    return cone.join(every, "grp").select("grp", "n_cone", "max_depth", r(F.col("n_cone") / F.col("n"), 6).alias("share"))


@query(f"""WITH RECURSIVE {G}, w AS (SELECT grp, src a, dst b FROM g UNION SELECT w.grp, w.a, g.dst FROM w JOIN g ON g.grp = w.grp AND g.src = w.b),
    m AS (SELECT x.grp, x.a node, x.b other FROM w x JOIN w y ON y.grp = x.grp AND y.a = x.b AND y.b = x.a WHERE x.a <> x.b),
    n AS (SELECT DISTINCT grp, unnest([src, dst]) node FROM g)
    SELECT n.grp, n.node, least(n.node, coalesce(min(m.other), n.node)) AS "group", 1 + count(m.other) AS size FROM n LEFT JOIN m ON m.grp = n.grp AND m.node = n.node GROUP BY 1, 2""")
def sheet_scc_flags(t: Tables) -> DataFrame:
    return graphs.connected_groups(sheet_graph(t))


@query(f"""WITH {G}, n AS (SELECT DISTINCT grp, unnest([src, dst]) node FROM g), i AS (SELECT grp, dst node, count(*) k FROM g GROUP BY 1, 2), o AS (SELECT grp, src node, count(*) k FROM g GROUP BY 1, 2)
    SELECT n.grp, n.node, coalesce(i.k, 0) AS n_in, coalesce(o.k, 0) AS n_out, CASE WHEN i.k IS NULL THEN 'source' WHEN o.k IS NULL THEN 'sink' ELSE 'inner' END AS role FROM n LEFT JOIN i USING (grp, node) LEFT JOIN o USING (grp, node)""")
def sheet_roles(t: Tables) -> DataFrame:
    g = sheet_graph(t)
    ends = g.select("grp", F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    out = ends.groupBy("grp", F.col("x.node").alias("node")).agg(F.sum("x.i").alias("n_in"), F.sum("x.o").alias("n_out"))
    return out.withColumn("role", F.when(F.col("n_in") == 0, "source").when(F.col("n_out") == 0, "sink").otherwise("inner"))


# ---------------------------------------------------------------- discounting

VD, RATE = "1998-06-30", 0.08
SQL_YF = """CASE WHEN hi <= one_year THEN dd / CASE WHEN year(lo) = year(hi) THEN CASE WHEN ly THEN 366.0 ELSE 365.0 END WHEN (ly AND make_date(year(lo), 2, CASE WHEN ly THEN 29 ELSE 28 END) BETWEEN lo AND hi) OR (hy AND make_date(year(hi), 2, CASE WHEN hy THEN 29 ELSE 28 END) BETWEEN lo AND hi) THEN 366.0 ELSE 365.0 END
    ELSE dd / (CAST(date_diff('day', make_date(year(lo), 1, 1), make_date(year(hi) + 1, 1, 1)) AS DOUBLE) / (year(hi) - year(lo) + 1)) END"""


def sql_yearfrac(source: str, a: str, b: str, keep: str) -> str:
    """SQL that adds yf, the years between a and b of ``source``, to the columns ``keep``."""
    leap = "({0} % 4 = 0 AND {0} % 100 <> 0 OR {0} % 400 = 0)"
    return f"""(SELECT {keep}, {SQL_YF} AS yf FROM (SELECT *, CAST(date_diff('day', lo, hi) AS DOUBLE) AS dd, {leap.format('year(lo)')} AS ly, {leap.format('year(hi)')} AS hy,
        CASE WHEN month(lo) = 2 AND day(lo) = 29 THEN make_date(year(lo) + 1, 3, 1) ELSE make_date(year(lo) + 1, month(lo), day(lo)) END AS one_year
        FROM (SELECT *, least({a}, {b}) lo, greatest({a}, {b}) hi FROM {source})))"""


@query(f"SELECT d, round(yf, 10) AS yf FROM {sql_yearfrac('(SELECT DISTINCT CAST(o_orderdate AS DATE) d FROM orders)', 'd', 'DATE ' + chr(39) + '2001-08-01' + chr(39), 'd')}")
def yearfrac_actual_actual(t: Tables) -> DataFrame:
    return t.orders.select(F.to_date("o_orderdate").alias("d")).distinct().withColumn("yf", F.round(yearfrac(F.col("d"), F.lit("2001-08-01").cast("date")), 10))


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, round(abs(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01')) / 365.0, 10) AS yf, date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS serial FROM orders")
def yearfrac_365(t: Tables) -> DataFrame:
    d = t.orders.select(F.to_date("o_orderdate").alias("d")).distinct()
    return d.select("d", F.round(yearfrac(F.col("d"), F.lit("2001-08-01").cast("date"), "actual/365"), 10).alias("yf"), serial_day(F.col("d")).cast("long").alias("serial"))


def flows(t: Tables) -> DataFrame:
    """Monthly flows per market segment with the period's last day."""
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_mktsegment").alias("segment"), F.last_day("o_orderdate").alias("period_end")).agg(F.sum(money("o_totalprice")).cast("double").alias("flow"))


FLOWS = "flows AS (SELECT c_mktsegment segment, last_day(o_orderdate) period_end, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) flow FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"
SQL_VD = f"DATE '{VD}'"


def vd() -> Column:
    return F.lit(VD).cast("date")


def _factors(t: Tables, timing: str, rate: float = RATE) -> DataFrame:
    return cashflow.factor(flows(t), ["segment"], "period_end", as_rate(F.lit(rate)), vd(), timing)


def _sql_factors(timing: str, rate: str = str(RATE)) -> str:
    mid = f"""(SELECT *, s + CAST(date_diff('day', s, period_end) // 2 AS INTEGER) m FROM (SELECT *, greatest(coalesce(lag(period_end) OVER (PARTITION BY segment ORDER BY period_end) + 1, period_end - 90), {SQL_VD}) s FROM flows))"""
    src, at = (mid, "m") if timing == "mid" else ("flows", "period_end")
    t = "yf - 0.5" if timing == "mid-year" else "yf"
    # the middle day of periods before the valuation date is clipped, their factor is 0 anyway
    return f"SELECT segment, period_end, flow, CASE WHEN period_end <= {SQL_VD} THEN 0.0 ELSE power(1 + {rate}, -({t})) END AS factor FROM {sql_yearfrac(src, at, SQL_VD, 'segment, period_end, flow')}"


def _factor_query(name: str, timing: str) -> None:
    def f(t: Tables) -> DataFrame:
        return _factors(t, timing).select("segment", "period_end", F.round("factor", 9).alias("factor"))

    f.__name__ = name
    query(f"WITH {FLOWS} SELECT segment, period_end, round(factor, 9) AS factor FROM ({_sql_factors(timing)})")(f)


for _name, _timing in (("discount_factors_end", "end"), ("discount_factors_mid", "mid"), ("discount_factors_midyear", "mid-year")):
    _factor_query(_name, _timing)


@query(f"""WITH {FLOWS} SELECT segment, round(sum(flow * factor), 2) AS pv, round(sum(CASE WHEN factor <> 0 THEN CAST(flow AS DECIMAL(18,2)) END), 2)::DOUBLE AS undiscounted, count(*) FILTER (factor = 0) AS n_excluded FROM ({_sql_factors('end')}) GROUP BY 1""")
def present_value(t: Tables) -> DataFrame:
    return cashflow.present_value(_factors(t, "end"), ["segment"], "flow").select("segment", r(F.col("pv"), 2).alias("pv"), r(F.col("undiscounted"), 2).alias("undiscounted"), "n_excluded")


@query(f"""WITH {FLOWS} SELECT segment, 0.07 AS rate, round(sum(flow * factor), 2) AS pv FROM ({_sql_factors('end', '0.07')}) GROUP BY 1 UNION ALL SELECT segment, 0.08, round(sum(flow * factor), 2) FROM ({_sql_factors('end', '0.08')}) GROUP BY 1
    UNION ALL SELECT segment, 0.09, round(sum(flow * factor), 2) FROM ({_sql_factors('end', '0.09')}) GROUP BY 1""".replace("0.07 AS rate", "CAST(0.07 AS DOUBLE) AS rate"))
def pv_sensitivity(t: Tables) -> DataFrame:
    rated = flows(t).withColumn("rate", F.explode(F.array(F.lit(0.07), F.lit(0.08), F.lit(0.09))))
    f = cashflow.factor(rated, ["segment", "rate"], "period_end", F.col("rate"), vd())
    return cashflow.present_value(f, ["segment", "rate"], "flow").select("segment", "rate", r(F.col("pv"), 2).alias("pv"))


@query(f"""WITH {FLOWS} SELECT segment, period_end, round(sum(flow * factor) OVER (PARTITION BY segment ORDER BY period_end ROWS UNBOUNDED PRECEDING), 2) AS cum_pv FROM ({_sql_factors('end')})""")
def pv_cumulative(t: Tables) -> DataFrame:
    return cashflow.running_pv(_factors(t, "end"), ["segment"], "period_end", "flow").select("segment", "period_end", r(F.col("cum_pv"), 2).alias("cum_pv"))


@query(f"""WITH {FLOWS} SELECT segment, round(sum(flow / power(1.01, n)), 2) AS npv FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY period_end) n FROM flows) GROUP BY 1""")
def npv_columns(t: Tables) -> DataFrame:
    return cashflow.npv_by_position(flows(t), ["segment"], "period_end", "flow", 0.01).select("segment", r(F.col("npv"), 2).alias("npv"))


@query(f"""WITH {FLOWS} SELECT segment, round(sum(flow / power(1.08, date_diff('day', f, period_end) / 365.0)), 2) AS xnpv FROM (SELECT *, min(period_end) OVER (PARTITION BY segment) f FROM flows) GROUP BY 1""")
def xnpv(t: Tables) -> DataFrame:
    return cashflow.xnpv(flows(t), ["segment"], "period_end", "flow", RATE).select("segment", r(F.col("xnpv"), 2).alias("xnpv"))


@query("SELECT DISTINCT c_mktsegment AS segment, 'mid' AS timing, 'actual/actual' AS day_count, CAST(0.08 AS DOUBLE) AS rate FROM customer")
def convention_search(t: Tables) -> DataFrame:
    """Factors made by one convention are read back to it and to its rate."""
    return cashflow.read_back(_factors(t, "mid"), ["segment"], "period_end", "factor", vd()).withColumn("rate", F.round("rate", 9))


@query(f"""WITH {FLOWS}, f AS ({_sql_factors('end')}), y AS (SELECT segment, factor, yf FROM f JOIN {sql_yearfrac('(SELECT DISTINCT period_end FROM flows)', 'period_end', SQL_VD, 'period_end')} z ON z.period_end = f.period_end WHERE factor > 0 AND yf > 0)
    SELECT segment, round(avg(power(factor, -1 / yf) - 1), 9) AS rate FROM y GROUP BY 1""")
def rate_backsolve(t: Tables) -> DataFrame:
    return cashflow.read_back(_factors(t, "end"), ["segment"], "period_end", "factor", vd()).select("segment", F.round("rate", 9).alias("rate"))


# ---------------------------------------------------------------- identities

NATION_MONTH = "nm AS (SELECT n_regionkey reg, n_nationkey nat, last_day(o_orderdate) p, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2, 3)"


def nation_month(t: Tables) -> DataFrame:
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("c_nationkey"))  # nations are 25 rows
    return o.groupBy(F.col("n_regionkey").alias("reg"), F.col("n_nationkey").alias("nat"), F.last_day("o_orderdate").alias("p")).agg(F.sum(money("o_totalprice")).cast("double").alias("v"))


def _region_parts(t: Tables, scale: Column) -> DataFrame:
    """Two parts a region and month: the sum of its nations, and a total to hold against it."""
    nm = nation_month(t).groupBy("reg", "p").agg(F.sum(F.col("v").cast("decimal(28,2)")).cast("double").alias("v"))
    return nm.select("reg", "p", F.explode(F.array(F.struct(F.lit(1.0).alias("coef"), F.col("v").alias("v"), F.lit(False).alias("flex")), F.struct(F.lit(-1.0).alias("coef"), (F.col("v") * scale).alias("v"), F.lit(True).alias("flex")))).alias("x")).select("reg", "p", "x.*")


@query(f"""WITH {NATION_MONTH} , s AS (SELECT reg, p, CAST(sum(CAST(v AS DECIMAL(28,2))) AS DOUBLE) parts FROM nm GROUP BY 1, 2), w AS (SELECT n_regionkey reg, last_day(o_orderdate) p, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) whole FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2)
    SELECT reg, max(abs(parts - whole)) AS max_residual, count(*) AS n_periods, CASE WHEN max(abs(parts - whole)) <= greatest(1e-6, 1e-6 * max(abs(whole))) THEN 'holds' ELSE 'fails' END AS status FROM s JOIN w USING (reg, p) GROUP BY 1""")
def identity_segments_sum(t: Tables) -> DataFrame:
    res = identities.residuals(_region_parts(t, F.lit(1.0)), ["reg"], "p", "coef", "v", 2)
    return identities.verdict(res, ["reg"], "p").select("reg", "max_residual", "n_periods", "status")


@query(f"""WITH {NATION_MONTH} , s AS (SELECT reg, p, CAST(sum(CAST(v AS DECIMAL(28,2))) AS DOUBLE) v FROM nm GROUP BY 1, 2), x AS (SELECT reg, c, max(abs(v - c * -v)) m, count(*) n FROM s, (VALUES (1), (-1)) q(c) GROUP BY 1, 2)
    SELECT reg, CAST(arg_min(c, m) AS INTEGER) AS convention, min(m) AS max_residual, any_value(n) AS n_periods FROM x GROUP BY 1""")
def identity_sign_flex(t: Tables) -> DataFrame:
    """The total is kept with the other sign; the convention that makes the identity hold is found."""
    return identities.best_signs(_region_parts(t, F.lit(-1.0)), ["reg"], "p", "coef", "v", "flex", 2)


@query(f"""WITH {NATION_MONTH}, s AS (SELECT reg, p, CAST(sum(CAST(v AS DECIMAL(28,2))) AS DOUBLE) v FROM nm GROUP BY 1, 2), x AS (SELECT reg, p, v - v * CASE WHEN year(p) = 1998 THEN 1.01 ELSE 1.0 END r FROM s)
    SELECT reg, round(max(abs(r)), 4) AS max_residual, count(*) FILTER (abs(r) > 1) AS n_failing, count(*) AS n_periods, CASE WHEN count(*) FILTER (abs(r) > 1) > 0 THEN 'fails' ELSE 'holds' END AS status FROM x GROUP BY 1""")
def identity_tolerance_fail(t: Tables) -> DataFrame:
    res = identities.residuals(_region_parts(t, F.when(F.year("p") == 1998, 1.01).otherwise(1.0)), ["reg"], "p", "coef", "v", 2)
    v = identities.verdict(res, ["reg"], "p")
    return v.select("reg", r(F.col("max_residual")).alias("max_residual"), F.size("failing").cast("long").alias("n_failing"), "n_periods", "status")


CUM = f"""{NATION_MONTH}, c AS (SELECT nat, p, CAST(v AS DECIMAL(18,2)) v, sum(CAST(v AS DECIMAL(18,2))) OVER (PARTITION BY nat ORDER BY p) closing FROM nm)"""


@query(f"""WITH {CUM}, o AS (SELECT *, lag(closing) OVER (PARTITION BY nat ORDER BY p) opening FROM c) SELECT nat, count(*) AS n_periods, CAST(max(abs(opening + v - closing)) AS DOUBLE) AS max_residual FROM o WHERE opening IS NOT NULL GROUP BY 1""")
def corkscrew_roll(t: Tables) -> DataFrame:
    w = Window.partitionBy("nat").orderBy("p")
    c = nation_month(t).withColumn("v", F.col("v").cast("decimal(18,2)")).withColumn("closing", F.sum("v").over(w))
    rf = identities.roll_forward(c, ["nat"], "p", "closing", F.col("v"))
    return rf.groupBy("nat").agg(F.count(F.lit(1)).alias("n_periods"), F.max(F.abs("residual")).cast("double").alias("max_residual"))


TIE_ROWS = f"""{NATION_MONTH}, t AS (SELECT nat * 10 "row", p, v FROM nm UNION ALL SELECT nat * 10 + 1, p, -v FROM nm WHERE nat % 2 = 0 UNION ALL SELECT nat * 10 + 2, p, v FROM nm WHERE nat % 3 = 0)"""


@query(f"""WITH {TIE_ROWS}, s AS (SELECT DISTINCT "row" FROM t), m AS (SELECT "row", "row" // 10 c FROM s), n AS (SELECT c, min("row") f, count(*) k FROM m GROUP BY 1)
    SELECT m."row", n.f AS class_row, CAST(CASE WHEN m."row" % 10 = 1 THEN -1 ELSE 1 END AS INTEGER) AS sign, n.k AS n_rows FROM m JOIN n USING (c) WHERE n.k > 1""")
def value_tie(t: Tables) -> DataFrame:
    nm = nation_month(t).select("nat", "p", "v")
    rows = nm.select((F.col("nat") * 10).alias("row"), "p", "v").unionByName(nm.filter("nat % 2 = 0").select((F.col("nat") * 10 + 1).alias("row"), "p", (-F.col("v")).alias("v"))).unionByName(nm.filter("nat % 3 = 0").select((F.col("nat") * 10 + 2).alias("row"), "p", "v"))
    return identities.tied_rows(rows, [], "row", "p", "v")


TRIPLES = f"""{NATION_MONTH}, s AS (SELECT reg, nat, p, CAST(v AS DECIMAL(18,2)) v FROM nm), k AS (SELECT *, dense_rank() OVER (PARTITION BY reg ORDER BY nat) k FROM s),
    z AS (SELECT reg, CAST(nat AS INTEGER) r, p, CAST(v AS DOUBLE) v FROM s UNION ALL SELECT reg, CAST(1000 + reg AS INTEGER), p, CAST(sum(v) AS DOUBLE) FROM k WHERE k <= 2 GROUP BY reg, p),
    n AS (SELECT reg, count(DISTINCT p) np FROM z GROUP BY 1), full_ AS (SELECT z.* FROM z JOIN n USING (reg) WHERE (z.reg, r) IN (SELECT (z.reg, r) FROM z JOIN n USING (reg) GROUP BY z.reg, r HAVING count(*) = max(np)))"""


@query(f"""WITH {TRIPLES}, signs AS (SELECT * FROM (VALUES (1), (-1)) x(sb), (VALUES (1), (-1)) y(sc)), tol AS (SELECT reg, r, greatest(1e-6, 1e-6 * max(abs(v))) e FROM full_ GROUP BY 1, 2),
    t AS (SELECT a.reg, a.r a, b.r b, c.r c, sb, sc, count(*) n, bool_and(abs(a.v - (sb * b.v + sc * c.v)) <= e) ok FROM full_ a JOIN tol ON tol.reg = a.reg AND tol.r = a.r JOIN full_ b ON b.reg = a.reg AND b.p = a.p AND b.r <> a.r JOIN full_ c ON c.reg = a.reg AND c.p = a.p AND c.r <> a.r AND c.r > b.r, signs GROUP BY ALL)
    SELECT reg, a, b, c, CAST(sb AS INTEGER) AS sign_b, CAST(sc AS INTEGER) AS sign_c, CAST(n AS INTEGER) AS n_periods FROM t WHERE ok""")
def balance_triples(t: Tables) -> DataFrame:
    """Rows a = b + c among the nations of a region and a total of its first two, in whichever signs hold."""
    return identities.value_triples(region_rows(t), ["reg"], "r", "p", "v").select("reg", "a", "b", "c", "sign_b", "sign_c", "n_periods")


def region_rows(t: Tables) -> DataFrame:
    """Rows of each region: its nations by month, and 1000 and the region for the sum of its first two."""
    s = nation_month(t).select("reg", F.col("nat").cast("int").alias("r"), "p", "v").withColumn("k", F.dense_rank().over(Window.partitionBy("reg").orderBy("r")))
    total = s.filter("k <= 2").groupBy("reg", "p").agg(F.sum(F.col("v").cast("decimal(18,2)")).cast("double").alias("v")).select("reg", (F.lit(1000) + F.col("reg")).cast("int").alias("r"), "p", "v")
    return s.select("reg", "r", "p", "v").unionByName(total)


@query(f"""WITH {E1}, s AS (SELECT workbook_id, src_sheet, src_row, list_sort(list(DISTINCT dst_row)) terms FROM e WHERE src_sheet = dst_sheet AND kind = 'direct' GROUP BY 1, 2, 3)
    SELECT workbook_id, src_sheet, CAST(min(src_row) AS INTEGER) AS first_row, count(*) AS n_rows, CAST(len(any_value(terms)) AS INTEGER) AS n_terms FROM s WHERE len(terms) > 1 GROUP BY workbook_id, src_sheet, terms HAVING count(*) > 1""")
def subtotal_detect(t: Tables) -> DataFrame:
    """Rows that read the same set of rows of their sheet."""
    e = edges_once(t).filter("src_sheet = dst_sheet and kind = 'direct'")
    s = e.groupBy("workbook_id", "src_sheet", "src_row").agg(F.array_sort(F.collect_set("dst_row")).alias("terms")).filter(F.size("terms") > 1)
    out = s.groupBy("workbook_id", "src_sheet", "terms").agg(F.min("src_row").alias("first_row"), F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")
    return out.select("workbook_id", "src_sheet", "first_row", "n_rows", F.size("terms").alias("n_terms"))


@query(f"""WITH {LIVE_CELLS}, f AS (SELECT *, count(formula) OVER w n, min(CASE WHEN formula IS NOT NULL THEN col END) OVER w a FROM live WHERE value_kind = 'num' WINDOW w AS (PARTITION BY workbook_id, sheet, row))
    SELECT workbook_id, sheet, row, min(col) AS col, count(*) AS n_breaks FROM f WHERE formula IS NULL AND n >= 6 AND col > a GROUP BY 1, 2, 3""")
def pattern_breaks(t: Tables) -> DataFrame:
    c = live_cells(t, "formula", "value_kind").filter("value_kind = 'num'")
    return identities.pattern_breaks(c, ["workbook_id", "sheet", "row"], "col", F.col("formula").isNotNull())


@query(f"""WITH {LIVE_CELLS}, n AS (SELECT workbook_id, sheet, row, col, value_num v, max(col) OVER (PARTITION BY workbook_id, sheet, row) m FROM live WHERE value_kind = 'num'),
    x AS (SELECT workbook_id, sheet, row, max(CASE WHEN col = m THEN v END) last, sum(CASE WHEN col < m THEN v END) s, count(*) k FROM n GROUP BY 1, 2, 3)
    SELECT workbook_id, sheet, count(*) AS n_rows, count(*) FILTER (abs(last - s) <= 1e-6 * greatest(abs(last), 1)) AS n_sum FROM x WHERE k > 2 GROUP BY 1, 2""")
def total_column(t: Tables) -> DataFrame:
    c = live_cells(t, "value_kind", "value_num").filter("value_kind = 'num'")
    keys = ["workbook_id", "sheet", "row"]
    m = c.withColumn("m", F.max("col").over(Window.partitionBy(*keys)))
    x = m.groupBy(*keys).agg(F.max(F.when(F.col("col") == F.col("m"), F.col("value_num"))).alias("last"), F.sum(F.when(F.col("col") < F.col("m"), F.col("value_num"))).alias("s"), F.count(F.lit(1)).alias("k")).filter("k > 2")
    hit = F.abs(F.col("last") - F.col("s")) <= 1e-6 * F.greatest(F.abs("last"), F.lit(1.0))
    return x.groupBy("workbook_id", "sheet").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(hit).alias("n_sum"))


@query(f"""WITH {NATION_MONTH}, d AS (SELECT nat, p, CAST(v AS DECIMAL(18,2)) - lag(CAST(v AS DECIMAL(18,2))) OVER (PARTITION BY nat ORDER BY p) d FROM nm), s AS (SELECT nat, p, CASE WHEN d > 0 THEN '+' WHEN d < 0 THEN '-' ELSE '0' END s FROM d WHERE d IS NOT NULL),
    n AS (SELECT *, CASE WHEN lag(s) OVER (PARTITION BY nat ORDER BY p) = s THEN 0 ELSE 1 END b FROM s), r AS (SELECT *, sum(b) OVER (PARTITION BY nat ORDER BY p) k FROM n), g AS (SELECT nat, k, any_value(s) || 'x' || count(*) x FROM r WHERE k <= 40 GROUP BY 1, 2)
    SELECT nat, string_agg(x, ' ' ORDER BY k) AS runs FROM g GROUP BY 1""")
def sign_runs(t: Tables) -> DataFrame:
    v = F.col("v").cast("decimal(18,2)")
    d = nation_month(t).withColumn("d", v - F.lag(v).over(Window.partitionBy("nat").orderBy("p"))).filter("d is not null")
    return timeline.sign_runs(d, ["nat"], "p", "d")


ROWS = f"""{LIVE_CELLS}, s AS (SELECT workbook_id, sheet, row, max(abs(value_num)) scale, max(value_num) - min(value_num) spread FROM live WHERE value_kind = 'num' GROUP BY 1, 2, 3)"""


def _scales(t: Tables) -> DataFrame:
    c = live_cells(t, "value_kind", "value_num").filter("value_kind = 'num'")
    return identities.row_scale(c, ["workbook_id", "sheet", "row"], "value_num")


@query(f"WITH {ROWS} SELECT workbook_id, sheet, row, scale, spread <= 1e-6 + 1e-6 * scale AS is_static, scale > 1e-6 AS is_nonzero FROM s")
def row_scale(t: Tables) -> DataFrame:
    return _scales(t)


@query(f"WITH {ROWS} SELECT workbook_id, count(*) AS n_rows, count(*) FILTER (spread <= 1e-6 + 1e-6 * scale) AS n_static FROM s GROUP BY 1")
def static_rows(t: Tables) -> DataFrame:
    return _scales(t).groupBy("workbook_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("is_static").alias("n_static"))


# ---------------------------------------------------------------- statements

LINES = """m AS (SELECT last_day(l_shipdate) p, sum(CAST(l_extendedprice AS DECIMAL(18,2))) revenue, -sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(6,2))) opex, sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(6,2))) tax FROM lineitem GROUP BY 1)"""


def _month_lines(t: Tables) -> DataFrame:
    part = lambda c: money("l_extendedprice") * F.col(c).cast("decimal(6,2)")
    return t.lineitem.groupBy(F.last_day("l_shipdate").alias("p")).agg(F.sum(money("l_extendedprice")).alias("revenue"), (-F.sum(part("l_discount"))).alias("opex"), F.sum(part("l_tax")).alias("tax"))


@query(f"""WITH {LINES} SELECT p, CAST(revenue AS DOUBLE) AS revenue, CAST(opex AS DOUBLE) AS opex, CAST(revenue + opex AS DOUBLE) AS ebitda, CAST(-tax AS DOUBLE) AS tax, CAST(revenue + opex - tax AS DOUBLE) AS npat FROM m""")
def pnl_chain(t: Tables) -> DataFrame:
    """The statements of one model of all months: costs come out negative, what is not given is derived."""
    given = {"revenue": F.col("revenue"), "opex": -F.col("opex"), "depreciation": F.lit(0.0), "interest": F.lit(0.0), "tax": F.col("tax")}
    lines = threeway.statements(as_roles(_month_lines(t).withColumn("workbook_id", F.lit("all")).withColumnRenamed("p", "period"), given))
    wide = lines.filter("statement = 'pnl'").groupBy("period").pivot("line", ["revenue", "opex", "ebitda", "tax", "npat"]).agg(F.max("value"))
    exact = lambda c: F.col(c).cast("decimal(24,4)").cast("double").alias(c)  # noqa: E731  sums of four decimals
    return wide.select(F.col("period").alias("p"), *[exact(c) for c in ("revenue", "opex", "ebitda", "tax", "npat")])


def as_roles(df: DataFrame, given: dict[str, Column]) -> DataFrame:
    """Rows of workbook_id and period with a column a role, those not ``given`` unknown."""
    return df.select("workbook_id", "period", *[given.get(k, F.lit(None)).cast("double").alias(k) for k in threeway.ROLES])


DELTA = f"""{NATION_MONTH}, d AS (SELECT nat, p, CAST(v AS DECIMAL(18,2)) - lag(CAST(v AS DECIMAL(18,2))) OVER (PARTITION BY nat ORDER BY p) d FROM nm)"""


@query(f"""WITH {DELTA} SELECT nat, CAST(sum(greatest(d, 0)) AS DOUBLE) AS inflow, CAST(sum(least(d, 0)) AS DOUBLE) AS outflow, CAST(sum(d) AS DOUBLE) AS net FROM d WHERE d IS NOT NULL GROUP BY 1""")
def cash_flow_lines(t: Tables) -> DataFrame:
    """Debt that follows the orders of a nation: its drawdowns and repayments in the cash-flow statement."""
    roles = as_roles(nation_month(t).select(F.col("nat").alias("workbook_id"), F.col("p").alias("period"), "v"), {"bs_debt": F.col("v")})
    moved = threeway.statements(roles).filter("statement = 'cf' and line in ('draw', 'rep') and value is not null").withColumn("value", F.col("value").cast("decimal(18,2)"))
    of = lambda line: F.sum(F.when(F.col("line") == line, F.col("value"))).cast("double")
    return moved.groupBy(F.col("workbook_id").alias("nat")).agg(of("draw").alias("inflow"), of("rep").alias("outflow"), F.sum("value").cast("double").alias("net"))


@query("""SELECT c_nationkey AS nation, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(coalesce(sum(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN CAST(c_acctbal AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS known,
    CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) - coalesce(sum(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN CAST(c_acctbal AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS other FROM customer GROUP BY 1""")
def balance_plug(t: Tables) -> DataFrame:
    """Total assets against the two parts that are known: the statement's other assets are what is left."""
    part = lambda *names: F.coalesce(F.sum(F.when(F.col("c_mktsegment").isin(*names), money("c_acctbal"))), F.lit(0).cast("decimal(18,2)"))
    sums = t.customer.groupBy(F.col("c_nationkey").alias("workbook_id")).agg(F.sum(money("c_acctbal")).alias("assets"), part("BUILDING").alias("cash"), part("MACHINERY").alias("fixed")).withColumn("period", vd())
    lines = threeway.statements(as_roles(sums, {"assets": F.col("assets"), "bs_cash": F.col("cash"), "bs_fixed_assets": F.col("fixed")}))
    w = lines.filter("statement = 'bs'").groupBy("workbook_id").pivot("line", ["ta", "cash", "fa", "other_assets"]).agg(F.max("value"))
    cents = lambda c: c.cast("decimal(18,2)").cast("double")
    return w.select(F.col("workbook_id").alias("nation"), cents(F.col("ta")).alias("total"), cents(F.col("cash") + F.col("fa")).alias("known"), cents(F.col("other_assets")).alias("other"))


FY = f"""{NATION_MONTH}, y AS (SELECT nat, p, CAST(v AS DECIMAL(18,2)) v, CASE WHEN nat % 5 = 0 AND month(p) = 3 THEN NULL ELSE CAST(v AS DECIMAL(18,2)) END w, year(p) + CASE WHEN month(p) > 6 THEN 1 ELSE 0 END fy FROM nm)"""


def _fy(t: Tables) -> DataFrame:
    """Fiscal years ending in June; some months of some nations are made unknown."""
    w = F.when((F.col("nat") % 5 == 0) & (F.month("p") == 3), None).otherwise(F.col("v").cast("decimal(18,2)"))
    return relational.rollup_period(nation_month(t).withColumn("w", w), ["nat"], fiscal_year(F.col("p"), 6), "p", "w", 12)


@query(f"WITH {FY} SELECT nat, CAST(fy AS INTEGER) AS fy, CAST(CASE WHEN count(w) = count(*) THEN sum(w) END AS DOUBLE) AS v_sum FROM y GROUP BY 1, 2")
def fy_rollup_sum(t: Tables) -> DataFrame:
    return _fy(t).select("nat", "fy", F.col("v_sum").cast("double").alias("v_sum"))


@query(f"WITH {FY} SELECT nat, CAST(fy AS INTEGER) AS fy, CAST(w AS DOUBLE) AS v_last FROM (SELECT *, row_number() OVER (PARTITION BY nat, fy ORDER BY p DESC) k FROM y) WHERE k = 1")
def fy_rollup_last(t: Tables) -> DataFrame:
    return _fy(t).select("nat", "fy", F.col("v_last").cast("double").alias("v_last"))


@query(f"WITH {FY} SELECT nat, CAST(fy AS INTEGER) AS fy, CAST(w AS DOUBLE) AS v_first FROM (SELECT *, row_number() OVER (PARTITION BY nat, fy ORDER BY p) k FROM y) WHERE k = 1")
def fy_rollup_first(t: Tables) -> DataFrame:
    return _fy(t).select("nat", "fy", F.col("v_first").cast("double").alias("v_first"))


@query(f"WITH {FY} SELECT nat, CAST(fy AS INTEGER) AS fy, count(*) AS n_periods, count(*) < 12 AS partial FROM y GROUP BY 1, 2")
def fy_partial(t: Tables) -> DataFrame:
    return _fy(t).select("nat", "fy", "n_periods", "partial")


@query(f"""WITH {LIVE_CELLS} SELECT workbook_id, sheet, count(*) AS n, sum(CAST(floor(value_num * 1000) AS BIGINT)) / 1000 AS known, CASE WHEN count(value_num) = count(*) THEN sum(CAST(floor(value_num * 1000) AS BIGINT)) / 1000 END AS strict FROM live GROUP BY 1, 2""")
def strict_vs_known_sum(t: Tables) -> DataFrame:
    c = live_cells(t, "value_num")
    v = F.floor(F.col("value_num") * 1000)  # whole thousandths: sums do not depend on their order
    return c.groupBy("workbook_id", "sheet").agg(F.count(F.lit(1)).alias("n"), (relational.sum_known(v) / 1000).alias("known"), (relational.sum_strict(v) / 1000).alias("strict"))


# ---------------------------------------------------------------- classification, vocabularies, diagnostics

def _sql_first(table: list, c: str, default: str) -> str:
    """The first subclass of a table of patterns that a label shows."""
    cases = " ".join(f"WHEN regexp_matches({c}, '(?i){p}') THEN '{n}'" if p else f"WHEN true THEN '{n}'" for p, n, *_ in table)
    return f"CASE {cases} ELSE '{default}' END"


#: What the label alone tells of the twelve rules, in their order.
RULES_SQL = f"""CASE WHEN regexp_matches(l, '(?i){review.TERMINAL}') AND regexp_matches(l, '(?i)\\bdate\\b') THEN 'timeline/terminal date'
    WHEN regexp_matches(l, '(?i){review.TERMINAL}') THEN 'terminal/' || {_sql_first(review.TERMINAL_SUB, 'l', 'terminal value')}
    {" ".join(f"WHEN regexp_matches(l, '(?i){p}') AND n >= {least} THEN 'discounting/{sub}'" for p, sub, least in review.DISCOUNTING)}
    WHEN regexp_matches(l, '(?i){review.TIMELINE}') AND n >= 3 THEN 'timeline/' || lower(regexp_extract(l, '(?i)({review.TIMELINE})', 1))
    WHEN n_const > 0 AND n_const >= 3 * n_formula THEN 'assumption/' || {_sql_first(review.ASSUMPTIONS, 'l', 'other')} ELSE 'calculation/' || {_sql_first(review.CALCULATIONS, 'l', 'calculation')} END"""


@query(f"WITH {LIVE_LINES}, x AS (SELECT coalesce(label, '') l, n_formula + n_const n, n_formula, n_const FROM lines) SELECT class, count(*) AS n FROM (SELECT {RULES_SQL} AS class FROM x) GROUP BY 1")
def classify_rows(t: Tables) -> DataFrame:
    """Live lines by class and subclass, as far as labels and counts tell."""
    got = review.classify(live_lines(t).select("label", "n_formula", "n_const"))
    return got.groupBy(F.concat_ws("/", "class", "subclass").alias("class")).agg(F.count(F.lit(1)).alias("n"))


def sql_says(pattern: str, c: str = "l") -> str:
    """A role's pattern without look-ahead, which SQL has not: what must not follow is a condition of its own."""
    if "(?!" not in pattern:
        return f"regexp_matches({c}, '{pattern.replace(chr(39), chr(39) * 2)}')"
    parts = []
    for alt in pattern.split("|^"):
        alt = alt if alt.startswith("^") else "^" + alt
        head, _, tail = alt.partition("(?!")
        rest = tail.split("|", 1)
        not_after = rest[0].rstrip(")")
        parts.append(f"(regexp_matches({c}, '{head}') AND NOT regexp_matches({c}, '{head}{not_after}'))" if tail else f"regexp_matches({c}, '{alt.replace(chr(39), chr(39) * 2)}')")
    return "(" + " OR ".join(parts) + ")"


@query(f"WITH {LIVE_LINES}, x AS (SELECT lower(trim(label)) l FROM lines WHERE label IS NOT NULL) " + " UNION ALL ".join(f"SELECT '{k}' AS role, count(*) AS n_lines FROM x WHERE {sql_says(v.vocab)} HAVING count(*) > 0" for k, v in ROLES.items()))
def vocab_hits(t: Tables) -> DataFrame:
    """How many live lines' labels show the wordings of each role."""
    said = live_lines(t).filter("label is not null").select(F.explode(named_roles(F.col("label"))).alias("role"))
    return said.groupBy("role").agg(F.count(F.lit(1)).alias("n_lines"))


SHAPE = r"\$?[A-Z]{1,3}\$?[0-9]+"


@query(rf"""WITH {LIVE_CELLS}, s AS (SELECT workbook_id, sheet, row, regexp_replace(formula, '{SHAPE}', '#', 'g') shape, count(*) n FROM live WHERE formula IS NOT NULL GROUP BY 1, 2, 3, 4)
    SELECT workbook_id, count(DISTINCT shape) AS n_families, count(*) FILTER (n = 1) AS n_single, count(DISTINCT (sheet, row)) AS n_rows FROM s GROUP BY 1""")
def families_metrics(t: Tables) -> DataFrame:
    c = live_cells(t, "formula").filter("formula is not null")
    s = c.groupBy("workbook_id", "sheet", "row", F.regexp_replace("formula", SHAPE, "#").alias("shape")).agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("workbook_id").agg(F.countDistinct("shape").alias("n_families"), F.count_if(F.col("n") == 1).alias("n_single"), F.countDistinct("sheet", "row").alias("n_rows"))


@query(f"""WITH {LIVE_CELLS}, f AS (SELECT DISTINCT workbook_id w, sheet s, row r, col c FROM live WHERE formula IS NOT NULL), i AS (SELECT w, s, r, c - row_number() OVER (PARTITION BY w, s, r ORDER BY c) g FROM f), x AS (SELECT w, s, r, g, count(*) n FROM i GROUP BY 1, 2, 3, 4)
    SELECT n AS run_length, count(*) AS n_runs FROM x GROUP BY 1""")
def runs_histogram(t: Tables) -> DataFrame:
    f = live_cells(t, "formula").filter("formula is not null")
    return timeline.runs(f, ["workbook_id", "sheet", "row"], F.col("col")).groupBy(F.col("n").alias("run_length")).agg(F.count(F.lit(1)).alias("n_runs"))


@query(rf"""WITH {LIVE_CELLS}, c AS (SELECT row_number() OVER () i, formula FROM live WHERE formula IS NOT NULL), x AS (SELECT i, unnest(regexp_extract_all(formula, '([A-Z][A-Z0-9.]+)\(', 1)) item FROM c) SELECT item, count(*) AS n_uses, count(DISTINCT i) AS n_texts FROM x GROUP BY 1""")
def function_frequency(t: Tables) -> DataFrame:
    return diagnostics.frequency(live_cells(t, "formula").filter("formula is not null"), "formula", r"([A-Z][A-Z0-9.]+)\(")


@query("SELECT sha256(text) AS fingerprint, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def fingerprint_dedupe(t: Tables) -> DataFrame:
    return t.documents.filter("text is not null").groupBy(F.sha2("text", 256).alias("fingerprint")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies"))


WORDS = r"[^a-z0-9]+"


@query(rf"""WITH p AS (SELECT DISTINCT trim(regexp_replace(lower(role_w), '[^a-z0-9]+', ' ', 'g')) phrase FROM (SELECT unnest(string_split(vocab, ' | ')) role_w FROM role_vocab)),
    d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' t FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, phrase FROM d JOIN p ON contains(t, ' ' || phrase || ' ')""")
def leak_scan_ngrams(t: Tables) -> DataFrame:
    """Canonical wordings are the forbidden phrases."""
    words = F.split(F.trim(F.regexp_replace(F.lower("text"), WORDS, " ")), " ")
    phrases = t.role_vocab.select(F.explode(F.split("vocab", r" \| ")).alias("w")).select(F.trim(F.regexp_replace(F.lower("w"), WORDS, " ")).alias("phrase"))
    return diagnostics.leak_hits(t.documents.filter("text is not null"), ["doc_id"], words, phrases)


@query(rf"""WITH p AS (SELECT DISTINCT trim(regexp_replace(lower(role_w), '[^a-z0-9]+', ' ', 'g')) phrase FROM (SELECT unnest(string_split(vocab, ' | ')) role_w FROM role_vocab)),
    d AS (SELECT doc_id, text, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' t FROM documents), h AS (SELECT DISTINCT doc_id FROM d JOIN p ON contains(t, ' ' || phrase || ' ')),
    g AS (SELECT d.doc_id, CASE WHEN text IS NULL THEN 'unreadable' WHEN h.doc_id IS NOT NULL THEN 'hit' WHEN length(text) <> strlen(text) THEN 'non-ascii' END reason FROM d LEFT JOIN h USING (doc_id))
    SELECT doc_id, reason, reason IS NOT NULL AS blocked FROM g""")
def leak_gate(t: Tables) -> DataFrame:
    return diagnostics.gate(t.documents, ["doc_id"], "text", leak_scan_ngrams(t))


@query("SELECT doc_id, regexp_replace(text, '[0-9]{3,}', '#', 'g') AS text FROM documents")
def scrub_numbers(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", diagnostics.scrub_numbers(F.col("text")).alias("text"))


@query("SELECT doc_id, regexp_replace(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}', '<date>', 'g') AS text FROM documents")
def scrub_dates(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", diagnostics.scrub_dates(F.col("text")).alias("text"))


@query(r"SELECT doc_id, regexp_replace(text, '[A-Za-z]:\\[^\s]+|\\\\[^\s]+|/[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+', '<path>', 'g') AS text FROM documents")
def scrub_paths(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", diagnostics.scrub_paths(F.col("text")).alias("text"))


@query(r"SELECT doc_id, CASE WHEN regexp_matches(ltrim(text, ' '), '^[=+\-@\t\r\n]') THEN '''' || text ELSE text END AS text FROM documents")
def csv_injection_guard(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", diagnostics.csv_guard(F.col("text")).alias("text"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS total, max(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS most FROM events GROUP BY 1")
def json_props(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"), F.max(k).alias("most"))


@query(f"WITH {LIVE_LINES} SELECT workbook_id, sum(n_formula)::BIGINT AS n_formula, CASE WHEN sum(n_formula) < 5000 THEN 'small' WHEN sum(n_formula) < 100000 THEN 'medium' ELSE 'large' END AS size FROM lines GROUP BY 1")
def size_class(t: Tables) -> DataFrame:
    return live_lines(t).groupBy("workbook_id").agg(F.sum("n_formula").alias("n_formula")).withColumn("size", diagnostics.size_class(F.col("n_formula")))


@query("""WITH x AS (SELECT c_custkey, c_acctbal d, abs(c_acctbal) * (c_custkey % 1000) s FROM customer) SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN d = 0 THEN '0' WHEN s = 0 THEN 'scale_zero' WHEN abs(d) / s < 1e-9 THEN '<1e-9' WHEN abs(d) / s < 1e-6 THEN '<1e-6' WHEN abs(d) / s < 1e-3 THEN '<1e-3'
    WHEN abs(d) / s < 1e-1 THEN '<1e-1' ELSE '>=1e-1' END bucket FROM x) GROUP BY 1""")
def residual_bucket(t: Tables) -> DataFrame:
    s = F.abs("c_acctbal") * (F.col("c_custkey") % 1000)
    return t.customer.groupBy(diagnostics.residual_bucket(F.col("c_acctbal"), s).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH x AS (SELECT o_orderkey, ['row not found', CASE o_orderstatus WHEN 'F' THEN 'stopped after 80 rows' WHEN 'O' THEN 'periodicity differs' ELSE lower(o_orderpriority) END] a FROM orders)
    SELECT o_orderkey, array_to_string(list_sort(list_distinct([CASE WHEN contains(v, 'periodicity differs') THEN 'periodicity' WHEN contains(v, 'stopped after') THEN 'capped' WHEN contains(v, 'not found') THEN 'no_candidate' ELSE 'other' END FOR v IN a])), ',') AS codes FROM x""")
def reason_codes(t: Tables) -> DataFrame:
    text = F.concat(F.lit("row not found; "), F.when(F.col("o_orderstatus") == "F", "stopped after 80 rows").when(F.col("o_orderstatus") == "O", "periodicity differs").otherwise(F.col("o_orderpriority")))
    return t.orders.select("o_orderkey", F.array_join(diagnostics.reason_codes(text), ",").alias("codes"))


@query("SELECT left(CAST(o_orderdate AS VARCHAR), 3) || '0s' AS decade, count(*) AS n FROM orders GROUP BY 1")
def decades(t: Tables) -> DataFrame:
    return t.orders.groupBy(decade(F.col("o_orderdate").cast("string")).alias("decade")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- extensions over the event stream, no reference parity

@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def window_tumbling_events(t: Tables) -> DataFrame:
    w = t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), r(F.sum("value")).alias("total"))
    return w.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM g)
    SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def window_session_events(t: Tables) -> DataFrame:
    s = t.events.groupBy("user_id", F.session_window("ts", "6 hours").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("s.start").alias("session_start"), "n")
