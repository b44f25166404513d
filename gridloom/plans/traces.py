"""Queries of the trace operators with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators import binding, cashflow, identities, threeway, trace
from gridloom.plans.catalog import (E1, FLOWS, LIVE_CELLS, LIVE_LINES, Tables, _factors, _month_lines, _sql_factors, as_roles, edges_once, flows, live_cells, live_lines, money, query, reach, region_rows, sheet_graph, LINES, TRIPLES)
from gridloom.plans.catalog import vd
from gridloom.tables import sheet_key


@query(f"{reach(5)} SELECT grp, node, min(d) AS depth FROM w WHERE contains(lower(node), 'cash') GROUP BY 1, 2")
def reach_of_cash(t: Tables) -> DataFrame:
    """Sheets named after cash that are at most five links from the inputs."""
    g = sheet_graph(t)
    ends = g.select("grp", F.explode(F.array("src", "dst")).alias("node")).filter(F.lower("node").contains("cash"))
    return trace.reaches(g.filter(sheet_key(F.col("src")) == "inputs").select("grp", F.col("src").alias("node")), g, ends)


@query(f"""WITH {FLOWS}, pv AS (SELECT segment, sum(flow * factor) pv FROM ({_sql_factors('end')}) GROUP BY 1), adj AS (SELECT c_mktsegment segment, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) a FROM customer GROUP BY 1),
    x AS (SELECT segment, 1 step, 'pv' item, pv v FROM pv UNION ALL SELECT segment, 2, 'balances', -a FROM adj)
    SELECT segment, step, item, round(v, 2) AS amount, round(sum(v) OVER (PARTITION BY segment ORDER BY step), 2) AS running FROM x""")
def bridge_decompose(t: Tables) -> DataFrame:
    """Equity of each segment, taken apart into its present value and the balances that are subtracted."""
    segments = t.customer.select(F.col("c_mktsegment").alias("grp")).distinct()
    terms = segments.select("grp", F.explode(F.array(*[F.struct(F.lit(a).alias("node"), F.lit(b).alias("child"), F.lit(s).alias("sign")) for a, b, s in (("equity", "enterprise", 1), ("equity", "debt", -1), ("enterprise", "pv", 1), ("pv", "factor", 1), ("debt", "balances", 1))])).alias("x")).select("grp", "x.*")
    items = trace.decompose(segments.select("grp", F.lit("equity").alias("top")), terms, segments.select("grp", F.lit("pv").alias("node")))
    pv = cashflow.present_value(_factors(t, "end"), ["segment"], "flow").select(F.col("segment").alias("grp"), F.lit("pv").alias("node"), F.col("pv").alias("v"))
    adj = t.customer.groupBy(F.col("c_mktsegment").alias("grp")).agg(F.sum(money("c_acctbal")).cast("double").alias("v")).select("grp", F.lit("balances").alias("node"), "v")
    valued = items.join(pv.unionByName(adj), ["grp", "node"]).withColumn("step", F.when(F.col("kind") == "pv", 1).otherwise(2))
    out = trace.bridge(valued, ["grp"], "step", "sign", "v")
    return out.select(F.col("grp").alias("segment"), "step", F.col("node").alias("item"), F.round("amount", 2).alias("amount"), F.round("running", 2).alias("running"))


@query("""WITH n AS (SELECT n_regionkey r, n_nationkey n FROM nation), c AS (SELECT c_custkey c, c_nationkey n, CASE WHEN c_acctbal < 0 THEN -1 ELSE 1 END s FROM customer), o AS (SELECT o_orderkey o, o_custkey c FROM orders)
    SELECT 'r' || r AS top, kind, count(*) AS n_items, CAST(sum(s) AS BIGINT) AS net FROM (SELECT r, 'item' AS kind, coalesce(c.s, 1) s FROM n LEFT JOIN c USING (n) LEFT JOIN o USING (c)) GROUP BY 1, 2""")
def cash_flow_parts(t: Tables) -> DataFrame:
    """Regions as cash flows that add up nations, customers and their orders, three levels down."""
    k = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    g, one = F.lit("g").alias("grp"), F.lit(1).alias("sign")
    terms = t.nation.select(g, k("r", "n_regionkey").alias("node"), k("n", "n_nationkey").alias("child"), one)
    terms = terms.unionByName(t.customer.select(g, k("n", "c_nationkey").alias("node"), k("c", "c_custkey").alias("child"), F.when(F.col("c_acctbal") < 0, -1).otherwise(1).alias("sign")))
    terms = terms.unionByName(t.orders.select(g, k("c", "o_custkey").alias("node"), k("o", "o_orderkey").alias("child"), one))
    found = trace.parts(t.nation.select(g, k("r", "n_regionkey").alias("top")).distinct(), terms)
    return found.groupBy("top", "kind").agg(F.count(F.lit(1)).alias("n_items"), F.sum("sign").alias("net"))


RATES = [7.0, 0.08, 9.0]


@query(f"""WITH {FLOWS}, adj AS (SELECT c_mktsegment segment, CAST(coalesce(sum(CASE WHEN c_custkey % 2 = 0 THEN CAST(c_acctbal AS DECIMAL(18,2)) END), 0) AS DOUBLE) now, CAST(coalesce(sum(CASE WHEN c_custkey % 2 <> 0 THEN CAST(c_acctbal AS DECIMAL(18,2)) END), 0) AS DOUBLE) later FROM customer GROUP BY 1),
    pv AS ({" UNION ALL ".join(f"SELECT segment, CAST({r if r < 1 else r / 100} AS DOUBLE) rate, sum(flow * factor) pv FROM ({_sql_factors('end', str(r if r < 1 else r / 100))}) GROUP BY 1" for r in RATES)})
    SELECT segment, rate, round(pv, 2) AS pv, round(pv + now + later / (1 + rate), 2) AS value FROM pv JOIN adj USING (segment)""")
def full_valuation(t: Tables) -> DataFrame:
    """Value per segment at three rates, balances counted at the valuation date or a year on."""
    adj = t.customer.select(F.col("c_mktsegment").alias("segment"), money("c_acctbal").alias("amount"), (F.col("c_custkey") % 2 == 0).alias("at_valuation_date"))
    adj = adj.groupBy("segment", "at_valuation_date").agg(F.sum("amount").cast("double").alias("amount"))
    got = trace.full_value(flows(t), adj, ["segment"], "period_end", "flow", RATES, vd())
    return got.select("segment", "rate", F.round("pv", 2).alias("pv"), F.round("value", 2).alias("value"))


@query(f"""WITH {FLOWS}, f AS ({_sql_factors('end')}), g AS (SELECT *, lag(CASE WHEN factor > 0 THEN factor END) OVER (PARTITION BY segment ORDER BY period_end) b FROM f), s AS (SELECT segment, sum(flow * factor) * CASE WHEN segment = 'BUILDING' THEN 1.01 ELSE 1 END pv FROM f GROUP BY 1),
    x AS (SELECT g.segment, count(flow) > 0 a, bool_and(factor BETWEEN 0 AND 1 AND (b IS NULL OR factor <= b)) b, abs(sum(flow * factor) - any_value(pv)) <= greatest(1e-6, 1e-6 * abs(any_value(pv))) c FROM g JOIN s USING (segment) GROUP BY 1)
    SELECT segment, unnest([1, 2, 3]) AS step, unnest(['cash flows', 'factors', 'present value']) AS name, unnest([a, b, c]) AS ok FROM x""")
def validation_steps(t: Tables) -> DataFrame:
    """The steps of each segment's valuation; one segment states a pv of its own that does not follow."""
    f = _factors(t, "end")
    off = F.when(F.col("segment") == "BUILDING", 1.01).otherwise(1.0)
    stated = cashflow.present_value(f, ["segment"], "flow").select("segment", (F.col("pv") * off).alias("pv"))
    return trace.validation(f, ["segment"], "period_end", "flow", "factor", stated)


CHECKS = f"""{LIVE_LINES}, {LIVE_CELLS}, k AS (SELECT DISTINCT workbook_id, sheet, row FROM lines WHERE regexp_matches(label, '(?i)check|error|integrity'))"""


@query(f"""WITH {CHECKS}, v AS (SELECT k.*, value_kind, value_num FROM k JOIN live c ON c.workbook_id = k.workbook_id AND c.sheet = k.sheet AND c.row = k.row WHERE value_kind IN ('num', 'bool') AND value_num IS NOT NULL),
    p AS (SELECT workbook_id, sheet, row, bool_and(value_kind = 'bool') f, min(value_num) a, max(abs(value_num)) b, count(*) n FROM v GROUP BY 1, 2, 3)
    SELECT k.workbook_id, k.sheet, k.row, coalesce(n, 0) AS n_values, CASE WHEN b IS NULL THEN 'unclear' WHEN CASE WHEN f THEN a <> 0 ELSE b <= 1e-6 END THEN 'holds' ELSE 'fails' END AS verdict FROM k LEFT JOIN p ON p.workbook_id = k.workbook_id AND p.sheet = k.sheet AND p.row = k.row""")
def check_verdicts(t: Tables) -> DataFrame:
    return trace.check_verdicts(live_lines(t), live_cells(t, "value_kind", "value_num"))


def _round(k: int) -> str:
    """SQL for one more round of rows that read nothing but checks."""
    p = f"c{k - 1}"
    return f"""c{k} AS (SELECT * FROM {p} UNION ALL SELECT r.workbook_id, r.sheet, r.row, {k} FROM r LEFT JOIN {p} q ON q.workbook_id = r.workbook_id AND q.sheet = r.t_sheet AND q.row = r.t_row GROUP BY 1, 2, 3 HAVING count(*) = count(q.row) AND NOT EXISTS (SELECT 1 FROM {p} z WHERE z.workbook_id = r.workbook_id AND z.sheet = r.sheet AND z.row = r.row))"""


@query(f"""WITH {E1}, {LIVE_LINES}, r AS (SELECT DISTINCT workbook_id, src_sheet sheet, src_row "row", dst_sheet t_sheet, dst_row t_row FROM e WHERE kind = 'direct'),
    c0 AS (SELECT DISTINCT workbook_id, sheet, row, 0 AS round FROM lines WHERE regexp_matches(label, '(?i)check|error|integrity|flag|score|index')), {", ".join(_round(k) for k in range(1, 8))} SELECT workbook_id, sheet, row, round FROM c7""")
def check_aggregates(t: Tables) -> DataFrame:
    """Rows that read nothing but checks (here also flags, scores and indices), and rows that read nothing but those."""
    seeds = live_lines(t).filter(F.col("label").rlike(r"(?i)check|error|integrity|flag|score|index"))
    reads = edges_once(t).filter("kind = 'direct'").select("workbook_id", F.col("src_sheet").alias("sheet"), F.col("src_row").alias("row"), F.col("dst_sheet").alias("t_sheet"), F.col("dst_row").alias("t_row"))
    return trace.aggregate_checks(seeds, reads)


@query(f"""WITH {LINES}, x AS (SELECT p, tax, tax - coalesce(lag(tax) OVER (ORDER BY p), 0) d FROM m) SELECT p, CAST(d AS DOUBLE) AS residual, CAST(tax AS DOUBLE) AS operating, CAST(d - tax AS DOUBLE) AS unexplained FROM x""")
def residual_split(t: Tables) -> DataFrame:
    """A balance sheet that is out by the tax of each month: what the cash flow's operating lines explain, and what is left."""
    given = {"revenue": F.col("revenue"), "opex": -F.col("opex"), "depreciation": F.lit(0.0), "interest": F.lit(0.0), "tax": F.col("tax"), "cfo": F.col("revenue") + F.col("opex"), "assets": F.col("revenue"), "total_le": F.col("revenue") - F.col("tax")}
    roles = as_roles(_month_lines(t).withColumn("workbook_id", F.lit("all")).withColumnRenamed("p", "period"), given)
    got = threeway.residual_components(threeway.statements(roles), roles)
    exact = lambda c: F.col(c).cast("decimal(24,4)").cast("double").alias(c)
    return got.select(F.col("period").alias("p"), exact("residual"), exact("operating"), exact("unexplained"))


@query("""WITH n AS (SELECT n_nationkey k FROM nation), c AS (SELECT k, CASE k % 3 WHEN 0 THEN 2 WHEN 1 THEN 5 ELSE 0 END e, CASE k % 3 WHEN 1 THEN 4 ELSE 0 END d FROM n)
    SELECT k AS nation, CAST(e AS BIGINT) AS n_extracted, CAST(d AS BIGINT) AS n_derived, CAST(9 - e - d AS BIGINT) AS n_missing, CASE WHEN e + d = 0 THEN 'none' WHEN e + d < 9 THEN 'partial' WHEN e >= d THEN 'extracted' ELSE 'derived' END AS mode FROM c""")
def mode_classify(t: Tables) -> DataFrame:
    """Profit and loss of models that hold two lines, five lines or none: the rest is derived where it follows, else missing."""
    k = F.col("n_nationkey") % 3
    some, most = F.when(k <= 1, 100.0), F.when(k == 1, 10.0)
    given = {"revenue": some, "npat": F.when(k == 0, 60.0), "opex": most, "depreciation": most, "interest": most, "tax": most}
    roles = as_roles(t.nation.select(F.col("n_nationkey").alias("workbook_id"), vd().alias("period"), "n_nationkey"), given)
    return threeway.modes(threeway.statements(roles)).filter("statement = 'pnl'").select(F.col("workbook_id").alias("nation"), "n_extracted", "n_derived", "n_missing", "mode")




# ---------------------------------------------------------------- bindings

@query(f"""WITH {TRIPLES}, t AS (SELECT a.reg, a.r a, b.r b, c.r c, count(*) n, bool_and(abs(a.v - (b.v + c.v)) <= e) ok FROM full_ a JOIN (SELECT reg, r, greatest(1e-6, 1e-6 * max(abs(v))) e FROM full_ GROUP BY 1, 2) tol ON tol.reg = a.reg AND tol.r = a.r JOIN full_ b ON b.reg = a.reg AND b.p = a.p AND b.r <> a.r JOIN full_ c ON c.reg = a.reg AND c.p = a.p AND c.r <> a.r AND c.r > b.r GROUP BY 1, 2, 3, 4),
    l AS (SELECT DISTINCT reg, r, CASE WHEN r >= 1000 THEN 'A' WHEN r % 2 = 0 THEN 'E' ELSE 'L' END k FROM full_),
    sc_ AS (SELECT t.reg, a, b, c, n, CASE WHEN x.k = 'A' THEN 2 ELSE 0 END s0, CASE WHEN y.k = 'L' THEN 2 ELSE 0 END + CASE WHEN z.k = 'E' THEN 2 ELSE 0 END s1, CASE WHEN z.k = 'L' THEN 2 ELSE 0 END + CASE WHEN y.k = 'E' THEN 2 ELSE 0 END s2 FROM t JOIN l x ON x.reg = t.reg AND x.r = a JOIN l y ON y.reg = t.reg AND y.r = b JOIN l z ON z.reg = t.reg AND z.r = c WHERE ok),
    g AS (SELECT reg, a, CASE WHEN s2 > s1 THEN c ELSE b END li, CASE WHEN s2 > s1 THEN b ELSE c END eq, s0 + greatest(s1, s2) sc, n FROM sc_), h AS (SELECT *, row_number() OVER (PARTITION BY reg ORDER BY sc DESC, n DESC, a, li, eq) k, max(sc) OVER (PARTITION BY reg) m FROM g)
    SELECT reg, CAST(max(CASE WHEN k = 1 THEN a END) AS INTEGER) AS assets, CAST(max(CASE WHEN k = 1 THEN li END) AS INTEGER) AS liabilities, CAST(max(CASE WHEN k = 1 THEN eq END) AS INTEGER) AS equity, CAST(max(m) AS INTEGER) AS score, CASE WHEN max(m) > 0 THEN 'label' ELSE 'value' END AS how, CAST(count(*) FILTER (sc = m) - 1 AS INTEGER) AS alternates FROM h GROUP BY 1""")
def balance_anchor(t: Tables) -> DataFrame:
    """The rows of each region that make a balance sheet: totals are labelled assets, nations liabilities or equity."""
    s = region_rows(t)
    label = F.when(F.col("row") >= 1000, "Total assets").when(F.col("row") % 2 == 0, "Total equity").otherwise("Total liabilities")
    labels = s.select("reg", F.col("r").alias("row")).distinct().withColumn("label", label)
    return binding.balance_anchor(identities.value_triples(s, ["reg"], "r", "p", "v"), labels, ["reg"])


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) k FROM customer), r AS (SELECT c_nationkey nation, c_custkey r, k, CASE WHEN c_custkey % 4 = 0 THEN 'o' WHEN c_custkey % 4 = 1 THEN 'i' WHEN c_custkey % 4 = 2 THEN 'f' ELSE '' END l FROM c WHERE k <= 3),
    w AS (SELECT a.nation, a.r cfo, b.r cfi, d.r cff, CASE WHEN a.l = 'o' THEN 2 ELSE 0 END + CASE WHEN b.l = 'i' THEN 2 ELSE 0 END + CASE WHEN d.l = 'f' THEN 2 ELSE 0 END score, a.k * 100 + b.k * 10 + d.k o FROM r a JOIN r b ON b.nation = a.nation AND b.k <> a.k JOIN r d ON d.nation = a.nation AND d.k <> a.k AND d.k <> b.k)
    SELECT nation, cfo, cfi, cff, CAST(score AS INTEGER) AS score FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY score DESC, o) n FROM w) WHERE n = 1""")
def flow_binding(t: Tables) -> DataFrame:
    """The first three customers of a nation as the flows of a cash-flow statement, by what their labels say, else in order."""
    k = F.col("c_custkey") % 4
    label = F.when(k == 0, "Net cash from operating activities").when(k == 1, "Net cash used in investing").when(k == 2, "Net cash used in financing").otherwise("Other")
    first = t.customer.withColumn("k", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))).filter("k <= 3").withColumn("label", label)
    said = {"cfo": r"operating activities", "cfi": "investing", "cff": "financing"}
    scored = first.select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("row"), "k", *[F.when(F.lower("label").contains(w), 2).otherwise(0).alias(r) for r, w in said.items()])
    return binding.assign_roles(scored, ["nation"], "row", list(said), "k")


@query("""WITH c AS (SELECT 'c' || c_custkey c, 'n' || c_nationkey n FROM customer), n AS (SELECT 'n' || n_nationkey n, 'r' || n_regionkey r FROM nation)
    SELECT c AS start, 0 AS step, c AS node FROM c UNION ALL SELECT c, 1, n FROM c UNION ALL SELECT c, 2, r FROM c JOIN n USING (n)""")
def total_chain(t: Tables) -> DataFrame:
    """Customers walked back to nations and regions, as a result is to the totals it is made from; regions point at themselves."""
    k = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    g = F.lit("g").alias("grp")
    feeds = t.customer.select(g, k("c", "c_custkey").alias("node"), k("n", "c_nationkey").alias("before")).unionByName(t.nation.select(g, k("n", "n_nationkey").alias("node"), k("r", "n_regionkey").alias("before")))
    feeds = feeds.unionByName(t.nation.select(g, k("r", "n_regionkey").alias("node"), k("r", "n_regionkey").alias("before")))
    return binding.chain_back(t.customer.select(g, k("c", "c_custkey").alias("start")), feeds).select("start", "step", "node")
