"""Following a value to what it is made of: reach, decomposition into present values and bridge items, parts, validation, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.formula import FormulaError, tokens
from gridloom.functions.finance import as_rate
from gridloom.operators.cashflow import factor, present_value
from gridloom.operators.graphs import closure
from gridloom.operators.portfolio import is_check
from gridloom.tables import materialise

#: How deep a value is followed, how deep the parts of a cash flow, how large a figure of a check may be.
REACH_DEPTH, TERM_DEPTH, PART_DEPTH, NIL = 5, 6, 3, 1e-6


def reaches(tops: DataFrame, links: DataFrame, targets: DataFrame, key: str = "grp", depth: int = REACH_DEPTH) -> DataFrame:
    """Targets (key, node) found at most ``depth`` links below each graph's tops (key, node): key, node, depth."""
    return closure(tops, links, key, depth=depth).join(targets.select(key, "node").distinct(), [key, "node"], "left_semi")


def decompose(tops: DataFrame, terms: DataFrame, stops: DataFrame, key: str = "grp", depth: int = TERM_DEPTH) -> DataFrame:
    """A value as signed items: key, top, node, sign, kind.

    Terms (key, node, child, sign) are followed from the tops (key, top) level by level, to present values, which are the
    nodes in ``stops`` (kind pv), and to nodes without terms (kind item). What still has terms ``depth`` levels down is
    undecomposable. An item met on several ways counts once for each, added up.
    """
    end, inner = stops.select(key, "node").distinct().withColumn("_pv", F.lit(True)), terms.select(key, "node").distinct().withColumn("_in", F.lit(True))
    at, out = tops.select(key, "top", F.col("top").alias("node"), F.lit(1).alias("sign")), None
    for level in range(depth + 1):
        seen = at.join(end, [key, "node"], "left").join(inner, [key, "node"], "left")
        kind = F.when(F.col("_pv"), "pv").when(F.col("_in").isNull(), "item").when(F.lit(level == depth), "undecomposable")
        told = materialise(seen.withColumn("kind", kind))
        done = told.filter("kind is not null").select(key, "top", "node", "sign", "kind")
        out = done if out is None else out.unionByName(done)
        at = told.filter("kind is null").select(key, "top", "node", "sign").join(terms.select(key, "node", "child", F.col("sign").alias("_s")), [key, "node"]).select(key, "top", F.col("child").alias("node"), (F.col("sign") * F.col("_s")).alias("sign"))
    return out.groupBy(key, "top", "node", "kind").agg(F.sum("sign").cast("int").alias("sign"))


def parts(tops: DataFrame, terms: DataFrame, key: str = "grp") -> DataFrame:
    """What a cash-flow row adds up, three levels down: rows reached by plain sums, with sign and kind as in :func:`decompose`."""
    nothing = terms.select(key, "node").limit(0)
    return decompose(tops, terms, nothing, key, PART_DEPTH)


def bridge(items: DataFrame, keys: list[str], order: str, sign: str, value: str) -> DataFrame:
    """Items of a value in order with what each adds and the running total."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    amount = F.col(sign) * F.col(value)
    return items.withColumn("amount", amount).withColumn("running", F.sum(amount).over(w))


def full_value(flows: DataFrame, adjustments: DataFrame, keys: list[str], end: str, flow: str, rates: list[float], valuation: Column) -> DataFrame:
    """Value at each rate (1 and more are per cent): discounted flows plus adjustments (keys, amount, at_valuation_date).

    Adjustments at the valuation date count in full, others are taken as year-end amounts one year on.
    """
    each = flows.withColumn("rate", F.explode(F.array(*[as_rate(F.lit(float(r))) for r in rates])))
    pv = present_value(factor(each, [*keys, "rate"], end, F.col("rate"), valuation), [*keys, "rate"], flow).select(*keys, "rate", "pv")
    adj = adjustments.groupBy(*keys).agg(F.sum(F.when(F.col("at_valuation_date"), F.col("amount"))).alias("_now"), F.sum(F.when(~F.col("at_valuation_date"), F.col("amount"))).alias("_later"))
    nil = F.lit(0.0)
    return pv.join(adj, keys, "left").withColumn("value", F.col("pv") + F.coalesce("_now", nil) + F.coalesce("_later", nil) / (1 + F.col("rate"))).drop("_now", "_later")


def validation(factors: DataFrame, keys: list[str], end: str, flow: str, factor_col: str, stated: DataFrame) -> DataFrame:
    """Steps of a valuation's check: there are flows, factors lie between 0 and 1 and fall, and flows by factors give the stated pv.

    ``stated`` has keys and pv. A step fails as a whole; the tolerance is a millionth of the pv.
    """
    w = Window.partitionBy(*keys).orderBy(end)
    live = factors.withColumn("_before", F.lag(F.when(F.col(factor_col) > 0, F.col(factor_col))).over(w))
    per = live.groupBy(*keys).agg(
        (F.count(flow) > 0).alias("cash_flows"), F.bool_and(F.col(factor_col).between(0, 1) & (F.col("_before").isNull() | (F.col(factor_col) <= F.col("_before")))).alias("factors"), F.sum(F.col(flow) * F.col(factor_col)).alias("_pv"))
    both = per.join(stated.select(*keys, "pv"), keys, "left")
    pv = F.coalesce(F.abs(F.col("_pv") - F.col("pv")) <= F.greatest(F.lit(1e-6), 1e-6 * F.abs("pv")), F.lit(False))
    step = lambda k, name, ok: F.struct(F.lit(k).alias("step"), F.lit(name).alias("name"), ok.alias("ok"))
    return both.select(*keys, F.explode(F.array(step(1, "cash flows", F.col("cash_flows")), step(2, "factors", F.col("factors")), step(3, "present value", pv))).alias("s")).select(*keys, "s.*")


def check_verdicts(lines: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows labelled as checks with what their saved values say: holds, fails, or unclear where there is no figure.

    A row of yes and no holds if all are yes, one of figures if all are nil; texts are left aside.
    """
    keys = ["workbook_id", "sheet", "row"]
    named = lines.filter(is_check(F.col("label"))).select(*keys).distinct()
    v = cells.join(named, keys, "left_semi").filter("value_kind in ('num', 'bool') and value_num is not null")
    per = v.groupBy(*keys).agg(F.bool_and(F.col("value_kind") == "bool").alias("_flags"), F.min("value_num").alias("_least"), F.max(F.abs("value_num")).alias("_most"), F.count(F.lit(1)).alias("n_values"))
    good = F.when(F.col("_flags"), F.col("_least") != 0).otherwise(F.col("_most") <= NIL)
    out = named.join(per, keys, "left")
    return out.select(*keys, F.coalesce("n_values", F.lit(0)).alias("n_values"), F.when(F.col("_most").isNull(), "unclear").when(good, "holds").otherwise("fails").alias("verdict"))


def aggregate_checks(checks: DataFrame, reads: DataFrame) -> DataFrame:
    """Checks (workbook_id, sheet, row) and the rows that read nothing but checks, to a fixed point: with the round they came in.

    ``reads`` has workbook_id, sheet, row and t_sheet, t_row; a row that reads itself is none.
    """
    keys = ["workbook_id", "sheet", "row"]
    known, level = materialise(checks.select(*keys).distinct().withColumn("round", F.lit(0))), 0
    links = materialise(reads.select(*keys, "t_sheet", "t_row").distinct())
    while True:
        level += 1
        hit = known.select("workbook_id", F.col("sheet").alias("t_sheet"), F.col("row").alias("t_row"), F.lit(True).alias("_hit"))
        full = links.join(hit, ["workbook_id", "t_sheet", "t_row"], "left").groupBy(*keys).agg(F.bool_and(F.col("_hit").isNotNull()).alias("_all")).filter("_all").select(*keys)
        new = materialise(full.join(known, keys, "left_anti").withColumn("round", F.lit(level)))
        if new.isEmpty():
            return known
        known = materialise(known.unionByName(new))


def split_top(expr: str, operators: str = "+-") -> list[tuple[str, str]] | None:
    """(operator, text) of a formula's terms at top level, outside brackets and quotes; None if it cannot be parsed.

    The first term has the operator + unless a sign stands before it; signs after an operator belong to the term.
    """
    try:
        toks = tokens(expr)
    except FormulaError:
        return None
    out, depth, op, text = [], 0, "+", ""
    for kind, t in toks:
        depth += (kind in ("open", "call")) - (kind == "close")
        if kind == "op" and t in operators and depth == 0 and (text.strip() or not out and op == "+"):
            if text.strip():
                out.append((op, text.strip()))
            op, text = t, ""
        else:
            text += t
    return [*out, (op, text.strip())] if text.strip() and depth == 0 else None


def in_words(formula: str, labels: dict[tuple[str, int], str], sheet: str) -> str:
    """A formula with its references replaced by the labels of their rows, where they have one: what it says to a reader."""
    from gridloom.functions.formula import area

    try:
        toks = tokens(formula)
    except FormulaError:
        return formula
    out = []
    for kind, text in toks:
        a = area(text) if kind == "ref" else None
        label = labels.get((a.sheet or sheet, a.r1)) if a is not None and a.r1 == a.r2 else None
        out.append(f"[{label}]" if label else text)
    return "".join(out)
