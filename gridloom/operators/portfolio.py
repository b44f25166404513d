"""What a reviewer asks of many models at once: names for unlabelled lines, counts of readers, pages, findings in order, graphs in figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.graphs import closure
from gridloom.tables import sheet_key, trimmed

LINE = ["workbook_id", "sheet", "row"]
#: Words of check rows, bounds of a page, severities in order.
CHECK = r"(?i)check|error|integrity"
LEAST_PAGE, MOST_PAGE = 1, 1000
SEVERITIES = ["high", "medium", "low", "info"]
#: A reference to one row of a named sheet, in A1 notation: quoted or plain sheet, and the row.
ONE_ROW = r"^=?(?:'((?:[^']|'')+)'|([^'!\[\]]+))!\$?[A-Za-z]{1,3}\$?([0-9]+)(?::\$?[A-Za-z]{1,3}\$?([0-9]+))?$"


def is_check(label: Column) -> Column:
    """Whether a label names a check; no label does not."""
    return F.coalesce(label.rlike(CHECK), F.lit(False))


def named_lines(lines: DataFrame, names: DataFrame) -> DataFrame:
    """Lines (workbook_id, sheet, row, label) with the name of unlabelled ones: the least defined name that points at their row.

    Names that point at several rows, other files, constants or broken references name no line.
    """
    ref = trimmed(F.col("ref"))
    part = lambda k: F.regexp_extract(ref, ONE_ROW, k)
    sheet = F.when(part(1) != "", F.replace(part(1), F.lit("''"), F.lit("'"))).otherwise(part(2))
    to = names.filter(ref.rlike(ONE_ROW) & ~ref.contains("[")).select("workbook_id", "name", sheet_key(sheet).alias("k"), part(3).try_cast("int").alias("row"), part(4).try_cast("int").alias("r2"))
    best = to.filter("r2 is null or r2 = `row`").groupBy("workbook_id", "k", "row").agg(F.min("name").alias("_name"))
    blank = F.col("label").isNull() | (trimmed(F.col("label")) == "")
    got = lines.withColumn("k", sheet_key(F.col("sheet"))).join(best, ["workbook_id", "k", "row"], "left").drop("k")
    return got.withColumn("shown", F.when(blank, F.col("_name")).otherwise(F.col("label"))).drop("_name")


def reader_counts(lines: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines with the lines they read and are read by; 0 where there are none."""
    def per(end: str, name: str) -> DataFrame:
        return edges.groupBy("workbook_id", F.col(f"{end}_sheet").alias("sheet"), F.col(f"{end}_row").alias("row")).agg(F.count(F.lit(1)).alias(name))

    out = lines.join(per("src", "n_reads"), LINE, "left").join(per("dst", "n_read_by"), LINE, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_reads", "n_read_by")})


def labelled_edges(edges: DataFrame, lines: DataFrame) -> DataFrame:
    """Edges with the labels of both ends; an end that is no line has none."""
    out = edges
    for end in ("src", "dst"):
        out = out.join(lines.select("workbook_id", F.col("sheet").alias(f"{end}_sheet"), F.col("row").alias(f"{end}_row"), F.col("label").alias(f"{end}_label")), ["workbook_id", f"{end}_sheet", f"{end}_row"], "left")
    return out


def page(df: DataFrame, keys: list[str], order: list[Column], size: int) -> DataFrame:
    """The first ``size`` rows of each key in order, ``size`` held between 1 and 1000; with their place."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= max(LEAST_PAGE, min(MOST_PAGE, size)))


def newest_first(df: DataFrame, key: str, at: str) -> DataFrame:
    """One row a key in order of its latest time, newest first, ties by key: the place is that among all keys."""
    last = df.groupBy(key).agg(F.max(at).alias("latest"))
    return last.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("latest"), key)))  # keys are models, not rows


def ordered_findings(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Findings (keys, kind, severity) once each, of repeats the gravest; with their place within ``keys`` by severity, then kind."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity")).cast("int"), F.lit(0))
    rank = F.when(rank == 0, len(SEVERITIES) + 1).otherwise(rank)
    one = findings.groupBy(*keys, "kind").agg(F.min(F.struct(rank.alias("r"), "severity")).alias("s")).select(*keys, "kind", F.col("s.severity").alias("severity"), F.col("s.r").alias("_r"))
    return one.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("_r", "kind"))).drop("_r")


def residual_peaks(res: DataFrame, keys: list[str], period: str, tol: Column) -> DataFrame:
    """The period of the greatest residual (the first of equals) and the first that fails."""
    size = F.abs("residual")
    return res.groupBy(*keys).agg(F.max_by(period, F.struct(size, -F.unix_date(F.col(period)))).alias("worst_period"), F.min(F.when(size > tol, F.col(period))).alias("first_failing"))


def coverage(lines: DataFrame, ties: DataFrame, static: DataFrame, keys: list[str], line: list[str]) -> DataFrame:
    """Per ``keys``: lines, those neither tied to another row nor static, and whether every line is covered."""
    known = ties.select(*line).unionByName(static.select(*line)).distinct().withColumn("_c", F.lit(True))
    return lines.select(*line).distinct().join(known, line, "left").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("_c").isNull()).alias("n_open"), F.bool_and(F.col("_c").isNotNull()).alias("covered"))


def single_column(parts: DataFrame, keys: list[str], part: str, col: str) -> DataFrame:
    """Of each block the first column in which all its parts have a value; null where there is none."""
    need = parts.groupBy(*keys).agg(F.countDistinct(part).alias("_need"))
    have = parts.groupBy(*keys, col).agg(F.countDistinct(part).alias("_n"))
    return need.join(have, keys).groupBy(*keys).agg(F.min(F.when(F.col("_n") == F.col("_need"), F.col(col))).alias("column"))


def period_amount(df: DataFrame, keys: list[str], period: str, value: str, at: Column) -> DataFrame:
    """What falls on the one period whose date is ``at``; 0 where no period has it."""
    return df.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col(period) == at, F.col(value))), F.lit(0)).alias("amount"))


def typed_value(value: Column) -> Column:
    """A text as (kind, number, day): a number, a percentage as its fraction, a day in ISO form, or a name."""
    t = trimmed(value)
    number, share = t.try_cast("double"), F.regexp_extract(t, r"^([-+]?[0-9]*\.?[0-9]+) ?%$", 1)
    day = F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.substring(t, 1, 10).try_cast("date"))
    plain = t.rlike(r"^[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?$")
    none = F.lit(None)
    make = lambda kind, x, d: F.struct(F.lit(kind).alias("kind"), x.cast("double").alias("number"), d.cast("date").alias("day"))
    return F.when(plain, make("number", number, none)).when(share != "", make("percent", share.try_cast("double") / 100, none)).when(day.isNotNull(), make("date", none, day)).when(t.rlike(r"^[\p{L}_]"), make("name", none, none))


def leaf_terms(links: DataFrame, tops: DataFrame, key: str = "grp") -> DataFrame:
    """Leaves under each top (key, top) along links (key, node, child, sign), with the product of signs on the way.

    A leaf reached on several ways counts once for each way, added up; links must not be circular. Levels are joined one
    after another, so rounds are as many as the deepest total has levels.
    """
    at, out = tops.select(key, "top", F.col("top").alias("node"), F.lit(1).alias("coef")), None
    inner = links.select(key, "node").distinct()
    while True:
        leaf = at.join(inner, [key, "node"], "left_anti")
        out = leaf if out is None else out.unionByName(leaf)
        at = at.join(links.select(key, "node", "child", "sign"), [key, "node"]).select(key, "top", F.col("child").alias("node"), (F.col("coef") * F.col("sign")).alias("coef"))
        if at.isEmpty():
            return out.groupBy(key, "top", F.col("node").alias("leaf")).agg(F.sum("coef").cast("int").alias("coef"))


def graph_figures(nodes: DataFrame, links: DataFrame, key: str = "grp") -> DataFrame:
    """Per graph: nodes, links, density (links of all that could be) and nodes without any link."""
    ends = links.select(key, F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("_t", F.lit(True))
    n = nodes.select(key, "node").unionByName(ends.select(key, "node")).distinct().join(ends, [key, "node"], "left")
    per = n.groupBy(key).agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("_t").isNull()).alias("n_isolated"))
    m = links.select(key, "src", "dst").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n_links"))
    out = per.join(m, key, "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    most = F.col("n_nodes") * (F.col("n_nodes") - 1)
    return out.withColumn("density", F.when(most > 0, F.round(F.col("n_links") / most, 6)).otherwise(0.0))


def total_columns(values: DataFrame, headers: DataFrame, keys: list[str], row: str, col: str, value: str) -> DataFrame:
    """The total column of each sheet: one whose heading says so, else the last in which more than half of three rows or more add up.

    ``values`` (keys, row, col, value) are the figures, ``headers`` (keys, col, text) the headings. A row adds up if its
    last figure is the sum of those before it, within a millionth.
    """
    said = headers.filter(F.lower("text").contains("total")).groupBy(*keys).agg(F.min(col).alias("by_text"))
    last = F.max(F.struct(col, value)).alias("_l")
    per = values.groupBy(*keys, row).agg(last, F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_n")).filter("_n > 2")
    rest, top = F.col("_s") - F.col(f"_l.{value}"), F.col(f"_l.{value}")
    fits = F.abs(rest - top) <= 1e-6 * F.greatest(F.abs(top), F.lit(1.0))
    cols = per.groupBy(*keys, F.col(f"_l.{col}").alias(col)).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(fits).alias("n_fit"))
    found = cols.filter((F.col("n_rows") >= 3) & (2 * F.col("n_fit") > F.col("n_rows"))).groupBy(*keys).agg(F.max(col).alias("by_sum"))
    out = values.select(*keys).distinct().join(said, keys, "left").join(found, keys, "left")
    return out.withColumn("total_col", F.coalesce("by_text", "by_sum")).withColumn("how", F.when(F.col("by_text").isNotNull(), "heading").when(F.col("by_sum").isNotNull(), "sum")).drop("by_text", "by_sum").filter("total_col is not null")


def rows_read(formulas: DataFrame) -> DataFrame:
    """Rows of the own sheet that formulas (workbook_id, sheet, row, formula) read by plain A1 references, ranges by their ends.

    Blind on INDIRECT and OFFSET, whole columns and other sheets, as the text alone does not tell their rows.
    """
    bare = F.regexp_replace("formula", r"\"[^\"]*\"|(?:'[^']*'|[\p{L}_][\p{L}\p{N}_.]*)![$A-Z0-9:]+", " ")
    refs = F.regexp_extract_all(bare, F.lit(r"(?:^|[^A-Za-z0-9_.$])\$?[A-Z]{1,3}\$?([0-9]+)(?=$|[^A-Za-z0-9_.(])"), F.lit(1))
    seen = formulas.filter(~F.col("formula").rlike(r"(?i)\b(?:INDIRECT|OFFSET)\("))
    return seen.select("workbook_id", "sheet", "row", F.explode(F.array_distinct(F.transform(refs, lambda x: x.try_cast("int")))).alias("read_row")).filter("read_row is not null").distinct()


def usage(df: DataFrame, at: str, by: list[str], amount: str) -> DataFrame:
    """Cost per day and ``by``: calls and the amount, 0 where none is known."""
    return df.groupBy(F.to_date(at).alias("day"), *by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(amount), F.lit(0)).alias("amount"))


def typed_majority(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of each key as one row: how many there are, how many are typed, and assumption if those are the most, else calculation."""
    typed = (F.col("n_const") > 0) & (F.col("n_const") >= 3 * F.col("n_formula"))
    out = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(typed).alias("n_typed"))
    return out.withColumn("class", F.when(2 * F.col("n_typed") > F.col("n_rows"), "assumption").otherwise("calculation"))


def beyond(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, key: str = "grp") -> DataFrame:
    """Nodes no way from the seeds leads to."""
    return nodes.select(key, "node").distinct().join(closure(seeds, edges, key).select(key, "node"), [key, "node"], "left_anti")
