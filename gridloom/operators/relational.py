"""Joins, predicates and aggregates with the semantics model reviews need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRENGTH = {"direct": 3, "offset": 3, "active": 2, "inactive": 1}


def newest(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row a key, of the greatest version; of equal versions one chosen by a hash of the row."""
    w = Window.partitionBy(*keys).orderBy(F.desc(version), F.xxhash64(*[F.col(c) for c in df.columns if not c == "layout"]))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def overlay(df: DataFrame, patch: DataFrame, keys: list[str], value: str) -> DataFrame:
    """What-if values: a patched key takes the patch's value even if that is null."""
    p = patch.select(*keys, F.col(value).alias("_patched"), F.lit(True).alias("_is"))
    return df.join(p, keys, "left").withColumn(value, F.when(F.col("_is"), F.col("_patched")).otherwise(F.col(value))).drop("_patched", "_is")


def strongest_kind(edges: DataFrame, keys: list[str], kind: Column, sequence: Column) -> DataFrame:
    """The strongest kind of each pair; of equally strong ones the first in sequence."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in STRENGTH.items() for x in kv]), kind), F.lit(0))
    return edges.groupBy(*keys).agg(F.max_by(kind, F.struct(rank, -sequence)).alias("kind"))


def connections(edges: DataFrame, node: list[str], other: str, k: int) -> DataFrame:
    """The k most connected nodes: edges and distinct others, ties by node."""
    out = edges.groupBy(*node).agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct(other).alias("n_others"))
    return out.orderBy(F.desc("n_edges"), *node).limit(k)


def like_text(pattern: str) -> str:
    """A search text as a LIKE pattern with its wildcards taken literally."""
    return "%" + pattern.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_") + "%"


def criterion(value: Column, crit: str) -> Column:
    """A spreadsheet criterion: an operator and a number or text, wildcards ``*`` and ``?`` in text, or a plain value."""
    op = next((o for o in ("<=", ">=", "<>", "<", ">", "=") if crit.startswith(o)), "=")
    rest = crit[len(op) :] if crit.startswith(op) else crit
    try:
        number = float(rest)
    except ValueError:
        number = None
    if number is not None:
        x = value.try_cast("double")
        same = F.coalesce(F.abs(x - number) < 1e-9, F.lit(False))
        return {"<=": x <= number, ">=": x >= number, "<": x < number, ">": x > number, "=": same, "<>": ~same}[op]
    t = F.lower(F.trim(value.cast("string")))
    if "*" in rest or "?" in rest:
        import re as _re

        rx = "".join(".*" if c == "*" else "." if c == "?" else _re.escape(c) for c in rest.lower().strip())
        hit = t.rlike(f"(?s)^{rx}$")
    else:
        hit = t == rest.lower().strip()
    return {"=": hit, "<>": ~hit}.get(op, F.lit(False))


def choose(index: Column, *branches: Column) -> Column:
    """The branch a whole number from 1 points at, as CHOOSE does; null beyond them."""
    out = F.when(F.lit(False), branches[0])
    for k, branch in enumerate(branches, 1):
        out = out.when(F.floor(index) == k, branch)
    return out


def loosely_equal(a: Column, b: Column) -> Column:
    """Texts agree trimmed and without case, numbers within a billionth; a number never equals a text."""
    x, y = a.try_cast("double"), b.try_cast("double")
    text = F.lower(F.trim(a.cast("string"))) == F.lower(F.trim(b.cast("string")))
    return F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) < 1e-9).otherwise(text)


def first_match(df: DataFrame, keys: list[str], hit: Column, order: list[str]) -> DataFrame:
    """Position and row of the first match of each key, as MATCH with exact type finds it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    at = df.withColumn("position", F.row_number().over(w)).filter(hit)
    return at.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("position"))).filter("_n = 1").drop("_n")


def sum_known(v: Column) -> Column:
    """Null only if nothing is known."""
    return F.sum(v)


def sum_strict(v: Column) -> Column:
    """Null if anything is unknown."""
    return F.when(F.count(v) == F.count(F.lit(1)), F.sum(v))


def rollup_period(df: DataFrame, keys: list[str], year: Column, order: str, value: str, whole: int) -> DataFrame:
    """Periods to years: strict sum, first and last, the periods found and whether some are missing."""
    out = df.withColumn("fy", year).groupBy(*keys, "fy")
    return out.agg(
        sum_strict(F.col(value)).alias("v_sum"), F.max_by(value, order).alias("v_last"), F.min_by(value, order).alias("v_first"),
        F.count(F.lit(1)).alias("n_periods"),
    ).withColumn("partial", F.col("n_periods") < whole)
