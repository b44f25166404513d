"""Linear identities between rows of values: residuals, sign conventions, roll-forwards, ties, subtotals, breaks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REL, ABS = 1e-6, 1e-6


def tolerance(scale: Column, rel: float = REL, absolute: float = ABS) -> Column:
    return F.greatest(F.lit(absolute), F.lit(rel) * scale)


def residuals(parts: DataFrame, keys: list[str], period: str, coef: str, value: str, n_parts: int) -> DataFrame:
    """Sum of coefficient x value per identity and period, over periods in which all parts are known."""
    return parts.filter(F.col(value).isNotNull()).groupBy(*keys, period).agg(
        F.sum(F.col(coef) * F.col(value)).alias("residual"), F.max(F.abs(value)).alias("scale"), F.count(F.lit(1)).alias("_n")
    ).filter(F.col("_n") == n_parts).drop("_n")


def verdict(res: DataFrame, keys: list[str], period: str, rel: float = REL, absolute: float = ABS) -> DataFrame:
    """Per identity: the largest residual, failing periods in order, periods checked, holds or fails."""
    tol = res.groupBy(*keys).agg(tolerance(F.max("scale"), rel, absolute).alias("tol"))
    bad = F.abs("residual") > F.col("tol")
    out = res.join(tol, keys).groupBy(*keys).agg(
        F.max(F.abs("residual")).alias("max_residual"), F.array_sort(F.collect_list(F.when(bad, F.col(period)))).alias("failing"), F.count(F.lit(1)).alias("n_periods")
    )
    return out.withColumn("status", F.when(F.size("failing") == 0, "holds").otherwise("fails"))


def best_signs(parts: DataFrame, keys: list[str], period: str, coef: str, value: str, flex: str, n_parts: int) -> DataFrame:
    """Both conventions of the parts marked ``flex`` are tried; the one with the smaller largest residual is kept."""
    both = parts.withColumn("convention", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumn("_c", F.col(coef) * F.when(F.col(flex), F.col("convention")).otherwise(1))
    res = residuals(both, [*keys, "convention"], period, "_c", value, n_parts)
    worst = res.groupBy(*keys, "convention").agg(F.max(F.abs("residual")).alias("max_residual"), F.count(F.lit(1)).alias("n_periods"))
    return worst.groupBy(*keys).agg(F.min_by(F.struct("convention", "max_residual", "n_periods"), F.struct("max_residual", -F.col("convention"))).alias("b")).select(*keys, "b.*")


def roll_forward(df: DataFrame, keys: list[str], period: str, closing: str, moves: Column) -> DataFrame:
    """Opening is the closing one period before; residual of opening + moves - closing where there is one before."""
    opening = F.lag(closing).over(Window.partitionBy(*keys).orderBy(period))
    return df.withColumn("opening", opening).withColumn("residual", F.col("opening") + moves - F.col(closing)).filter("opening is not null")


def signatures(values: DataFrame, keys: list[str], period: str, value: str, digits: int = 2) -> DataFrame:
    """One digest a row of values over all its periods, of the values and of their negatives; equal rows share one."""
    cell = lambda sign: F.concat_ws(":", F.col(period).cast("string"), F.round(sign * F.col(value), digits).cast("decimal(38,6)").cast("string"))
    zero = F.sum(F.abs(F.round(value, digits)))
    return values.groupBy(*keys).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(cell(F.lit(1)))), "|"), 256).alias("sig"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(cell(F.lit(-1)))), "|"), 256).alias("neg"), F.count(F.lit(1)).alias("n_periods"), zero.alias("_size"),
    ).filter("_size > 0").drop("_size")


def tied_rows(values: DataFrame, keys: list[str], row: str, period: str, value: str) -> DataFrame:
    """Rows equal to another row of their key in every period, up to sign: row, the smallest of its class, and the sign.

    Digests are joined, not pairs of rows: a class of n equal rows gives n rows, not n squared.
    """
    sig = signatures(values, [*keys, row], period, value)
    both = sig.withColumn("canon", F.least("sig", "neg")).withColumn("flipped", F.col("neg") < F.col("sig"))
    w = Window.partitionBy(*keys, "canon", "n_periods")
    out = both.withColumn("class_row", F.min(row).over(w)).withColumn("n_rows", F.count(F.lit(1)).over(w)).filter("n_rows > 1")
    first = F.max(F.when(F.col(row) == F.col("class_row"), F.col("flipped"))).over(w)
    return out.withColumn("sign", F.when(F.col("flipped") == first, 1).otherwise(-1)).select(*keys, row, "class_row", "sign", "n_rows")


def value_triples(values: DataFrame, keys: list[str], row: str, period: str, value: str) -> DataFrame:
    """Triples a = b + c (signs of b and c free) that hold in every period among each key's rows: keys, a, b, c, signs.

    All moving rows known in every period of their key take part. A key's pairs are made inside one task, a row at a time;
    a is looked up by its value in the period that spreads most, then held against the sum in all periods.
    """
    sizes = values.groupBy(*keys, row).agg(F.max(F.abs(value)).alias("_s"), (F.max(value) - F.min(value)).alias("_d")).filter((F.col("_s") > ABS) & (F.col("_d") > ABS))
    rows = values.join(sizes.select(*keys, row), [*keys, row]).filter(F.col(value).isNotNull()).select(*keys, row, period, value)
    kinds = {f.name: f.dataType.simpleString() for f in values.schema}
    out = ", ".join([*[f"{k} {kinds[k]}" for k in keys], *[f"{x} {kinds[row]}" for x in "abc"], "sign_b int", "sign_c int", "n_periods int"])

    def find(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index=row, columns=period, values=value, aggfunc="first")
        full = wide.dropna()
        v, ids = full.to_numpy(), full.index.to_list()
        got = []
        if len(v) > 2:
            size = np.abs(v).max(axis=1)
            tol = np.maximum(ABS, REL * size)
            p = np.ptp(v, axis=0).argmax()
            order = np.argsort(v[:, p])
            known = v[order, p]
        for i in range(len(ids) if len(v) > 2 else 0):
            j = np.arange(i + 1, len(ids))
            reach = np.maximum(ABS, 2 * REL * (size[i] + size[j]))  # no less than the tolerance of any a that fits
            for sb, sc in ((1, 1), (1, -1), (-1, 1), (-1, -1)):
                s = sb * v[i] + sc * v[j]
                lo, hi = np.searchsorted(known, s[:, p] - reach), np.searchsorted(known, s[:, p] + reach, "right")
                n = hi - lo
                at = np.repeat(np.arange(len(j)), n)
                a = order[np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)]
                ok = (np.abs(v[a] - s[at]) <= tol[a][:, None]).all(axis=1) & (a != i) & (a != j[at])
                got += [(*k, ids[x], ids[i], ids[y], sb, sc, v.shape[1]) for x, y in zip(a[ok], j[at[ok]])]
        return pd.DataFrame(got, columns=[*keys, "a", "b", "c", "sign_b", "sign_c", "n_periods"])

    return rows.groupBy(*keys).applyInPandas(find, out)


def pattern_breaks(df: DataFrame, keys: list[str], order: str, is_formula: Column, least: int = 6) -> DataFrame:
    """The first typed value inside a row of at least ``least`` formulas; one before the first formula is its seed."""
    w = Window.partitionBy(*keys)
    marked = df.withColumn("_f", is_formula).withColumn("_n", F.count_if("_f").over(w)).withColumn("_first", F.min(F.when(F.col("_f"), F.col(order))).over(w))
    odd = marked.filter(~F.col("_f") & (F.col("_n") >= least) & (F.col(order) > F.col("_first")))
    return odd.groupBy(*keys).agg(F.min(order).alias(order), F.count(F.lit(1)).alias("n_breaks"))


def row_scale(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Scale, whether a row is static (its values agree within the tolerance) and whether it is other than zero."""
    s = F.max(F.abs(value))
    out = df.groupBy(*keys).agg(s.alias("scale"), (F.max(value) - F.min(value)).alias("_spread"))
    return out.withColumn("is_static", F.col("_spread") <= ABS + REL * F.col("scale")).withColumn("is_nonzero", F.col("scale") > ABS).drop("_spread")
