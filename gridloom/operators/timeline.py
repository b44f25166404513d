"""Windows over ordered rows: runs, islands, fill-down, periodicity, signs, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, keys: list[str], at: Column, by: list[Column] | None = None) -> DataFrame:
    """Maximal runs of consecutive integers ``at`` with equal ``by``: keys, run_start, run_end, n."""
    by = by or []
    rows = df.select(*keys, at.cast("long").alias("_at"), *[c.alias(f"_b{i}") for i, c in enumerate(by)]).distinct()
    bs = [f"_b{i}" for i in range(len(by))]
    island = F.col("_at") - F.row_number().over(Window.partitionBy(*keys, *bs).orderBy("_at"))
    out = rows.withColumn("_i", island).groupBy(*keys, *bs, "_i")
    return out.agg(F.min("_at").alias("run_start"), F.max("_at").alias("run_end"), F.count(F.lit(1)).alias("n")).drop("_i")


def longest_run(df: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """The longest run of each key, the first of equally long ones."""
    return runs(df, keys, at).groupBy(*keys).agg(F.max_by(F.struct("run_start", "run_end", "n"), F.struct("n", -F.col("run_start"))).alias("r")).select(*keys, "r.*")


def fill_down(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """The last known value at or above each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


#: Names of typical gaps in days (fixed values).
PERIODICITIES = (("daily", 1), ("weekly", 7), ("monthly", 30), ("quarterly", 91), ("half-yearly", 182), ("annual", 365))


def periodicity(gap: Column) -> Column:
    """Name of a typical gap in days: within a day or a tenth of the named one, ``?`` if there is no gap."""
    out = F.when(gap.isNull(), "?")
    for name, days in PERIODICITIES:
        out = out.when(F.abs(gap - days) <= max(1, days * 0.1), name)
    text = F.when(gap == F.floor(gap), gap.cast("bigint").cast("string")).otherwise(gap.cast("string"))
    return out.otherwise(F.concat(F.lit("~"), text, F.lit("-day")))


def typical_gap(df: DataFrame, keys: list[str], when: str) -> DataFrame:
    """Median days between neighbouring distinct dates of each key."""
    one = df.select(*keys, when).distinct()
    gap = F.datediff(F.lead(when).over(Window.partitionBy(*keys).orderBy(when)), F.col(when))
    return one.withColumn("gap", gap).groupBy(*keys).agg(F.median("gap").alias("gap"))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows of each key; ranks are limited before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def sign_runs(df: DataFrame, keys: list[str], order: str, value: str, most: int = 40) -> DataFrame:
    """Run-length code of signs in order, such as ``+x12 0x3``, at most ``most`` runs of it; ``_`` stands for no value."""
    sign = F.when(F.col(value).isNull(), "_").when(F.col(value) > 0, "+").when(F.col(value) < 0, "-").otherwise("0")
    w = Window.partitionBy(*keys).orderBy(order)
    marked = df.select(*keys, order, sign.alias("_s")).withColumn("_new", F.when(F.lag("_s").over(w) == F.col("_s"), 0).otherwise(1))
    numbered = marked.withColumn("_r", F.sum("_new").over(w))
    each = numbered.groupBy(*keys, "_r").agg(F.first("_s").alias("_s"), F.count(F.lit(1)).alias("_n")).filter(F.col("_r") <= most)
    code = F.transform(F.array_sort(F.collect_list(F.struct("_r", "_s", "_n"))), lambda x: F.concat(x["_s"], F.lit("x"), x["_n"].cast("string")))
    return each.groupBy(*keys).agg(F.array_join(code, " ").alias("runs"))


def column_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per text column: filled values, mean length, label score n x min(mean length, 20) and distinct share."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("x.*")
    out = long.filter("v is not null and v <> ''").groupBy("column_name").agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("v")).alias("avg_len"), F.countDistinct("v").alias("n_distinct"))
    return out.select("column_name", "n", "avg_len", (F.col("n") * F.least("avg_len", F.lit(20.0))).alias("score"), (F.col("n_distinct") / F.col("n")).alias("distinct_ratio"))
