"""Binding lines to roles by what their values and formulas say, with labels to choose between what fits: the balance sheet's
anchor, flows of a total, chains of totals."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.ontology import named_roles
from gridloom.tables import materialise

#: Longest chain of totals that is walked back (fixed value).
CHAIN = 12


def label_score(label: Column, role: str) -> Column:
    """2 if a label's wording is this role's alone, 1 if it shows it among others, else 0."""
    said = named_roles(F.coalesce(label, F.lit("")))
    return F.when(F.array_contains(said, role), F.when(F.size(said) == 1, 2).otherwise(1)).otherwise(0)


def assign_roles(rows: DataFrame, keys: list[str], row: str, scores: list[str], order: str) -> DataFrame:
    """Two or three rows of each key given one role each so that the scores add up to the most: keys, role columns, score.

    All orders are tried; of equally good ones the first by ``order`` wins, so rows without telling labels keep their
    order. Keys with another number of rows than there are roles give nothing.
    """
    n = len(scores)
    if n not in (2, 3):
        raise ValueError("two or three roles")
    each = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(row).alias("row"), *[F.col(s).alias(f"s{i}") for i, s in enumerate(scores)]))).alias("_r")).filter(F.size("_r") == n)
    at = lambda k: F.col("_r")[k]
    ways = [F.struct(sum((at(k)[f"s{i}"] for i, k in enumerate(p)), F.lit(0)).alias("score"), F.lit(-j).alias("first"), *[at(k)["row"].alias(s) for s, k in zip(scores, p)]) for j, p in enumerate(permutations(range(n)))]
    best = F.array_max(F.array(*ways))
    return each.select(*keys, best.alias("b")).select(*keys, *[F.col(f"b.{s}").alias(s) for s in scores], F.col("b.score").alias("score"))


def balance_anchor(triples: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows a = b + c the one that is the balance sheet: keys, assets, liabilities, equity, score, how, alternates.

    ``triples`` has keys, a, b, c, sign_b, sign_c, n_periods, ``labels`` keys, row, label. The label of a must speak for assets
    and those of b and c for liabilities and equity, in whichever order scores more; more periods, then the smaller row
    decide between equals. How is label if anything speaks for it, else value; alternates counts triples as good.
    """
    score = {r: label_score(F.col("label"), r) for r in ("assets", "liabilities", "equity")}
    said = labels.select(*keys, "row", *[v.alias(k) for k, v in score.items()])
    out = triples.filter("sign_b = 1 and sign_c = 1")
    for x in "abc":
        out = out.join(said.select(*keys, F.col("row").alias(x), *[F.coalesce(k, F.lit(0)).alias(f"{x}_{k}") for k in score]), [*keys, x], "left")
    s = lambda x, k: F.coalesce(F.col(f"{x}_{k}"), F.lit(0))
    plain, swapped = s("b", "liabilities") + s("c", "equity"), s("c", "liabilities") + s("b", "equity")
    swap = swapped > plain
    got = out.select(*keys, F.col("a").alias("assets"), F.when(swap, F.col("c")).otherwise(F.col("b")).alias("liabilities"), F.when(swap, F.col("b")).otherwise(F.col("c")).alias("equity"), (s("a", "assets") + F.greatest(plain, swapped)).alias("score"), "n_periods")
    rank = F.struct("score", "n_periods", -F.col("assets"), -F.col("liabilities"), -F.col("equity"))
    best = got.groupBy(*keys).agg(F.max_by(F.struct("assets", "liabilities", "equity", "score", "n_periods"), rank).alias("x"), F.collect_list("score").alias("_all"))
    alternates = F.size(F.filter("_all", lambda v: v == F.col("x.score"))) - 1
    return best.select(*keys, "x.assets", "x.liabilities", "x.equity", "x.score", F.when(F.col("x.score") > 0, "label").otherwise("value").alias("how"), alternates.alias("alternates"))


def chain_back(starts: DataFrame, feeds: DataFrame, key: str = "grp", longest: int = CHAIN) -> DataFrame:
    """The chain of totals behind each start (key, start): key, start, step, node, from the start itself on.

    ``feeds`` (key, node, before) names for a total the total it is made from; of several the smallest counts. A chain ends at a
    node made from none, where it comes back to itself, or after ``longest`` steps.
    """
    prev = materialise(feeds.groupBy(key, "node").agg(F.min("before").alias("before")))
    at = materialise(starts.select(key, "start").distinct().select(key, "start", F.lit(0).alias("step"), F.col("start").alias("node"), F.array("start").alias("_seen")))
    out = at
    for k in range(1, longest + 1):
        at = materialise(at.join(prev, [key, "node"]).filter(~F.array_contains("_seen", F.col("before"))).select(key, "start", F.lit(k).alias("step"), F.col("before").alias("node"), F.array_append("_seen", F.col("before")).alias("_seen")))
        if at.isEmpty():
            break
        out = out.unionByName(at)
    return out.drop("_seen")
