"""Filling containers of fixed capacity with texts measured in tokens, by sum-of-squares online packing.

A level array counts the open containers of each fill. Every text goes to the fill level for which the sum of
squared counts of partly filled containers is least afterwards. Texts are dealt to shards by a hash, each shard
packs its own containers, and what shards leave partly filled is packed again with the containers as items.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.tables import materialise

ITEMS_PER_SHARD = 20_000


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item, in the order given; sizes are 1..capacity, containers are numbered from 0.

    With N(h) containers filled to h, moving one from h to h+s changes the sum of squares by
    2 (N(h+s) - N(h)) + 2, by -2 N(h) + 1 if that fills it, and opening one by 2 N(s) + 1 (0 if it is full at
    once). Ties prefer the fuller level. An item that fills a container exactly takes that one.
    """
    level = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), np.int64)
    opened = 0
    for i, s in enumerate(sizes.tolist()):
        best, at = (2 * int(level[s]) + 1 if s < capacity else 0), 0
        if s < capacity:
            src = level[1 : capacity - s + 1]
            cost = 2 * (level[1 + s : capacity + 1] - src) + 2
            cost[-1] = 1 - 2 * src[-1]  # level[capacity] stays 0: full containers no longer count
            cost[src == 0] = np.iinfo(np.int64).max
            k = len(cost) - 1 - int(np.argmin(cost[::-1]))
            if cost[k] <= best:
                best, at = cost[k], k + 1
        if at:
            c = stacks[at].pop()
            level[at] -= 1
        else:
            c, opened = opened, opened + 1
        out[i] = c
        if at + s < capacity:
            level[at + s] += 1
            stacks[at + s].append(c)
    return out


def _pack(items: DataFrame, item: str, per_shard: int) -> DataFrame:
    """items: pack_id, capacity, ``item`` (long), size -> with shard and container within the shard."""
    loads = items.groupBy("pack_id").agg(F.count(F.lit(1)).alias("n"))
    shards = loads.select("pack_id", F.greatest(F.lit(1), F.ceil(F.col("n") / per_shard)).cast("int").alias("shards"))
    placed = items.join(F.broadcast(shards), "pack_id").withColumn("shard", F.pmod(F.xxhash64(item), F.col("shards")).cast("int")).drop("shards")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", item], kind="stable")
        return pdf.assign(container=sum_of_squares(pdf["size"].to_numpy(), int(pdf.capacity.iloc[0])))[["pack_id", "capacity", item, "size", "shard", "container"]]

    return placed.withColumn("order", F.xxhash64(F.lit(5), item)).groupBy("pack_id", "shard").applyInPandas(run, f"pack_id int, capacity int, {item} long, size int, shard int, container long")


def pack_documents(counts: DataFrame, packs: DataFrame, per_shard: int = ITEMS_PER_SHARD) -> DataFrame:
    """Every text's place in containers of each capacity: pack_id, doc_id, piece_no, tokens, container.

    ``counts`` has doc_id and n_tokens. A text is split only if it exceeds the capacity: into full containers of
    its own and one rest, which is packed like any text. Texts of no tokens take no room and have a null
    container, piece 0 and 0 tokens. Of rows with one doc_id the largest count holds; packs without a capacity of
    at least one token are left out. ``packs`` is the fixed list of container kinds.
    """
    kinds = packs.select(F.col("pack_id").cast("int").alias("pack_id"), F.col("capacity_tokens").cast("int").alias("capacity")).filter("capacity > 0").dropDuplicates(["pack_id"])
    sizes = [(r.pack_id, r.capacity) for r in kinds.orderBy("pack_id").collect()]
    docs = materialise(counts.filter("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.max("n_tokens"), F.lit(0)).alias("n")))
    every = F.array(*[F.struct(F.lit(p).alias("pack_id"), F.lit(c).alias("capacity")) for p, c in sizes]) if sizes else F.array().cast("array<struct<pack_id:int,capacity:int>>")
    each = docs.select("doc_id", "n", F.explode(every).alias("k")).select("doc_id", "n", "k.*")
    empty = each.filter("n = 0").select("pack_id", "doc_id", F.lit(0).alias("piece_no"), F.lit(0).alias("tokens"), F.lit(None).cast("string").alias("container"))
    full = each.filter("n >= capacity").select("pack_id", "doc_id", "capacity", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / F.col("capacity")).cast("int") - 1)).alias("piece_no"))
    full = full.select("pack_id", "doc_id", "piece_no", F.col("capacity").alias("tokens"), F.concat(F.lit("f"), "doc_id", F.lit("."), "piece_no").alias("container"))
    rest = each.withColumn("size", (F.col("n") % F.col("capacity")).cast("int")).filter("size > 0").select("pack_id", "capacity", "doc_id", "size")

    first = materialise(_pack(rest, "doc_id", per_shard))
    boxes = first.groupBy("pack_id", "capacity", "shard", "container").agg(F.sum("size").cast("int").alias("size"))
    partly = boxes.filter("size < capacity").withColumn("box", (F.col("shard").cast("long") * F.lit(2**32) + F.col("container")))
    again = _pack(partly.select("pack_id", "capacity", "box", "size"), "box", per_shard)
    moved = again.select("pack_id", F.floor(F.col("box") / F.lit(2**32)).cast("int").alias("shard"), (F.col("box") % F.lit(2**32)).alias("container"), F.concat(F.lit("r"), F.col("shard"), F.lit("."), F.col("container")).alias("new"))
    own = F.concat(F.lit("s"), F.col("shard"), F.lit("."), F.col("container"))
    packed = first.join(moved, ["pack_id", "shard", "container"], "left").join(docs, "doc_id").select(
        "pack_id", "doc_id", F.floor(F.col("n") / F.col("capacity")).cast("int").alias("piece_no"), F.col("size").alias("tokens"), F.coalesce("new", own).alias("container")
    )
    return packed.unionByName(full).unionByName(empty)


def pack_summary(packed: DataFrame, packs: DataFrame) -> DataFrame:
    """Per kind of container: containers used, the least that could hold the tokens, and the share of room used."""
    per = packed.filter("container is not null").groupBy("pack_id").agg(F.sum("tokens").alias("tokens"), F.countDistinct("container").alias("containers"))
    cap = packs.select(F.col("pack_id").cast("int").alias("pack_id"), F.col("capacity_tokens").cast("long").alias("capacity"))
    out = per.join(F.broadcast(cap), "pack_id")
    return out.select("pack_id", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"), "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("used"))
