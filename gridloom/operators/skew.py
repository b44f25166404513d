"""Per-key results when a few keys hold most rows: fragment and replicate by estimated load.

Keys are bin-packed to tasks by load. A key larger than one task's share is cut into shards in proportion to its
load; the matching side is copied to exactly those shards. Light keys go through a bounded number of hash bins, so
the plan held by the driver is bounded by the number of tasks, not by the data. Where whole rows move (joins,
cogroups) they go to the very task the packing chose.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS_PER_TASK = 16


@dataclass
class ShardPlan:
    """Where rows of each key go. ``heavy`` has at most ``tasks`` keys, ``bins`` a fixed number of entries."""

    keys: list[str]
    tasks: int
    total: int
    heavy: DataFrame
    heavy_keys: int
    bins: list[int]
    shards: dict[int, list[int]] = field(default_factory=dict)


def key_of(keys: Sequence[str]) -> Column:
    """A 64-bit stand-in of the key used for placement only; equal keys always agree, nulls included."""
    return F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0null")) for k in keys])


def key_loads(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key; counted with map-side combination, so a hot key sends one number a map task."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("load"))


def pack_bins(loads: list[tuple[int, int]], tasks: int, start: list[int]) -> list[int]:
    """Longest-first assignment of (bin, load) to the task with the least load; ``start`` is what tasks hold already."""
    heap = [(load, t) for t, load in enumerate(start)]
    heapq.heapify(heap)
    place = [0] * (max((b for b, _ in loads), default=-1) + 1)
    for b, load in sorted(loads, key=lambda x: (-x[1], x[0])):
        now, t = heapq.heappop(heap)
        place[b] = t
        heapq.heappush(heap, (now + load, t))
    return place


def plan_shards(rows: DataFrame, keys: Sequence[str], tasks: int) -> ShardPlan:
    """Cut keys above one task's share into shards and bin-pack everything else.

    Only the loads of ``16 * tasks`` hash bins are counted over all rows; keys are counted one by one just inside the
    bins that hold more than a task's share. A key gets ``ceil(load / share)`` shards where ``share`` is total / tasks, so
    at most ``tasks`` keys are heavy and only those are brought to the driver. Both passes combine on the map side.
    """
    keys = list(keys)
    n_bins = tasks * BINS_PER_TASK
    keyed = rows.select(key_of(keys).alias("k")).withColumn("b", F.pmod("k", F.lit(n_bins)).cast("int"))
    load = {r["b"]: r["load"] for r in key_loads(keyed, ["b"]).collect()}
    total = sum(load.values())
    share = max(1, -(-total // tasks))
    full = sorted(b for b, n in load.items() if n > share)
    heavy_rows = []
    if full:
        heavy_rows = key_loads(keyed.filter(F.col("b").isin(full)), ["k", "b"]).filter(F.col("load") > share).orderBy("k").collect()
    filled, shards, at = [0] * tasks, {}, 0
    for r in heavy_rows:
        n = -(-r["load"] // share)
        shards[r["k"]] = [(at + i) % tasks for i in range(n)]
        for t in shards[r["k"]]:
            filled[t] += r["load"] // n
        at += n
        load[r["b"]] -= r["load"]
    placed = pack_bins(sorted(load.items()), tasks, filled)
    placed += [i % tasks for i in range(len(placed), n_bins)]
    heavy = rows.sparkSession.createDataFrame(list(shards.items()), "heavy_key long, shard_tasks array<int>")
    return ShardPlan(keys, tasks, total, heavy, len(shards), placed, shards)


def _placed(df: DataFrame, plan: ShardPlan) -> DataFrame:
    """Adds ``shard_tasks`` (null for light keys) and the bin's task. Both tables joined are bounded by the plan:
    at most ``tasks`` heavy keys and 16 bins a task."""
    spark = df.sparkSession
    bins = spark.createDataFrame([(b, t) for b, t in enumerate(plan.bins)], "_b int, _bin int")
    out = df.withColumn("_key", key_of(plan.keys)).withColumn("_b", F.pmod("_key", F.lit(len(plan.bins))).cast("int")).join(F.broadcast(bins), "_b").drop("_b")
    return out.join(F.broadcast(plan.heavy), F.col("_key") == F.col("heavy_key"), "left").drop("heavy_key")


def fragment(df: DataFrame, plan: ShardPlan, spread: Sequence[str]) -> DataFrame:
    """Rows with ``task`` and ``shard``: a heavy key's rows are spread over its shards by a hash of ``spread``.

    ``spread`` names columns that tell rows of one key apart; the choice is a pure function of the row, so a
    recomputed task places it alike. Rows equal in all of them share a shard. Aggregates that add up over
    ``spread`` groups (say a distinct count of ``spread``) add up over shards.
    """
    salt = F.xxhash64(F.lit(7), *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in spread])
    shard = F.when(F.col("shard_tasks").isNull(), F.lit(0)).otherwise(F.pmod(salt, F.size("shard_tasks")).cast("int"))
    out = _placed(df, plan).withColumn("shard", shard)
    task = F.when(F.col("shard_tasks").isNull(), F.col("_bin")).otherwise(F.element_at("shard_tasks", F.col("shard") + 1))
    return out.withColumn("task", task).drop("_key", "_bin", "shard_tasks")


def replicate(df: DataFrame, plan: ShardPlan) -> DataFrame:
    """The matching side: one copy of a row per shard of its key, hence one only for light keys."""
    shards = F.when(F.col("shard_tasks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size("shard_tasks") - 1))
    out = _placed(df, plan).withColumn("shard", F.explode(shards))
    task = F.when(F.col("shard_tasks").isNull(), F.col("_bin")).otherwise(F.element_at("shard_tasks", F.col("shard") + 1))
    return out.withColumn("task", task).drop("_key", "_bin", "shard_tasks")


def at_task(df: DataFrame, plan: ShardPlan) -> DataFrame:
    """Every row in the partition its ``task`` names, so that the packing decides where work is done."""
    return df.repartitionById(plan.tasks, "task")


def default_tasks(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def balanced_counts(df: DataFrame, keys: Sequence[str], spread: Sequence[str], tasks: int | None = None) -> DataFrame:
    """Rows per key with ``share`` of all rows, made shard by shard.

    Counts are combined before they move, one number a key and map task, so the shards' numbers and no rows travel.
    Nulls form a key of their own. An empty input gives an empty result. Columns besides ``keys`` and ``spread``
    are ignored. Result: keys, n_rows long, n_shards int, share double.
    """
    keys = list(keys)
    rows = df.select(*dict.fromkeys([*keys, *spread]))
    plan = plan_shards(rows, keys, tasks or default_tasks(df))
    part = fragment(rows, plan, spread).groupBy("task", "shard", *keys).agg(F.count(F.lit(1)).alias("n"))
    whole = part.groupBy(*keys).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).cast("int").alias("n_shards"))
    return whole.withColumn("share", F.col("n_rows") / F.lit(float(max(1, plan.total))))


def balanced_join(left: DataFrame, right: DataFrame, keys: Sequence[str], spread: Sequence[str], how: str = "inner", tasks: int | None = None) -> DataFrame:
    """Equi-join of a skewed ``left`` with ``right``, ``how`` inner or left; null keys match nothing.

    Each left row meets its matches in the one shard it is placed in, so results are those of a plain join. The
    right side may have any columns; those that clash with the left's get the suffix ``_r``.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left: a right row is copied to several shards")
    keys = list(keys)
    n = tasks or default_tasks(left)
    plan = plan_shards(left, keys, n)
    a = at_task(fragment(left, plan, spread), plan)
    right = right.select(*[F.col(c).alias(c if c in keys or c not in left.columns else f"{c}_r") for c in right.columns])
    b = at_task(replicate(right.dropna(subset=keys), plan), plan)
    return a.join(b, ["task", "shard", *keys], how).drop("task", "shard")
