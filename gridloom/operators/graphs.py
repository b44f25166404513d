"""Dependency graphs: closures level by level, budgets, hidden rows, strongly connected groups, layers."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.tables import materialise, new_folder


def closure(seeds: DataFrame, edges: DataFrame, key: str = "grp", depth: int | None = None, budget: int | None = None, stop: DataFrame | None = None) -> DataFrame:
    """Nodes reached from ``seeds`` (key, node) along ``edges`` (key, src, dst): key, node, depth.

    One frontier join a level for all groups at once; nodes met before and those in ``stop`` are not followed.
    ``depth`` bounds the levels. With a ``budget`` each group shows so many nodes at most: at each level those with
    most outgoing edges first, then by name. Frontiers are cut in the shared folder, so plans stay short.
    """
    links = materialise(edges.select(key, "src", "dst").filter("src <> dst").distinct())
    weight = links.groupBy(key, F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("_w")) if budget is not None else None
    spark, at, level = edges.sparkSession, new_folder(edges.sparkSession), 0
    first = seeds.select(key, "node").distinct()
    schema = first.schema
    first.write.parquet(f"{at}/level=0")
    known = lambda n: spark.read.schema(schema).parquet(*[f"{at}/level={i}" for i in range(n)])
    step = links.withColumnRenamed("src", "node")
    while depth is None or level < depth:
        frontier, seen = spark.read.schema(schema).parquet(f"{at}/level={level}"), known(level + 1)
        nxt = frontier.join(step, [key, "node"]).select(key, F.col("dst").alias("node")).distinct()
        nxt = nxt.join(seen, [key, "node"], "left_anti")
        if stop is not None:
            nxt = nxt.join(stop.select(key, "node"), [key, "node"], "left_anti")
        if budget is not None:
            room = seen.groupBy(key).agg((F.lit(budget) - F.count(F.lit(1))).alias("_room"))
            w = Window.partitionBy(key).orderBy(F.desc(F.coalesce("_w", F.lit(0))), "node")
            nxt = nxt.join(weight, [key, "node"], "left").withColumn("_n", F.row_number().over(w)).join(room, key).filter("_n <= _room").select(key, "node")
        nxt.select(key, "node").write.parquet(f"{at}/level={level + 1}")
        if spark.read.schema(schema).parquet(f"{at}/level={level + 1}").isEmpty():
            break
        level += 1
    # one scan of all rounds; the folder of a round is its depth
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("level", T.IntegerType())])).parquet(at).withColumnRenamed("level", "depth")


def hidden_by(full: DataFrame, shown: DataFrame, key: str, group: Sequence[str]) -> DataFrame:
    """Nodes of a closure that are not shown, counted per group."""
    return full.join(shown.select(key, "node"), [key, "node"], "left_anti").groupBy(*group).agg(F.count(F.lit(1)).alias("n_hidden"))


#: Graphs of a group with at most so many links are searched by one task; larger ones by distributed rounds.
LINKS_PER_TASK = 200_000


def components(pdf: pd.DataFrame) -> pd.DataFrame:
    """Strongly connected groups and longest-path layers of one graph (src, dst): node, group, size, layer."""
    nodes = sorted(set(pdf.src) | set(pdf.dst))
    of = {n: i for i, n in enumerate(nodes)}
    out: list[list[int]] = [[] for _ in nodes]
    for a, b in zip(pdf.src, pdf.dst):
        out[of[a]].append(of[b])
    index, low, comp = [-1] * len(nodes), [0] * len(nodes), [-1] * len(nodes)
    stack: list[int] = []
    groups: list[list[int]] = []  # sinks first
    clock = 0
    for start in range(len(nodes)):
        if index[start] >= 0:
            continue
        work = [(start, 0)]
        while work:
            v, at = work.pop()
            if at == 0:
                index[v] = low[v] = clock
                clock += 1
                stack.append(v)
            again = False
            for k in range(at, len(out[v])):
                w = out[v][k]
                if index[w] < 0:
                    work += [(v, k + 1), (w, 0)]
                    again = True
                    break
                if comp[w] < 0:
                    low[v] = min(low[v], index[w])
            if again:
                continue
            if low[v] == index[v]:
                members = []
                while True:
                    w = stack.pop()
                    comp[w] = len(groups)
                    members.append(w)
                    if w == v:
                        break
                groups.append(members)
            if work:
                u = work[-1][0]
                low[u] = min(low[u], low[v])
    layer = [0] * len(groups)
    for g in range(len(groups) - 1, -1, -1):
        for v in groups[g]:
            for w in out[v]:
                if comp[w] != g:
                    layer[comp[w]] = max(layer[comp[w]], layer[g] + 1)
    rows = [(nodes[v], nodes[min(m)], len(m), layer[g]) for g, m in enumerate(groups) for v in m]
    return pd.DataFrame(rows, columns=["node", "group", "size", "layer"])


def _by_size(edges: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Results of the graphs one task can take, and the links of the larger ones, None if there are none."""
    links = materialise(edges.select(key, "src", "dst").dropna().filter("src <> dst").distinct())
    sizes = materialise(links.groupBy(key).agg(F.count(F.lit(1)).alias("_n")))
    kind = links.schema[key].dataType.simpleString()
    small = links.join(sizes.filter(F.col("_n") <= LINKS_PER_TASK), key)

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return components(pdf).assign(**{key: k[0]})[[key, "node", "group", "size", "layer"]]

    done = small.groupBy(key).applyInPandas(run, f"{key} {kind}, node string, `group` string, size long, layer int")
    big = sizes.filter(F.col("_n") > LINKS_PER_TASK)
    return done, None if big.isEmpty() else links.join(big.select(key), key, "left_semi")


def connected_groups(edges: DataFrame, key: str = "grp") -> DataFrame:
    """Strongly connected groups: key, node, group (its smallest node), size; nodes on no cycle are groups of one."""
    done, big = _by_size(edges, key)
    done = done.select(key, "node", "group", "size")
    return done if big is None else done.unionByName(groups_by_rounds(big, key))


def layers(edges: DataFrame, key: str = "grp") -> DataFrame:
    """Longest-path layer of each node of the graph of groups, so that back edges do not count: key, node, layer."""
    done, big = _by_size(edges, key)
    done = done.select(key, "node", "layer")
    return done if big is None else done.unionByName(layers_by_rounds(big, key))


def groups_by_rounds(edges: DataFrame, key: str = "grp") -> DataFrame:
    """The groups of graphs of any size.

    Rounds of colouring: each node takes the smallest name that reaches it; of a colour, the nodes that reach its
    root back are one group and leave the graph. Nodes without an edge in or out among those left leave at once.
    """
    links = materialise(edges.select(key, "src", "dst").dropna().filter("src <> dst").distinct())
    names = links.select(key, F.col("src").alias("node")).unionByName(links.select(key, F.col("dst").alias("node"))).distinct()
    done = None
    left = materialise(names)
    while not left.isEmpty():
        # forward smallest names to a fixed point
        colour = materialise(left.withColumn("c", F.col("node")))
        while True:
            sent = links.join(colour.withColumnRenamed("node", "src"), [key, "src"]).select(key, F.col("dst").alias("node"), "c")
            nxt = materialise(colour.unionByName(sent).groupBy(key, "node").agg(F.min("c").alias("c")).join(left, [key, "node"], "left_semi"))
            settled = nxt.join(colour.withColumnRenamed("c", "old"), [key, "node"]).filter("c <> old").isEmpty()
            colour = nxt
            if settled:
                break
        # nodes of a colour that reach its root
        inside = links.join(colour.select(key, F.col("node").alias("src"), F.col("c").alias("c1")), [key, "src"]).join(colour.select(key, F.col("node").alias("dst"), F.col("c").alias("c2")), [key, "dst"]).filter("c1 = c2")
        back = inside.select(F.struct(F.col(key), "c1").alias("g"), F.col("dst").alias("src"), F.col("src").alias("dst"))
        roots = colour.filter("node = c").select(F.struct(F.col(key), F.col("c").alias("c1")).alias("g"), "node")
        got = closure(roots, back, key="g").select(F.col("g")[key].alias(key), "node", F.col("g")["c1"].alias("group"))
        got = materialise(got)
        done = got if done is None else done.unionByName(got)
        left = materialise(left.join(got.select(key, "node"), [key, "node"], "left_anti"))
        links = materialise(links.join(left.withColumnRenamed("node", "src"), [key, "src"], "left_semi").join(left.withColumnRenamed("node", "dst"), [key, "dst"], "left_semi"))
    if done is None:
        return names.withColumn("group", F.col("node")).withColumn("size", F.lit(1).cast("long"))
    return done.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy(key, "group")))


def layers_by_rounds(edges: DataFrame, key: str = "grp") -> DataFrame:
    """The layers of graphs of any size."""
    groups = materialise(groups_by_rounds(edges, key))
    a, b = groups.select(key, F.col("node").alias("src"), F.col("group").alias("g1")), groups.select(key, F.col("node").alias("dst"), F.col("group").alias("g2"))
    links = materialise(edges.select(key, "src", "dst").join(a, [key, "src"]).join(b, [key, "dst"]).filter("g1 <> g2").select(key, "g1", "g2").distinct())
    layer = materialise(groups.select(key, F.col("group").alias("g")).distinct().withColumn("layer", F.lit(0)))
    while True:
        up = links.join(layer.withColumnRenamed("g", "g1"), [key, "g1"]).select(key, F.col("g2").alias("g"), (F.col("layer") + 1).alias("layer"))
        nxt = materialise(layer.unionByName(up).groupBy(key, "g").agg(F.max("layer").alias("layer")))
        if nxt.join(layer.withColumnRenamed("layer", "old"), [key, "g"]).filter("layer <> old").isEmpty():
            break
        layer = nxt
    return groups.select(key, "node", F.col("group").alias("g")).join(nxt, [key, "g"]).select(key, "node", "layer")
