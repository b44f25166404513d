"""Parent-child links of unknown depth to full hierarchies: path, depth, root, descendants and cycles.

Level-wise frontier joins start at the roots and extend paths and depths, for all trees at once; a round joins its
frontier with the links of the next levels, several at a time. A node no round reaches lies on or below a cycle; pointer doubling finds the cycle and its smallest name in
a logarithmic number of rounds, and a second set of frontiers starts from the cycles' nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.tables import materialise, new_folder, sheet_key, trimmed

SEP = " > "


#: Levels a round goes down; a power of two. The links of so many levels are made once, by doubling.
STRIDE = 8


def _strides(children: DataFrame) -> DataFrame:
    """Links over one to ``STRIDE`` levels: grp, node, child, hop, mid (the nodes below ``node`` down to the child)."""
    links = children.select("grp", F.col("parent").alias("node"), F.col("node").alias("child"), F.lit(1).alias("hop"), F.array("node").alias("mid"))
    reach = 1
    while reach < STRIDE:
        links = materialise(links)
        below = links.select("grp", F.col("node").alias("child"), F.col("child").alias("to"), F.col("hop").alias("more"), F.col("mid").alias("then"))
        longer = links.filter(F.col("hop") == reach).join(below, ["grp", "child"])
        links = links.unionByName(longer.select("grp", "node", F.col("to").alias("child"), (F.col("hop") + F.col("more")).alias("hop"), F.concat("mid", "then").alias("mid")))
        reach *= 2
    return materialise(links)


def _levels(start: DataFrame, children: DataFrame) -> DataFrame:
    """Frontier rounds: ``start`` has grp, node, path (array); a round joins the frontier with the links of the next levels.

    A round is a folder of the shared folder, so lineage stays one join deep whatever the depth, and all rounds are
    read back by one scan. Every node enters once; only nodes of a round's last level are the next frontier.
    """
    spark, at, n = start.sparkSession, new_folder(start.sparkSession), 0
    step = _strides(children)
    first = start.select("grp", "node", "path", F.lit(STRIDE).alias("hop"))
    first.write.parquet(f"{at}/round=0")
    while True:
        met = spark.read.schema(first.schema).parquet(f"{at}/round={n}")
        frontier = met.filter(F.col("hop") == STRIDE).select("grp", "node", "path")
        if frontier.isEmpty():
            return spark.read.schema(first.schema).parquet(*[f"{at}/round={i}" for i in range(n + 1)]).select("grp", "node", "path")
        n += 1
        frontier.join(step, ["grp", "node"]).select("grp", F.col("child").alias("node"), F.concat("path", "mid").alias("path"), "hop").write.parquet(f"{at}/round={n}")


def hierarchy(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Trees of ``nodes`` (grp, node) under ``links`` (grp, node, parent): grp, node, root, depth, path array, n_desc.

    A node has at most one parent; of several given the smallest counts, links to oneself and links whose ends are
    not among the nodes are ignored, repeats count once. Nodes on or below a cycle have depth -1, an empty path and
    as root the smallest name on that cycle by bytes. Rows with a null grp or node are left out.
    """
    own = nodes.select("grp", "node").dropna().distinct()
    up = links.select("grp", "node", "parent").dropna().filter("node <> parent")
    up = up.join(own, ["grp", "node"], "left_semi").join(own.withColumnRenamed("node", "parent"), ["grp", "parent"], "left_semi")
    parent = materialise(up.groupBy("grp", "node").agg(F.min("parent").alias("parent")))
    own = materialise(own)

    roots = own.join(parent, ["grp", "node"], "left_anti").withColumn("path", F.array("node"))
    tree = _levels(roots, parent)
    stuck = materialise(own.join(tree.select("grp", "node"), ["grp", "node"], "left_anti"))
    trees = _with_descendants(tree).select("grp", "node", F.element_at("path", 1).alias("root"), (F.size("path") - 1).alias("depth"), "path", "n_desc")
    if stuck.isEmpty():
        return trees
    return trees.unionByName(_stuck(stuck, parent.join(stuck, ["grp", "node"], "left_semi")))


def _with_descendants(tree: DataFrame) -> DataFrame:
    """Ancestor pairs come out of the paths; counting them by ancestor gives each node's descendants."""
    pairs = tree.select("grp", F.explode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("node"))
    return tree.join(pairs.groupBy("grp", "node").agg(F.count(F.lit(1)).alias("n_desc")), ["grp", "node"], "left").withColumn("n_desc", F.coalesce("n_desc", F.lit(0)).cast("int"))


def _stuck(stuck: DataFrame, parent: DataFrame) -> DataFrame:
    """Nodes that no root reaches: every one has a parent among them."""
    jump = materialise(parent.select("grp", "node", F.col("parent").alias("to"), F.least("node", "parent").alias("low")))
    most = stuck.groupBy("grp").count().agg(F.max("count")).first()[0]
    far = 1
    while far < most:  # after the rounds `to` lies on the cycle and `low` covers a whole turn of it
        nxt = jump.select("grp", F.col("node").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        jump = materialise(jump.join(nxt, ["grp", "to"]).select("grp", "node", F.col("to2").alias("to"), F.least("low", "low2").alias("low")))
        far *= 2
    cycle = materialise(jump.select("grp", F.col("to").alias("node")).distinct().join(jump.select("grp", "node", "low"), ["grp", "node"]))
    root = materialise(jump.join(cycle.select("grp", F.col("node").alias("to"), F.col("low").alias("root")), ["grp", "to"]).select("grp", "node", "root"))
    on = cycle.select("grp", "node")
    below = _levels(on.withColumn("path", F.array("node")), parent.join(on, ["grp", "node"], "left_anti"))
    whole = root.groupBy("grp", "root").agg((F.count(F.lit(1)) - 1).cast("int").alias("all_others"))
    out = _with_descendants(below).join(root, ["grp", "node"]).join(whole, ["grp", "root"]).join(on.withColumn("on_cycle", F.lit(True)), ["grp", "node"], "left")
    n_desc = F.when(F.col("on_cycle"), F.col("all_others")).otherwise(F.col("n_desc"))
    return out.select("grp", "node", "root", F.lit(-1).alias("depth"), F.array().cast("array<string>").alias("path"), n_desc.alias("n_desc"))


def sheet_hierarchy(sheets: DataFrame, edges: DataFrame) -> DataFrame:
    """Every sheet with its root, depth, path and number of sheets below: workbook_id, sheet, root_sheet, depth, path, n_desc.

    The parent of a sheet is the other sheet of its workbook that reads it by an edge that is not inactive (a null
    kind counts). Names agree whatever their case, outer blanks and quotes; results show them as in ``sheets``,
    the newest delivery's writing if there are several.
    """
    named = sheets.select("workbook_id", "sheet", sheet_key(F.col("sheet")).alias("k"), "loaded_at").filter("workbook_id is not null and sheet is not null")
    names = materialise(named.groupBy("workbook_id", "k").agg(F.max_by("sheet", F.struct("loaded_at", "sheet")).alias("sheet")))
    live = edges.filter(F.coalesce(F.lower(trimmed(F.col("kind"))), F.lit("")) != "inactive")
    pairs = live.select("workbook_id", sheet_key(F.col("src_sheet")).alias("src"), sheet_key(F.col("dst_sheet")).alias("dst")).filter("src <> dst").distinct()
    child, top = names.alias("c"), names.alias("p")
    links = pairs.join(child, (pairs.workbook_id == F.col("c.workbook_id")) & (pairs.dst == F.col("c.k"))).join(top, (pairs.workbook_id == F.col("p.workbook_id")) & (pairs.src == F.col("p.k")))
    links = links.select(pairs.workbook_id.alias("grp"), F.col("c.sheet").alias("node"), F.col("p.sheet").alias("parent"))
    found = hierarchy(names.select(F.col("workbook_id").alias("grp"), F.col("sheet").alias("node")), links)
    return found.select(
        F.col("grp").alias("workbook_id"), F.col("node").alias("sheet"), F.col("root").alias("root_sheet"), F.col("depth").cast("int").alias("depth"),
        F.when(F.col("depth") >= 0, F.array_join("path", SEP)).otherwise(F.lit("")).alias("path"), F.col("n_desc").cast("int").alias("n_desc"),
    )
