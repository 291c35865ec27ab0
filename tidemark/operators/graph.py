"""Connected components and trees of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.storage import store


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of edges (a, b): the root is the least node of its component.

    Labels go to the least label of the neighbours and then to that label's own label, until none changes.
    """
    both = store(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).where("u != v").distinct(), "edges")
    labels = store(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")), "roots")
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("root").alias("m"))
        step = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", "root", F.least("root", "m").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("root").alias("far"))
        moved = store(step.join(jump, "new", "left").select("node", F.least("new", F.coalesce("far", "new")).alias("next"), "root"), "roots")
        changed = not moved.where("next != root").isEmpty()
        labels = moved.select("node", F.col("next").alias("root"))
        if not changed:
            return labels


def depths(nodes: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """(id, root, depth) of reply trees of any depth; a root is a node without a known parent. Nodes on a cycle have none.

    Each round a node takes over what its farthest known ancestor knows, so rounds grow with the log of the depth.
    """
    n = nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent")).distinct()
    known = n.select(F.col("id").alias("parent"), F.col("id").alias("up"))
    state = n.join(known, "parent", "left").select("id", "up", F.coalesce("up", "id").alias("root"), F.col("up").isNotNull().cast("int").alias("depth"))
    state, open_ = store(state, "tree"), -1
    while (left := state.where("up IS NOT NULL").count()) not in (0, open_):
        open_ = left
        far = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("root").alias("top"), F.col("depth").alias("more"))
        state = store(state.join(far, "up", "left").select("id", F.col("next").alias("up"), F.coalesce("top", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "tree")
    return state.where("up IS NULL").select("id", "root", "depth")
