"""Tree inspection as table operators on the node table (no linked objects, no graph lib).

All functions take the ``nodes`` DataFrame (group, tree, node, depth, size, feature,
threshold, is_leaf) and return DataFrames.  Per-tree work is keyed by ``tree``; the
node table is bounded by trees * (2 psi - 1) rows, so the few shuffles here are small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import branch_numbers, branch_of, node_at_path


def node_lookup(nodes: DataFrame, path: str) -> DataFrame:
    """The node reached from each tree's root by the letters of ``path`` (absent
    when the path runs past a leaf)."""
    target = node_at_path(F.lit(path))
    depth = F.size(F.filter(F.split(F.lit(path), ""), lambda c: (c == "L") | (c == "R")))
    return nodes.where((F.col("node") == target) & (F.col("depth") == depth))


def leaf_branches(nodes: DataFrame) -> DataFrame:
    """Every root-to-leaf branch: (group, tree, leaf, depth, size, branch array, branch_str)."""
    leaves = nodes.where(F.col("is_leaf"))
    return leaves.select(
        "group", "tree", F.col("node").alias("leaf"), "depth", "size",
        branch_of("node", "depth").alias("branch"),
    ).withColumn("branch_str", F.array_join("branch", ""))


def with_branch_numbers(branches: DataFrame, init_root: int = 0, branch_col: str = "branch_str") -> DataFrame:
    """Node numbers along each branch, first element ``init_root``."""
    return branches.withColumn("numbers", branch_numbers(branch_col, init_root))


def node_vertices(nodes: DataFrame) -> DataFrame:
    """T4 from the node table, whose rows are the vertices: no shuffle."""
    return nodes.select("tree", "node", F.concat(F.lit("t"), F.col("tree").cast("string"), F.lit(":"), F.col("node").cast("string")).alias("name"))


def node_edges(nodes: DataFrame) -> DataFrame:
    """T5 from the node table: every node but the root with its parent and side; no shuffle."""
    side = F.when(F.col("node") % 2 == 1, "L").otherwise("R")
    return nodes.where("node > 0").select("tree", F.shiftright(F.col("node") - 1, 1).alias("parent"), F.col("node").alias("child"), side.alias("side"))


def vertices(branches: DataFrame, prefix_col=None, init_root: int = 0) -> DataFrame:
    """T4: distinct node numbers over all branches of a tree, with a display name."""
    b = branches if "numbers" in branches.columns else with_branch_numbers(branches, init_root)
    v = b.select("tree", F.explode("numbers").alias("node")).distinct()
    prefix = prefix_col if prefix_col is not None else F.concat(F.lit("t"), F.col("tree").cast("string"), F.lit(":"))
    return v.withColumn("name", F.concat(prefix, F.col("node").cast("string")))


def edges(branches: DataFrame, init_root: int = 0) -> DataFrame:
    """T5: consecutive (parent, child) pairs along branches, de-duplicated, with side."""
    b = branches if "numbers" in branches.columns else with_branch_numbers(branches, init_root)
    n = F.size("numbers")
    pairs = F.arrays_zip(F.slice("numbers", 1, n - 1).alias("parent"), F.slice("numbers", 2, n - 1).alias("child"))
    e = b.where(n > 1).select("tree", F.explode(pairs).alias("e")).select(
        "tree", F.col("e.parent").alias("parent"), F.col("e.child").alias("child")).distinct()
    return e.withColumn("side", F.when(F.col("child") == F.col("parent") * 2 + 1, "L").otherwise("R"))


def max_node(verts: DataFrame) -> DataFrame:
    """Largest node number per tree (offset for packing several trees in one graph)."""
    return verts.groupBy("tree").agg(F.max("node").alias("max_node"), F.count("*").alias("n_vertices"))


def tree_stats(nodes: DataFrame) -> DataFrame:
    """Per tree: node and leaf counts, empty leaves, leaf-size total (= psi), depth."""
    leaf = F.col("is_leaf")
    return nodes.groupBy("group", "tree").agg(
        F.count("*").alias("n_nodes"),
        F.count_if(leaf).alias("n_leaves"),
        F.count_if(leaf & (F.col("size") == 0)).alias("n_empty_leaves"),
        F.sum(F.when(leaf, F.col("size")).otherwise(0)).alias("leaf_size_sum"),
        F.max("depth").alias("max_depth"),
        F.max(F.when(F.col("node") == 0, F.col("size"))).alias("root_size"),
    )


def split_children(nodes: DataFrame) -> DataFrame:
    """Each internal node with the sizes of its two children (left: x < threshold).  A
    node counts for itself and, by side, for its parent: one aggregate, no join."""
    at = F.explode(F.array(F.col("node"), F.when(F.col("node") > 0, F.shiftright(F.col("node") - 1, 1))))
    n = nodes.select("tree", F.col("node").alias("own"), "depth", "size", "feature", "threshold", "is_leaf", at.alias("node")).where("node is not null")
    self_ = (F.col("own") == F.col("node"))
    g = n.groupBy("tree", "node").agg(
        *[F.max(F.when(self_, F.col(c))).alias(c) for c in ("depth", "size", "feature", "threshold", "is_leaf")],
        F.max(F.when(~self_ & (F.col("own") % 2 == 1), F.col("size"))).alias("left_size"),
        F.max(F.when(~self_ & (F.col("own") % 2 == 0), F.col("size"))).alias("right_size"))
    return g.where("not is_leaf").select("tree", "node", "depth", "size", "feature", "threshold", "left_size", "right_size")
