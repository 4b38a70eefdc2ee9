"""Random isolation-tree growth.

The sample is hash-partitioned by tree, so a task holds whole trees: at most
trees * psi / partitions rows, bounded by the parameters and never by data skew.  All
trees of a task are grown together, level by level (``grow_level_wise``);
``grow_tree`` is the plain recursive definition it must equal.  Split choices are keyed
draws:

    feature   q = floor(u(seed, 's', tree, node) * d)
    threshold p = min_q + u'(seed, 's', tree, node) * (max_q - min_q)

(u and u' are the two draws of one digest).

Rows with x_q < p go to the left child 2*node+1, all others (ties, NaN) to the right
child 2*node+2.  A node is a leaf when depth >= limit or it holds <= 1 row; a split on
a constant feature leaves an empty (size 0) left leaf.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.draws import two_u_py, u_col
from ..session import new_path

NODES_SCHEMA = T.StructType([
    T.StructField("group", T.IntegerType(), False),
    T.StructField("tree", T.IntegerType(), False),
    T.StructField("node", T.LongType(), False),
    T.StructField("depth", T.IntegerType(), False),
    T.StructField("size", T.LongType(), False),
    T.StructField("feature", T.IntegerType(), True),
    T.StructField("threshold", T.DoubleType(), True),
    T.StructField("is_leaf", T.BooleanType(), False),
])


def grow_tree(tree: int, X: np.ndarray, limit: int, seed: int) -> list[tuple]:
    """Nodes of one tree as (node, depth, size, feature, threshold, is_leaf)."""
    d = X.shape[1]
    out = []
    stack = [(0, 0, np.arange(X.shape[0]))]
    while stack:
        node, depth, idx = stack.pop()
        size = int(idx.shape[0])
        if depth >= limit or size <= 1:
            out.append((node, depth, size, None, None, True))
            continue
        uq, up = two_u_py(seed, "s", tree, node)
        q = int(uq * d)
        col = X[idx, q]
        lo = float(col.min())
        hi = float(col.max())
        p = lo + up * (hi - lo)
        go_left = col < p
        out.append((node, depth, size, q, p, False))
        stack.append((2 * node + 2, depth + 1, idx[~go_left]))
        stack.append((2 * node + 1, depth + 1, idx[go_left]))
    return out


def grow_level_wise(tree: np.ndarray, ids: np.ndarray, X: np.ndarray, limit: int, seed: int) -> dict:
    """Grow every tree present in (tree, ids, X) together, one level at a time.

    Same definition as ``grow_tree`` (bit-identical nodes): per level, rows are grouped
    by (tree, node) with one sort, node min/max come from segment reductions, and the
    keyed draws are taken once per splitting node.
    """
    d = X.shape[1]
    out = {k: [] for k in ("tree", "node", "depth", "size", "feature", "threshold", "is_leaf")}
    if tree.shape[0] == 0:
        return {k: np.array(v) for k, v in out.items()}
    o = np.lexsort((ids, tree))
    t_s, i_s = tree[o], ids[o]
    dup = (t_s[1:] == t_s[:-1]) & (i_s[1:] == i_s[:-1])
    if dup.any():
        raise ValueError(f"duplicate ids in the sample of tree {int(t_s[1:][dup][0])}: the id column must be unique")
    node = np.zeros(tree.shape[0], dtype=np.int64)
    rows = np.arange(tree.shape[0])
    key = tree.astype(np.int64)  # of each row: its node, numbered in the order (tree, node)

    def emit(tr, nd, dep, sz, ft, th, lf):
        out["tree"].append(tr)
        out["node"].append(nd)
        out["depth"].append(dep)
        out["size"].append(sz)
        out["feature"].append(ft)
        out["threshold"].append(th)
        out["is_leaf"].append(lf)

    for depth in range(limit + 1):
        if rows.shape[0] == 0:
            break
        o = np.argsort(key, kind="stable")
        rows, key = rows[o], key[o]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        counts = np.diff(np.r_[starts, key.shape[0]])
        n_tree = tree[rows[starts]]
        n_node = node[rows[starts]]
        split = (counts > 1) & (depth < limit)
        nl = ~split
        k = int(nl.sum())
        if k:
            emit(n_tree[nl], n_node[nl], np.full(k, depth), counts[nl], np.full(k, -1), np.full(k, np.nan),
                 np.ones(k, dtype=bool))
        if not split.any():
            break
        s_tree, s_node, s_start, s_cnt = n_tree[split], n_node[split], starts[split], counts[split]
        draws = np.array([two_u_py(seed, "s", t, n) for t, n in zip(s_tree.tolist(), s_node.tolist())], dtype=np.float64)
        q, up = (draws[:, 0] * d).astype(np.int64), draws[:, 1]
        # rows of splitting nodes, with their node's position in the split arrays
        seg = np.repeat(np.arange(s_start.shape[0]), s_cnt)
        r_idx = rows[np.concatenate([np.arange(a, a + c) for a, c in zip(s_start, s_cnt)])]
        xq = X[r_idx, q[seg]]
        bounds = np.r_[0, np.cumsum(s_cnt)[:-1]]
        lo = np.minimum.reduceat(xq, bounds)
        hi = np.maximum.reduceat(xq, bounds)
        thr = lo + up * (hi - lo)
        go_left = xq < thr[seg]
        n_left = np.add.reduceat(go_left.astype(np.int64), bounds)
        m = s_tree.shape[0]
        emit(s_tree, s_node, np.full(m, depth), s_cnt, q, thr, np.zeros(m, dtype=bool))
        for empty, side in ((n_left == 0, 1), (n_left == s_cnt, 2)):
            e = int(empty.sum())
            if e:
                emit(s_tree[empty], 2 * s_node[empty] + side, np.full(e, depth + 1), np.zeros(e, dtype=np.int64),
                     np.full(e, -1), np.full(e, np.nan), np.ones(e, dtype=bool))
        node[r_idx] = 2 * node[r_idx] + np.where(go_left, 1, 2)
        rows, key = r_idx, 2 * seg + np.where(go_left, 0, 1)
    return {k: np.concatenate(v) if v else np.array([]) for k, v in out.items()}


def grow_partition_fn(d: int, limit: int, seed: int, trees_per_group: int, arrow_schema):
    """mapInArrow body: a partition holds whole trees (hash-partitioned by tree); its
    rows (bounded by trees * psi / partitions) are grown together."""
    import pyarrow as pa

    def fn(batches):
        tb = [b for b in batches if b.num_rows]
        if not tb:
            return
        tab = pa.Table.from_batches(tb)
        tree = tab.column("_tree").to_numpy().astype(np.int64)
        ids = tab.column("_id").to_numpy().astype(np.int64)
        X = np.column_stack([tab.column(f"_x{i}").to_numpy(zero_copy_only=False).astype(np.float64)
                             for i in range(d)]) if d else np.zeros((tree.shape[0], 0))
        r = grow_level_wise(tree, ids, X, limit, seed)
        feat = r["feature"].astype(np.int64)
        yield pa.RecordBatch.from_arrays([
            pa.array((r["tree"] // trees_per_group).astype(np.int32)),
            pa.array(r["tree"].astype(np.int32)),
            pa.array(r["node"].astype(np.int64)),
            pa.array(r["depth"].astype(np.int32)),
            pa.array(r["size"].astype(np.int64)),
            pa.array(feat.astype(np.int32), mask=feat < 0),
            pa.array(r["threshold"].astype(np.float64), mask=feat < 0),
            pa.array(r["is_leaf"].astype(bool)),
        ], schema=arrow_schema)

    return fn


def grow_by_levels(sample: DataFrame, d: int, limit: int, seed: int, trees_per_group: int) -> DataFrame:
    """The same trees (bit for bit) from Spark aggregates, one level at a time, for samples
    that no single task could hold.

    A level is one map-side combined aggregate of (rows, min and max of the drawn feature)
    by node, and one join that moves the rows to the children.  Rows of leaves drop out.
    Each level is written to the shared folder, so a lost executor repeats one level.
    """
    spark = sample.sparkSession

    def staged(df: DataFrame) -> DataFrame:
        path = new_path(spark, "growth")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    x = F.array(*[F.col(f"_x{i}") for i in range(d)])
    feature = F.floor(u_col(seed, "s", F.col("tree"), F.col("node")) * F.lit(float(d))).cast("int")
    rows = staged(sample.select(F.col("_tree").cast("int").alias("tree"), F.lit(0).cast("bigint").alias("node"), x.alias("x"), F.col("_id").alias("id")))
    dup = rows.groupBy("tree", "id").count().where("count > 1").select("tree").limit(1).collect()
    if dup:
        raise ValueError(f"duplicate ids in the sample of tree {dup[0]['tree']}: the id column must be unique")
    levels = []
    none = [F.lit(None).cast("int").alias("feature"), F.lit(None).cast("double").alias("threshold")]
    for depth in range(limit + 1):
        drawn = rows.withColumn("feature", feature)
        v = F.element_at("x", F.col("feature") + 1)
        counts = drawn.groupBy("tree", "node", "feature").agg(F.count("*").alias("size"), F.min(v).alias("lo"), F.max(v).alias("hi"))
        draw = u_col(seed, "s", F.col("tree"), F.col("node"), second=True)
        nodes = staged(counts.select("tree", "node", "size", "feature", (F.col("lo") + draw * (F.col("hi") - F.col("lo"))).alias("threshold"),
                                     ((F.col("size") > 1) & F.lit(depth < limit)).alias("split")))
        levels.append(nodes.where("not split").select("tree", "node", F.lit(depth).alias("depth"), "size", *none, F.lit(True).alias("is_leaf")))
        inner = nodes.where("split")
        levels.append(inner.select("tree", "node", F.lit(depth).alias("depth"), "size", "feature", "threshold", F.lit(False).alias("is_leaf")))
        moved = rows.join(inner.drop("size", "split"), ["tree", "node"])
        right = F.when(F.element_at("x", F.col("feature") + 1) < F.col("threshold"), 1).otherwise(2)
        rows = staged(moved.select("tree", (F.col("node") * 2 + right).cast("bigint").alias("node"), "x", "id"))
        # a side that got no rows is a leaf of size 0
        sides = inner.select("tree", F.explode(F.array(F.col("node") * 2 + 1, F.col("node") * 2 + 2)).alias("node"))
        empty = sides.join(rows.select("tree", "node").distinct(), ["tree", "node"], "left_anti")
        levels.append(empty.select("tree", "node", F.lit(depth + 1).alias("depth"), F.lit(0).cast("bigint").alias("size"), *none, F.lit(True).alias("is_leaf")))
        if rows.isEmpty():
            break
    out = levels[0]
    for part in levels[1:]:
        out = out.unionByName(part)
    return out.select((F.col("tree") / F.lit(trees_per_group)).cast("int").alias("group"), *[F.col(f.name).cast(f.dataType) for f in NODES_SCHEMA.fields[1:]])
