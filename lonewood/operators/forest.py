"""Isolation forests as Spark jobs: fit (sample -> grow -> persist) and score.

Training plan (two exchanges, both carrying only ~TT * psi' rows whatever N is):
    scan(id, features) -> NA policy + first sampling hop (one filter, codegen)
    -> round-robin of the survivors -> mapInArrow(remaining hops) = candidates
    -> repartition(P, tree) -> row_number <= psi per tree -> mapInArrow(grow whole trees)
    -> nodes written to the shared folder (lineage cut; scores always come from the
       saved model) -> packed and broadcast block by block.
Scoring plan (no shuffle):
    scan -> Arrow function of the feature columns (descend all trees of a block), one for
    each block -> Column maths.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.draws import c_factor_py
from ..session import new_path, put_file, shared_dir, ship_package
from ..sources import versions
from ..sources.points import FeatureSpec, apply_na, canonical, resolve_features
from . import scoring as S
from .growth import NODES_SCHEMA, grow_by_levels, grow_partition_fn
from .sampling import Population, candidates, chunk_hash, contiguous_bounds, group_by_bounds, trim_to_psi
from .sketch import LEVELS, exact, level_for, level_of, one_pass_samples

FORMAT_VERSION = 1
# bytes per broadcast block: every Python worker of an executor deserialises its own
# copy, so a block stays small (8 workers x 64 MB)
MAX_BLOCK_BYTES = 64 << 20
# a larger model is not broadcast: a worker would hold all of it
MAX_BROADCAST_BYTES = 4 * MAX_BLOCK_BYTES
# pairs of a point and a tree in one task, where points are dealt before they are walked: each is a
# row of paths, or a term of a score
PATHS_PER_TASK = 2_000_000
SCORES_PER_TASK = 20_000_000
# of the candidates or samples of one task of training; above about 10 MB tasks are no faster
TASK_BYTES = 16 << 20

META_SCHEMA = T.StructType([
    T.StructField("group", T.IntegerType(), False),
    T.StructField("n_trees", T.IntegerType(), False),
    T.StructField("psi", T.IntegerType(), False),
    T.StructField("depth_limit", T.IntegerType(), False),
    T.StructField("c_psi", T.DoubleType(), False),
    T.StructField("n_rows", T.LongType(), False),
    T.StructField("features", T.ArrayType(T.StringType()), False),
    T.StructField("seed", T.LongType(), False),
    T.StructField("assign", T.StringType(), False),
    T.StructField("margin", T.DoubleType(), False),
    T.StructField("spec_json", T.StringType(), False),
    T.StructField("format_version", T.IntegerType(), False),
    T.StructField("chunk_bounds", T.ArrayType(T.LongType()), True),
])


@dataclass
class ForestModel:
    spark: SparkSession
    path: str
    nodes: DataFrame
    spec: FeatureSpec
    n_groups: int
    trees_per_group: int
    psi: int
    limit: int
    seed: int
    assign: str
    margin: float
    n_rows: dict = field(default_factory=dict)
    chunk_bounds: list | None = None  # contiguous chunks: ids opening chunks 1..k-1
    _blocks: list | None = None

    # ------------------------------------------------------------ basics
    @property
    def n_trees_total(self) -> int:
        return self.n_groups * self.trees_per_group

    @property
    def c_psi(self) -> float:
        return c_factor_py(self.psi)

    @property
    def d(self) -> int:
        return self.spec.d

    def meta_df(self) -> DataFrame:
        rows = [(g, self.trees_per_group, self.psi, self.limit, self.c_psi, int(self.n_rows.get(g, 0)),
                 self.spec.names(), int(self.seed), self.assign, float(self.margin),
                 json.dumps(self.spec.to_meta()), FORMAT_VERSION,
                 [int(b) for b in self.chunk_bounds] if self.chunk_bounds is not None else None)
                for g in range(self.n_groups)]
        return self.spark.createDataFrame(rows, META_SCHEMA)

    # ------------------------------------------------------------ packing
    def blocks(self) -> list[Block]:
        """The model as broadcast blocks of at most ``MAX_BLOCK_BYTES`` packed bytes: whole
        forests, or a part of one that is larger.  Blocks are read, packed and broadcast
        one after another, so the driver holds one at a time whatever the model's size.  Those of
        a model above ``MAX_BROADCAST_BYTES`` are shipped as files that workers map."""
        ship_package(self.spark)
        if self._blocks is None:
            trees = [(int(r["group"]), int(r["tree"]), S.bytes_per_tree(self.limit, int(r["n"]))) for r in
                     self.nodes.groupBy("group", "tree").agg(F.count("*").alias("n")).orderBy("tree").collect()]
            large = sum(t[2] for t in trees) > MAX_BROADCAST_BYTES
            self._blocks = []
            for part, whole in S.block_split(trees, MAX_BLOCK_BYTES):
                nodes = self.nodes.where(F.col("tree").between(part[0][1], part[-1][1])).toArrow().to_pandas()
                packed = S.pack(nodes, self.limit)
                self._blocks.append(Block(part[0][0], whole, self._shipped(packed) if large else self.spark.sparkContext.broadcast(packed)))
        return self._blocks

    def _shipped(self, packed: S.PackedTrees) -> S.MappedTrees:
        name = f"lonewood-{uuid.uuid4().hex}.trees"
        self.spark.sparkContext.addFile(put_file(self.spark, f"{shared_dir(self.spark)}/lonewood/blocks", name, S.to_file(packed)))
        return S.MappedTrees(name)

    def release(self) -> None:
        """Drops the broadcast blocks; the next scoring makes them anew."""
        for b in self._blocks or []:
            b.packed.unpersist()
        self._blocks = None

    # ------------------------------------------------------------ scoring
    def group_of(self, df: DataFrame, id_col: str) -> Column:
        """The chunk a row belongs to under the model's assignment (for local scoring)."""
        if self.assign == "hash":
            return chunk_hash(df, self.n_groups, self.seed, id_col)
        if self.assign == "contiguous" and self.chunk_bounds is not None:
            return group_by_bounds(F.col(id_col).cast("bigint"), self.chunk_bounds)
        raise ValueError("local scoring needs chunked forests (assign='hash' or 'contiguous') or group_col=")

    def score(self, df: DataFrame, combine: str = "forest", group_col: str | None = None,
              id_col: str | None = None, prefix: str = "", spread: int | None = None) -> DataFrame:
        """Append ``{prefix}path_mean`` and ``{prefix}score`` to ``df``.

        combine: 'forest' (all trees one ensemble), 'mean_of_forests' (per-group score,
        then arithmetic mean over groups), 'local' (only the row's own group; NULL for rows
        of no or an unknown group).  Several models can score the same scan by chaining
        calls with distinct prefixes.

        The trees are walked in scalar Arrow functions of the feature columns: no other
        column goes to Python, unused ones are not read, and filters on others reach the
        scan.  ``spread`` deals the rows over that many partitions first (a small file is
        one split, and scoring costs rows x trees x depth); by default rows stay in place.
        """
        names = (f"{prefix}path_mean", f"{prefix}score")
        clash = [n for n in names if n in df.columns]
        if clash:
            raise ValueError(f"the input already has columns {clash}: rename them or give a prefix")
        if spread:
            df = df.repartition(spread)
        xs = self.spec.exprs()
        T_, c = float(self.trees_per_group), self.c_psi
        own = uuid.uuid4().hex
        blocks = self.blocks()
        if combine == "local":
            g = (F.col(group_col) if group_col else self.group_of(df, id_col)).cast("int")
            hs = [_local_sum(b.packed)(g, *xs) for b in blocks]
            known = g.between(0, self.n_groups - 1)
            path = F.when(known, _added([F.col(f"_{own}_{i}") for i in range(len(hs))]) / F.lit(T_))
            score = F.pow(F.lit(2.0), -path / F.lit(c))
        elif combine == "forest":
            hs = [_path_sum(b.packed)(*xs) for b in blocks]
            path = _added([F.col(f"_{own}_{i}") for i in range(len(hs))]) / F.lit(float(self.n_trees_total))
            score = F.pow(F.lit(2.0), -path / F.lit(c))
        elif combine == "mean_of_forests":
            hs = [_forest_sums(b.packed, T_, c)(*xs) if b.whole else _path_sum(b.packed)(*xs) for b in blocks]
            col = [F.col(f"_{own}_{i}") for i in range(len(hs))]
            parts: dict[int, list[Column]] = {}  # forests larger than a block
            for b, h in zip(blocks, col):
                if not b.whole:
                    parts.setdefault(b.group, []).append(h)
            sums = [_added(p) for p in parts.values()]
            path = _added([h["paths"] for b, h in zip(blocks, col) if b.whole] + sums) / F.lit(float(self.n_trees_total))
            score = _added([h["scores"] for b, h in zip(blocks, col) if b.whole] +
                           [F.pow(F.lit(2.0), -(v / F.lit(T_)) / F.lit(c)) for v in sums]) / F.lit(float(self.n_groups))
        else:
            raise ValueError("combine must be 'forest', 'mean_of_forests' or 'local'")
        walked = df.select("*", *[h.alias(f"_{own}_{i}") for i, h in enumerate(hs)])
        return walked.select(*[F.col(f"`{n}`") for n in df.columns], path.alias(names[0]), score.alias(names[1]))

    def _walks(self) -> int:
        """Pairs of a training row and a tree."""
        rows = max(self.n_rows.values(), default=0) if self.assign == "all" else sum(self.n_rows.values())
        return rows * self.n_trees_total

    def score_tasks(self) -> int:
        """Tasks for the scores of the training rows, by their number."""
        return max(1, math.ceil(self._walks() / SCORES_PER_TASK))

    def path_tasks(self) -> int:
        """Tasks for the paths of the training rows, by their number."""
        return max(1, math.ceil(self._walks() / PATHS_PER_TASK))

    def paths(self, df: DataFrame, id_col: str, spread: int | None = None) -> DataFrame:
        """Long form (id, group, tree, path_length, leaf): one row per point and tree.

        ``spread`` deals the points over that many partitions first: a point becomes a row per
        tree, so points that fill one split of a file are the work of many tasks."""
        d = self.d
        blocks = self.blocks()
        base = df.select(F.col(id_col).cast("bigint").alias("_id"), *self.spec.exprs())
        if spread and spread > 1:
            base = base.repartition(spread)
        schema = T.StructType([
            T.StructField("id", T.LongType(), False),
            T.StructField("group", T.IntegerType(), False),
            T.StructField("tree", T.IntegerType(), False),
            T.StructField("path_length", T.DoubleType(), False),
            T.StructField("leaf", T.LongType(), False),
            T.StructField("leaf_depth", T.IntegerType(), False),
        ])
        arrow_schema = to_arrow_schema(schema)

        def fn(batches):
            for b in batches:
                X = S.matrix_from_batch(b, d)
                ids = b.column(0).to_numpy(zero_copy_only=False)
                for block in blocks:
                    pk = block.packed.value
                    for r0, r1 in S.row_chunks(X.shape[0]):
                        Xr = X[r0:r1]
                        for t0, t1 in S.tree_chunks(Xr.shape[0], pk.tree_ids.shape[0]):
                            leaf = S.descend(Xr, pk, t0, t1)
                            nt = t1 - t0
                            yield pa.RecordBatch.from_arrays([
                                pa.array(np.repeat(ids[r0:r1], nt).astype(np.int64)),
                                pa.array(np.tile(pk.groups[t0:t1], Xr.shape[0]).astype(np.int32)),
                                pa.array(np.tile(pk.tree_ids[t0:t1], Xr.shape[0]).astype(np.int32)),
                                pa.array(pk.leaf_value[leaf].ravel()),
                                pa.array(pk.heap_of(leaf).ravel().astype(np.int64)),
                                pa.array(pk.leaf_depth[leaf].ravel().astype(np.int32)),
                            ], schema=arrow_schema)

        return base.mapInArrow(fn, schema)


@dataclass
class Block:
    """A part of the model: whole forests from ``group`` on, or a part of that forest."""

    group: int
    whole: bool
    packed: object  # broadcast variable of PackedTrees, or MappedTrees


def _added(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def _matrix(columns) -> np.ndarray:
    return np.ascontiguousarray(np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64, copy=False) for c in columns]))


def _path_sum(packed):
    """Sum of path lengths over all trees of a block."""

    @F.arrow_udf("double")
    def path_sum(*xs: pa.Array) -> pa.Array:
        return pa.array(S.path_sums(_matrix(xs), packed.value))

    return path_sum


def _forest_sums(packed, trees: float, c: float):
    """Of a block of whole forests: the sum of path lengths, and of the forests' scores."""

    @F.arrow_udf("struct<paths: double, scores: double>")
    def forest_sums(*xs: pa.Array) -> pa.Array:
        paths, scores = S.forest_sums(_matrix(xs), packed.value, trees, c)
        return pa.StructArray.from_arrays([pa.array(paths), pa.array(scores)], names=["paths", "scores"])

    return forest_sums


def _local_sum(packed):
    """Sum of path lengths over the block's trees of the row's own group."""

    @F.arrow_udf("double")
    def local_sum(*columns: pa.Array) -> pa.Array:
        g = columns[0].fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.array(S.local_sums(_matrix(columns[1:]), packed.value, g))

    return local_sum


# ================================================================= fit
def default_limit(psi: int) -> int:
    return int(math.ceil(math.log2(psi)))


def prepare(df: DataFrame, features=None, feature_col=None, id_col: str = "id", na: str = "drop",
            dim: int | None = None):
    spec = resolve_features(df, features, feature_col, dim)
    pts = canonical(apply_na(df, spec, na, id_col), spec, id_col)
    return spec, pts


def assign_groups(pts: DataFrame, groups: int, assign: str, seed: int):
    """Adds ``_g``; returns rows per group (k small rows collected) and, for contiguous
    chunks, the ids opening each chunk."""
    bounds = None
    if assign == "hash":
        pts = pts.withColumn("_g", chunk_hash(pts, groups, seed))
    elif assign == "contiguous":
        # ids are unique (fit's contract), so rank boundaries are id boundaries
        bounds = contiguous_bounds(pts, groups)
        pts = pts.withColumn("_g", group_by_bounds(F.col("_id"), bounds))
    else:
        raise ValueError("assign must be 'all', 'hash' or 'contiguous'")
    counts = {int(r["_g"]): int(r["n"]) for r in pts.groupBy("_g").agg(F.count("*").alias("n")).collect()}
    return pts, counts, bounds


def rows_per_task(d: int) -> int:
    """Rows of id, tree and ``d`` features for one task of training."""
    return max(1024, TASK_BYTES // (8 * (d + 2)))


def sample_partitions(spark: SparkSession, trees: int, psi: int, d: int) -> int:
    """Tasks for the samples of all trees: at least as many as run side by side, more if the
    rows ask for it, and a tree each at most."""
    slots = spark.sparkContext.defaultParallelism
    return max(1, min(trees, max(slots, math.ceil(trees * psi / rows_per_task(d)))))


def sample_trees(pts: DataFrame, pops: list[Population], psi: int, seed: int, margin: float,
                 pop_col: str | None, n_parts: int, d: int) -> DataFrame:
    cands = candidates(pts, pops, psi, seed, margin, pop_col, rows_per_task(d), min(n_parts, pts.sparkSession.sparkContext.defaultParallelism))
    return trim_to_psi(cands, psi, seed, n_parts)


def grow_samples(sample: DataFrame, d: int, limit: int, seed: int, n_trees: int, n_parts: int) -> DataFrame:
    """Trees from samples (``_tree``, ``_id``, features): a task grows whole trees."""
    grower = grow_partition_fn(d, limit, seed, n_trees, to_arrow_schema(NODES_SCHEMA))
    cols = ["_tree", "_id"] + [f"_x{i}" for i in range(d)]
    return sample.select(*cols).repartition(n_parts, "_tree").mapInArrow(grower, NODES_SCHEMA)


def tree_samples(df: DataFrame, features=None, feature_col: str | None = None, id_col: str = "id",
                 n_trees: int = 100, psi: int = 256, seed: int = 0, groups: int = 1, assign: str = "all",
                 na: str = "drop", margin: float = 8.0, dim: int | None = None, with_features: bool = False) -> DataFrame:
    """F1 on its own: (group, tree, id) of every tree's psi-row sample, and on request the
    features as an array ``x``."""
    spec, pts = prepare(df, features, feature_col, id_col, na, dim)
    pops, pop_col, pts, _counts, _bounds = _populations(pts, n_trees, psi, seed, groups, assign)
    n_parts = sample_partitions(df.sparkSession, groups * n_trees, psi, spec.d)
    s = sample_trees(pts, pops, psi, seed, margin, pop_col, n_parts, spec.d)
    return s.select((F.col("_tree") / F.lit(n_trees)).cast("int").alias("group"),
                    F.col("_tree").cast("int").alias("tree"), F.col("_id").alias("id"),
                    *([F.array(*[F.col(f"_x{i}") for i in range(spec.d)]).alias("x")] if with_features else []))


def _populations(pts: DataFrame, n_trees: int, psi: int, seed: int, groups: int, assign: str):
    bounds = None
    if assign == "all":
        n = pts.count()
        counts = {0: n}
        pops = [Population(0, n, groups * n_trees, 0)]
        pop_col = None
    else:
        pts, counts, bounds = assign_groups(pts, groups, assign, seed)
        pops = [Population(g, counts.get(g, 0), n_trees, g * n_trees) for g in range(groups)]
        pop_col = "_g"
    for pp in pops:
        if pp.n < psi:
            raise ValueError(f"sample size psi={psi} exceeds the {pp.n} rows of population {pp.pop}")
    return pops, pop_col, pts, counts, bounds


def fit(df: DataFrame, features=None, feature_col: str | None = None, id_col: str = "id",
        n_trees: int = 100, psi: int = 256, limit: int | None = None, seed: int = 0, groups: int = 1,
        assign: str = "all", na: str = "drop", margin: float = 8.0, path: str | None = None,
        dim: int | None = None, strict_ids: bool = False, growth: str = "task", sampling: str = "counted") -> ForestModel:
    """Train ``groups`` forests of ``n_trees`` trees each on sub-samples of ``psi`` rows.

    assign='all'       : every forest samples from all rows (one forest of groups*n_trees trees)
    assign='hash'      : rows are split into ``groups`` chunks by a keyed draw of the id
    assign='contiguous': chunks of consecutive ids (global row index, two passes)

    growth='task'      : a task grows whole trees; its memory holds at least one sample of psi rows
    growth='levels'    : every level of all trees is one Spark aggregate over the samples, for
                         samples too large for a task; the trees are the same

    sampling='counted' : rows are counted first, then drawn with one draw a row (two scans)
    sampling='one_pass': the psi rows of least key of each tree (``sketch``), in one scan with
                         some draws a row, for input that is dear to read or to make; trees
                         are those of ``streaming.refit``.  For assign='all'

    Ids must be unique.  A duplicate that lands in a sample always raises; with
    ``strict_ids=True`` uniqueness is checked over all rows first (one aggregation on
    the id column, partial counts map-side, so a hot duplicated id cannot overload a task).
    """
    spark = df.sparkSession
    ship_package(spark)
    if psi < 2:
        raise ValueError("psi must be >= 2")
    if growth not in ("task", "levels"):
        raise ValueError("growth must be 'task' or 'levels'")
    if n_trees < 1 or groups < 1:
        raise ValueError("n_trees and groups must be >= 1")
    limit = default_limit(psi) if limit is None else int(limit)
    if not 0 <= limit <= 62:
        raise ValueError("limit must be in 0..62 (heap node numbers are 64-bit)")
    if sampling not in ("counted", "one_pass") or (sampling == "one_pass" and assign != "all"):
        raise ValueError("sampling must be 'counted', or 'one_pass' with assign='all'")
    spec, pts = prepare(df, features, feature_col, id_col, na, dim)
    if strict_ids:
        dup = pts.groupBy("_id").count().where(F.col("count") > 1).select("_id").limit(1).collect()
        if dup:
            raise ValueError(f"id {dup[0]['_id']} occurs more than once: the id column must be unique")
    path = path or new_path(spark, "models")
    if sampling == "one_pass":
        return _fit_one_pass(pts, spec, groups, n_trees, psi, limit, int(seed), growth, path)
    pops, pop_col, pts, counts, bounds = _populations(pts, n_trees, psi, seed, groups, assign)
    total = groups * n_trees
    n_parts = sample_partitions(spark, total, psi, spec.d)
    grower = grow_partition_fn(spec.d, limit, seed, n_trees, to_arrow_schema(NODES_SCHEMA))
    cols = ["_tree", "_id"] + [f"_x{i}" for i in range(spec.d)]
    for attempt in range(4):
        # the sample stays hash-partitioned by tree: each task grows whole trees
        sample = sample_trees(pts, pops, psi, seed, margin, pop_col, n_parts, spec.d).select(*cols)
        if growth == "levels":
            nodes = grow_by_levels(sample, spec.d, limit, seed, n_trees)
        else:
            nodes = sample.mapInArrow(grower, NODES_SCHEMA)
        nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        saved = spark.read.parquet(f"{path}/nodes")
        # one aggregate over the saved table: every tree full (root size psi)
        root = F.col("node") == 0
        roots = saved.agg(F.count_if(root).alias("trees"), F.min(F.when(root, F.col("size"))).alias("lo"),
                          F.max(F.when(root, F.col("size"))).alias("hi")).first()
        if roots["trees"] == total and roots["lo"] == psi and roots["hi"] == psi:
            break
        margin *= 2.0  # a tree got fewer than psi candidates: widen p and redraw
    else:
        raise RuntimeError("sampling failed to fill every tree")
    model = ForestModel(spark, path, saved, spec, groups, n_trees, psi, limit, int(seed), assign, margin,
                        dict(counts) if assign != "all" else {g: counts[0] for g in range(groups)}, bounds)
    model.meta_df().write.mode("overwrite").parquet(f"{path}/meta")
    return model


def _fit_one_pass(pts: DataFrame, spec, groups: int, n_trees: int, psi: int, limit: int, seed: int, growth: str, path: str) -> ForestModel:
    """``fit`` on samples of one scan.  The model's number of rows is what the scan's tasks
    counted: one that ran again after a lost executor may count twice.  Nothing else uses it."""
    spark, total, highest = pts.sparkSession, groups * n_trees, LEVELS
    n_parts = sample_partitions(spark, total, psi, spec.d)
    while True:
        seen = Observation()
        one_pass_samples(pts, total, psi, seed, n_parts, highest, seen).write.mode("overwrite").parquet(f"{path}/samples")
        sample = spark.read.parquet(f"{path}/samples")
        per_tree = sample.groupBy("_tree").agg(F.count("*").alias("n"), F.max("_key").alias("worst"))
        found = per_tree.agg(F.count("*").alias("trees"), F.min("n").alias("least"), F.max("worst").alias("worst")).first()
        rows, longest = seen.get["rows"], seen.get["longest"]
        full = found["trees"] == total and found["least"] == psi
        if full and exact(found["worst"], longest, psi, highest):
            break
        reached = min(highest, level_for(longest, psi))
        if not full and not reached:  # nothing was passed over
            raise ValueError(f"sample size psi={psi} exceeds the {rows} rows of population 0")
        highest = min(reached - 1, level_of(found["worst"])) if full else reached - 1
    if growth == "levels":
        columns = ["_tree", "_id"] + [f"_x{i}" for i in range(spec.d)]
        nodes = grow_by_levels(sample.select(*columns), spec.d, limit, seed, n_trees)
    else:
        nodes = grow_samples(sample, spec.d, limit, seed, n_trees, n_parts)
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    model = ForestModel(spark, path, spark.read.parquet(f"{path}/nodes"), spec, groups, n_trees, psi, limit, seed, "all", 0.0, {g: rows for g in range(groups)})
    model.meta_df().write.mode("overwrite").parquet(f"{path}/meta")
    return model


def load_model(spark: SparkSession, path: str) -> ForestModel:
    """The model saved at ``path``: its last version if it has versions."""
    path = versions.resolve(spark, path)
    meta = spark.read.parquet(f"{path}/meta").orderBy("group").collect()
    if not meta:
        raise ValueError(f"no model meta under {path}")
    m0 = meta[0]
    spec = FeatureSpec.from_meta(json.loads(m0["spec_json"]))
    nodes = spark.read.parquet(f"{path}/nodes")
    cb = m0["chunk_bounds"] if "chunk_bounds" in m0.asDict() else None
    return ForestModel(spark, path, nodes, spec, len(meta), int(m0["n_trees"]), int(m0["psi"]),
                       int(m0["depth_limit"]), int(m0["seed"]), m0["assign"], float(m0["margin"]),
                       {int(r["group"]): int(r["n_rows"]) for r in meta}, list(cb) if cb is not None else None)


__all__ = ["ForestModel", "fit", "load_model", "prepare", "default_limit", "shared_dir"]
