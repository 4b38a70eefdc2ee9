"""Registered queries: one per operator of the inventory, each with its SQL twin.

Every query reads the driver's tables (whole tables, no row caps) and returns a
DataFrame; ``ORACLE`` holds the equivalent DuckDB SQL over the same tables.  Scenario
and forest definitions are shared by both sides so parameters cannot drift.

Doubles that the two engines compute with different summation order or libm are
rounded to 6 places on both sides; where a result depends on the *order* of scores
(top-k, ranks, "how many training scores are <= s") both sides order by the score
rounded to 9 places, then by id.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import c_factor
from ..functions.paths import branch_string
from ..operators import analysis as A
from ..operators import inspect as I
from ..operators.forest import ForestModel, fit, tree_samples
from ..operators.ordering import global_row_index
from ..operators.sampling import chunk_contiguous, chunk_hash
from ..session import new_path, partitions_for
from ..sources import bundle as B
from ..sources import readers as RD
from ..sources.points import read_parquet_wallclock
from ..sources.ranks import save_ranks
from ..sources.runs import aligned, save_run
from .oracle import ForestSQL, PointsSQL

R = 6  # output rounding for engine-dependent doubles
RK = 9  # rounding of scores used as an ordering key


# ============================================================ scenarios
@dataclass(frozen=True)
class Scen:
    table: str
    id_col: str
    feats: tuple = ()  # (name, expression valid in Spark SQL and DuckDB)
    array_col: str | None = None
    dim: int = 0
    index_keys: tuple = ()  # no key in the table: id = global row index in this order

    def df(self, spark: SparkSession, sf: str) -> DataFrame:
        t = read_parquet_wallclock(spark, f"{sf}/{self.table}.parquet")
        if self.index_keys:  # only the keys and features go through the sort
            keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(self.index_keys)]
            t = t.select(*keys, *[F.expr(e).alias(n) for n, e in self.feats])
            t = global_row_index(t, [F.col(f"_k{i}") for i in range(len(keys))], self.id_col, keep=self.names())
            return t.select(self.id_col, *self.names())
        if self.array_col:
            return t.select(F.col(self.id_col), F.col(self.array_col))
        return t.select(F.col(self.id_col), *[F.expr(e).alias(n) for n, e in self.feats])

    def names(self) -> list[str]:
        return [n for n, _ in self.feats]

    def sql_table(self) -> str:
        if self.index_keys:
            return (f"(SELECT *, row_number() OVER (ORDER BY {', '.join(self.index_keys)}) - 1 AS {self.id_col} "
                    f"FROM {self.table})")
        return self.table

    def psql(self) -> PointsSQL:
        if self.array_col:
            return PointsSQL(self.sql_table(), self.id_col, None, self.array_col, self.dim)
        return PointsSQL(self.sql_table(), self.id_col, [e for _, e in self.feats])


ORD = Scen("orders", "o_orderkey", (("o_totalprice", "o_totalprice"), ("o_doy", "dayofyear(o_orderdate)")))
CUST = Scen("customer", "c_custkey", (("c_acctbal", "c_acctbal"), ("c_nationkey", "c_nationkey")))
PART = Scen("part", "p_partkey", (("p_retailprice", "p_retailprice"), ("p_size", "p_size")))
EVT = Scen("events", "event_id", (("value", "value"), ("ev_hour", "hour(ts)")))
EMB = Scen("embeddings", "vec_id", (), "embedding", 64)
# new points for scoring against the orders model: line-level price and ship day
LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
             "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINE_NEW = Scen("lineitem", "li_id", (("o_totalprice", "l_extendedprice"), ("o_doy", "dayofyear(l_shipdate)")),
                index_keys=tuple(LINE_KEYS))
# lineitem as a training table of its own: no key, id = global row index; heavy ties
LINE = Scen("lineitem", "li_id", (("l_quantity", "l_quantity"), ("l_extendedprice", "l_extendedprice"),
                                  ("l_discount", "l_discount"), ("l_tax", "l_tax")), index_keys=tuple(LINE_KEYS))


@dataclass(frozen=True)
class Spec:
    scen: Scen
    n_trees: int = 100
    psi: int = 256
    seed: int = 7
    groups: int = 1
    assign: str = "all"
    limit: int | None = None

    def fit_args(self) -> dict:
        s = self.scen
        a = dict(id_col=s.id_col, n_trees=self.n_trees, psi=self.psi, seed=self.seed, groups=self.groups,
                 assign=self.assign, limit=self.limit)
        if s.array_col:
            a.update(feature_col=s.array_col, dim=s.dim)
        else:
            a.update(features=s.names())
        return a

    def sql(self, prefix: str = "f") -> ForestSQL:
        return ForestSQL(self.scen.psql(), self.n_trees, self.psi, self.seed, self.groups, self.assign,
                         self.limit, 8.0, prefix)


M_ORD = Spec(ORD, 100, 256, 7)
M_ORD_B = Spec(ORD, 100, 256, 1)  # benchmark run for comparisons
M_ORD_R = Spec(ORD, 100, 256, 2)  # a second serial run
M_ORD_K = Spec(ORD, 25, 256, 11, 4, "all")  # 4 forests, all data each
M_ORD_C = Spec(ORD, 25, 256, 11, 4, "hash")  # 4 forests on hash chunks
M_ORD_CC = Spec(ORD, 25, 256, 11, 4, "contiguous")  # 4 forests on id-contiguous chunks
M_CUST = Spec(CUST, 100, 256, 3)
M_PART = Spec(PART, 100, 256, 5)
M_EVT = Spec(EVT, 100, 256, 13)
M_EMB = Spec(EMB, 50, 128, 17)
M_LINE = Spec(LINE, 20, 256, 19)

_MODELS: dict = {}


def model(spark: SparkSession, sf: str, spec: Spec) -> ForestModel:
    """Fit once per (session, tables, spec); the model lives in the shared folder."""
    key = (spark.sparkContext.applicationId, sf, spec)
    if key not in _MODELS:
        _MODELS[key] = fit(spec.scen.df(spark, sf), **spec.fit_args())
    return _MODELS[key]


def r(c, n: int = R) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, n)


def scores(spark, sf, spec: Spec, combine: str = "forest", data: Scen | None = None) -> DataFrame:
    """(id, path_mean, score) of ``data`` (default: the training table) under ``spec``."""
    m = model(spark, sf, spec)
    scen = data or spec.scen
    df = scen.df(spark, sf)
    # the rows of a file may be a split or two; an index's rows lie in files of their own
    tasks = m.score_tasks() if data is None and not scen.index_keys else 1
    out = m.score(df, combine=combine, id_col=scen.id_col, spread=tasks if tasks > 1 else None)
    return out.select(F.col(scen.id_col).cast("bigint").alias("id"), "path_mean", "score")


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into spark.checkpoint.dir: one lineage cut before multi-pass analysis."""
    return df.checkpoint(eager=True)


def ranked_scores(spark, sf, spec, combine="forest", data=None) -> DataFrame:
    """Scores with the rounded score as ordering key; ``materialize`` it for several passes."""
    return scores(spark, sf, spec, combine, data).withColumn("rscore", F.round("score", RK))


def paths(spark, sf, spec: Spec) -> DataFrame:
    m = model(spark, sf, spec)
    return m.paths(spec.scen.df(spark, sf), spec.scen.id_col, spread=m.path_tasks())


# ============================================================ Spark queries
def q_tree_samples(spark, sf):
    s = M_ORD
    return tree_samples(s.scen.df(spark, sf), **{k: v for k, v in s.fit_args().items() if k != "limit"}).select(
        F.col("tree").cast("bigint").alias("tree"), F.col("id").cast("bigint").alias("id"))


def _nodes_out(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("group").cast("bigint").alias("group"), F.col("tree").cast("bigint").alias("tree"),
                        "node", F.col("depth").cast("bigint").alias("depth"), "size",
                        F.coalesce(F.col("feature"), F.lit(-1)).cast("bigint").alias("feature"), "threshold",
                        "is_leaf")


def q_tree_nodes(spark, sf):
    return _nodes_out(model(spark, sf, M_ORD).nodes)


def q_root_splits(spark, sf):
    s = M_ORD
    smp = tree_samples(s.scen.df(spark, sf), with_features=True, **{k: v for k, v in s.fit_args().items() if k != "limit"})
    roots = model(spark, sf, s).nodes.where(F.col("node") == 0).select("tree", "feature", "threshold")
    xq = F.element_at(F.col("x"), F.col("feature") + 1)
    return smp.join(roots, "tree").groupBy("tree", "feature", "threshold").agg(
        F.min(xq).alias("lo"), F.max(xq).alias("hi"), F.count("*").alias("n")).select(
        F.col("tree").cast("bigint").alias("tree"), F.col("feature").cast("bigint").alias("feature"),
        "threshold", "lo", "hi", "n")


def q_split_children(spark, sf):
    sc = I.split_children(model(spark, sf, M_ORD).nodes)
    return sc.select(F.col("tree").cast("bigint").alias("tree"), "node", "size",
                     F.col("feature").cast("bigint").alias("feature"), "threshold", "left_size", "right_size")


def q_tree_stats(spark, sf):
    st = I.tree_stats(model(spark, sf, M_ORD).nodes)
    return st.select(*[F.col(c).cast("bigint").alias(c) for c in st.columns])


def _forest_stats(m: ForestModel, by_group: bool) -> DataFrame:
    n = m.nodes
    keys = ["group"] if by_group else []
    agg = n.groupBy(*keys).agg(
        F.countDistinct("tree").cast("bigint").alias("n_trees"), F.count("*").alias("n_nodes"),
        F.count_if("is_leaf").alias("n_leaves"),
        F.sum(F.when(F.col("is_leaf"), F.col("size")).otherwise(0)).alias("leaf_size_sum"),
        F.max("depth").cast("bigint").alias("max_depth"))
    if by_group:
        rows = [(g, int(m.n_rows.get(g, 0))) for g in range(m.n_groups)]
        cnt = m.spark.createDataFrame(rows, "group int, n_rows bigint")
        agg = agg.join(cnt, "group").withColumn("group", F.col("group").cast("bigint"))
    else:
        agg = agg.withColumn("n_rows", F.lit(int(m.n_rows.get(0, 0))).cast("bigint"))
    return agg.withColumn("psi", F.lit(m.psi).cast("bigint")).withColumn(
        "depth_limit", F.lit(m.limit).cast("bigint")).withColumn("c_psi", F.round(F.lit(m.c_psi), R))


def q_fit_forest_stats(spark, sf):
    return _forest_stats(model(spark, sf, M_ORD), False)


def q_fit_k_full(spark, sf):
    return _forest_stats(model(spark, sf, M_ORD_K), True)


def q_fit_k_chunks(spark, sf):
    return _forest_stats(model(spark, sf, M_ORD_C), True)


def q_fit_k_contiguous(spark, sf):
    return _forest_stats(model(spark, sf, M_ORD_CC), True)


def q_chunk_hash(spark, sf):
    d = ORD.df(spark, sf).select(F.col(ORD.id_col).cast("bigint").alias("id"))
    return d.select("id", chunk_hash(d, 4, 11, "id").cast("bigint").alias("group"))


def q_chunk_contiguous(spark, sf):
    d = ORD.df(spark, sf).select(F.col(ORD.id_col).cast("bigint").alias("id"))
    n = d.count()
    ix = global_row_index(d, [F.col("id")], "row_index")
    return ix.select("id", chunk_contiguous(F.col("row_index"), n, 4).cast("bigint").alias("group"))


def q_global_row_index(spark, sf):
    li = read_parquet_wallclock(spark, f"{sf}/lineitem.parquet").select(*LINE_KEYS)
    ix = global_row_index(li, [F.col(c) for c in LINE_KEYS], "row_index")
    return ix.select("row_index", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def q_path_lengths(spark, sf):
    p = paths(spark, sf, M_CUST)
    return p.select("id", F.col("tree").cast("bigint").alias("tree"), r("path_length").alias("path_length"), "leaf")


def q_path_trace(spark, sf):
    p = paths(spark, sf, M_CUST)
    return p.select("id", F.col("tree").cast("bigint").alias("tree"),
                    branch_string("leaf", "leaf_depth").alias("branch"))


def _score_out(s: DataFrame) -> DataFrame:
    return s.select("id", r("path_mean").alias("path_mean"), r("score").alias("score"))


def q_score_forest(spark, sf):
    return _score_out(scores(spark, sf, M_ORD))


def q_score_mean_of_forests(spark, sf):
    return _score_out(scores(spark, sf, M_ORD_C, "mean_of_forests"))


def q_score_local(spark, sf):
    return _score_out(scores(spark, sf, M_ORD_C, "local"))


def q_score_local_contiguous(spark, sf):
    return _score_out(scores(spark, sf, M_ORD_CC, "local"))


def q_score_k_full(spark, sf):
    return _score_out(scores(spark, sf, M_ORD_K, "mean_of_forests"))


def q_score_per_tree(spark, sf):
    p = A.per_tree_scores(paths(spark, sf, M_CUST), model(spark, sf, M_CUST).c_psi)
    return p.select("id", F.col("tree").cast("bigint").alias("tree"), r("score").alias("score"))


def q_score_product(spark, sf):
    m = model(spark, sf, M_CUST)
    return A.product_scores(paths(spark, sf, M_CUST), m.n_trees_total, m.c_psi).select("id", r("score").alias("score"))


def q_score_by_tree_agg(spark, sf):
    return _score_out(A.mean_path_scores(paths(spark, sf, M_CUST), model(spark, sf, M_CUST).c_psi))


def q_score_embeddings(spark, sf):
    return _score_out(scores(spark, sf, M_EMB))


def q_score_events(spark, sf):
    return _score_out(scores(spark, sf, M_EVT))


def _cust_bundle(spark, sf) -> B.Bundle:
    key = (spark.sparkContext.applicationId, sf, "cust_bundle")
    if key not in _MODELS:
        s = M_CUST
        _MODELS[key] = B.fit_score_save(s.scen.df(spark, sf), **s.fit_args())
    return _MODELS[key]


def q_score_point(spark, sf):
    bnd = _cust_bundle(spark, sf)
    t = read_parquet_wallclock(spark, f"{sf}/customer.parquet")
    lit = F.concat(F.lit("("), F.col("c_acctbal").cast("string"), F.lit(", "),
                   F.col("c_nationkey").cast("string"), F.lit(")"))
    pts = t.select(F.col("c_custkey").cast("bigint").alias("id"), lit.alias("point"))
    return _score_out(B.score_literals(bnd, pts, "point"))


def q_bundle_scores_roundtrip(spark, sf):
    bnd = _cust_bundle(spark, sf)
    return bnd.scores.select(F.col("c_custkey").cast("bigint").alias("id"), r("path_mean").alias("path_mean"),
                             r("score").alias("score"))


def q_fit_score_save(spark, sf):
    bnd = _cust_bundle(spark, sf)
    s = bnd.scores.select(F.col("c_custkey").cast("bigint").alias("id"), "score")
    s = s.withColumn("rscore", F.round("score", RK))
    return A.top_anomalies(s, 10, "rscore", "id").select("id", r("score").alias("score"))


def q_model_roundtrip(spark, sf):
    """Nodes, thresholds and meta of a model that was written and read again."""
    m = model(spark, sf, M_ORD)
    m2 = B.save_model(m, new_path(spark, "models"))
    n = m2.nodes.groupBy("tree").agg(F.count("*").alias("n_nodes"), F.sum("size").alias("size_sum"),
                                     F.sum(F.floor(F.col("threshold") * 1000).cast("bigint")).alias("threshold_sum"),
                                     F.sum(F.col("feature").cast("bigint") * F.col("node")).alias("feature_sum"))
    meta = [F.lit(int(v)).cast("bigint").alias(k) for k, v in (
        ("psi", m2.psi), ("depth_limit", m2.limit), ("n_rows", m2.n_rows[0]), ("seed", m2.seed), ("n_features", m2.d))]
    return n.select(F.col("tree").cast("bigint").alias("tree"), "n_nodes", "size_sum", "threshold_sum", "feature_sum", *meta)


def q_score_table(spark, sf):
    """Score an uploaded headerless CSV with a model trained on the part table."""
    m = model(spark, sf, M_PART)
    path = new_path(spark, "uploads")
    read_parquet_wallclock(spark, f"{sf}/part.parquet").select("p_retailprice", F.col("p_size").cast("double")).write.csv(path)
    up = RD.read_points_csv(spark, path, names=["p_retailprice", "p_size"])
    s = m.score(up, id_col="id")
    return s.select(F.col("p_retailprice").alias("x0"), F.col("p_size").alias("x1"), r("score").alias("score"))


def q_csv_points_scan(spark, sf):
    path = new_path(spark, "csv")
    read_parquet_wallclock(spark, f"{sf}/customer.parquet").select("c_acctbal", "c_nationkey").write.csv(path)
    return RD.read_points_csv(spark, path, names=["x0", "x1"]).select("x0", "x1")


def q_text_points_parse(spark, sf):
    path = new_path(spark, "text")
    t = read_parquet_wallclock(spark, f"{sf}/part.parquet")
    t.select(F.concat_ws(",", F.col("p_retailprice").cast("string"), F.col("p_size").cast("string"),
                         F.col("p_name")).alias("value")).write.text(path)
    return RD.read_text_points(spark, path, 2).select("x", "y")


def q_point_literal_parse(spark, sf):
    t = read_parquet_wallclock(spark, f"{sf}/customer.parquet")
    lit = F.concat(F.lit("(("), F.col("c_acctbal").cast("string"), F.lit(" ,"),
                   F.col("c_nationkey").cast("string"), F.lit(") "))
    arr = RD.parse_point_literal(lit)
    return t.select(F.col("c_custkey").cast("bigint").alias("id"), F.size(arr).cast("bigint").alias("n_values"),
                    arr.getItem(0).alias("x0"), arr.getItem(1).alias("x1"))


def q_assemble_features(spark, sf):
    d = RD.assemble(ORD.df(spark, sf), ORD.names(), "features")
    return d.select(F.col(ORD.id_col).cast("bigint").alias("id"), F.size("features").cast("bigint").alias("n_values"),
                    F.col("features").getItem(0).alias("x0"), F.col("features").getItem(1).alias("x1"))


def q_c_factor(spark, sf):
    t = read_parquet_wallclock(spark, f"{sf}/part.parquet").select(F.col("p_size").cast("bigint").alias("n")).distinct()
    return t.select("n", r(c_factor(F.col("n"))).alias("c"))


def q_node_at_path(spark, sf):
    n = I.node_lookup(model(spark, sf, M_ORD).nodes, "LR")
    return n.select(F.col("tree").cast("bigint").alias("tree"), "node", F.col("depth").cast("bigint").alias("depth"),
                    "size", "is_leaf")


def _branches(spark, sf) -> DataFrame:
    return I.leaf_branches(model(spark, sf, M_CUST).nodes)


def q_leaf_branches(spark, sf):
    b = _branches(spark, sf)
    return b.select(F.col("tree").cast("bigint").alias("tree"), "leaf", "size", F.col("branch_str").alias("branch"))


def q_branch_numbers(spark, sf):
    b = I.with_branch_numbers(_branches(spark, sf), 0)
    return b.select(F.col("tree").cast("bigint").alias("tree"), "leaf",
                    F.array_join(F.transform("numbers", lambda v: v.cast("string")), ",").alias("numbers"))


def q_tree_vertices(spark, sf):
    v = I.node_vertices(model(spark, sf, M_CUST).nodes)
    return v.select(F.col("tree").cast("bigint").alias("tree"), "node", "name")


def q_tree_edges(spark, sf):
    e = I.node_edges(model(spark, sf, M_CUST).nodes)
    return e.select(F.col("tree").cast("bigint").alias("tree"), "parent", "child", "side")


def q_tree_max_node(spark, sf):
    mx = I.max_node(I.node_vertices(model(spark, sf, M_CUST).nodes))
    return mx.select(F.col("tree").cast("bigint").alias("tree"), "max_node", "n_vertices")


def q_top_anomalies(spark, sf):
    s = ranked_scores(spark, sf, M_ORD)
    return A.top_anomalies(s, 10, "rscore", "id").select("id", r("score").alias("score"))


def q_bottom_normals(spark, sf):
    s = ranked_scores(spark, sf, M_ORD)
    return A.bottom_normals(s, 10, "rscore", "id").select("id", r("score").alias("score"))


def q_label_layers(spark, sf):
    s = materialize(ranked_scores(spark, sf, M_ORD))
    return A.label_layers(s, 10, "rscore", "id").select("id", r("score").alias("score"), "layer")


def q_mean_var_pop(spark, sf):
    ev = read_parquet_wallclock(spark, f"{sf}/events.parquet")
    m = A.mean_var_pop(ev, "value", ["event_type"])
    return m.select("event_type", "n", r("mean").alias("mean"), r("var_pop").alias("var_pop"))


def _hist_out(h: DataFrame) -> DataFrame:
    return h.select(F.col("bin").cast("bigint").alias("bin"), r("edge_lo").alias("edge_lo"),
                    r("edge_hi").alias("edge_hi"), "count", r("density").alias("density"))


def q_hist_tree_scores(spark, sf):
    m = model(spark, sf, M_CUST)
    p = paths(spark, sf, M_CUST).select(
        F.round(F.pow(F.lit(2.0), -F.col("path_length") / F.lit(m.c_psi)), RK).alias("s"))
    return _hist_out(A.hist_fixed(p, "s", 19, 0.0, 1.0))


def q_hist_scores_fd(spark, sf):
    s = materialize(ranked_scores(spark, sf, M_ORD))
    return _hist_out(A.hist_fd(s, "rscore", 50))


def q_hist_scores_fd_rule(spark, sf):
    """The bin rule itself: a limit that it does not reach."""
    s = materialize(ranked_scores(spark, sf, M_ORD))
    return _hist_out(A.hist_fd(s, "rscore", None))


def q_hist_point_tree_scores(spark, sf):
    """Every customer's own distribution of tree scores."""
    p = A.per_tree_scores(paths(spark, sf, M_CUST), model(spark, sf, M_CUST).c_psi)
    h = A.hist_fixed(p.withColumn("s", F.round("score", RK)), "s", 19, 0.0, 1.0, by=["id"])
    return h.select("id", F.col("bin").cast("bigint").alias("bin"), "count", r("density").alias("density"))


def q_saved_runs_aligned(spark, sf):
    """Two runs that were scored and saved apart, joined by id."""
    runs = [ranked_scores(spark, sf, spec).select("id", "rscore") for spec in (M_ORD_B, M_ORD_R)]
    buckets = partitions_for(runs[0])
    return aligned(spark, *[save_run(s, buckets=buckets) for s in runs], "id", "rscore")


def q_series_total(spark, sf):
    """Two series by nation added up: balances of customers and of suppliers."""
    c = read_parquet_wallclock(spark, f"{sf}/customer.parquet").groupBy(F.col("c_nationkey").cast("bigint").alias("nationkey")).agg(F.sum("c_acctbal").alias("balance"))
    s = read_parquet_wallclock(spark, f"{sf}/supplier.parquet").groupBy(F.col("s_nationkey").cast("bigint").alias("nationkey")).agg(F.sum("s_acctbal").alias("balance"))
    return A.series_total(c, s, "nationkey", "balance").select("nationkey", r("balance", 2).alias("balance"))


def q_score_lineitem(spark, sf):
    return _score_out(scores(spark, sf, M_LINE))


def q_tree_nodes_by_level(spark, sf):
    """The forest of ``tree_nodes``, grown level by level with Spark aggregates."""
    return _nodes_out(fit(M_ORD.scen.df(spark, sf), growth="levels", **M_ORD.fit_args()).nodes)


def q_kde_scores(spark, sf):
    s = materialize(ranked_scores(spark, sf, M_ORD))
    k = A.kde(s, "rscore", 100, 3.0)
    return k.select(F.col("grid_index").cast("bigint").alias("grid_index"), r("x").alias("x"),
                    r("density").alias("density"))


def _aligned(spark, sf, run_spec: Spec, combine: str = "forest") -> DataFrame:
    """(id, benchmark, run): both runs score one scan of orders, no join."""
    runs = {"benchmark": (model(spark, sf, M_ORD_B), "forest"), "run": (model(spark, sf, run_spec), combine)}
    return A.score_runs(ORD.df(spark, sf), runs, ORD.id_col, RK)


def q_score_rel_diff(spark, sf):
    d = A.rel_diff(_aligned(spark, sf, M_ORD_R))
    return d.select("id", "benchmark", "run",
                    r("rel_diff_sq").alias("rel_diff_sq"), r("abs_pct_diff").alias("abs_pct_diff"))


def q_score_e_metric(spark, sf):
    e = A.e_metric(_aligned(spark, sf, M_ORD_R))
    return e.select("n", r("e_metric").alias("e_metric"))


def q_max_abs_pct_diff(spark, sf):
    d1 = A.rel_diff(_aligned(spark, sf, M_ORD_R))
    d2 = A.rel_diff(_aligned(spark, sf, M_ORD_C, "mean_of_forests"))
    m = A.max_abs_pct_diff({"serial_seed2": d1, "chunks4": d2})
    return m.select("series", r("max_abs_pct_diff").alias("max_abs_pct_diff"))


def q_scores_by_benchmark_rank(spark, sf):
    rk = A.by_benchmark_rank(_aligned(spark, sf, M_ORD_R))
    return rk.select("rank", "id", "benchmark", "run")


def q_score_position(spark, sf):
    train = materialize(ranked_scores(spark, sf, M_ORD))
    new = materialize(scores(spark, sf, M_ORD, data=LINE_NEW).withColumn("rscore", F.round("score", RK)))
    pos = A.score_position(train, new, "rscore", "id", 19)
    return pos.select(F.col("rscore").alias("score"), "n_train_le", r("frac_train_le").alias("frac_train_le"),
                      F.col("bin").cast("bigint").alias("bin"))


def q_score_position_saved(spark, sf):
    """The places of ``score_position`` from a rank directory of the training scores."""
    ranks = save_ranks(ranked_scores(spark, sf, M_ORD), new_path(spark, "ranks"), "rscore")
    new = scores(spark, sf, M_ORD, data=LINE_NEW).withColumn("rscore", F.round("score", RK))
    pos = ranks.place(new, "rscore", "id", 19)
    return pos.select(F.col("rscore").alias("score"), "n_train_le", r("frac_train_le").alias("frac_train_le"),
                      F.col("bin").cast("bigint").alias("bin"))


def q_kde_scores_binned(spark, sf):
    k = A.kde_binned(materialize(ranked_scores(spark, sf, M_ORD)), "rscore")
    return k.select(F.col("grid_index").cast("bigint").alias("grid_index"), r("x").alias("x"), r("density").alias("density"))


def q_score_quartiles_sketch(spark, sf):
    """Quartiles of the scores: the exact ones, and whether the sketch's lie within its error."""
    s = materialize(ranked_scores(spark, sf, M_ORD))
    qs, error = [0.25, 0.5, 0.75], 1e-4
    sketch, exact = A.sketch_quantiles(s, "rscore", qs, error), A.exact_quantiles(s, "rscore", qs)
    n = F.count("*")
    sides = s.agg(n.alias("n"), F.array(*[F.struct(
        F.lit(q).alias("q"), F.lit(x).alias("quantile"),
        ((F.count_if(F.col("rscore") < v) <= n * (q + error) + 1) & (F.count_if(F.col("rscore") <= v) >= n * (q - error) - 1)).alias("within_error"))
        for q, v, x in zip(qs, sketch, exact, strict=True)]).alias("a"))
    return sides.select("n", F.explode("a").alias("a")).select("a.q", "n", r("a.quantile").alias("quantile"), "a.within_error")


def q_csv_row_ids(spark, sf):
    """Ids of rows of CSV files: their places."""
    path = new_path(spark, "csv")
    t = read_parquet_wallclock(spark, f"{sf}/customer.parquet").repartitionByRange(4, "c_custkey").sortWithinPartitions("c_custkey")
    t.select("c_custkey", "c_acctbal").write.csv(path)
    return RD.read_points_csv(spark, path, names=["x0", "x1"])


def q_stream_score_events(spark, sf):
    """The events table replayed as a file stream, scored micro-batch by micro-batch."""
    from ..streaming.scoring import replay_as_stream, score_stream, write_scores

    m = model(spark, sf, M_EVT)
    stream = replay_as_stream(spark, EVT.df(spark, sf))
    out = new_path(spark, "stream-sinks")
    q = write_scores(score_stream(m, stream, id_col=EVT.id_col), out)
    q.awaitTermination()
    s = spark.read.parquet(out)
    return _score_out(s.select(F.col(EVT.id_col).cast("bigint").alias("id"), "path_mean", "score"))


M_EVT_F = Spec(EVT, 40, 128, 23)  # a forest that follows the events as they come


def _bottom_points(spark, sf, spec: Spec) -> DataFrame:
    from ..operators.forest import prepare

    return prepare(spec.scen.df(spark, sf), spec.scen.names(), None, spec.scen.id_col)[1]


def q_merged_samples(spark, sf):
    """Samples of five parts of orders, merged in two steps: the sample of all orders."""
    from ..operators.sketch import bottom_samples, level_for, merged

    s = M_ORD
    points = _bottom_points(spark, sf, s)
    level = level_for(points.count(), s.psi)
    part = [bottom_samples(points.where(F.pmod(F.col("_id"), F.lit(5)) == k), s.n_trees, s.psi, s.seed, level) for k in range(5)]
    every = merged([merged(part[:2], s.psi), merged(part[2:], s.psi)], s.psi)
    return every.select(F.col("_tree").alias("tree"), F.col("_id").alias("id"))


def _follow_events(spark, sf):
    from ..streaming.refit import Refit, refit_stream
    from ..streaming.scoring import replay_as_stream

    s = M_EVT_F
    refit = Refit(new_path(spark, "followed"), tuple(s.scen.names()), None, s.scen.id_col, s.n_trees, s.psi, None, s.seed)
    refit_stream(replay_as_stream(spark, s.scen.df(spark, sf), n_files=4), refit).awaitTermination()
    return refit.model(spark)


def q_stream_refit_events(spark, sf):
    """Trees of the last version, after the events came in four micro-batches."""
    return _nodes_out(_follow_events(spark, sf).nodes)


def q_stream_refit_scores(spark, sf):
    """All events scored with the last version."""
    s = M_EVT_F
    out = _follow_events(spark, sf).score(s.scen.df(spark, sf))
    return _score_out(out.select(F.col(s.scen.id_col).cast("bigint").alias("id"), "path_mean", "score"))


def q_tree_nodes_one_pass(spark, sf):
    """Trees of a forest whose samples were drawn in one scan of orders."""
    return _nodes_out(fit(M_ORD.scen.df(spark, sf), sampling="one_pass", **M_ORD.fit_args()).nodes)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "csv_points_scan": q_csv_points_scan,
    "text_points_parse": q_text_points_parse,
    "point_literal_parse": q_point_literal_parse,
    "assemble_features": q_assemble_features,
    "model_roundtrip": q_model_roundtrip,
    "bundle_scores_roundtrip": q_bundle_scores_roundtrip,
    "split_children": q_split_children,
    "chunk_hash": q_chunk_hash,
    "chunk_contiguous": q_chunk_contiguous,
    "label_layers": q_label_layers,
    "tree_samples": q_tree_samples,
    "root_splits": q_root_splits,
    "tree_nodes": q_tree_nodes,
    "fit_forest_stats": q_fit_forest_stats,
    "fit_k_full": q_fit_k_full,
    "fit_k_chunks": q_fit_k_chunks,
    "fit_k_contiguous": q_fit_k_contiguous,
    "path_lengths": q_path_lengths,
    "path_trace": q_path_trace,
    "score_forest": q_score_forest,
    "score_per_tree": q_score_per_tree,
    "score_mean_of_forests": q_score_mean_of_forests,
    "score_k_full": q_score_k_full,
    "score_product": q_score_product,
    "score_by_tree_agg": q_score_by_tree_agg,
    "score_local": q_score_local,
    "score_local_contiguous": q_score_local_contiguous,
    "score_point": q_score_point,
    "score_table": q_score_table,
    "score_embeddings": q_score_embeddings,
    "score_events": q_score_events,
    "score_lineitem": q_score_lineitem,
    "tree_nodes_by_level": q_tree_nodes_by_level,
    "saved_runs_aligned": q_saved_runs_aligned,
    "series_total": q_series_total,
    "hist_scores_fd_rule": q_hist_scores_fd_rule,
    "hist_point_tree_scores": q_hist_point_tree_scores,
    "stream_score_events": q_stream_score_events,
    "merged_samples": q_merged_samples,
    "tree_nodes_one_pass": q_tree_nodes_one_pass,
    "stream_refit_events": q_stream_refit_events,
    "stream_refit_scores": q_stream_refit_scores,
    "fit_score_save": q_fit_score_save,
    "c_factor": q_c_factor,
    "node_at_path": q_node_at_path,
    "leaf_branches": q_leaf_branches,
    "branch_numbers": q_branch_numbers,
    "tree_vertices": q_tree_vertices,
    "tree_edges": q_tree_edges,
    "tree_max_node": q_tree_max_node,
    "tree_stats": q_tree_stats,
    "score_rel_diff": q_score_rel_diff,
    "mean_var_pop": q_mean_var_pop,
    "hist_tree_scores": q_hist_tree_scores,
    "hist_scores_fd": q_hist_scores_fd,
    "kde_scores": q_kde_scores,
    "score_e_metric": q_score_e_metric,
    "max_abs_pct_diff": q_max_abs_pct_diff,
    "score_position_saved": q_score_position_saved,
    "kde_scores_binned": q_kde_scores_binned,
    "score_quartiles_sketch": q_score_quartiles_sketch,
    "csv_row_ids": q_csv_row_ids,
    "score_position": q_score_position,
    "top_anomalies": q_top_anomalies,
    "bottom_normals": q_bottom_normals,
    "scores_by_benchmark_rank": q_scores_by_benchmark_rank,
    "global_row_index": q_global_row_index,
}
