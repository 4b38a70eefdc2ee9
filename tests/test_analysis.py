"""Ordering, analysis and inspection operators against brute force on small inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import gauss, points_df
from lonewood.operators import analysis as A
from lonewood.operators import inspect as I
from lonewood.operators.forest import fit
from lonewood.operators.ordering import global_row_index, running_counts


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(11)
    vals = np.round(rng.uniform(0.3, 0.8, 2000), 4)  # ties on purpose
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "id bigint, score double"), vals


def test_global_row_index_matches_sort(spark, scores):
    df, vals = scores
    ix = global_row_index(df.repartition(5), [F.col("score"), F.col("id")], n_parts=6)
    got = {r.id: r.row_index for r in ix.collect()}
    order = sorted(range(len(vals)), key=lambda i: (vals[i], i))
    assert [got[i] for i in order] == list(range(len(vals)))


def test_running_counts(spark, scores):
    df, vals = scores
    d = df.withColumn("flag", (F.col("id") % 3 == 0).cast("int"))
    rc = running_counts(d, [F.col("score"), F.col("id")], ["flag"], n_parts=4).collect()
    order = sorted(range(len(vals)), key=lambda i: (vals[i], i))
    cum, expect = 0, {}
    for i in order:
        cum += int(i % 3 == 0)
        expect[i] = cum
    assert all(r.cum_flag == expect[r.id] for r in rc)


def test_exact_quantiles(scores):
    df, vals = scores
    q = A.exact_quantiles(df, "score", [0.0, 0.25, 0.5, 0.75, 1.0])
    assert np.allclose(q, np.quantile(vals, [0.0, 0.25, 0.5, 0.75, 1.0]), rtol=0, atol=1e-12)


def test_top_bottom_and_layers(scores):
    df, vals = scores
    top = [r.id for r in A.top_anomalies(df, 10).collect()]
    assert top == sorted(range(len(vals)), key=lambda i: (-vals[i], i))[:10]
    bot = [r.id for r in A.bottom_normals(df, 10).collect()]
    assert bot == sorted(range(len(vals)), key=lambda i: (vals[i], i))[:10]
    lay = {r.id: r.layer for r in A.label_layers(df, 10).collect()}
    assert sum(v == "top" for v in lay.values()) == 10 and sum(v == "bottom" for v in lay.values()) == 10
    assert all(lay[i] == "top" for i in top) and all(lay[i] == "bottom" for i in bot)


def test_fixed_histogram_has_empty_bins_and_closed_last_bin(spark):
    vals = [0.0, 0.01, 0.5, 0.5, 1.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id bigint, score double")
    h = {r.bin: r for r in A.hist_fixed(df, "score", 19).collect()}
    assert len(h) == 19
    assert h[0]["count"] == 2 and h[9]["count"] == 2 and h[18]["count"] == 1
    assert sum(r["count"] for r in h.values()) == 5
    assert abs(sum(r.density * (1 / 19) for r in h.values()) - 1.0) < 1e-12
    counts, _ = np.histogram(vals, bins=np.linspace(0, 1, 20))
    assert [h[b]["count"] for b in range(19)] == counts.tolist()


def test_fd_histogram_and_kde(scores):
    df, vals = scores
    h = A.hist_fd(df, "score").collect()
    assert sum(r["count"] for r in h) == len(vals)
    width = h[0].edge_hi - h[0].edge_lo
    assert abs(sum(r.density for r in h) * width - 1.0) < 1e-9
    k = sorted(A.kde(df, "score").collect(), key=lambda r: r.grid_index)
    assert len(k) == 100
    # brute force Gaussian KDE with Scott's factor
    n, sd = len(vals), np.std(vals, ddof=1)
    hbw = sd * n ** (-0.2)
    xs = np.array([r.x for r in k])
    dens = np.exp(-0.5 * ((xs[:, None] - vals[None, :]) / hbw) ** 2).sum(1) / (n * hbw * math.sqrt(2 * math.pi))
    assert np.allclose([r.density for r in k], dens, rtol=1e-9)


def test_comparison_metrics(spark):
    b = spark.createDataFrame([(1, 0.5), (2, 0.4), (3, 0.8)], "id bigint, score double")
    r = spark.createDataFrame([(1, 0.55), (2, 0.4), (3, 0.6)], "id bigint, score double")
    al = A.align_runs(b, r)
    e = A.e_metric(al).first()
    expect = 100.0 / 3 * math.sqrt(((0.55 - 0.5) / 0.5) ** 2 + ((0.6 - 0.8) / 0.8) ** 2)
    assert abs(e.e_metric - expect) < 1e-12
    d = {x.id: x for x in A.rel_diff(al).collect()}
    assert abs(d[3].abs_pct_diff - 25.0) < 1e-9
    m = {x.series: x.max_abs_pct_diff for x in A.max_abs_pct_diff({"a": A.rel_diff(al)}).collect()}
    assert abs(m["*"] - 25.0) < 1e-9
    rk = {x.id: x.rank for x in A.by_benchmark_rank(al).collect()}
    assert rk == {2: 0, 1: 1, 3: 2}


def test_score_position(spark):
    train = spark.createDataFrame([(i, v) for i, v in enumerate([0.1, 0.2, 0.2, 0.5, 0.9])], "id bigint, score double")
    new = spark.createDataFrame([(100, 0.2), (101, 0.05), (102, 0.95)], "id bigint, score double")
    got = {r.id: (r.n_train_le, r.bin) for r in A.score_position(train, new).collect()}
    assert got == {100: (3, 3), 101: (0, 0), 102: (5, 18)}


def test_inspection_tables(spark):
    X = np.random.default_rng(2).normal(size=(500, 2))
    m = fit(points_df(spark, X), features=["x", "y"], n_trees=5, psi=64, seed=3)
    nodes = m.nodes
    br = I.leaf_branches(nodes)
    # one branch per leaf; branch length = depth
    assert br.where(F.length("branch_str") != F.col("depth")).count() == 0
    assert br.count() == nodes.where("is_leaf").count()
    v = I.vertices(br)
    # vertices from the branches = every node of every tree
    assert sorted((r.tree, r.node) for r in v.collect()) == sorted((r.tree, r.node) for r in nodes.collect())
    e = I.edges(br)
    assert e.count() == nodes.count() - 5
    assert e.where(F.col("parent") != F.floor((F.col("child") - 1) / 2)).count() == 0
    mx = {r.tree: r.max_node for r in I.max_node(v).collect()}
    assert mx == {r.tree: r.m for r in nodes.groupBy("tree").agg(F.max("node").alias("m")).collect()}
    # The node reached by 'L' is the root's left child in every tree with a split root
    lk = I.node_lookup(nodes, "L").collect()
    assert all(r.node == 1 and r.depth == 1 for r in lk) and len(lk) == 5


@pytest.mark.parametrize("buckets", [4096, 8, 2])
def test_exact_quantiles_by_refinement(spark, buckets):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(size=3000), np.full(500, 0.25), rng.exponential(size=500) * 1e6])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "id bigint, score double")
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = A.exact_quantiles(df, "score", qs, buckets=buckets)
    assert got == list(np.quantile(vals, qs))


def test_order_statistics_on_large_integers(spark):
    base = 2 ** 60
    ids = [base + 7 * i for i in range(5000)]
    df = spark.createDataFrame([(v,) for v in ids], "v bigint")
    assert A.order_statistics(df, "v", [0, 1, 2499, 4999], buckets=16) == [ids[0], ids[1], ids[2499], ids[4999]]


def test_order_statistics_over_overflowing_ranges(spark):
    """hi - lo is no finite double (no 64-bit integer): the selection still narrows down."""
    rng = np.random.default_rng(4)
    wide = np.concatenate([rng.normal(size=3000), [-1.7e308, 1.7e308, 5e-324, 0.0]])
    df = spark.createDataFrame([(float(v),) for v in wide], "v double")
    assert A.order_statistics(df, "v", [0, 1, 1500, 3002, 3003]) == [np.sort(wide)[r] for r in (0, 1, 1500, 3002, 3003)]
    ints = [-(2 ** 63), 2 ** 63 - 1, *range(2000)]
    df = spark.createDataFrame([(v,) for v in ints], "v bigint")
    assert A.order_statistics(df, "v", [0, 1000, 2001], buckets=8) == [sorted(ints)[r] for r in (0, 1000, 2001)]


def test_order_statistics_jobs_do_not_grow_with_ranks(spark):
    """64 chunk boundaries take as many aggregates as 8."""
    df = spark.createDataFrame([(int(v),) for v in np.random.default_rng(5).integers(0, 10 ** 12, 20000)], "v bigint")
    tracker, jobs = spark.sparkContext.statusTracker(), {}
    for k in (8, 64):
        spark.sparkContext.setJobGroup(f"ranks-{k}", "")
        got = A.order_statistics(df, "v", lambda n: [j * n // k for j in range(1, k)], buckets=1024)
        jobs[k] = len(tracker.getJobIdsForGroup(f"ranks-{k}"))
        assert len(got) == k - 1 and got == sorted(got)
    spark.sparkContext._jsc.sc().clearJobGroup()
    assert jobs[64] <= jobs[8] + 6, jobs  # a level more at most: fewer cuts for each


def test_vertices_and_edges_of_the_node_table(spark):
    X = gauss(300, [0, 0], 2)
    nodes = fit(points_df(spark, X), features=["x", "y"], n_trees=4, psi=32, seed=3).nodes
    br = I.leaf_branches(nodes)
    assert sorted(I.node_vertices(nodes).collect()) == sorted(I.vertices(br).collect())
    assert sorted(I.node_edges(nodes).collect()) == sorted(I.edges(br).collect())
    want = {(r.tree, r.node): r.size for r in nodes.collect()}
    sc = I.split_children(nodes).collect()
    assert len(sc) == nodes.where("not is_leaf").count()
    assert all((r.left_size, r.right_size, r.size) == (want[r.tree, 2 * r.node + 1], want[r.tree, 2 * r.node + 2], want[r.tree, r.node]) for r in sc)


def test_series_total_and_runs(spark):
    a = spark.createDataFrame([(1, 1.5), (2, 2.0)], "k int, v double")
    b = spark.createDataFrame([(2, 10.0), (1, 20.0), (3, 1.0)], "k int, v double")
    assert sorted(map(tuple, A.series_total(a, b, "k", "v").collect())) == [(1, 21.5), (2, 12.0)]


def test_grouped_histogram_per_point(spark):
    rows = [(1, 0.1), (1, 0.12), (1, 0.9), (2, 0.5), (2, 1.0)]
    df = spark.createDataFrame(rows, "id bigint, s double")
    h = A.hist_fixed(df, "s", 19, by=["id"]).collect()
    assert len(h) == 2 * 19
    per = {}
    for r in h:
        per.setdefault(r["id"], {})[r["bin"]] = r["count"]
    for i, vals in ((1, [0.1, 0.12, 0.9]), (2, [0.5, 1.0])):
        counts, _ = np.histogram(vals, bins=np.linspace(0, 1, 20))
        assert [per[i][b] for b in range(19)] == counts.tolist()
    d1 = sum(r["density"] for r in h if r["id"] == 1) / 19
    assert abs(d1 - 1.0) < 1e-12


def test_range_sort_splits_a_hot_key(spark):
    """A third of the rows are exact copies: the global index still spreads them over
    several range partitions and numbers every row exactly once."""
    from pyspark.sql.functions import spark_partition_id

    rows = [(7, 1.0)] * 3000 + [(i, float(i)) for i in range(6000)]
    df = spark.createDataFrame(rows, "k bigint, v double")
    ix = global_row_index(df, [F.col("k"), F.col("v")], n_parts=6)
    got = ix.select("row_index").collect()
    assert sorted(r.row_index for r in got) == list(range(9000))
    hot = ix.where((F.col("k") == 7) & (F.col("v") == 1.0)).groupBy(spark_partition_id().alias("p")).count().collect()
    assert len(hot) >= 2 and max(r["count"] for r in hot) < 3001


def test_freedman_diaconis_has_no_hidden_limit():
    assert A.fd_bins(10 ** 15, 0.4, 0.6, 0.0, 1.0, None) == 250000
    assert A.fd_bins(10 ** 15, 0.4, 0.6, 0.0, 1.0) == 50 and A.fd_bins(100, 0.5, 0.5, 0.0, 1.0, None) == 50


def test_a_row_index_writes_only_what_is_kept(spark):
    df = spark.createDataFrame([(i % 3, f"k{i}", float(i)) for i in range(50)], "a int, b string, x double").repartition(4)
    ix = global_row_index(df, [F.col("a"), F.col("b")], "i", n_parts=5, keep=["x"])
    written = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in ix.inputFiles()})
    assert written.columns == ["x", "_mid"] and ix.columns == ["x", "i"]
    want = [r.x for r in df.orderBy("a", "b").collect()]
    assert [r.x for r in sorted(ix.collect(), key=lambda r: r.i)] == want
