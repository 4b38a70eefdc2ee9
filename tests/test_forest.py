"""Sampling, growth and scoring: invariants, edge cases, layout independence, behaviour."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF01, gauss, points_df, sine
from lonewood.operators import inspect as I
from lonewood.operators.forest import fit, tree_samples


@pytest.fixture(scope="module")
def orders(spark):
    return spark.read.parquet(f"{SF001}/orders.parquet").select(
        "o_orderkey", "o_totalprice", F.dayofyear("o_orderdate").alias("doy"))


@pytest.fixture(scope="module")
def model(orders):
    return fit(orders, features=["o_totalprice", "doy"], id_col="o_orderkey", n_trees=30, psi=64, seed=3)


def test_every_tree_gets_exactly_psi_distinct_rows(orders):
    s = tree_samples(orders, features=["o_totalprice", "doy"], id_col="o_orderkey", n_trees=40, psi=64, seed=9)
    per = s.groupBy("tree").agg(F.count("*").alias("n"), F.countDistinct("id").alias("u")).collect()
    assert len(per) == 40
    assert all(r.n == 64 and r.u == 64 for r in per)


def test_sample_is_layout_independent(spark, orders):
    a = tree_samples(orders, features=["o_totalprice", "doy"], id_col="o_orderkey", n_trees=10, psi=32, seed=4)
    b = tree_samples(orders.repartition(7), features=["o_totalprice", "doy"], id_col="o_orderkey", n_trees=10,
                     psi=32, seed=4)
    assert sorted(a.collect()) == sorted(b.collect())


def test_inclusion_frequencies_are_uniform(spark):
    """Each row lands in a tree with probability psi/N; the count over T trees is
    ~Binomial(T, psi/N): mean and variance match."""
    n, T, psi = 1500, 200, 64
    X = np.random.default_rng(1).normal(size=(n, 2))
    s = tree_samples(points_df(spark, X), features=["x", "y"], id_col="id", n_trees=T, psi=psi, seed=5)
    counts = np.zeros(n)
    for r in s.groupBy("id").count().collect():
        counts[r["id"]] = r["count"]
    p = psi / n
    assert abs(counts.mean() - T * p) < 1e-9
    ratio = counts.var() / (T * p * (1 - p))
    assert 0.85 < ratio < 1.15


def test_tree_invariants(model):
    nodes = model.nodes
    st = I.tree_stats(nodes).collect()
    assert len(st) == 30
    assert all(r.leaf_size_sum == 64 and r.root_size == 64 and r.max_depth <= 6 for r in st)
    sc = I.split_children(nodes).where(F.col("left_size") + F.col("right_size") != F.col("size")).count()
    assert sc == 0
    # every internal node has its threshold inside the data range of its split feature
    assert nodes.where(~F.col("is_leaf") & F.col("threshold").isNull()).count() == 0
    assert nodes.where(F.col("is_leaf") & F.col("threshold").isNotNull()).count() == 0


def test_scores_in_range_and_product_equals_forest(model, orders):
    s = model.score(orders, id_col="o_orderkey")
    agg = s.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert 0 < agg.lo <= agg.hi <= 1
    p = model.paths(orders, "o_orderkey")
    f = F.pow(F.lit(2.0), -F.col("path_length") / F.lit(30.0) / F.lit(model.c_psi))
    prod = p.groupBy("id").agg(F.product(f).alias("sp"))
    j = s.join(prod, s.o_orderkey == prod.id).select(F.max(F.abs(F.col("score") - F.col("sp"))).alias("d")).first()
    assert j.d < 1e-9


def test_same_seed_same_model_under_repartition(orders, model):
    m2 = fit(orders.repartition(5), features=["o_totalprice", "doy"], id_col="o_orderkey", n_trees=30, psi=64, seed=3)
    a = sorted(tuple(r) for r in model.nodes.collect())
    b = sorted(tuple(r) for r in m2.nodes.collect())
    assert a == b


def test_mean_of_forests_at_least_forest_score(orders):
    m = fit(orders, features=["o_totalprice", "doy"], id_col="o_orderkey", n_trees=10, psi=64, seed=2, groups=4)
    a = m.score(orders, "forest", id_col="o_orderkey").select("o_orderkey", F.col("score").alias("sf"))
    b = m.score(orders, "mean_of_forests", id_col="o_orderkey").select("o_orderkey", F.col("score").alias("sm"))
    worst = a.join(b, "o_orderkey").select(F.min(F.col("sm") - F.col("sf")).alias("m")).first().m
    assert worst >= -1e-12  # Jensen: mean of convex function >= function of mean


def test_local_scoring_uses_own_group_only(orders):
    m = fit(orders, features=["o_totalprice", "doy"], id_col="o_orderkey", n_trees=10, psi=64, seed=2, groups=4,
            assign="hash")
    loc = m.score(orders, "local", id_col="o_orderkey")
    assert loc.count() == orders.count()
    # recompute by hand for a few rows from the long form
    p = m.paths(orders, "o_orderkey")
    g = orders.select(F.col("o_orderkey").alias("id"), m.group_of(orders, "o_orderkey").alias("g"))
    own = p.join(g, "id").where(F.col("group") == F.col("g")).groupBy("id").agg((F.sum("path_length") / 10).alias("pm"))
    d = loc.join(own, loc.o_orderkey == own.id).select(F.max(F.abs(F.col("path_mean") - F.col("pm"))).alias("d")).first()
    assert d.d < 1e-9


def test_psi_larger_than_data_raises(spark):
    X = np.random.default_rng(0).normal(size=(50, 2))
    with pytest.raises(ValueError, match="exceeds"):
        fit(points_df(spark, X), features=["x", "y"], n_trees=5, psi=64)


def test_n_equals_psi_and_psi_two(spark):
    X = np.random.default_rng(0).normal(size=(64, 2))
    m = fit(points_df(spark, X), features=["x", "y"], n_trees=5, psi=64, seed=1)
    assert all(r.root_size == 64 for r in I.tree_stats(m.nodes).collect())
    m2 = fit(points_df(spark, X), features=["x", "y"], n_trees=5, psi=2, seed=1)
    assert m2.limit == 1 and all(r.leaf_size_sum == 2 for r in I.tree_stats(m2.nodes).collect())


@pytest.mark.parametrize("limit", [0, 1, 20])
def test_explicit_limits(spark, limit):
    X = np.random.default_rng(0).normal(size=(300, 2))
    m = fit(points_df(spark, X), features=["x", "y"], n_trees=4, psi=128, seed=1, limit=limit)
    st = I.tree_stats(m.nodes).collect()
    assert all(r.max_depth <= limit and r.leaf_size_sum == 128 for r in st)
    s = m.score(points_df(spark, X)).agg(F.min("score"), F.max("score")).first()
    assert 0 < s[0] <= s[1] <= 1
    if limit == 0:
        assert all(r.n_nodes == 1 for r in st)
        # root-only trees: h = c(psi) for every point, so every score is exactly 0.5
        assert abs(s[0] - 0.5) < 1e-12 and abs(s[1] - 0.5) < 1e-12


def test_constant_feature_gives_empty_leaves(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(rng.normal()), 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, x double, c double")
    m = fit(df, features=["x", "c"], n_trees=20, psi=128, seed=2)
    st = I.tree_stats(m.nodes).collect()
    assert sum(r.n_empty_leaves for r in st) > 0
    assert all(r.leaf_size_sum == 128 for r in st)
    s = m.score(df).agg(F.min("score"), F.max("score")).first()
    assert 0 < s[0] <= s[1] <= 1


def test_one_feature_and_array_input(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.normal()), [float(v) for v in rng.normal(size=8)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, x double, v array<float>")
    m1 = fit(df, features=["x"], n_trees=5, psi=64, seed=1)
    assert m1.score(df).count() == 300
    m8 = fit(df, feature_col="v", n_trees=5, psi=64, seed=1)
    assert m8.d == 8 and m8.score(df).where(F.col("score").isNull()).count() == 0


def test_nulls_dropped_in_training_and_sent_right_in_scoring(spark):
    rng = np.random.default_rng(4)
    rows = [(i, None if i % 10 == 0 else float(rng.normal()), float(rng.normal())) for i in range(400)]
    rows[5] = (5, float("nan"), 0.0)
    df = spark.createDataFrame(rows, "id bigint, x double, y double")
    m = fit(df, features=["x", "y"], n_trees=10, psi=64, seed=1)
    assert m.n_rows[0] == 400 - 40 - 1
    s = m.score(df)
    assert s.count() == 400 and s.where(F.col("score").isNull()).count() == 0
    with pytest.raises(Exception):
        fit(df, features=["x", "y"], n_trees=2, psi=64, na="fail")


def test_duplicate_ids_are_rejected(spark):
    X = np.random.default_rng(0).normal(size=(100, 2))
    rows = [(i % 50, float(a), float(b)) for i, (a, b) in enumerate(X)]
    df = spark.createDataFrame(rows, "id bigint, x double, y double")
    with pytest.raises(Exception, match="duplicate"):
        fit(df, features=["x", "y"], n_trees=20, psi=64, seed=1)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_planted_gaussian_outlier_is_in_top_ten(spark, seed):
    X = gauss(3000, [0.0, 0.0], seed)
    df = points_df(spark, X)
    m = fit(df, features=["x", "y"], n_trees=200, psi=256, seed=seed)
    top = [r.id for r in m.score(df).orderBy(F.desc("score"), "id").limit(10).collect()]
    assert 0 in top


def test_sine_planted_points(spark):
    X = sine(4000, 7)
    df = points_df(spark, X)
    m = fit(df, features=["x", "y"], n_trees=300, psi=512, seed=7)
    ranked = [r.id for r in m.score(df).orderBy(F.desc("score"), "id").collect()]
    assert ranked.index(2) < 20
    assert ranked.index(0) < 800 and ranked.index(1) < 800


def test_chunk_too_small_raises(spark):
    X = np.random.default_rng(0).normal(size=(600, 2))
    with pytest.raises(ValueError, match="exceeds"):
        fit(points_df(spark, X), features=["x", "y"], n_trees=5, psi=128, groups=8, assign="hash")


def test_contiguous_chunks_follow_id_order(spark):
    X = np.random.default_rng(0).normal(size=(1003, 2))
    m = fit(points_df(spark, X), features=["x", "y"], n_trees=5, psi=64, groups=4, assign="contiguous", seed=1)
    assert [m.n_rows[g] for g in range(4)] == [250, 250, 250, 253]


def test_model_blocks_add_up(spark, model, orders, monkeypatch):
    """A model scored in several broadcast blocks gives the same scores as one block."""
    import lonewood.operators.forest as FO

    one = model.score(orders, id_col="o_orderkey").select("o_orderkey", F.col("score").alias("a"))
    monkeypatch.setattr(FO, "MAX_BLOCK_BYTES", 20_000)
    m2 = FO.load_model(model.spark, model.path)
    assert len(m2.blocks()) > 1
    many = m2.score(orders, id_col="o_orderkey").select("o_orderkey", F.col("score").alias("b"))
    d = one.join(many, "o_orderkey").select(F.max(F.abs(F.col("a") - F.col("b"))).alias("d")).first().d
    assert d < 1e-12


@pytest.mark.parametrize("seed", [1, 2])
def test_level_wise_growth_equals_recursive_definition(seed):
    from lonewood.operators.growth import grow_level_wise, grow_tree

    rng = np.random.default_rng(seed)
    X = np.round(rng.normal(size=(64 * 30, 3)), 1)  # ties
    X[:, 2] = 1.0  # a constant feature -> empty leaves
    tree = np.repeat(np.arange(30), 64)
    ids = np.tile(np.arange(64), 30)
    r = grow_level_wise(tree, ids, X, 6, seed)
    got = sorted((int(t), int(n), int(d), int(s), int(f), None if np.isnan(th) else float(th), bool(lf))
                 for t, n, d, s, f, th, lf in zip(r["tree"], r["node"], r["depth"], r["size"], r["feature"],
                                                  r["threshold"], r["is_leaf"]))
    ref = []
    for t in range(30):
        for n, d, s, f, th, lf in grow_tree(t, X[tree == t], 6, seed):
            ref.append((t, n, d, s, -1 if f is None else f, th, lf))
    assert got == sorted(ref)


def test_strict_ids_checks_all_rows(spark):
    X = np.random.default_rng(0).normal(size=(400, 2))
    rows = [(i if i != 399 else 0, float(a), float(b)) for i, (a, b) in enumerate(X)]
    df = spark.createDataFrame(rows, "id bigint, x double, y double")
    with pytest.raises(ValueError, match="more than once"):
        fit(df, features=["x", "y"], n_trees=2, psi=8, seed=1, strict_ids=True)


def test_e_metric_between_runs_on_sine(spark):
    """Two 500-tree runs with different seeds differ little (E < 0.1); a run against
    itself gives exactly 0.  Both runs score one scan, no join."""
    from lonewood.operators import analysis as A

    X = sine(4000, 3)
    df = points_df(spark, X)
    m1 = fit(df, features=["x", "y"], n_trees=500, psi=256, seed=1)
    m2 = fit(df, features=["x", "y"], n_trees=500, psi=256, seed=2)
    al = A.score_runs(df, {"benchmark": (m1, "forest"), "run": (m2, "forest")}, "id")
    e = A.e_metric(al).first().e_metric
    assert 0 < e < 0.1
    same = A.score_runs(df, {"benchmark": (m1, "forest"), "run": (m1, "forest")}, "id")
    assert A.e_metric(same).first().e_metric == 0.0


def test_local_scoring_of_contiguous_chunks(spark):
    from lonewood.operators.forest import load_model

    X = np.random.default_rng(6).normal(size=(1200, 2))
    df = points_df(spark, X)
    m = fit(df, features=["x", "y"], n_trees=8, psi=64, groups=4, assign="contiguous", seed=3)
    assert len(m.chunk_bounds) == 3 and m.chunk_bounds == [300, 600, 900]
    again = load_model(spark, m.path)
    assert again.chunk_bounds == m.chunk_bounds
    loc = again.score(df, "local", id_col="id")
    p = again.paths(df, "id")
    own = p.where(F.col("group") == F.floor(F.col("id") / 300)).groupBy("id").agg((F.sum("path_length") / 8).alias("pm"))
    d = loc.join(own, "id").select(F.max(F.abs(F.col("path_mean") - F.col("pm"))).alias("d")).first().d
    assert d < 1e-9 and loc.count() == 1200


def test_non_integral_id_is_rejected(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0)], "id string, x double, y double")
    with pytest.raises(TypeError, match="integer"):
        fit(df, features=["x", "y"], n_trees=1, psi=2)


def test_blocks_of_any_size_agree(spark, monkeypatch, orders):
    """Whole forests in a block, several of them, and forests cut over blocks: same scores."""
    import lonewood.operators.forest as FO

    m = fit(orders, features=["o_totalprice", "doy"], id_col="o_orderkey", n_trees=5, psi=32, seed=4, groups=6, assign="hash")
    want = {}
    for size, whole in ((64 << 20, {True}), (30_000, {True}), (3_000, {False})):
        monkeypatch.setattr(FO, "MAX_BLOCK_BYTES", size)
        m2 = FO.load_model(spark, m.path)
        assert {b.whole for b in m2.blocks()} == whole and (len(m2.blocks()) > 1) == (size < 1 << 20)
        for combine in ("forest", "mean_of_forests", "local"):
            got = m2.score(orders, combine, id_col="o_orderkey").orderBy("o_orderkey").select("path_mean", "score").toPandas().to_numpy()
            assert np.allclose(got, want.setdefault(combine, got), rtol=1e-12)
        m2.release()


def test_bounds_of_many_chunks(orders):
    from lonewood.operators.sampling import group_by_bounds

    for bounds in ([], [500], list(range(10, 1000, 10))):
        got = orders.select("o_orderkey", group_by_bounds(F.col("o_orderkey"), bounds).alias("g")).collect()
        assert all(r.g == sum(1 for b in bounds if b <= r.o_orderkey) for r in got)


def test_scoring_reads_and_sends_what_it_needs(spark, model):
    """Only id and features are read, a filter on the id reaches the scan, planning runs no
    job, and columns of any name survive."""
    wide = spark.read.parquet(f"{SF001}/orders.parquet").withColumn("doy", F.dayofyear("o_orderdate"))
    model.blocks()
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup())
    grouped = wide.groupBy("o_orderkey").agg(F.max("o_totalprice").alias("o_totalprice"), F.max("doy").alias("doy"))
    model.score(grouped, id_col="o_orderkey")
    assert len(tracker.getJobIdsForGroup()) == before
    q = model.score(wide, id_col="o_orderkey").where("o_orderkey < 100").select("o_orderkey", "score")
    plan = q._jdf.queryExecution().executedPlan().toString()
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan)[1]
    assert {c.split(":")[0] for c in schema.split(",")} == {"o_orderkey", "o_totalprice", "o_orderdate"}
    assert "LessThan(o_orderkey,100)" in plan
    odd = model.score(wide.withColumn("_xtra", F.lit("kept")).withColumn("_x0", F.lit(1)).withColumn("_h0", F.lit(2)), id_col="o_orderkey").first()
    assert (odd._xtra, odd._x0, odd._h0) == ("kept", 1, 2)


def test_unknown_groups_have_no_score(spark, orders):
    m = fit(orders, features=["o_totalprice", "doy"], id_col="o_orderkey", n_trees=3, psi=16, seed=4, groups=2, assign="hash")
    d = orders.limit(1).crossJoin(spark.createDataFrame([(0,), (2,), (-1,), (None,)], "g int"))
    got = {r.g: r.score for r in m.score(d, "local", group_col="g").collect()}
    assert got[2] is None and got[-1] is None and got[None] is None and 0 < got[0] < 1


def test_null_ids_are_no_rows(spark, orders):
    args = dict(features=["o_totalprice", "doy"], id_col="o_orderkey", n_trees=3, psi=16, seed=4)
    nulls = orders.unionByName(orders.limit(50).withColumn("o_orderkey", F.lit(None).cast("bigint")))
    a, b = fit(orders, **args), fit(nulls, **args)
    assert a.n_rows == b.n_rows and a.nodes.orderBy("tree", "node").collect() == b.nodes.orderBy("tree", "node").collect()
    with pytest.raises(Exception, match="NULL id"):
        fit(nulls, na="fail", **args)


@pytest.mark.parametrize("limit", [40, 57, 62])
@pytest.mark.parametrize("kind", ["normal", "constant", "tied"])
def test_deep_limits(spark, limit, kind):
    """Trees and scores at limits where heap numbers fill all bits."""
    from lonewood.operators.growth import grow_level_wise, grow_tree
    from lonewood.operators.scoring import pack, path_sums

    rng = np.random.default_rng(3)
    X = {"normal": rng.normal(size=(64, 2)), "constant": np.ones((8, 2)), "tied": rng.integers(0, 2, (64, 2)).astype(float)}[kind]
    trees = 100
    tree = np.repeat(np.arange(trees), len(X))
    r = grow_level_wise(tree, np.tile(np.arange(len(X)), trees), np.tile(X, (trees, 1)), limit, 5)
    got = {}
    for t, n, d, s, f, th, leaf in zip(*(r[k].tolist() for k in ("tree", "node", "depth", "size", "feature", "threshold", "is_leaf"))):
        got.setdefault(t, []).append((n, d, s, None if leaf else f, None if leaf else th, leaf))
    want = {t: grow_tree(t, X, limit, 5) for t in range(trees)}
    assert {t: sorted(v, key=lambda x: x[0]) for t, v in got.items()} == {t: sorted(v, key=lambda x: x[0]) for t, v in want.items()}
    import pandas as pd

    nodes = pd.DataFrame({k: r[k] for k in ("tree", "node", "depth", "size", "feature", "threshold", "is_leaf")}).assign(group=0)
    nodes.loc[nodes.is_leaf, "feature"] = np.nan
    slow = np.zeros(len(X))
    from lonewood.functions.draws import c_factor_py

    for t in range(trees):
        by = {n[0]: n for n in want[t]}
        for i, x in enumerate(X):
            n = by[0]
            while not n[5]:
                n = by[2 * n[0] + (1 if x[n[3]] < n[4] else 2)]
            slow[i] += n[1] + c_factor_py(n[2])
    assert np.allclose(path_sums(X, pack(nodes, limit)), slow)


def test_names_of_results_are_not_overwritten(spark, model, orders):
    for name in ("score", "path_mean"):
        with pytest.raises(ValueError, match="already has"):
            model.score(orders.withColumn(name, F.lit(1.0)), id_col="o_orderkey")
    both = model.score(orders.withColumn("score", F.lit(-1.0)), id_col="o_orderkey", prefix="new_").first()
    assert both.score == -1.0 and 0 < both.new_score < 1


@pytest.mark.parametrize("limit", [None, 0, 3, 15])
def test_level_wise_growth_gives_the_same_trees(spark, limit):
    rng = np.random.default_rng(9)
    X = np.column_stack([rng.normal(size=400), rng.integers(0, 3, 400), np.ones(400)])
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(X)], "id bigint, a double, b double, c double")
    args = dict(features=["a", "b", "c"], n_trees=6, psi=100, seed=2, groups=2, assign="hash", limit=limit)
    one, two = (fit(df, growth=g, **args).nodes.orderBy("tree", "node").collect() for g in ("task", "levels"))
    assert one == two
    with pytest.raises(ValueError):
        fit(df, growth="other", **args)


def test_a_model_of_a_hundred_blocks_is_mapped(spark, monkeypatch, orders):
    """A model of over 100 blocks is shipped in files: equal scores and paths, dense or compact."""
    import lonewood.operators.forest as FO

    monkeypatch.setattr(FO, "MAX_BROADCAST_BYTES", 4 * 3_000)
    for limit in (None, 14):
        m = fit(orders, features=["o_totalprice", "doy"], id_col="o_orderkey", n_trees=35, psi=32, limit=limit, seed=4, groups=6, assign="hash")
        got = {}
        for size in (64 << 20, 3_000):
            monkeypatch.setattr(FO, "MAX_BLOCK_BYTES", size)
            monkeypatch.setattr(FO, "MAX_BROADCAST_BYTES", 4 * size)
            m2 = FO.load_model(spark, m.path)
            mapped = [isinstance(b.packed, FO.S.MappedTrees) for b in m2.blocks()]
            assert all(mapped) and len(mapped) >= (100 if limit is None else 40) if size == 3_000 else mapped == [False]
            for combine in ("forest", "mean_of_forests", "local"):
                s = m2.score(orders, combine, id_col="o_orderkey").orderBy("o_orderkey").select("path_mean", "score").toPandas().to_numpy()
                assert np.allclose(s, got.setdefault(combine, s), rtol=1e-12)
            p = sorted(map(tuple, m2.paths(orders.where("o_orderkey < 50"), "o_orderkey").collect()))
            assert p == got.setdefault("paths", p)
            m2.release()


def test_mapped_blocks_are_no_memory_of_the_worker(tmp_path):
    from lonewood.operators import scoring as S

    def anonymous():
        with open("/proc/self/status") as f:
            return next(int(line.split()[1]) for line in f if line.startswith("RssAnon")) << 10

    n = 1 << 20
    X = np.random.default_rng(0).normal(size=(64, 2))
    made = S.PackedTrees(np.arange(n // 1023), np.zeros(n // 1023, np.int64), 9, True, np.zeros(n, np.int32), np.linspace(-3, 3, n), np.ones(n), None, np.full(n, 9, np.int8))
    (tmp_path / "b").write_bytes(S.to_file(made))
    want = S.path_sums(X, made)
    before, kept = anonymous(), []
    for _ in range(10):
        kept.append(S.from_file(str(tmp_path / "b")))
        assert np.array_equal(S.path_sums(X, kept[-1]), want) and not kept[-1].threshold.flags.owndata
    assert anonymous() - before < 21 * n  # less than one block, with ten of them open


def test_paths_of_one_split_are_the_work_of_many_tasks(spark, monkeypatch):
    from lonewood.operators import forest
    from lonewood.plans import catalog

    monkeypatch.setattr(forest, "PATHS_PER_TASK", 20_000)
    dealt = catalog.paths(spark, SF01, catalog.M_CUST)
    m = catalog.model(spark, SF01, catalog.M_CUST)
    plain = m.paths(catalog.CUST.df(spark, SF01), "c_custkey")
    assert plain.rdd.getNumPartitions() == 1
    assert m.path_tasks() > 1 and dealt.rdd.getNumPartitions() == m.path_tasks()
    assert sorted(dealt.collect()) == sorted(plain.collect())


def test_scores_of_one_split_are_the_work_of_many_tasks(spark, monkeypatch):
    from lonewood.operators import forest
    from lonewood.plans import catalog

    plain = catalog.scores(spark, SF001, catalog.M_ORD)
    monkeypatch.setattr(forest, "SCORES_PER_TASK", 50_000)
    dealt = catalog.scores(spark, SF001, catalog.M_ORD)
    m = catalog.model(spark, SF001, catalog.M_ORD)
    assert plain.rdd.getNumPartitions() == 1 < m.score_tasks() == dealt.rdd.getNumPartitions()
    assert sorted(dealt.collect()) == sorted(plain.collect())
