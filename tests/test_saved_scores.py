"""Rank directories, bucketed runs, binned densities, sketched quartiles, row places of files."""

import bisect
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import gauss, points_df
from lonewood.operators import analysis as A
from lonewood.operators.forest import fit
from lonewood.operators.ordering import global_row_index, running_counts
from lonewood.session import new_path
from lonewood.sources import bundle
from lonewood.sources.ranks import load_ranks, save_ranks
from lonewood.sources.readers import read_points_csv
from lonewood.sources.runs import aligned, save_run


def column(spark, values, name="score"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id bigint, {name} double")


@pytest.fixture(scope="module")
def train(spark):
    v = np.round(np.random.default_rng(3).uniform(0.3, 0.8, 3000), 3).tolist()
    return v + [0.5] * 1500 + [None, float("nan")]  # a third of all scores is one value


@pytest.fixture(scope="module")
def ranks(spark, train):
    return save_ranks(column(spark, train), new_path(spark, "t"), n_ranges=6)


@pytest.mark.parametrize("points_per_task", [7, 10 ** 6])
def test_places_by_brute_force(spark, train, ranks, points_per_task):
    ordered = sorted(v for v in train if v is not None and v == v)
    new = [0.0, 0.3, 0.5, 0.4999999, 0.9, 0.55, 0.55, None, float("nan"), *np.round(np.random.default_rng(4).uniform(0.2, 0.9, 200), 4).tolist()] + [0.61] * 100
    got = load_ranks(spark, ranks.ranges.inputFiles()[0].split("/ranges/")[0]).place(column(spark, new), points_per_task=points_per_task).collect()
    assert len(got) == len(new) and ranks.n == len(ordered)
    for r in got:
        s = new[r.id]
        want = None if s is None else bisect.bisect_right(ordered, s) if s == s else len(ordered)
        assert r.n_train_le == want, s
        assert r.frac_train_le == (None if want is None else want / len(ordered))
        assert s is None or s != s or r.bin == min(int(s * 19), 18)


def test_a_point_reads_one_range_and_sorts_nothing(spark, train, ranks):
    placed = ranks.place(column(spark, [0.52]))
    assert placed.first().n_train_le == sum(1 for v in train if v is not None and v <= 0.52)
    physical = placed._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*range#\d+L? = 2\)", physical) and "rangepartitioning" not in physical


def test_an_empty_directory_places_at_zero(spark):
    empty = save_ranks(column(spark, [None]), new_path(spark, "t"))
    assert [(r.n_train_le, r.frac_train_le) for r in empty.place(column(spark, [0.5, 0.5])).collect()] == [(0, 0.0)] * 2
    full = save_ranks(column(spark, [0.5]), new_path(spark, "t"))
    assert full.place(column(spark, [])).count() == 0


def test_a_literal_is_placed_by_the_bundles_directory(spark):
    df = points_df(spark, gauss(400, (0, 0), 1))
    m = fit(df, ["x", "y"], n_trees=10, psi=32, seed=1)
    s = m.score(df).select("id", "score")
    with_ranks = bundle.save_bundle(m, df, s, new_path(spark, "t"), ranks=True)
    plain = bundle.save_bundle(m, df, s, new_path(spark, "t"))
    assert with_ranks.ranks and not plain.ranks
    for text in ("(3.3, 3.3)", "(0, 0.1)"):
        a, b = (bundle.score_literal(x, text).first().asDict() for x in (with_ranks, plain))
        assert a == b and 0 <= a["n_train_le"] <= 400


def test_saved_runs_join_without_an_exchange(spark):
    a, b = (column(spark, np.random.default_rng(s).uniform(size=5000).tolist()) for s in (1, 2))
    names = [save_run(x, buckets=5) for x in (a, b)]
    joined = aligned(spark, *names)
    joined.collect()
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    want = a.join(b.withColumnRenamed("score", "run"), "id")
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, want.collect()))


def test_binned_density_is_close_to_the_exact_one(spark):
    v = np.r_[np.random.default_rng(1).normal(0.5, 0.05, 3000), np.random.default_rng(2).normal(0.7, 0.02, 300)].tolist()
    s = column(spark, [*v, None])
    exact, binned = (f(s).orderBy("grid_index").toPandas() for f in (A.kde, A.kde_binned))
    assert np.allclose(exact.x, binned.x) and np.abs(exact.density - binned.density).max() < 1e-4 * exact.density.max()
    coarse = A.kde_binned(s, cells=512).orderBy("grid_index").toPandas()
    assert np.abs(exact.density - coarse.density).max() > np.abs(exact.density - binned.density).max()
    assert "Python" not in A.kde_binned(s)._jdf.queryExecution().executedPlan().toString()
    for few in ([], [0.5], [0.5, 0.5], [None, float("nan")]):
        assert A.kde_binned(column(spark, few)).count() == 0
    assert A.kde_binned(column(spark, [0.1, 0.9])).count() == 100


def test_sketched_quartiles(spark):
    v = np.random.default_rng(1).exponential(size=20000)
    s, ordered = column(spark, v.tolist()).repartition(7), np.sort(v)
    for error in (1e-2, 1e-3):
        for q, got in zip((0.25, 0.5, 0.9), A.sketch_quantiles(s, "score", [0.25, 0.5, 0.9], error), strict=True):
            assert abs(np.searchsorted(ordered, got) - q * len(v)) <= error * len(v) + 1
    assert all(np.isnan(A.sketch_quantiles(column(spark, []), "score", [0.5, 0.6])))
    a, b = (A.hist_fd(s, "score", None, error=e) for e in (None, 1e-4))
    assert abs(a.count() - b.count()) <= 0.01 * a.count()
    assert b.agg(F.sum("count")).first()[0] == len(v)
    assert A.hist_fd(column(spark, []), error=1e-3).count() == 0


def test_row_places_don_t_depend_on_splits(spark):
    path = new_path(spark, "t")
    spark.range(5000, numPartitions=3).select("id", F.lit(1.5)).write.csv(path)
    rows, forests = set(), set()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "3k", "700b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = read_points_csv(spark, path, names=["x", "y"])
            got = sorted((r.id, r.x, r.y) for r in df.collect())
            assert [(i, x) for i, x, _ in got] == [(i, float(i)) for i in range(5000)]
            rows.add((df.rdd.getNumPartitions() > 20, len(got)))
            if size != "700b":
                forests.add(tuple(sorted(map(str, fit(df, ["x"], n_trees=4, psi=16, seed=1).nodes.collect()))))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 2 and len(forests) == 1
    assert read_points_csv(spark, path + "/part-00001*", names=["x"]).agg(F.min("id"), F.max("id")).first() == (0, 1666)


def test_offsets_are_joined(spark):
    df = column(spark, [0.5] * 700 + [0.1, 0.9, None]).withColumn("f", (F.col("id") % 2).cast("int"))
    idx = global_row_index(df, [F.col("score"), F.col("id")], "i", n_parts=7)
    got = {r.id: r.i for r in idx.collect()}
    assert got == {i: k for k, i in enumerate([702, 700, *range(700), 701])} and idx.columns == [*df.columns, "i"]
    rc = running_counts(df, [F.col("score"), F.col("id")], ["f"], n_parts=7, index_col="i").orderBy("i").collect()
    assert [r.cum_f for r in rc] == np.cumsum([r.f for r in rc]).tolist() and [r.i for r in rc] == list(range(703))
    empty = global_row_index(df.where("id < 0"), [F.col("id")], "i")
    assert empty.count() == 0
