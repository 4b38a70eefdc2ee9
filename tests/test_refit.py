"""Mergeable samples, forests that follow a stream, versions of saved models."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import gauss, points_df
from lonewood.functions.draws import u_py
from lonewood.operators.forest import fit, prepare
from lonewood.operators.growth import grow_tree
from lonewood.operators.sketch import LEVELS, bottom_samples, exact, hit_probability, key_range, level_for, level_of, merged, one_pass_samples
from lonewood.session import new_path
from lonewood.sources import bundle, versions
from lonewood.streaming.refit import Refit, refit_stream
from lonewood.streaming.scoring import replay_as_stream

SEED = 5


def slow_key(i, tree, n_trees):
    """Key of one pair from the definition."""
    low, width = key_range(0)
    keys = [low + width * u_py(SEED, "c", 0, i, tree)]
    for j in range(1, LEVELS + 1):
        at, k = -1, 1
        while at < tree:
            at += 1 + math.floor(math.log(1.0 - u_py(SEED, "b", j, i, k)) / math.log1p(-hit_probability(j)))
            k += 1
        if at == tree:
            low, width = key_range(j)
            keys.append(low + width * u_py(SEED, "c", j, i, tree))
    return min(keys)


def slow_sample(ids, n_trees, psi):
    return {(t, i) for t in range(n_trees) for _, i in sorted((slow_key(i, t, n_trees), i) for i in ids)[:psi]}


def points(spark, n):
    return prepare(points_df(spark, gauss(n, (0, 0), 1)), ["x", "y"], None, "id")[1]


def pairs(sample):
    return {(r["_tree"], r["_id"]) for r in sample.select("_tree", "_id").collect()}


@pytest.mark.parametrize("n, psi, level", [(300, 16, 0), (900, 16, 1), (5, 5, 0)])
def test_sample_by_brute_force(spark, n, psi, level):
    got = pairs(bottom_samples(points(spark, n).repartition(3), 6, psi, SEED, level))
    assert got == slow_sample(range(n), 6, psi)


def test_any_split_merges_to_the_sample_of_the_whole(spark):
    p = points(spark, 2000)
    want = pairs(bottom_samples(p, 10, 32, SEED, 0))
    rng = np.random.default_rng(1)
    for k in (2, 7):
        cut = p.withColumn("_part", F.pmod(F.xxhash64("_id", F.lit(int(rng.integers(1000)))), F.lit(k)))
        parts = [bottom_samples(cut.where(F.col("_part") == j).drop("_part"), 10, 32, SEED, j % 2) for j in range(k)]
        assert pairs(merged(parts, 32)) == want
        assert pairs(merged([merged(parts[1:], 32), parts[0]], 32)) == want


def test_samples_are_uniform(spark):
    n, trees, psi = 400, 300, 40
    got = bottom_samples(points(spark, n), trees, psi, SEED, 0).groupBy("_id").count().collect()
    counts = np.array([r["count"] for r in got] + [0] * (n - len(got)))
    p = psi / n
    assert counts.sum() == trees * psi
    assert 0.8 < counts.var() / (trees * p * (1 - p)) < 1.25


def test_levels():
    assert level_for(100, 256) == 0 and level_for(10 ** 6, 256) == 2 and level_for(10 ** 30, 256) == LEVELS
    assert [level_of(k) for k in (0.9, 1 / 16, 0.06, 1 / 256, 1e-30)] == [0, 0, 1, 1, LEVELS]
    assert sum(hit_probability(j) for j in range(1, LEVELS + 1)) < 1 / 16 + 1e-9


def nodes_of(model):
    return sorted(tuple(r) for r in model.nodes.collect())


def follow(spark, path, psi=32):
    return Refit(path, ("x", "y"), n_trees=12, psi=psi, seed=SEED)


def test_last_version_equals_one_fit_over_all_rows(spark):
    df = points_df(spark, gauss(3000, (0, 0), 1))
    one = follow(spark, new_path(spark, "t"))
    one.update(df)
    many = follow(spark, new_path(spark, "t"))
    refit_stream(replay_as_stream(spark, df, n_files=5), many).awaitTermination()
    assert versions.latest(spark, many.path)["version"] > 2 and versions.latest(spark, many.path)["rows"] == 3000
    assert nodes_of(one.model(spark)) == nodes_of(many.model(spark))
    ids = np.arange(3000)
    X = gauss(3000, (0, 0), 1)
    sample = slow_sample(ids.tolist(), 12, 32)
    for t in (0, 11):
        rows = np.array(sorted(i for tree, i in sample if tree == t))
        want = {(n[0], n[1], n[2], n[4]) for n in grow_tree(t, X[rows], 5, SEED)}
        assert {(r[2], r[3], r[4], r[6]) for r in nodes_of(one.model(spark)) if r[1] == t} == want
    scores = {r.id: r.score for r in many.model(spark).score(df).collect()}
    assert sorted(scores, key=scores.get)[-150:].count(0) == 1  # the planted point, by twelve small trees


def test_batches_count_once_and_small_beginnings_wait(spark):
    df = points_df(spark, gauss(200, (0, 0), 1))
    m = follow(spark, new_path(spark, "t"))
    assert m.update(df.where("id < 20"), 0)["trees"] is False
    with pytest.raises(ValueError):
        m.model(spark)
    m.update(df.where("id between 20 and 99"), 1)
    again = m.update(df.where("id between 20 and 99"), 1)  # a batch run twice
    assert (again["version"], again["rows"]) == (2, 100)
    assert m.update(df.where("id < 0"), 2)["version"] == 2  # no rows
    m.update(df.where("id >= 100 or id is null"), 3)
    whole = follow(spark, new_path(spark, "t"))
    whole.update(df)
    assert nodes_of(m.model(spark)) == nodes_of(whole.model(spark))
    with pytest.raises(Exception):  # an id for the second time
        follow(spark, new_path(spark, "t")).update(df.union(df).where("id < 20"))


def test_a_failed_update_leaves_the_last_version(spark, monkeypatch):
    df = points_df(spark, gauss(300, (0, 0), 1))
    m = follow(spark, new_path(spark, "t"))
    m.update(df.where("id < 150"), 0)
    before = nodes_of(m.model(spark))
    real = versions.commit

    def fails(*a, **k):
        raise OSError("lost")

    monkeypatch.setattr(versions, "commit", fails)
    with pytest.raises(OSError):
        m.update(df.where("id >= 150"), 1)
    assert nodes_of(m.model(spark)) == before
    monkeypatch.setattr(versions, "commit", real)
    assert m.update(df.where("id >= 150"), 1)["rows"] == 300
    with pytest.raises(RuntimeError):
        versions.commit(spark, m.path, versions.new_folder(m.path), after=1)


def test_saved_models_change_in_one_step(spark, monkeypatch):
    df = points_df(spark, gauss(300, (0, 0), 1))
    a, b = (fit(df, ["x", "y"], n_trees=4, psi=16, seed=s) for s in (1, 2))
    path = new_path(spark, "t")
    first = bundle.save_bundle(a, df, a.score(df), path)
    assert nodes_of(first.model) == nodes_of(a)
    monkeypatch.setattr(type(b), "meta_df", lambda self: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):  # after the nodes, before the meta table
        bundle.save_bundle(b, df, b.score(df), path)
    assert nodes_of(bundle.load_bundle(spark, path).model) == nodes_of(a)
    monkeypatch.undo()
    second = bundle.save_model(b, path)
    assert nodes_of(second) == nodes_of(b) and versions.latest(spark, path)["version"] == 2


@pytest.mark.parametrize("n, psi, tasks", [(900, 16, 1), (900, 16, 5), (5, 5, 2), (6000, 8, 1)])
def test_one_pass_sample_by_brute_force(spark, n, psi, tasks):
    from pyspark.sql import Observation

    p, seen = points(spark, n).repartition(tasks), Observation()
    sample = one_pass_samples(p, 4, psi, SEED, seen=seen).collect()
    assert {(r["_tree"], r["_id"]) for r in sample} == slow_sample(range(n), 4, psi)
    assert seen.get["rows"] == n and n / tasks <= seen.get["longest"] <= n
    assert exact(max(r["_key"] for r in sample), seen.get["longest"], psi)
    assert not exact(0.5, 10 ** 6, psi)


def test_one_pass_fit_reads_once_and_equals_the_followed_forest(spark):
    df = points_df(spark, gauss(3000, (0, 0), 1))
    whole = follow(spark, new_path(spark, "t"))
    whole.update(df)
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    once = df.mapInArrow(count, df.schema)
    for source in (once, df.repartition(7)):
        one = fit(source, ["x", "y"], n_trees=12, psi=32, seed=SEED, sampling="one_pass")
        assert nodes_of(one) == nodes_of(whole.model(spark)) and one.n_rows == {0: 3000}
    assert read.value == 3000
    levels = fit(df, ["x", "y"], n_trees=6, groups=2, psi=32, seed=SEED, sampling="one_pass", growth="levels")
    assert {r[1:] for r in nodes_of(levels)} == {r[1:] for r in nodes_of(one)} and levels.n_rows == {0: 3000, 1: 3000}


def test_one_pass_fit_starts_again_where_a_row_may_be_missing(spark, monkeypatch):
    from lonewood.operators import forest

    df = points_df(spark, gauss(2000, (0, 0), 1)).coalesce(1)
    want = nodes_of(fit(df, ["x", "y"], n_trees=5, psi=16, seed=SEED, sampling="one_pass"))
    real, runs = forest.one_pass_samples, []

    def lossy(points, n_trees, psi, seed, parts, highest, seen):
        runs.append(highest)
        few = points if len(runs) > 1 else points.where("_id % 200 = 0")
        return real(few, n_trees, psi, seed, parts, highest, seen)

    monkeypatch.setattr(forest, "level_for", lambda n, psi: 1)
    monkeypatch.setattr(forest, "one_pass_samples", lossy)
    assert nodes_of(fit(df, ["x", "y"], n_trees=5, psi=16, seed=SEED, sampling="one_pass")) == want
    assert runs == [LEVELS, 0]


def test_one_pass_fit_refuses(spark):
    df = points_df(spark, gauss(30, (0, 0), 1))
    for bad in (df, df.where("id < 0")):
        with pytest.raises(ValueError, match="psi=32 exceeds"):
            fit(bad, ["x", "y"], n_trees=3, psi=32, sampling="one_pass")
    with pytest.raises(ValueError):
        fit(df, ["x", "y"], n_trees=3, psi=8, groups=2, assign="hash", sampling="one_pass")
    with pytest.raises(Exception):  # an id for the second time
        fit(df.union(df), ["x", "y"], n_trees=3, psi=32, sampling="one_pass")
