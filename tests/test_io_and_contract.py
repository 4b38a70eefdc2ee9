"""Readers, bundles, the driver contract and a slice of the SQL oracle."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF01, gauss, points_df
from lonewood.session import new_path
from lonewood.sources import bundle as B
from lonewood.sources import readers as RD


def test_csv_scan_with_header_and_ragged_rows(spark, tmp_path):
    p = tmp_path / "pts.csv"
    p.write_text("a,b\n1.5,2\n3,\n4,5,6\n7,x\n")
    df = RD.read_points_csv(spark, str(p), n_features=2)
    rows = sorted((r.x0, r.x1) for r in df.collect() if r.x0 is not None)
    assert rows == [(1.5, 2.0), (3.0, None), (4.0, 5.0), (7.0, None)]
    assert df.select("id").distinct().count() == 5


def test_bundle_roundtrip_and_point_scoring(spark):
    X = np.random.default_rng(5).normal(size=(600, 2))
    X[0] = (6.0, 6.0)
    df = points_df(spark, X)
    bnd = B.fit_score_save(df, features=["x", "y"], n_trees=50, psi=128, seed=1)
    again = B.load_bundle(spark, bnd.path)
    assert again.scores.count() == 600 and again.data.count() == 600
    assert again.model.n_trees_total == 50 and again.model.psi == 128
    pts = spark.createDataFrame([("(6.0, 6.0)",), ("(0, 0)",)], "s string").select(
        F.monotonically_increasing_id().alias("id"), RD.parse_point_literal("s").alias("a"))
    pts = pts.select("id", F.col("a")[0].alias("x"), F.col("a")[1].alias("y"))
    got = sorted(r.score for r in B.score_points(again, pts).collect())
    saved = {r.id: r.score for r in again.scores.collect()}
    assert abs(got[1] - saved[0]) < 1e-12  # the planted point scores as in the bundle
    assert got[0] < got[1]


def test_entry_runs_on_smoke_tables(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 10
    assert set(df.columns) >= {"id", "score", "path_mean"}
    s = [r.score for r in rows]
    assert s == sorted(s, reverse=True)


def _duck(sf):
    con = duckdb.connect()
    for t in ("customer", "orders", "part", "events", "embeddings", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _norm(x):
    import pandas as pd

    if x is None or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, bool) or isinstance(x, str):
        return x
    if isinstance(x, (int, float)):
        return round(float(x), 9)
    return x


def _rows(pdf):
    cols = sorted(pdf.columns)
    out = [tuple(_norm(x) for x in rec) for rec in pdf[cols].itertuples(index=False)]
    return cols, sorted(out, key=repr)


@pytest.mark.parametrize("name", ["tree_samples", "tree_nodes", "score_forest", "score_local", "tree_edges",
                                  "hist_scores_fd", "score_position", "chunk_contiguous"])
def test_oracle_slice(spark, name):
    import __spark_entry__ as E

    sp = E.queries()[name](spark, SF01).toPandas()
    od = _duck(SF01).sql(E.oracle_sql()[name]).df()
    assert _rows(sp) == _rows(od)


def test_every_query_has_an_oracle():
    import __spark_entry__ as E

    from lonewood.plans.catalog import QUERIES

    assert set(QUERIES) <= set(E.oracle_sql()) <= set(E.queries())


def test_stream_scoring_equals_batch(spark):
    from lonewood.operators.forest import fit
    from lonewood.streaming.scoring import replay_as_stream, score_stream, write_scores

    ev = spark.read.parquet(f"{SF001}/events.parquet").select("event_id", "value", F.hour("ts").alias("h"))
    m = fit(ev, features=["value", "h"], id_col="event_id", n_trees=20, psi=128, seed=2)
    batch = {r.event_id: r.score for r in m.score(ev, id_col="event_id").collect()}
    stream = replay_as_stream(spark, ev, n_files=3)
    out = new_path(spark, "test-stream-out")
    q = write_scores(score_stream(m, stream, id_col="event_id"), out)
    q.awaitTermination()
    got = {r.event_id: r.score for r in spark.read.parquet(out).collect()}
    assert got == batch


def test_naive_timestamps_keep_wall_clock_under_any_session(spark):
    """Naive Parquet timestamps are read as TIMESTAMP_NTZ even when the session would
    map them to local-time instants; day-of-year features do not depend on the zone."""
    from pyspark.sql import types as T

    from lonewood.sources.points import read_parquet_wallclock

    path = f"{SF001}/orders.parquet"
    base = duckdb.sql(f"SELECT sum(dayofyear(o_orderdate)) FROM read_parquet('{path}')").fetchall()[0][0]
    old_tz = spark.conf.get("spark.sql.session.timeZone")
    old_ntz = spark.conf.get("spark.sql.parquet.inferTimestampNTZ.enabled", "true")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")
        df = read_parquet_wallclock(spark, path)
        assert isinstance(df.schema["o_orderdate"].dataType, T.TimestampNTZType)
        got = df.select(F.sum(F.dayofyear("o_orderdate"))).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old_tz)
        spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", old_ntz)
    assert got == base


def test_score_literal_matches_table_scoring(spark):
    X = np.random.default_rng(8).normal(size=(500, 2))
    X[0] = (5.0, -5.0)
    df = points_df(spark, X)
    bnd = B.fit_score_save(df, features=["x", "y"], n_trees=30, psi=128, seed=2)
    one = B.score_literal(bnd, " ((5.0, -5.0)) ").first()
    saved = {r.id: r.score for r in bnd.scores.collect()}
    assert one.x == 5.0 and one.y == -5.0
    assert abs(one.score - saved[0]) < 1e-12


def test_literals_that_are_no_points_are_errors(spark):
    from lonewood.sources.bundle import fit_score_save, score_literal

    X = gauss(300, [0, 0], 2)
    b = fit_score_save(points_df(spark, X), features=["x", "y"], n_trees=10, psi=32, seed=3)
    good = score_literal(b, "(1.0, 2.0)").first()
    train = [r.score for r in b.scores.collect()]
    assert 0 < good.score < 1 and good.n_train_le == sum(s <= good.score for s in train) and good.frac_train_le == good.n_train_le / 300
    for bad in ("(abc, 2.0)", "(1.0, 2.0, 99)", "(1.0)", "", None):
        with pytest.raises(Exception, match="not a point of 2 numbers"):
            score_literal(b, bad).collect()


def test_ragged_csv_rows_fail_when_strict(spark, tmp_path):
    from lonewood.sources.readers import read_points_csv

    f = tmp_path / "x.csv"
    f.write_text("1,2\n3,4,5\n6\nx,7\n")
    loose = read_points_csv(spark, str(f), 2).orderBy("id").collect()
    assert [(r.x0, r.x1) for r in loose] == [(1, 2), (3, 4), (6, None), (None, 7)]
    for text in ("1,2\n3,4,5\n", "1,2\n6\n", "1,2\nx,7\n"):
        f.write_text(text)
        with pytest.raises(Exception):
            read_points_csv(spark, str(f), 2, strict=True).collect()
