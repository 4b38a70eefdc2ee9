"""Unit tests: normaliser values, keyed draws in three engines, path arithmetic, parsers."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lonewood.functions.draws import c_factor, c_factor_py, c_factor_sql, two_u_py, u_col, u_py, u_sql
from lonewood.functions.paths import (branch_numbers, branch_numbers_sql, branch_string, branch_string_sql,
                                      node_at_path, node_at_path_sql)
from lonewood.sources.readers import parse_point_literal, parse_text_points


@pytest.mark.parametrize("n,c", [(2, 0.1544313298), (3, 1.2073923576), (256, 10.2447709201), (512, 11.6310767602)])
def test_c_factor_values(n, c):
    assert abs(c_factor_py(n) - c) < 1e-9


def test_c_factor_small_n_is_zero(spark):
    assert c_factor_py(1) == 0.0 and c_factor_py(0) == 0.0
    got = spark.createDataFrame([(0,), (1,), (2,), (256,)], "n long").select(c_factor(F.col("n")).alias("c")).collect()
    assert [r.c for r in got][:2] == [0.0, 0.0]
    assert abs(got[3].c - c_factor_py(256)) < 1e-12
    d = duckdb.sql(f"SELECT {c_factor_sql('n')} AS c FROM (VALUES (0), (1), (256)) t(n)").fetchall()
    assert d[0][0] == 0.0 and d[1][0] == 0.0 and abs(d[2][0] - c_factor_py(256)) < 1e-12


def test_draws_agree_in_python_spark_duckdb(spark):
    keys = [(7, i, k) for i in (0, 1, 12345678901, -5) for k in (1, 2, 99)]
    py = [u_py(*k) for k in keys]
    df = spark.createDataFrame(keys, "s long, i long, k long")
    sp = [r.u for r in df.select(u_col(F.col("s"), F.col("i"), F.col("k")).alias("u")).collect()]
    vals = ", ".join(f"({s}, {i}, {k})" for s, i, k in keys)
    dd = [r[0] for r in duckdb.sql(f"SELECT {u_sql('s', 'i', 'k')} FROM (VALUES {vals}) t(s, i, k)").fetchall()]
    assert py == sp == dd
    assert all(0.0 <= u < 1.0 for u in py)
    both = [two_u_py(*k) for k in keys]
    sp = [r.u for r in df.select(u_col(F.col("s"), F.col("i"), F.col("k"), second=True).alias("u")).collect()]
    dd = [r[0] for r in duckdb.sql(f"SELECT {u_sql('s', 'i', 'k', second=True)} FROM (VALUES {vals}) t(s, i, k)").fetchall()]
    assert [a for a, _ in both] == py and [b for _, b in both] == sp == dd and not set(sp) & set(py)


def test_branch_and_node_arithmetic(spark):
    rows = [(0, 0), (1, 1), (2, 1), (9, 3), (10, 3), (254, 7)]
    df = spark.createDataFrame(rows, "node long, depth int")
    got = df.select(branch_string("node", "depth").alias("b")).collect()
    assert [r.b for r in got] == ["", "L", "R", "LRL", "LRR", "RRRRRRR"]
    back = df.select(node_at_path(branch_string("node", "depth")).alias("n")).collect()
    assert [r.n for r in back] == [r[0] for r in rows]
    # letters other than L/R are ignored
    assert spark.range(1).select(node_at_path(F.lit("LxR?L")).alias("n")).first().n == 9
    nums = spark.range(1).select(branch_numbers(F.lit("LRL"), 0).alias("a"), branch_numbers(F.lit("LR"), 5).alias("b")).first()
    assert nums.a == [0, 1, 4, 9] and nums.b == [5, 11, 24]
    d = duckdb.sql(f"SELECT {branch_string_sql('10', '3')}, {node_at_path_sql(repr('LxR?L'))}, "
                   f"{branch_numbers_sql(repr('LR'), 5)}").fetchall()[0]
    assert d[0] == "LRR" and d[1] == 9 and list(d[2]) == [5, 11, 24]


def test_point_literal_parse(spark):
    df = spark.createDataFrame([("(3.3, 3.3)",), ("((1,2,3))",), (" 4 , 5 ",), ("(1, abc)",), ("(2.5e-3,-1)",)], "s string")
    got = [r.a for r in df.select(parse_point_literal("s").alias("a")).collect()]
    assert got[0] == [3.3, 3.3]
    assert got[1] == [1.0, 2.0, 3.0]
    assert got[2] == [4.0, 5.0]
    assert got[3] == [1.0, None]
    assert got[4] == [0.0025, -1.0]


def test_text_points_parse(spark):
    lines = spark.createDataFrame([("1.5,2,extra",), ("x,y",), ("",), ("3,4\r",)], "value string")
    got = parse_text_points(lines).collect()
    assert [(r.x, r.y) for r in got] == [(1.5, 2.0), (None, None), (3.0, 4.0)]
