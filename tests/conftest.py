import os
import sys

import numpy as np
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[4]").appName("lonewood-tests")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", "8")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    # tests only: a checkpoint folder of our own when the session names none
    if not s.conf.get("spark.checkpoint.dir", None):
        ck = str(tmp_path_factory.mktemp("ckpt"))
        s.conf.set("spark.checkpoint.dir", ck)
        s.sparkContext.setCheckpointDir(ck)
    yield s


def gauss(n, mean, seed, outlier=(3.3, 3.3)):
    """Fixture of FIXTURES.md (gauss0 / gauss10): 2-d normal, row 0 planted."""
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, 2)) + np.array(mean)
    X[0] = outlier
    return X


def sine(n, seed):
    """Fixture 'sine': x ~ U(0,1), y = sin(10x) + N(0,1)/2, three planted rows."""
    rng = np.random.default_rng(seed)
    x = rng.uniform(0, 1, n)
    y = np.sin(10 * x) + rng.normal(size=n) / 2
    X = np.column_stack([x, y])
    X[0], X[1], X[2] = (0.4, 0.9), (0.6, 1.5), (0.5, -3.0)
    return X


def points_df(spark, X, id_offset=0):
    rows = [(int(i + id_offset), float(a), float(b)) for i, (a, b) in enumerate(X)]
    return spark.createDataFrame(rows, "id bigint, x double, y double")
