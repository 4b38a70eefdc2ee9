"""Subprocess body for test_fault_tolerance: Spark with task retries, first attempts of
the growth and scoring tasks fail, results must equal an undisturbed run."""

import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pyarrow as pa  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

spark = (SparkSession.builder.master("local[4,3]").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8")
         .getOrCreate())
spark.sparkContext.setLogLevel("OFF")
if not spark.conf.get("spark.checkpoint.dir", None):
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="lonewood-fault-"))

import lonewood.operators.forest as FO  # noqa: E402

orders = spark.read.parquet(sys.argv[1]).select("o_orderkey", "o_totalprice", F.dayofyear("o_orderdate").alias("doy"))
args = dict(features=["o_totalprice", "doy"], id_col="o_orderkey", n_trees=20, psi=64, seed=5)
clean = FO.fit(orders, **args)
clean_nodes = sorted(tuple(r) for r in clean.nodes.collect())
clean_scores = {r.o_orderkey: r.score for r in clean.score(orders, id_col="o_orderkey").collect()}

original = FO.grow_partition_fn


def flaky_grower(*a, **k):
    inner = original(*a, **k)

    def fn(batches):
        from pyspark import TaskContext

        tc = TaskContext.get()
        if tc.attemptNumber() == 0 and tc.partitionId() == 0:
            raise RuntimeError("injected failure: executor lost during growth")
        yield from inner(batches)

    return fn


FO.grow_partition_fn = flaky_grower
faulty = FO.fit(orders, **args)
FO.grow_partition_fn = original
faulty_nodes = sorted(tuple(r) for r in faulty.nodes.collect())

def flaky_path_sum(packed):
    @F.arrow_udf("double")
    def path_sum(*xs: pa.Array) -> pa.Array:
        from pyspark import TaskContext

        tc = TaskContext.get()
        if tc.attemptNumber() == 0 and tc.partitionId() == 1:
            raise RuntimeError("injected failure: executor lost during scoring")
        return pa.array(FO.S.path_sums(FO._matrix(xs), packed.value))

    return path_sum


FO._path_sum = flaky_path_sum
faulty_scores = {r.o_orderkey: r.score for r in faulty.score(orders, id_col="o_orderkey", spread=4).collect()}
print(json.dumps({"nodes_equal": clean_nodes == faulty_nodes, "scores_equal": clean_scores == faulty_scores,
                  "n_nodes": len(clean_nodes), "n_scores": len(clean_scores)}))
