"""Print the physical plans of the main operators (no actions on the data besides the
small counts fit needs to size its sampling).

usage: python tools/show_plans.py [SF_DIR]
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def tree(df) -> str:
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.initialPlan()  # prepared plan, exchanges included, before runtime re-planning
    return "\n".join(line[:160] for line in plan.treeString().splitlines()) + "\n"


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    import lonewood.operators.forest as FO
    from lonewood.operators import analysis as A
    from lonewood.operators.growth import NODES_SCHEMA, grow_partition_fn
    from lonewood.operators.ordering import global_row_index
    from lonewood.plans.catalog import ORD

    df = ORD.df(spark, sf)
    spec, pts = FO.prepare(df, ORD.names(), None, ORD.id_col, "drop")
    pops, pop_col, pts2, _, _ = FO._populations(pts, 100, 256, 1, 4, "hash")
    sample = FO.sample_trees(pts2, pops, 256, 1, 8.0, pop_col, 8).select("_tree", "_id", "_x0", "_x1")
    grow = sample.mapInArrow(grow_partition_fn(2, 8, 1, 100, to_arrow_schema(NODES_SCHEMA)), NODES_SCHEMA)
    m = FO.fit(df, features=ORD.names(), id_col=ORD.id_col, n_trees=100, psi=256, seed=1)
    m2 = FO.fit(df, features=ORD.names(), id_col=ORD.id_col, n_trees=100, psi=256, seed=2)
    scored = m.score(df, id_col=ORD.id_col).select(F.col(ORD.id_col).alias("id"), "score")
    shows = {
        "fit: sample + grow (4 hash chunks x 100 trees)": grow,
        "score (forest)": m.score(df, id_col=ORD.id_col),
        "score (wide table, filter on the id, two columns kept)": m.score(
            spark.read.parquet(f"{sf}/orders.parquet").withColumn("o_doy", F.dayofyear("o_orderdate"))).where("o_orderkey < 10").select("o_orderkey", "score"),
        "score_runs (two models, one scan)": A.score_runs(df, {"a": (m, "forest"), "b": (m2, "forest")}, ORD.id_col),
        "label_layers": A.label_layers(scored, 10),
        "top_anomalies": A.top_anomalies(scored, 10),
        "paths -> product per id": A.product_scores(m.paths(df, ORD.id_col), m.n_trees_total, m.c_psi),
    }
    for title, d in shows.items():
        print(f"### {title}\n```\n{tree(d)}```\n")


if __name__ == "__main__":
    main()
