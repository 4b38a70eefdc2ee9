"""Saved score runs that are joined where they lie.

A run is a table bucketed and sorted by id.  Two runs with equal numbers of buckets join
bucket by bucket, without an exchange, as often as they are compared."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path, partitions_for


def save_run(scores: DataFrame, id_col: str = "id", buckets: int | None = None, table: str | None = None) -> str:
    """Saves ``scores`` as a table of ``buckets`` buckets by id, and returns its name.  The files lie in
    the shared folder."""
    buckets = buckets or partitions_for(scores)
    table = table or f"run_{uuid.uuid4().hex}"
    dealt = scores.repartition(buckets, F.col(id_col))  # as the buckets are dealt: a file each
    dealt.write.bucketBy(buckets, id_col).sortBy(id_col).option("path", new_path(scores.sparkSession, "runs")).saveAsTable(table)
    return table


def aligned(spark: SparkSession, bench: str, run: str, id_col: str = "id", col: str = "score") -> DataFrame:
    """(id, benchmark, run) of two saved runs, joined bucket by bucket."""
    b = spark.table(bench).select(F.col(id_col).alias("id"), F.col(col).alias("benchmark"))
    r = spark.table(run).select(F.col(id_col).alias("id"), F.col(col).alias("run"))
    return b.join(r.hint("merge"), "id")
