"""Rank directories: saved scores in which a new point finds its place without a sort.

``save_ranks`` range-partitions the scores once and writes a folder per range, every
different score of it with the number of scores up to and including it, and a directory with
the least score of each range.  A new score lies in the last range that begins at or below
it, so only the ranges that new scores fall into are read (partition pruning), and within a
range the place is the last score at or below the new one.

Runs of one score, however long, are one row.  Many new points in one range are dealt over
several tasks, each with a copy of that range, so neither side is bound to one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import new_path, partitions_for, shared_dir

# ranges at most: the directory (16 bytes a range) is broadcast
MAX_RANGES = 65_536
# new points of a range in one task
POINTS_PER_TASK = 1_000_000


def save_ranks(scores: DataFrame, path: str, col: str = "score", n_ranges: int | None = None) -> "Ranks":
    """Writes the rank directory of ``scores`` under ``path``.  Null and NaN scores have no place
    and don't count."""
    shared_dir(scores.sparkSession)
    s = F.col(col).cast("double")
    # a filter on the score itself would move down to where scores are made, and make them twice
    counts = scores.select(s.alias("s")).groupBy("s").agg(F.count_if(F.col("s").isNotNull() & ~F.isnan("s")).alias("n")).where("n > 0")
    ranges = min(MAX_RANGES, n_ranges or partitions_for(scores.select(s.alias("s"))))
    w = Window.partitionBy("range").orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = counts.repartitionByRange(ranges, "s").withColumn("range", F.spark_partition_id())
    cut.sortWithinPartitions("range", "s").write.mode("overwrite").partitionBy("range").parquet(f"{path}/cut")
    spark = scores.sparkSession
    saved = spark.read.schema("s double, n bigint, range int").parquet(f"{path}/cut")
    per = saved.groupBy("range").agg(F.min("s").alias("least"), F.sum("n").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    per.select("range", "least", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).coalesce(1).write.mode("overwrite").parquet(f"{path}/directory")
    placed = saved.select("range", "s", F.sum("n").over(w).alias("n_le"))
    placed.sortWithinPartitions("range", "s").write.mode("overwrite").partitionBy("range").parquet(f"{path}/ranges")
    return load_ranks(spark, path)


def load_ranks(spark: SparkSession, path: str) -> "Ranks":
    directory = spark.read.parquet(f"{path}/directory").orderBy("range").collect()  # MAX_RANGES rows at most
    ranges = spark.read.schema("s double, n_le bigint, range int").parquet(f"{path}/ranges")
    return Ranks(spark, ranges, [r["range"] for r in directory], [r["least"] for r in directory], [r["before"] for r in directory], sum(r["n"] for r in directory))


@dataclass
class Ranks:
    spark: SparkSession
    ranges: DataFrame  # s, n_le (in its range), range
    numbers: list
    least: list
    before: list
    n: int

    def place(self, points: DataFrame, col: str = "score", id_col: str = "id", bins: int = 19, points_per_task: int = POINTS_PER_TASK) -> DataFrame:
        """``id_col`` and ``col`` of ``points`` with n_train_le, frac_train_le and bin, as
        ``analysis.score_position`` gives them.  Repeated rows stay rows of their own.  NaN is
        above all scores; a null score has null places."""
        shared = self.spark.sparkContext.broadcast((np.array(self.least, np.float64), np.array([*self.numbers, -1], np.int32), np.array([*self.before, 0], np.int64)))

        @F.arrow_udf("struct<range: int, before: bigint>")
        def find(v: pa.Array) -> pa.Array:
            least, numbers, before = shared.value
            k = np.searchsorted(least, v.to_numpy(zero_copy_only=False).astype(np.float64), "right") - 1  # -1: below all
            return pa.StructArray.from_arrays([pa.array(numbers[k]), pa.array(before[k])], names=["range", "before"])

        path = new_path(self.spark, "placing")
        score = F.col(f"`{col}`").cast("double")
        new = points.select(F.col(f"`{id_col}`").alias("id"), score.alias("s"), F.when(score.isNotNull(), find(score)).alias("at"), F.monotonically_increasing_id().alias("k"))
        new.select("id", "s", "at.range", "at.before", "k").write.parquet(path)  # read twice
        new = self.spark.read.parquet(path)
        counts = {r["range"]: r["n"] for r in new.where("range >= 0").groupBy("range").agg(F.count("*").alias("n")).collect()}  # a row a range
        tasks = {k: -(-n // points_per_task) for k, n in counts.items()}
        known = self.ranges.where(F.col("range").isin(sorted(counts)))  # these folders are read
        many = sorted(k for k, n in tasks.items() if n > 1)
        if many:
            of = F.element_at(F.create_map(*[F.lit(v) for k in many for v in (k, tasks[k])]), F.col("range"))
            copies = F.when(F.col("range").isin(many), of).otherwise(1)
        else:
            copies = F.lit(1)
        known = known.select("range", "s", "n_le", F.explode(F.sequence(F.lit(0), copies - 1)).alias("task"), F.lit(False).alias("new"), F.lit(None).cast(new.schema["id"].dataType).alias("id"), F.lit(0).cast("long").alias("before"))
        placed = new.where("range >= 0").select("range", "s", F.lit(None).cast("long").alias("n_le"), F.pmod(F.xxhash64("k"), copies).cast("int").alias("task"), F.lit(True).alias("new"), "id", "before")
        w = Window.partitionBy("range", "task").orderBy("s", "new").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        joined = known.unionByName(placed).withColumn("n_le", F.last("n_le", ignorenulls=True).over(w)).where("new").select("id", "s", (F.col("before") + F.col("n_le")).alias("n"))
        rest = new.where("range IS NULL OR range < 0").select("id", "s", F.when(F.col("range").isNotNull(), F.lit(0)).cast("long").alias("n"))
        s = F.col("s")
        return joined.unionByName(rest).select(
            F.col("id").alias(id_col), s.alias(col), F.col("n").alias("n_train_le"), (F.col("n") / F.lit(float(max(self.n, 1)))).alias("frac_train_le"),
            F.least(F.floor(s * F.lit(float(bins))), F.lit(bins - 1)).cast("int").alias("bin"))
