"""Global order without a single-task window.

``row_number() OVER (ORDER BY ...)`` with no PARTITION BY moves every row into one
task.  Instead:

1. ``repartitionByRange(P, keys)`` + ``sortWithinPartitions(keys)`` -> partition i holds
   a contiguous, sorted key range; the result is written once (reliable, shared folder: a checkpoint,
   or, where only some columns are kept, these and the places as Parquet), so every later pass sees the same places even after executor loss;
2. per-partition counts -> a table (partition, rows before it), of one small row a partition;
3. global index = rows before the partition + local position, by a join with that table.

Keys must form a total order: callers append the unique id as the last key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import new_path, partitions_for, shared_dir, ship_package

_LOCAL_BITS = 33


def _ranged(df: DataFrame, keys: list, n_parts: int | None) -> DataFrame:
    """Range partitions sized by the data.

    A last, unique key ``_tb`` (row position in the input scan) splits runs of equal
    keys -- e.g. a third of all rows being exact copies -- over several range partitions
    instead of one.  Rows equal on all ``keys`` are interchangeable, so results do not
    depend on how they are ordered among themselves."""
    shared_dir(df.sparkSession)
    P = n_parts or partitions_for(df)
    keyed = df.withColumn("_tb", F.monotonically_increasing_id())
    allk = list(keys) + [F.col("_tb")]
    return keyed.repartitionByRange(P, *allk).sortWithinPartitions(*allk)


def _before(rows: DataFrame, part: Column, **counted: Column) -> DataFrame:
    """(_p, one column per sum): the sums over all partitions before ``_p``.  It has one row a
    partition, so its size is bounded by the number of tasks and it is broadcast."""
    per = rows.groupBy(part.alias("_p")).agg(*[F.sum(c).alias(n) for n, c in counted.items()])
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(per.select("_p", *[F.coalesce(F.sum(n).over(w), F.lit(0)).cast("bigint").alias(n) for n in counted]))


def global_row_index(df: DataFrame, keys: list, index_col: str = "row_index",
                     n_parts: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds ``index_col`` = 0-based position of the row in the global order of ``keys``.

    By default the rows stay in the partitions of the sort, a checkpoint of all columns.  With
    ``keep`` only those columns are left, written as Parquet with the places, so keys that no
    one reads again end at the sort; the partitions are then those of the files' splits."""
    spark = df.sparkSession
    ranged = _ranged(df, keys, n_parts).withColumn("_mid", F.monotonically_increasing_id())
    if keep is None:
        ranged = ranged.drop("_tb").checkpoint(eager=True)
    else:
        path, kept = new_path(spark, "indexed"), ranged.select(*[F.col(f"`{c}`") for c in keep], "_mid")
        kept.write.parquet(path)
        ranged = spark.read.schema(kept.schema).parquet(path)
    pid = F.shiftright(F.col("_mid"), _LOCAL_BITS)
    local = F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    offsets = _before(ranged, pid, _off_n=F.lit(1))
    return ranged.withColumn("_p", pid).join(offsets, "_p").withColumn(index_col, F.col("_off_n") + local).drop("_mid", "_p", "_off_n")


def running_counts(df: DataFrame, keys: list, flags: list[str], n_parts: int | None = None,
                   index_col: str = "row_index") -> DataFrame:
    """Adds the global index and, per 0/1 column ``f`` in ``flags``, ``cum_<f>``: the number
    of rows up to and including this one (in ``keys`` order) with f = 1."""
    ship_package(df.sparkSession)
    ranged = _ranged(df, keys, n_parts).checkpoint(eager=True)
    in_schema = ranged.schema
    out_schema = T.StructType(list(in_schema.fields) + [
        T.StructField("_pid", T.IntegerType(), False),
        T.StructField("_lidx", T.LongType(), False),
    ] + [T.StructField(f"_lcum_{f}", T.LongType(), False) for f in flags])
    flag_names = list(flags)

    def local_counts(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        seen = 0
        cum = {f: 0 for f in flag_names}
        for b in batches:
            n = b.num_rows
            arrays = list(b.columns)
            arrays.append(pa.array(np.full(n, pid, dtype=np.int32)))
            arrays.append(pa.array(np.arange(seen, seen + n, dtype=np.int64)))
            for f in flag_names:
                v = b.column(b.schema.get_field_index(f)).to_numpy(zero_copy_only=False)
                v = np.nan_to_num(v.astype(np.float64)).astype(np.int64)
                c = np.cumsum(v) + cum[f]
                cum[f] = int(c[-1]) if n else cum[f]
                arrays.append(pa.array(c.astype(np.int64)))
            seen += n
            yield pa.RecordBatch.from_arrays(arrays, schema=out_schema_arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    out_schema_arrow = to_arrow_schema(out_schema)
    local = ranged.mapInArrow(local_counts, out_schema)
    sums = {f"_off_{f}": F.col(f).cast("bigint") for f in flags}
    offsets = _before(ranged, F.spark_partition_id(), _off_n=F.lit(1), **sums)
    out = local.withColumnRenamed("_pid", "_p").join(offsets, "_p").withColumn(index_col, F.col("_off_n") + F.col("_lidx"))
    for f in flags:
        out = out.withColumn(f"cum_{f}", F.col(f"_off_{f}") + F.col(f"_lcum_{f}"))
    return out.drop("_p", "_off_n", "_lidx", "_tb", *[f"_lcum_{f}" for f in flags], *sums)
