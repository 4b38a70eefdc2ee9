"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import new_path, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, kind: str) -> DataFrame:
    """Writes ``df`` to a new folder under ``spark.checkpoint.dir`` and reads it back: the
    lineage is cut, and a lost executor costs no more than a re-read."""
    path = new_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once: a bound lambda variable, not a copied
    expression."""
    return F.transform(F.array(value), body)[0]


def spread_join(many: DataFrame, one: DataFrame, key: str, by: str | Column, rows: int = 1000, heavy: int = 4096,
                how: str = "inner", counts: DataFrame | None = None, hint: str = "") -> DataFrame:
    """Join of ``many`` (any number of rows of a key) with ``one`` (few of a key) in which no key
    is one task's: a key with over ``rows`` rows is dealt out by a hash of ``by``, and its rows
    of ``one`` go to each part.

    Keys to deal out are those above ``rows`` or the share 1 / ``heavy`` of all rows, so there are
    ``heavy`` at most, and only they are broadcast.  ``counts`` are rows (key, n) of ``many``; without
    them it is read twice and should be a written table.  ``hint``: of the join, for ``one``."""
    hinted = (lambda d: d.hint(hint)) if hint else (lambda d: d)
    total = many.count() if counts is None else counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(rows, int(total) // heavy)
    if total <= limit:
        return many.join(hinted(one), key, how)
    counts = many.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts
    parts = F.broadcast(staged(counts.select(key, F.ceil(F.col("n") / limit).cast("int").alias("__parts")).where("__parts > 1"), "heavy"))
    dealt = many.join(parts, key, "left").withColumn("__part", F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), "__parts")).cast("int"))
    copies = one.join(parts, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)))
    return dealt.drop("__parts").join(hinted(copies.drop("__parts")), [key, "__part"], how).drop("__part")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ready(spark: SparkSession) -> SparkSession:
    """Makes this package importable in the executors' Python workers."""
    ship_package(spark)
    return spark


def give_back() -> None:
    """Returns what a task has freed to the system: Python workers idle between tasks, next to
    the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable) -> Callable:
    """``run`` (the body of a mapInArrow) with ``give_back`` at its end."""

    def tidied(batches) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def with_struct(docs: DataFrame, keep: list[str] | None, name: str, kind: T.StructType, inputs: list[Column], body: Callable[..., pa.Array]) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all) and a struct ``name`` of type ``kind``,
    which ``body`` makes from Arrow arrays of ``inputs``, batch by batch."""
    keep = docs.columns if keep is None else keep
    if name in keep:
        raise ValueError(f"the input has a column named {name}")
    ready(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    out = T.StructType([*[docs.schema[c] for c in keep], T.StructField(name, kind)])
    schema = to_arrow_schema(out)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [b.column(0).field(c).cast(schema.field(c).type) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, body(*b.columns[1:])], schema=schema)

    return docs.select(row.alias("row"), *[c.alias(f"in{i}") for i, c in enumerate(inputs)]).mapInArrow(tidy(run), out)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow column without copying each value;
    nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    if column.null_count:
        column = column.fill_null(b"")
    _, offs, data = column.buffers()
    n, kind = len(column), np.int64 if wide else np.int32
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, kind, n + 1 + column.offset)[column.offset:].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[o[0]:o[-1]], o - o[0]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(s, s + n)`` for every (s, n)."""
    starts, lengths = np.asarray(starts, np.int64), np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
