"""Best-fit packing of token sequences, in bulk-synchronous steps.

Documents become pieces of at most ``limit`` tokens.  A Spark range sort by length gives
every piece its rank among all pieces.  Pieces of one length are interchangeable, and so
are sequences with one gap that were filled alike, so both sides are runs of equal sizes:
at most ``limit`` runs of pieces, whatever the number of documents.  One step takes the
longest run left and sweeps the sorted gaps for its successor (the least gap it fits);
ranks decide which pieces get the places when there are more pieces than places, the gaps
of the sequences that got some are updated, and the rest goes to the next larger gap or
opens sequences.  This is exactly best-fit decreasing.

The runs (a few thousand rows for any input) are the only thing the driver sees.  Each
piece then finds its place by its rank.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import ready, shuffle_partitions, staged, tidy
from .tokens import encoder

LIMIT = 2048
END = 0


def token_pieces(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, limit: int = LIMIT, end: int | None = END,
                 ids: bool = False) -> DataFrame:
    """One row per piece: the columns ``keep`` of ``docs`` (default: all but the text), then
    piece (from 0), start, length, ids_crc32 and, on request, ids."""
    ready(docs.sparkSession)
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    own = T.StructType([docs.schema[c] for c in keep])
    new = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    new += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else []
    clash = {f.name for f in new} & set(keep)
    if clash:
        raise ValueError(f"the input has columns named {sorted(clash)}")
    out = T.StructType([*own.fields, *new])
    schema = to_arrow_schema(out)

    def run(batches) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        last = np.array([] if end is None else [end], "<u4")
        for b in batches:
            flat, counts = e.encode(b.column(0).to_pylist())
            at, row, piece, start, length, crc, parts = 0, [], [], [], [], [], []
            for i, n in enumerate(counts.tolist()):
                mine = np.concatenate([flat[at:at + n].astype("<u4"), last])
                at += n
                for k, s in enumerate(range(0, len(mine), limit)):
                    part = mine[s:s + limit]
                    row.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(len(part))
                    crc.append(crc32(part.tobytes()))
                    if ids:
                        parts.append(part.astype(np.int32))
            columns = [b.column(1).field(k).take(pa.array(row, pa.int64())) for k in range(len(keep))]
            columns += [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            columns += [pa.array(parts, pa.list_(pa.int32()))] if ids else []
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    return docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), row.alias("row")).mapInArrow(tidy(run), out)


def best_fit(counts: dict[int, int], limit: int) -> np.ndarray:
    """Places for ``counts[length]`` pieces of each length, longest first.  Rows (pieces,
    length, first sequence, pieces in each sequence, offset): consecutive pieces of the
    length fill consecutive sequences from that offset on."""
    gaps: list[int] = []
    runs: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, sequences)
    places, sequences = [], 0

    def add(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                insort(gaps, gap)
                runs[gap] = []
            runs[gap].append((first, n))

    def fill(gap: int, length: int, first: int, n: int, left: int) -> int:
        """Puts up to ``left`` pieces into ``n`` sequences with this gap; returns the rest."""
        each = gap // length
        full = min(n, left // each)
        if full:
            places.append((full * each, length, first, each, limit - gap))
            add(gap - each * length, first, full)
            left -= full * each
        if left and full < n:
            places.append((left, length, first + full, left, limit - gap))
            add(gap - left * length, first + full, 1)
            add(gap, first + full + 1, n - full - 1)
            return 0
        add(gap, first + full, n - full)
        return left

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_left(gaps, length)
            if k == len(gaps):
                need = -(-left // (limit // length))
                left = fill(limit, length, sequences, need, left)
                sequences += need
                continue
            gap = gaps[k]
            first, n = runs[gap].pop()
            if not runs[gap]:
                del runs[gap], gaps[k]
            left = fill(gap, length, first, n, left)
    return np.array(places, np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, limit: int = LIMIT, length: str = "length") -> DataFrame:
    """``pieces`` with sequence_id and offset: places in sequences of at most ``limit`` tokens.

    Lengths are 1 to ``limit``; another length or null is an error.  Repeated rows are pieces
    of their own.  An empty table gives an empty result."""
    spark = ready(pieces.sparkSession)
    clash = {"sequence_id", "offset"} & set(pieces.columns)
    if clash:
        raise ValueError(f"the input has columns named {sorted(clash)}")
    stored = staged(pieces.select(F.struct(*[F.col(f"`{c}`") for c in pieces.columns]).alias("row"), F.col(length).cast("long").alias("length")), "packing")
    counts = {r["length"]: r["n"] for r in stored.groupBy(F.when(F.col("length").between(1, limit), F.col("length")).alias("length")).agg(
        F.count("*").alias("n")).collect()}  # at most limit + 1 rows
    if None in counts:
        raise ValueError(f"{counts[None]} pieces are not of 1 to {limit} tokens")

    # the last key splits a run of equal lengths over tasks
    ranged = stored.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(shuffle_partitions(spark), F.desc("length"), "tie")
    numbered = T.StructType([T.StructField("row", stored.schema["row"].dataType), T.StructField("length", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType())])

    def number(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen, seen + n))], names=["row", "length", "part", "place"])
            seen += n

    sorted_ = staged(ranged.sortWithinPartitions(F.desc("length"), "tie").select("row", "length").mapInArrow(tidy(number), numbered), "packing")
    sizes = {r["part"]: r["n"] for r in sorted_.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before = np.zeros(max(sizes, default=0) + 2, np.int64)
    for p, n in sizes.items():
        before[p + 1] = n
    before = np.cumsum(before)
    plan = best_fit(counts, limit)
    starts = np.cumsum(plan[:, 0]) - plan[:, 0]
    shared = spark.sparkContext.broadcast((before, plan, starts))
    out = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    schema = to_arrow_schema(out)

    def place(batches):
        before, plan, starts = shared.value
        for b in batches:
            rank = before[b.column(2).to_numpy()] + b.column(3).to_numpy()
            k = np.searchsorted(starts, rank, "right") - 1
            i = rank - starts[k]
            row = b.column(0)
            columns = [row.field(j) for j in range(row.type.num_fields)]
            columns += [pa.array(plan[k, 2] + i // plan[k, 3]), pa.array(plan[k, 4] + i % plan[k, 3] * plan[k, 1])]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return sorted_.mapInArrow(tidy(place), out)


def pack_documents(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, limit: int = LIMIT, end: int | None = END, ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` with their places.  Null and empty texts are the end id alone."""
    return pack(token_pieces(docs, path, text, keep, limit, end, ids), limit)
