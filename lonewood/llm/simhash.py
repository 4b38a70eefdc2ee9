"""SimHash near-duplicate groups with pivot distance tables.

1. A fingerprint per document: 64 majority bits over the XXH64 values of its word shingles.
2. Equal fingerprints collapse to one row (a group of exact copies of any size is one row
   after map-side aggregation); the documents themselves are in block files and stay there.
   For each distinct fingerprint its Hamming distances to
   ``N_PIVOTS`` reference fingerprints are stored.
3. Two fingerprints within ``max_bits`` differ by at most ``max_bits`` in every pivot
   coordinate (triangle inequality), so a larger coordinate difference discards a pair;
   survivors are verified by the bit count of their exclusive or.
   A pivot coordinate alone keeps more than half of all random pairs, so it cannot be the
   key that brings pairs together.  That key is exact: with the 64 bits cut into
   ``max_bits + e`` blocks, a linked pair agrees in at least ``e`` of them, so every choice
   of ``e`` blocks is one join key.  ``e`` follows from the number of fingerprints: the
   least at which a key value holds few of them by chance.
4. A key value that holds more than ``CHUNK`` fingerprints is cut into chunks whose pairs
   are tasks of their own.  Inside a large bucket only a spanning forest of the links is
   emitted, never all pairs.
5. Connected components of the links; the class id is the least document id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import new_path
from .common import ready, shuffle_partitions, spread_join, staged, tidy, utf8
from .files import NewFile, pack_rows, read_file, unpack_rows
from .components import connected_components

SHINGLE = 4
SEED = 42
MAX_BITS = 4
N_PIVOTS = 16
PER_KEY = 8
SMALL = 32
CHUNK = 4096
BLOCK_BYTES = 8 << 20

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """Fingerprint of one text (UTF-8): A-Z lower-cased, words split at ASCII white space,
    shingles joined by one space.  No words: 0."""
    words = raw.lower().split()
    n = len(words)
    if not n:
        return 0
    text = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(text, SEED)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    digest = xxhash.xxh64_intdigest
    spans = zip((ends - sizes)[:n - shingle + 1].tolist(), ends[shingle - 1:].tolist(), strict=True)
    h = np.fromiter((digest(text[a:b], SEED) for a, b in spans), np.uint64, n - shingle + 1)
    return majority(h)


def majority(h: np.ndarray) -> int:
    """64 bits, each 1 if set in over half of the hashes ``h``."""
    by_byte = np.ascontiguousarray(h, "<u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(by_byte[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * counts > len(h), bitorder="little").tobytes(), "little")


def block_path(folder: str, block: int) -> str:
    """File of a block; its number is the task attempt's, then that of the block in it."""
    return f"{folder}/{block >> 24}-{block & 0xFFFFFF}.arrow"


def fingerprints(docs: DataFrame, folder: str, text: str, doc_id: str, keep: list[str], shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, place, fp, no_id, id) of every document, fp as signed 64-bit integer; null texts
    are empty.  The columns ``keep`` go to files of about ``block_bytes`` of text, ``block``
    and ``place`` say where; no later step moves them."""
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    columns = [row.alias("row"), F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id")] + ([] if text in keep else [F.col(text).alias("text")])
    out = T.StructType([T.StructField("block", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("fp", T.LongType()),
                        T.StructField("no_id", T.BooleanType()), T.StructField("id", docs.schema[doc_id].dataType)])
    schema = to_arrow_schema(out)

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, size, n = TaskContext.get().taskAttemptId() << 24, [], 0, 0

        def flush() -> None:
            f = NewFile(block_path(folder, block))
            f.write(pack_rows(held))
            f.close()

        for b in batches:
            data, offs = utf8(b.column(0).field(text) if text in keep else b.column(3))
            raw, lo = memoryview(data), 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + block_bytes - size, "right")) - 1)
                held.append(b.slice(lo, hi - lo).select([0]))
                fp = [fingerprint(raw[x:y].tobytes(), shingle) for x, y in zip(offs[lo:hi].tolist(), offs[lo + 1:hi + 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(hi - lo, block, np.int64)), pa.array(np.arange(n, n + hi - lo, dtype=np.int32)), pa.array(np.array(fp, np.uint64).view(np.int64)),
                    b.column(1).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo)], schema=schema)
                size, n = size + int(offs[hi] - offs[lo]), n + hi - lo
                lo = hi
                if size >= block_bytes or lo < b.num_rows:
                    flush()
                    block, held, size, n = block + 1, [], 0, 0
        if held:
            flush()

    return docs.select(*columns).mapInArrow(tidy(run), out)


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    """Reference fingerprints: random bits from a fixed seed."""
    return np.random.default_rng(SEED).integers(0, 1 << 64, n, np.uint64)


def pivot_table(fp: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances (rows: fingerprints, columns: references)."""
    return np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int8)


def _linked(fp: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, max_bits: int) -> np.ndarray:
    """Which of the pairs (i, j) are links: first by pivot coordinates, then by all bits."""
    near = np.flatnonzero(np.abs(table[i] - table[j]).max(axis=1) <= max_bits)
    near = near[np.bitwise_count(fp[i[near]] ^ fp[j[near]]) <= max_bits]
    return near


def _forest(fp: np.ndarray, table: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among ``fp``: each fingerprint is visited once and
    compared with those not reached yet."""
    left, a, b = np.arange(len(fp)), [], []
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            x = front.pop()
            hit = _linked(fp, table, np.full(len(left), x), left, max_bits)
            found = left[hit]
            a += [x] * len(found)
            b += found.tolist()
            front += found.tolist()
            left = np.delete(left, hit)
    return np.array(a, np.int64), np.array(b, np.int64)


def block_keys(n: float, max_bits: int, per_key: int = PER_KEY) -> list[int]:
    """Bit masks of the join keys for ``n`` fingerprints: two equal blocks at least."""
    if max_bits >= 32:
        raise ValueError("max_bits must be below 32")
    e = next(e for e in range(2, 65 - max_bits) if n / 2.0 ** (64 * e / (max_bits + e)) <= per_key or comb(max_bits + e + 1, e + 1) > 500)
    edges = np.linspace(0, 64, max_bits + e + 1).round().astype(int).tolist()
    blocks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, e)]


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("k", pa.int32()), ("v", pa.int64()), ("chunk", pa.int32()), ("fps", pa.binary())])


def _bucket_links(max_bits: int, n_pivots: int, chunk: int):
    """Over rows (k, v, fp, pivots) sorted by (k, v, fp): links of every bucket; of buckets
    above ``chunk`` rows, their chunks instead."""
    refs_n = n_pivots

    def rows(i, j, fp):
        n = len(i)
        return pa.RecordBatch.from_arrays([pa.array(fp[i].view(np.int64)), pa.array(fp[j].view(np.int64)), pa.nulls(n, pa.int32()),
                                           pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=_EDGES)

    def emit(k, v, fp, table) -> Iterator[pa.RecordBatch]:
        """Whole buckets, in order."""
        same = (k[1:] == k[:-1]) & (v[1:] == v[:-1])
        starts = np.concatenate([[0], np.flatnonzero(~same) + 1])
        sizes = np.diff(np.concatenate([starts, [len(fp)]]))
        rank = np.arange(len(fp)) - np.repeat(starts, sizes)
        size = np.repeat(sizes, sizes)
        for d in range(1, SMALL):
            i = np.flatnonzero((size <= SMALL) & (rank + d < size))
            if not len(i):
                break
            hit = _linked(fp, table, i, i + d, max_bits)
            yield rows(i[hit], i[hit] + d, fp)
        for s, m in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            a, b = _forest(fp[s:s + m], table[s:s + m], max_bits)
            yield rows(a + s, b + s, fp)

    def run(batches):
        held, over = [], None  # over: the number of the next chunk of the large bucket at hand
        for batch in batches:
            k = batch.column("k").to_numpy(zero_copy_only=False)
            v = batch.column("v").to_numpy(zero_copy_only=False)
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            table = np.frombuffer(b"".join(batch.column("pivots").to_pylist()), np.int8).reshape(-1, refs_n)
            held.append((k, v, fp, table))
            k, v, fp, table = (np.concatenate(x) for x in zip(*held, strict=True))
            last = int(np.flatnonzero((k != k[-1]) | (v != v[-1]))[-1]) + 1 if ((k != k[-1]) | (v != v[-1])).any() else 0
            if over is not None and last:  # the large bucket ends in this batch
                head = int(np.flatnonzero((k != over[0]) | (v != over[1]))[0]) if ((k[0], v[0]) == over[:2]) else 0
                if head:
                    yield chunk_row(over, fp[:head])
                k, v, fp, table, last, over = k[head:], v[head:], fp[head:], table[head:], last - head, None
            if last:
                yield from emit(k[:last], v[:last], fp[:last], table[:last])
            k, v, fp, table = k[last:], v[last:], fp[last:], table[last:]
            while len(fp) > chunk:
                over = over or (int(k[0]), int(v[0]), 0)
                yield chunk_row(over, fp[:chunk])
                over = (over[0], over[1], over[2] + 1)
                k, v, fp, table = k[chunk:], v[chunk:], fp[chunk:], table[chunk:]
            held = [(k, v, fp, table)]
        if held and len(held[0][2]):
            k, v, fp, table = held[0]
            if over is not None and (int(k[0]), int(v[0])) == over[:2]:
                yield chunk_row(over, fp)
            else:
                yield from emit(k, v, fp, table)

    def chunk_row(over, fp):
        return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([over[0]], pa.int32()), pa.array([over[1]], pa.int64()),
                                           pa.array([over[2]], pa.int32()), pa.array([np.ascontiguousarray(fp).tobytes()], pa.binary())], schema=_EDGES)

    return run


def _chunk_links(max_bits: int, n_pivots: int):
    """Over rows (x, y) of two chunks of one bucket: a spanning forest of their links."""

    def run(batches):
        refs = pivots(n_pivots)
        for batch in batches:
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                fp = np.unique(np.frombuffer(x + y, np.uint64))
                a, b = _forest(fp, pivot_table(fp, refs), max_bits)
                yield pa.RecordBatch.from_arrays([pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], names=["a", "b"])

    return run


def near_links(distinct: DataFrame, max_bits: int = MAX_BITS, n_pivots: int = N_PIVOTS, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) among distinct fingerprints (column ``fp``) within ``max_bits`` bits, such
    that every linked pair is connected through them."""
    spark = ready(distinct.sparkSession)

    @F.arrow_udf("binary")
    def table_of(fp: pa.Array) -> pa.Array:
        t = pivot_table(fp.to_numpy(zero_copy_only=False).view(np.uint64), pivots(n_pivots))
        return pa.array([row.tobytes() for row in t], pa.binary())

    tabled = staged(distinct.select("fp", table_of("fp").alias("pivots")), "simhash")
    masks = block_keys(max(1, tabled.count()), max_bits)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("v")) for k, m in enumerate(signed)]))
    keyed = tabled.select("fp", "pivots", keys.alias("key")).select("key.k", "key.v", "fp", "pivots")
    sorted_ = keyed.repartition("k", "v").sortWithinPartitions("k", "v", "fp")
    found = staged(sorted_.mapInArrow(tidy(_bucket_links(max_bits, n_pivots, chunk)), "a long, b long, k int, v long, chunk int, fps binary"), "simhash")
    links = found.where("chunk is null").select("a", "b").distinct()
    chunks = found.where("chunk is not null").select("k", "v", "chunk", "fps")
    # pairs of chunk numbers first (a few bytes each), their fingerprints afterwards
    number = chunks.select("k", "v", "chunk")
    pairs = number.withColumnRenamed("chunk", "i").join(number.withColumnRenamed("chunk", "j"), ["k", "v"]).where("i <= j")
    pairs = pairs.join(chunks.select("k", "v", F.col("chunk").alias("i"), F.col("fps").alias("x")), ["k", "v", "i"])
    pairs = pairs.join(chunks.select("k", "v", F.col("chunk").alias("j"), F.col("fps").alias("y")), ["k", "v", "j"])
    return links.union(pairs.select("x", "y").mapInArrow(tidy(_chunk_links(max_bits, n_pivots)), "a long, b long"))


def simhash_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE,
                   max_bits: int = MAX_BITS, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all) and a struct ``simhash``: fingerprint
    (16 hexadecimal digits), component_id (least doc_id of the component) and first (true
    for one row of each component, of least doc_id).

    Null and empty texts have fingerprint 0 and are linked like any other.  Repeated rows
    share a component and one of them is first.  Null ids come after all others: a component
    of null ids only has a null component_id.  An empty table gives an empty result."""
    spark = ready(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    if "simhash" in keep:
        raise ValueError("the input has a column named simhash")
    folder = new_path(spark, "blocks")
    marked = staged(fingerprints(docs, folder, text, doc_id, keep, shingle), "simhash")
    rep = F.struct("no_id", "id", "block", "place")
    distinct = staged(marked.groupBy("fp").agg(F.min(rep).alias("rep"), F.count("*").alias("n")), "simhash")
    roots = connected_components(near_links(distinct, max_bits))
    rooted = staged(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "rep", "n", F.coalesce("root", "fp").alias("root")), "simhash")
    least = rooted.groupBy("root").agg(F.min("rep").alias("least"), F.count("*").alias("m"), F.max("n").alias("most"))
    # only fingerprints of several rows or links need the join: the others are their own class
    shared = spread_join(rooted.select("fp", "root"), least.where("m > 1 or most > 1"), "root", "fp").select("fp", "least")
    decided = spread_join(marked, shared, "fp", F.struct("block", "place"), how="left").withColumn("least", F.coalesce("least", rep))
    result = F.struct("place", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("least.id").alias("component_id"),
                      ((F.col("least.block") == F.col("block")) & (F.col("least.place") == F.col("place"))).alias("first"))
    by_block = decided.groupBy("block").agg(F.sort_array(F.collect_list(result)).alias("results"))
    found = T.StructType(by_block.schema["results"].dataType.elementType.fields[1:])
    out = T.StructType([*[docs.schema[c] for c in keep], T.StructField("simhash", found)])
    schema = to_arrow_schema(out)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, results in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                r = results.values
                rows = unpack_rows(read_file(block_path(folder, block)))
                columns = [rows.field(c).cast(schema.field(c).type) for c in keep]
                kind = schema.field("simhash").type
                columns.append(pa.StructArray.from_arrays([r.field(f.name).cast(f.type) for f in kind], fields=list(kind)))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    # few rows with a block of documents behind each: as many tasks as for any shuffle
    return by_block.repartition(shuffle_partitions(spark)).mapInArrow(tidy(run), out)
