"""MinHash near-duplicate groups.

1. Documents are written in blocks, one file each, and stay there.  For each distinct shingle
   set of a block one row goes on: a digest of the set, a signature of ``BANDS`` x ``ROWS``
   minima of universal hashes (multiply-shift) and its bands.
2. Sets that share a band are candidates.  Band values are range-sorted with the digest as
   last key, so a value that very many sets have lies in several tasks.  A value of up to
   ``SMALL`` sets gives its pairs.  The sets of a larger one are cut into pieces of ``PIECE``;
   in a piece the set nearest to the piece's commonest minima is the hub, and only pairs with
   hubs are candidates: as many as there are sets.
3. Candidates whose signatures agree too little are discarded, the others are confirmed on
   their whole sets.
4. Confirmed links give components (alternating large-star and small-star).  What the hubs
   did not settle is settled now: components that share a large value are a family, and each
   set outside its family's largest component is compared with all sets of the family, on the
   whole sets, in packs; only links that connect components are written.  Pairs in one
   component need no test.

A pair of similarity s shares no band with probability (1 - s ** ROWS) ** BANDS, 4e-9 at 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import new_path
from .common import ranges, ready, shuffle_partitions, spread_join, staged, tidy, utf8
from .components import connected_components
from .files import NewFile, pack_rows, read_file, unpack_table

SHINGLE = 2
PERCENT = 80
BANDS = 64
ROWS = 6
SMALL = 6
PIECE = 1024
HUB_MINIMA = 128  # minima by which a piece's candidates are found; all of them decide afterwards
PACK = 512  # sets compared with as many others at once
OFTEN = 64
BLOCK_BYTES = 8 << 20
WORDS = 1 << 20  # hashes of words a task remembers
SEED = 12
#: Tables of all sets grow with the documents: they are merged at any size, never broadcast.
MERGE = "merge"

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_COLUMNS = 128  # shingles hashed together
_SLICE = 4096  # columns of a matrix


class WordHashes(dict):
    """XXH64 of words; at most ``WORDS`` are remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: bytes, hashes: WordHashes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text (UTF-8): A-Z lower-cased, words
    split at ASCII white space; fewer words than a shingle are one shingle; no words, none."""
    words = text.lower().split()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(shingle, len(words))
    if not k:
        return h
    out = h[:len(h) - k + 1] * _MIX[0] + np.uint64(k)
    for j in range(1, k):
        out ^= out >> np.uint64(31)
        out = out * _MIX[1] + h[j:len(h) - k + 1 + j] * _MIX[2]
    out ^= out >> np.uint64(29)
    return np.unique(out)


def universal(n: int = BANDS * ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Factors (odd) and summands of the hash functions, from a fixed seed."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 64, n, np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, n, np.uint64)


class Signer:
    """Minima of ``bands * rows`` universal hashes of a set."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows = bands, rows
        a, b = universal(bands * rows)
        self.a, self.b = a[:, None], b[:, None]
        self.space = np.empty((bands * rows, _COLUMNS), np.uint64)
        self.salts = np.random.default_rng(SEED + 1).integers(0, 1 << 64, bands, np.uint64)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        least = None
        for lo in range(0, len(shingles), _COLUMNS):
            x = shingles[None, lo:lo + _COLUMNS]
            h = self.space[:, :x.shape[1]]
            np.multiply(self.a, x, out=h)
            np.add(h, self.b, out=h)
            m = h.min(axis=1)
            least = m if least is None else np.minimum(least, m)
        return (least >> np.uint64(32)).astype(np.uint32)

    def band_values(self, minima: np.ndarray) -> np.ndarray:
        v = self.salts.copy()
        for column in minima.reshape(self.bands, self.rows).T:
            v = (v ^ column) * _MIX[0]
            v ^= v >> np.uint64(29)
        return v.view(np.int64)


def floor_of(percent: int, n: int) -> int:
    """Equal minima of ``n`` below which a pair is discarded: six deviations under the mean."""
    s = percent / 100
    return int(n * (s - 6 * sqrt(s * (1 - s) / n)))


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets (sorted) have ``100 * common >= percent * all``."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    every = len(np.union1d(x, y))
    return 100 * (len(x) + len(y) - every) >= percent * every


def block_path(folder: str, block: int) -> str:
    """File of a block; its number is the task attempt's, then that of the block in it."""
    return f"{folder}/{block >> 24}-{block & 0xFFFFFF}.arrow"


def signed(docs: DataFrame, folder: str, text: str, doc_id: str, keep: list[str], shingle: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Writes blocks of ``docs`` and returns a row per block and distinct set: block, key (digest),
    no_id, id and place of its first document by id, signature and bands."""
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    columns = [row.alias("row"), F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")]
    out = T.StructType([T.StructField("block", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("no_id", T.BooleanType()),
                        T.StructField("id", docs.schema[doc_id].dataType), T.StructField("place", T.IntegerType()),
                        T.StructField("signature", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    schema = to_arrow_schema(out)

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, hashes, signer = TaskContext.get().taskAttemptId() << 24, WordHashes(), Signer()
        held, size, n, sets = [], 0, 0, {}

        def flush() -> pa.RecordBatch:
            f = NewFile(block_path(folder, block))
            f.write(pack_rows(held))
            f.close()
            # a block without words has one row without a set
            rows = list(sets.values())
            if not rows:
                return pa.RecordBatch.from_pylist([{"block": block}], schema=schema)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * BANDS, pa.int32()), pa.array(np.concatenate([r[3] for r in rows])))
            return pa.RecordBatch.from_arrays([
                pa.array(np.full(len(rows), block, np.int64)), pa.array(list(sets), pa.binary()), pa.array([r[0][0] for r in rows], pa.bool_()),
                pa.array([r[0][1] for r in rows], schema.field("id").type), pa.array([r[1] for r in rows], pa.int32()),
                pa.array([r[2] for r in rows], pa.binary()), bands.cast(schema.field("bands").type)], schema=schema)

        for b in batches:
            data, offs = utf8(b.column(2))
            raw, ids, lo = memoryview(data), b.column(1).to_pylist(), 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + block_bytes - size, "right")) - 1)
                keys, counts = [], []
                for i in range(lo, hi):
                    shingles = shingle_set(raw[offs[i]:offs[i + 1]].tobytes(), hashes, shingle)
                    key = xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None
                    keys.append(key)
                    counts.append(len(shingles))
                    if key is None:
                        continue
                    rank, known = (ids[i] is None, ids[i]), sets.get(key)
                    if known is None:
                        minima = signer.minima(shingles)
                        sets[key] = [rank, n + i - lo, minima.astype(np.uint8).tobytes(), signer.band_values(minima)]
                    elif not rank[0] and (known[0][0] or rank[1] < known[0][1]):
                        known[:2] = rank, n + i - lo
                held.append(pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo),
                                                        pa.array(keys, pa.binary()), pa.array(counts, pa.int64())], names=["row", "id", "text", "key", "n"]))
                size, n = size + int(offs[hi] - offs[lo]), n + hi - lo
                lo = hi
                if size >= block_bytes or lo < b.num_rows:
                    yield flush()
                    block, held, size, n, sets = block + 1, [], 0, 0, {}
        if held:
            yield flush()

    return docs.select(*columns).mapInArrow(tidy(run), out)


_SHARED = "a binary, b binary, value long, piece long, key binary"
_SHARED_ARROW = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("value", pa.int64()), ("piece", pa.int64()), ("key", pa.binary())])


def _keys(k: np.ndarray) -> pa.Array:
    """Digests from rows of their two halves."""
    raw = k.astype(">i8").tobytes()
    return pa.array([raw[i:i + 16] for i in range(0, len(raw), 16)], pa.binary())


def _shared_values(small: int, piece_rows: int):
    """Over rows (value, k1, k2) sorted by all: pairs (a, b) of every value of 2 to ``small``
    sets; of larger values, and of a task's first and last one, which may go on in the next,
    their sets with the number of their piece."""

    def pairs(i, j, k):
        m = len(i)
        return pa.RecordBatch.from_arrays([_keys(k[i]), _keys(k[j]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())], schema=_SHARED_ARROW)

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, first, cut = TaskContext.get().partitionId() << 32, True, False
        v, k = np.zeros(0, np.int64), np.zeros((0, 2), np.int64)

        def members(v, k) -> Iterator[pa.RecordBatch]:
            nonlocal number
            for lo in range(0, len(v), piece_rows):
                m = len(v[lo:lo + piece_rows])
                yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.array(v[lo:lo + piece_rows]),
                                                  pa.array(np.full(m, number, np.int64)), _keys(k[lo:lo + piece_rows])], schema=_SHARED_ARROW)
                number += 1

        def whole(v, k) -> Iterator[pa.RecordBatch]:
            """Values that have all their rows here; the first may go on before."""
            nonlocal first, cut
            starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            sizes = np.diff(np.append(starts, len(v)))
            if first or cut:
                yield from members(v[:sizes[0]], k[:sizes[0]])
                starts, sizes, first, cut = starts[1:], sizes[1:], False, False
            size, rank = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)
            few, m = starts[sizes <= small], sizes[sizes <= small]
            place = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            at = np.repeat(few, m) + place
            size[at], rank[at] = np.repeat(m, m), place
            for d in range(1, small):
                i = np.flatnonzero(rank + d < size)
                if not len(i):
                    break
                yield pairs(i, i + d, k)
            for s, m in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
                yield from members(v[s:s + m], k[s:s + m])

        for b in batches:
            if not b.num_rows:
                continue
            nv, n1, n2 = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            v, k = np.concatenate([v, nv]), np.concatenate([k, np.stack([n1, n2], 1)])
            new = np.ones(len(v), bool)
            new[1:] = (v[1:] != v[:-1]) | (k[1:] != k[:-1]).any(axis=1)
            v, k = v[new], k[new]  # one set may be in many blocks
            last = int(np.searchsorted(v, v[-1]))
            if last:
                yield from whole(v[:last], k[:last])
                v, k = v[last:], k[last:]
            while len(v) > piece_rows:  # the last row stays: the next may be its copy
                yield from members(v[:piece_rows], k[:piece_rows])
                v, k, cut = v[piece_rows:], k[piece_rows:], True
        yield from members(v, k)

    return run


def _agreement(signatures: np.ndarray, one: np.ndarray) -> np.ndarray:
    return (signatures == one).sum(axis=1)


def hub_pairs(signatures: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (hub, member) of a piece: the hub is nearest to the commonest minima of those left;
    it and all that agree with it enough are done."""
    left, a, b = np.arange(len(signatures)), [], []
    width = signatures.shape[1]
    columns = np.arange(width) * 256
    while len(left) > 1:
        s = signatures[left]
        common = np.bincount((s + columns).ravel(), minlength=256 * width).reshape(width, 256).argmax(axis=1)
        hub = int(_agreement(s, common.astype(np.uint8)).argmax())
        hit = _agreement(s, s[hub]) >= floor
        hit[hub] = False
        a.append(np.full(int(hit.sum()), left[hub]))
        b.append(left[hit])
        hit[hub] = True
        left = left[~hit]
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


_PAIRS = "a binary, b binary"


def _ordered(a: list[bytes], b: list[bytes]) -> pa.RecordBatch:
    low = [min(x, y) for x, y in zip(a, b, strict=True)]
    high = [max(x, y) for x, y in zip(a, b, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(low, pa.binary()), pa.array(high, pa.binary())], names=["a", "b"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _hubs(floor: int):
    """Over rows (piece, key, signature) sorted by piece: candidate pairs."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def piece(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(rows)
            keys = t.column(1).to_pylist()
            a, b = hub_pairs(_matrix(t.column(2).combine_chunks()), floor)
            return _ordered([keys[i] for i in a.tolist()], [keys[i] for i in b.tolist()])

        for batch in batches:
            p = batch.column(0).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(p)) + 1).tolist(), len(p)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if held and held[-1].column(0)[0].as_py() != int(p[lo]):
                    yield piece(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield piece(held)

    return run


def _rest(floor: int):
    """Over rows of packed sets (value, and of each side keys, roots and signatures): pairs of
    different components whose signatures agree enough."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x, y = (np.frombuffer(b"".join(m["signature"] for m in row[s]), np.uint8).reshape(len(row[s]), -1) for s in ("outside", "inside"))
                roots = np.array([m["root"] for m in row["inside"]])
                for m, one in zip(row["outside"], x, strict=True):
                    hit = np.flatnonzero((_agreement(y, one) >= floor) & (roots != m["root"]))
                    if len(hit):
                        yield _ordered([m["key"]] * len(hit), [row["inside"][i]["key"] for i in hit.tolist()])

    return run


def whole_sets(keys: DataFrame, distinct: DataFrame, folder: str, shingle: int) -> DataFrame:
    """(key, shingles) of the distinct ``keys``, from the first document of each in its block."""
    wanted = keys.join(distinct.select("key", "least").hint(MERGE), "key")
    by_block = wanted.groupBy(F.col("least.block").alias("block")).agg(F.collect_list(F.struct(F.col("least.place").alias("place"), "key")).alias("wanted"))

    def sets_of(batches) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for block, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data, offs = utf8(unpack_table(read_file(block_path(folder, block))).column("text"))
                for lo in range(0, len(rows), 256):
                    some = rows[lo:lo + 256]
                    sets = [shingle_set(data[offs[r["place"]]:offs[r["place"] + 1]].tobytes(), hashes, shingle).tobytes() for r in some]
                    yield pa.RecordBatch.from_arrays([pa.array([r["key"] for r in some], pa.binary()), pa.array(sets, pa.binary())], names=["key", "shingles"])

    return by_block.repartition(shuffle_partitions(keys.sparkSession)).mapInArrow(tidy(sets_of), "key binary, shingles binary")


def links_of(links: DataFrame, distinct: DataFrame) -> DataFrame:
    """Links between keys (a written table) as links between their first documents."""
    least = distinct.select("key", "least")
    links = spread_join(links, least.select(F.col("key").alias("a"), F.col("least").alias("p")), "a", "b", hint=MERGE)
    links = links.join(least.select(F.col("key").alias("b"), F.col("least").alias("q")).hint(MERGE), "b")
    return staged(links.select(F.col("p").alias("a"), F.col("q").alias("b")), "minhash")


def confirmed(pairs: DataFrame, distinct: DataFrame, folder: str, shingle: int, percent: int) -> DataFrame:
    """Links (a, b: first documents) of the candidate pairs (a, b: keys; a written table) that
    are as similar as they must be: by their signatures, then on their whole sets."""
    floor = floor_of(percent, BANDS * ROWS)
    signature = distinct.select(F.col("key").alias("a"), F.col("signature").alias("x"))
    near = spread_join(pairs, signature, "a", "b", hint=MERGE)
    other = distinct.select(F.col("key").alias("b"), F.col("signature").alias("y"))
    near = near.join(other.hint(MERGE), "b")

    def close(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                hit = (_matrix(b.column(2)) == _matrix(b.column(3))).sum(axis=1) >= floor
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(hit))

    near = staged(near.select("a", "b", "x", "y").mapInArrow(tidy(close), _PAIRS), "minhash")
    sets = staged(whole_sets(near.select(F.explode(F.array("a", "b")).alias("key")).distinct(), distinct, folder, shingle), "minhash")
    both = spread_join(near, sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a", "b", hint=MERGE)
    both = both.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")).hint(MERGE), "b")

    def check(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = ([np.frombuffer(v.as_buffer(), np.uint64) for v in b.column(c)] for c in (2, 3))
            hit = [similar(p, q, percent) for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return links_of(staged(both.select("a", "b", "x", "y").mapInArrow(tidy(check), _PAIRS), "minhash"), distinct)


def common_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``x`` with every set of ``y``: shingles that
    many of both have by matrix products, the others one by one."""
    ex, ey = np.concatenate(x), np.concatenate(y)
    every = np.unique(ex)
    at = np.searchsorted(every, ey)
    known = at < len(every)
    known[known] = every[at[known]] == ey[known]
    ex, rx = np.searchsorted(every, ex), np.repeat(np.arange(len(x)), [len(v) for v in x])
    ey, ry = at[known], np.repeat(np.arange(len(y)), [len(v) for v in y])[known]
    dx, dy = np.bincount(ex, minlength=len(every)), np.bincount(ey, minlength=len(every))
    out = np.zeros((len(x), len(y)), np.int64)
    often = dx * dy > OFTEN
    number = np.cumsum(often) - 1
    for lo in range(0, int(often.sum()), _SLICE):
        sides = []
        for e, r, n in ((ex, rx, len(x)), (ey, ry, len(y))):
            use = often[e] & (number[e] >= lo) & (number[e] < lo + _SLICE)
            m = np.zeros((n, _SLICE), np.float32)
            m[r[use], number[e[use]] - lo] = 1
            sides.append(m)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    rare = ~often[ex]
    ex, rx = ex[rare], rx[rare]
    order = np.argsort(ey, kind="stable")
    first = np.searchsorted(ey[order], np.arange(len(every)))
    counts = dy[ex]
    other = ry[order][ranges(first[ex], counts)]
    out += np.bincount(np.repeat(rx, counts) * len(y) + other, minlength=out.size).reshape(out.shape)
    return out


def _rest(percent: int):
    """Over rows of two lists of sets: links between sets of different components, as many as
    connect all that they connect."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x, y = row["outside"], row["inside"]
                sets = [[np.frombuffer(m["shingles"], np.uint64) for m in side] for side in (x, y)]
                common = common_counts(*sets)
                size = np.add.outer(*[[len(v) for v in side] for side in sets])
                roots = [np.array([m["root"] for m in side]) for side in (x, y)]
                hit = (100 * common >= percent * (size - common)) & (roots[0][:, None] != roots[1][None])
                parent: dict[int, int] = {}

                def find(r: int) -> int:
                    while parent.get(r, r) != r:
                        r = parent[r]
                    return r

                a, b = [], []
                for i, j in zip(*(v.tolist() for v in np.nonzero(hit)), strict=True):
                    p, q = find(int(roots[0][i])), find(int(roots[1][j]))
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        a.append(x[i]["key"])
                        b.append(y[j]["key"])
                yield _ordered(a, b)

    return run


def unsettled_links(members: DataFrame, distinct: DataFrame, roots: DataFrame, folder: str, shingle: int, percent: int, pack: int) -> DataFrame | None:
    """Links (a, b: keys) that connect all linked sets of different components with a large
    value in common; None if no such value has several components.

    Components that meet in a value are a family.  Each set outside its family's largest
    component is compared with all sets of the family, pack by pack."""
    of_key = distinct.join(roots, distinct["least"] == roots["node"], "left").select("key", F.xxhash64(F.coalesce("root", "least")).alias("root"))
    rooted = staged(members.join(of_key.hint(MERGE), "key"), "minhash")
    counts = staged(rooted.groupBy("value", "root").agg(F.count("*").alias("n")), "minhash")
    largest = counts.groupBy("value").agg(F.max(F.struct("n", "root")).alias("most"), F.count("*").alias("components")).where("components > 1")
    meet = spread_join(counts, largest.select("value", F.col("most.root").alias("b")), "value", "root").select(F.col("root").alias("a"), "b")
    meet = staged(meet.where("a <> b").distinct(), "minhash")
    if meet.isEmpty():
        return None
    above = connected_components(meet)
    family = staged(above.union(above.select("root", "root").distinct()).toDF("root", "family"), "minhash")
    in_family = staged(spread_join(staged(rooted.select("key", "root").distinct(), "minhash"), family, "root", "key"), "minhash")
    sizes = in_family.groupBy("family", "root").agg(F.count("*").alias("n")).groupBy("family")
    sizes = sizes.agg(F.max(F.struct("n", "root")).alias("most"), F.ceil(F.sum("n") / pack).alias("packs"))
    dealt = spread_join(in_family, sizes.select("family", F.col("most.root").alias("largest"), "packs"), "family", "key")
    dealt = dealt.select("key", "family", "root", "largest", F.pmod(F.xxhash64("key"), "packs").alias("pack"))
    one = F.struct("key", "root", "shingles")
    packs = dealt.join(whole_sets(in_family.select("key"), distinct, folder, shingle).hint(MERGE), "key").groupBy("family", "pack")
    packs = staged(packs.agg(F.collect_list(one).alias("inside"), F.collect_list(F.when(F.col("root") != F.col("largest"), one)).alias("outside")), "minhash")
    outside = packs.where(F.size("outside") > 0).select("family", "outside")
    sides = spread_join(packs.select("family", "pack", "inside"), outside, "family", "pack", rows=4)
    return staged(sides.select("outside", "inside").mapInArrow(tidy(_rest(percent)), _PAIRS).distinct(), "minhash")


def minhash_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT,
                   keep: list[str] | None = None, small: int = SMALL, piece_rows: int = PIECE, pack: int = PACK) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all) and a struct ``minhash``: n_shingles,
    component_id (least doc_id of the component) and first (true for one row of each
    component, of least doc_id).  Documents are linked if their sets of word shingles have at
    least ``percent`` of a hundred shingles in common, of all that either has.

    A text of fewer words than a shingle is one shingle.  Null, empty and wordless texts have no
    shingles and are linked with nothing, not even each other.  Equal sets are one set, so
    copies and repeated rows cost no links; of equal least ids one row is first.  Null ids come
    after all others.  A very long text is held whole.  Other columns may have any name but
    ``minhash``.  An empty table gives an empty result."""
    spark = ready(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    if "minhash" in keep:
        raise ValueError("the input has a column named minhash")
    folder = new_path(spark, "blocks")
    sets = staged(signed(docs, folder, text, doc_id, keep, shingle), "minhash")
    least = F.min(F.struct("no_id", "id", "block", "place", "signature")).alias("m")
    distinct = sets.where("key is not null").groupBy("key").agg(least).select("key", F.struct("m.no_id", "m.id", "m.block", "m.place").alias("least"), F.col("m.signature").alias("signature"))
    distinct = staged(distinct, "minhash")
    half = [F.conv(F.substring(F.hex("key"), 1 + 16 * i, 16), 16, -10).cast("long").alias(f"k{i + 1}") for i in range(2)]
    banded = sets.select(*half, "bands").select(F.explode("bands").alias("value"), "k1", "k2")
    size = sets.count() * BANDS * 32
    parts = max(1, min(shuffle_partitions(spark), 1 + (size >> 22)), size >> 26)
    ranged = banded.repartitionByRange(parts, "value", "k1", "k2").sortWithinPartitions("value", "k1", "k2")
    shared = staged(ranged.mapInArrow(tidy(_shared_values(small, piece_rows)), _SHARED), "minhash")
    members = shared.where("key is not null").select("value", "piece", "key")
    short = distinct.select("key", F.substring("signature", 1, HUB_MINIMA).alias("signature"))
    pieces = members.join(short.hint(MERGE), "key").select("piece", "key", "signature").repartition("piece").sortWithinPartitions("piece", "key")
    near = pieces.mapInArrow(tidy(_hubs(floor_of(percent, HUB_MINIMA))), _PAIRS)
    ordered = shared.where("a is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    tested = staged(ordered.union(near).distinct(), "minhash")
    links = confirmed(tested, distinct, folder, shingle, percent)
    roots = staged(connected_components(links), "minhash")
    more = unsettled_links(members, distinct, roots, folder, shingle, percent, pack)
    if more is not None and not more.isEmpty():
        roots = staged(connected_components(links.union(links_of(more, distinct))), "minhash")
    component = distinct.join(roots, distinct["least"] == roots["node"], "left").select("key", F.coalesce("root", "least").alias("c"))
    found = sets.select("block", "key").join(component.hint(MERGE), "key", "left")
    by_block = found.groupBy("block").agg(F.collect_list(F.struct("key", F.col("c.id").alias("id"), F.col("c.block").alias("at"), "c.place")).alias("components"))
    id_type = docs.schema[doc_id].dataType
    kind = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("component_id", id_type), T.StructField("first", T.BooleanType())])
    out = T.StructType([*[docs.schema[c] for c in keep], T.StructField("minhash", kind)])
    schema = to_arrow_schema(out)

    def run(batches) -> Iterator[pa.RecordBatch]:
        fields = list(schema.field("minhash").type)
        for batch in batches:
            for block, components in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                of = {c["key"]: c for c in components}
                t = unpack_table(read_file(block_path(folder, block)))
                ids, first = t.column("id").to_pylist(), []
                for i, key in enumerate(t.column("key").to_pylist()):
                    c = of.get(key)
                    first.append(c is None or (c["at"] == block and c["place"] == i))
                    if c is not None:
                        ids[i] = c["id"]
                rows = t.column("row").combine_chunks()
                rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows
                found = pa.StructArray.from_arrays([t.column("n").combine_chunks(), pa.array(ids, fields[1].type), pa.array(first, pa.bool_())], fields=fields)
                yield pa.RecordBatch.from_arrays([*[rows.field(c).cast(schema.field(c).type) for c in keep], found], schema=schema)

    # few rows with a block of documents behind each: as many tasks as for any shuffle
    return by_block.repartition(shuffle_partitions(spark)).mapInArrow(tidy(run), out)
