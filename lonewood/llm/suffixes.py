"""Removal of long byte strings that an earlier document also has, by suffix arrays.

A byte goes if a ``length``-byte string covers it that also starts in a document of
smaller id.  Judged on the input text, within documents, by these steps:

1. ``blocks``: documents are written in blocks of about ``BLOCK_BYTES`` of text, one file
   each; later steps move file names and read the text in place.
2. Every ``length``-byte window has a minimizer, the least hash among its ``GRAM``-byte
   grams.  Equal windows have equal minimizers, so they meet under one key; consecutive
   windows with one minimizer make one snippet.  Each block sends its distinct minimizers
   (sorted numbers, a few bytes each) to buckets, which answer with those that occur in at
   least two documents.  All other windows are unique and go no further.
3. For shared minimizers each block sends its distinct snippets with the least document id
   of each.  A bucket (``shard``) sorts the suffixes of its snippets by induced sorting and
   computes permuted common prefixes; suffixes that share ``length`` bytes form a group,
   whose least document id is the answer for each of its windows.  (A minimizer with one
   snippet in all blocks needs no sorting: its windows are in no other.)
   A minimizer that occurs more than ``HOT`` times can have any number of different
   snippets.  Its windows are sent one by one and dealt out by the whole window, so no
   shard gathers them.
4. Blocks mark the windows whose least id is below the document's own.

No step holds more than a block or a bucket; copies shrink to one snippet per block.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import new_path
from .common import ranges, ready, shuffle_partitions, staged, tidy, utf8
from .files import NewFile, pack_rows, read_file, task_name, unpack_table
from .sais import common_prefixes, suffix_array

LENGTH = 50
GRAM = 20
HOT = 4096
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20
STEP = 1 << 19
NO_ID = np.iinfo(np.int64).max

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes (16 to 24) at each place of ``raw``."""
    n = len(raw) - gram + 1
    words = np.ndarray((len(raw) - 7,), "<u8", np.ascontiguousarray(raw), strides=(1,))
    h = words[:n] * _MIX[0]
    h ^= h >> np.uint64(31)
    h += words[8:n + 8] * _MIX[1]
    h ^= h >> np.uint64(29)
    h += words[gram - 8:n + gram - 8] * _MIX[2]
    h ^= h >> np.uint64(32)
    h *= _MIX[3]
    h ^= h >> np.uint64(29)
    return h


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours."""
    m, have = h, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < width:
        m = np.minimum(m[:len(h) - width + 1], m[width - have:len(h) - width + 1 + width - have])
    return m


def snippets(raw: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(key, start, windows, doc) of the runs of consecutive windows with one minimizer."""
    keys, starts, counts = [], [], []
    total = len(raw)
    ends = offs[1:][np.diff(offs) >= length]
    if total >= length and len(ends):
        for lo in range(0, total - length + 1, STEP):
            hi = min(lo + STEP, total - length + 1)  # window starts lo..hi-1
            m = sliding_min(gram_hashes(raw[lo:hi + length - 1], gram), length - gram + 1)
            # a window is valid if no document ends inside it
            cut = offs[1:-1]
            cut = cut[(cut > lo) & (cut < hi + length - 1)] - lo
            bad = np.zeros(hi - lo + 1, np.int32)
            np.add.at(bad, np.maximum(cut - length + 1, 0), 1)
            np.add.at(bad, np.minimum(cut, hi - lo), -1)
            ok = np.cumsum(bad[:-1]) == 0
            new = np.ones(hi - lo, bool)
            new[1:] = (m[1:] != m[:-1]) | (ok[1:] != ok[:-1])
            at = np.flatnonzero(new)
            n = np.diff(np.concatenate([at, [hi - lo]]))
            use = ok[at]
            keys.append(m[at[use]])
            starts.append(at[use] + lo)
            counts.append(n[use])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.concatenate(starts)
    return np.concatenate(keys), start, np.concatenate(counts), np.searchsorted(offs, start, "right") - 1


# --- blocks ------------------------------------------------------------------------------


def blocks(docs: DataFrame, text: str, doc_id: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (block, bytes, path): files of whole rows of ``docs``, with their text and id as
    first two columns."""
    folder = new_path(docs.sparkSession, "blocks")
    cols = [F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__text"), F.coalesce(F.col(doc_id).cast("long"), F.lit(int(NO_ID))).alias("__id"),
            F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(0).alias("none")]).alias("__row")]

    def run(batches):
        from pyspark import TaskContext

        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            path = f"{folder}/{task_name()}-{seq:06d}.arrow"
            f = NewFile(path)
            f.write(pack_rows(held))
            f.close()
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + seq], pa.int64()), pa.array([size], pa.int64()), pa.array([path])], names=["block", "bytes", "path"])

        for b in batches:
            _, offs = utf8(b.column(0))
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + block_bytes - size, "right")) - 1)
                held.append(b.slice(lo, hi - lo))
                size += int(offs[hi] - offs[lo])
                lo = hi
                if size >= block_bytes or lo < b.num_rows:
                    yield flush()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield flush()

    return staged(docs.select(*cols).mapInArrow(tidy(run), "block long, bytes long, path string"), "suffixes")


def _texts(path: str) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    t = unpack_table(read_file(path))
    raw, offs = utf8(t.column(0))
    return t, raw, offs, t.column(1).to_numpy().astype(np.int64)


def pack_numbers(x: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as byte planes of their differences, which compress well."""
    return np.ascontiguousarray(np.diff(x.astype("<u4"), prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack_numbers(data: bytes) -> np.ndarray:
    planes = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T)
    return np.cumsum(planes.view("<u4").ravel(), dtype=np.uint32)


def address(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, 32-bit number in it) of minimizers.  Two minimizers with one address only make
    snippets that are compared in vain."""
    return (key % np.uint64(buckets)).astype(np.int64), ((key * _MIX[0]) >> np.uint64(32)).astype(np.uint32)


# --- step 2: minimizers that several documents have ----------------------------------------


def _keys(length: int, gram: int, buckets: int):
    """Of each block and bucket: distinct minimizers, and how often they occur (the sign is
    negative if in one document only)."""

    def run(batches):
        for batch in batches:
            for block, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, raw, offs, ids = _texts(path)
                key, _, _, doc = snippets(raw, offs, length, gram)
                if not len(key):
                    continue
                bucket, number = address(key, buckets)
                order = np.lexsort((number, bucket))
                bucket, number, who = bucket[order], number[order], ids[doc[order]]
                first = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (bucket[1:] != bucket[:-1])]))
                n = np.diff(np.concatenate([first, [len(key)]]))
                one = np.minimum.reduceat(who, first) == np.maximum.reduceat(who, first)
                times = np.where(one, -n, n).astype(np.int32)
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket[first])) + 1, [len(first)]])
                at = first[cuts[:-1]]
                yield pa.RecordBatch.from_arrays([
                    pa.array(bucket[at].astype(np.int32)), pa.array(np.full(len(at), block, np.int64)),
                    pa.array([pack_numbers(number[first[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                    pa.array([times[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                ], names=["bucket", "block", "keys", "times"])

    return run


def _shared(hot: int):
    """Of a bucket: for each block its minimizers that occur in two documents or more; those
    that occur more than ``hot`` times apart."""

    def run(bucket: pa.Table) -> pa.Table:
        block = bucket.column("block").to_numpy()
        keys = [unpack_numbers(x.as_py()) for x in bucket.column("keys")]
        times = np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in bucket.column("times")])
        sizes = np.array([len(k) for k in keys])
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        s, n = every[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        several = (np.diff(np.concatenate([first, [len(s)]])) > 1) | (np.maximum.reduceat(n, first) > 0)
        often = np.add.reduceat(np.abs(n).astype(np.int64), first) > hot
        width = np.diff(np.concatenate([first, [len(s)]]))
        kind = np.zeros(len(every), np.int8)
        kind[order] = np.repeat(np.where(several, np.where(often, 2, 1), 0), width)
        out = {"block": [], "cool": [], "hot": []}
        at = 0
        for b, k, m in zip(block.tolist(), keys, sizes.tolist(), strict=True):
            mine = kind[at:at + m]
            at += m
            if mine.any():
                out["block"].append(b)
                out["cool"].append(pack_numbers(k[mine == 1]))
                out["hot"].append(pack_numbers(k[mine == 2]))
        where = pa.array([bucket.column("bucket")[0].as_py()] * len(out["block"]), pa.int32())
        return pa.table([pa.array(out["block"], pa.int64()), where, pa.array(out["cool"], pa.binary()), pa.array(out["hot"], pa.binary())], names=["block", "bucket", "cool", "hot"])

    return run


# --- step 3: snippets and suffix arrays ---------------------------------------------------


def outgoing(raw: np.ndarray, offs: np.ndarray, shared: list[dict], length: int, gram: int, buckets: int):
    """What a block sends, bucket by bucket.  Returns (places, texts, begin, which, doc): bucket
    and distinct snippets of each message; and every occurrence: where it begins, its number
    among all snippets in the order of the messages, and its document."""
    key, start, count, doc = snippets(raw, offs, length, gram)
    place, number = address(key, buckets)
    code = place.astype(np.uint64) << np.uint64(32) | number

    def member(kind: str) -> np.ndarray:
        have = np.sort(np.concatenate([np.uint64(x["bucket"]) << np.uint64(32) | unpack_numbers(x[kind]) for x in shared] or [np.zeros(0, np.uint64)]))
        if not len(have):
            return np.zeros(len(code), bool)
        return have[np.minimum(np.searchsorted(have, code), len(have) - 1)] == code

    c, h = member("cool"), member("hot")
    whole = raw.tobytes()
    digest = xxhash.xxh64_intdigest
    single = ranges(start[h], count[h])
    place = np.concatenate([place[c], np.array([digest(whole[a:a + length]) % buckets for a in single.tolist()], np.int64)])
    begin = np.concatenate([start[c], single])
    windows = np.concatenate([count[c], np.ones(len(single), np.int64)])
    doc = np.concatenate([doc[c], np.repeat(doc[h], count[h])])
    order = np.argsort(place, kind="stable")
    place, begin, windows, doc = place[order], begin[order], windows[order], doc[order]
    which = np.empty(len(place), np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1, [len(place)]]) if len(place) else np.zeros(1, np.int64)
    places, texts, before = [], [], 0
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        seen: dict[bytes, int] = {}
        which[lo:hi] = [seen.setdefault(whole[a:a + w + length - 1], len(seen)) for a, w in zip(begin[lo:hi].tolist(), windows[lo:hi].tolist(), strict=True)]
        which[lo:hi] += before
        before += len(seen)
        places.append(int(place[lo]))
        texts.append(list(seen))
    return places, texts, begin, which, doc


def _sent(length: int, gram: int, buckets: int):
    """Of each block, for each bucket: its distinct snippets with the least id of each."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for block, path, shared in zip(*[batch.column(c).to_pylist() for c in ("block", "path", "shared")], strict=True):
                _, raw, offs, ids = _texts(path)
                places, texts, _, which, doc = outgoing(raw, offs, shared, length, gram, buckets)
                least = np.full(sum(map(len, texts)), NO_ID)
                np.minimum.at(least, which, ids[doc])
                at = 0
                for place, mine in zip(places, texts, strict=True):
                    sizes = np.array([len(x) for x in mine], np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([place], pa.int32())] + [pa.array([squeeze(x)], pa.binary()) for x in (
                        sizes.tobytes(), least[at:at + len(mine)].tobytes(), b"".join(mine))], names=["block", "bucket", "sizes", "ids", "data"])
                    at += len(mine)

    return run


def window_owners(texts: list[bytes], ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each ``length``-byte window of each text, in order, the least id of a text that has
    it.  Returns (ids, number of windows of each text)."""
    sizes = np.array([len(x) for x in texts], np.int64)
    raw = np.frombuffer(b"\0".join(texts) + b"\0\0", np.uint8)
    kind = np.uint8 if not len(raw) or raw.max() < 254 else np.uint16
    t = raw.astype(kind) + kind(2)
    ends = np.cumsum(sizes + 1) - 1
    t[ends] = 1
    t[-1] = 0
    sa = suffix_array(t)
    shared = common_prefixes(t, sa)
    doc = np.repeat(np.arange(len(texts)), sizes + 1)
    full = np.zeros(len(t), bool)
    starts = ends - sizes
    counts = np.maximum(sizes - length + 1, 0)
    where = ranges(starts, counts)
    full[where] = True
    inside = full[sa]
    p = sa[inside]
    # suffixes that start with one window lie next to each other: all of them are full
    new = np.concatenate([[True], ~((shared[p[1:]] >= length) & (np.diff(np.flatnonzero(inside)) == 1))]) if len(p) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    owner = np.zeros(len(t), np.int64)
    if len(p):
        least = np.minimum.reduceat(ids[doc[p]], np.flatnonzero(new))
        owner[p] = least[group]
    return owner[where], counts


def owners_of(texts: list[bytes], ids: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``window_owners``; only snippets whose minimizer others have too are sorted."""
    sizes = np.array([len(x) for x in texts], np.int64)
    counts = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(ids, counts)
    # the first window's minimizer: the least of its gram hashes
    head = np.frombuffer(b"".join(x[:length] for x in texts), np.uint8).reshape(-1, length)
    key = gram_hashes(head.ravel(), gram)
    at = np.arange(len(texts))[:, None] * length + np.arange(length - gram + 1)
    key = key[at].min(axis=1)
    _, where, n = np.unique(key, return_inverse=True, return_counts=True)
    several = np.flatnonzero((n[where] > 1) & (counts > 0))
    if len(several):
        first = np.cumsum(counts) - counts
        owner[ranges(first[several], counts[several])] = window_owners([texts[i] for i in several.tolist()], ids[several], length)[0]
    return owner, counts


def _shard(length: int, gram: int):
    """Of a bucket: for each block and each of its snippets, runs of windows with one owner."""

    def run(bucket: pa.Table) -> pa.Table:
        grow, squeeze = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        seen: dict[bytes, int] = {}
        which, least = [], []
        for sizes, ids, data in zip(*[bucket.column(c).to_pylist() for c in ("sizes", "ids", "data")], strict=True):
            ends, data = np.cumsum(np.frombuffer(grow(sizes), np.int32)).tolist(), grow(data)
            which.append(np.array([seen.setdefault(data[a:b], len(seen)) for a, b in zip([0, *ends[:-1]], ends, strict=True)], np.int64))
            least.append(np.frombuffer(grow(ids), np.int64))
        own = np.full(len(seen), NO_ID)
        np.minimum.at(own, np.concatenate(which), np.concatenate(least))
        owner, counts = owners_of(list(seen), own, length, gram)
        first = np.cumsum(counts) - counts
        new = np.zeros(len(owner), bool)
        new[first] = True
        new[1:] |= owner[1:] != owner[:-1]
        at = np.flatnonzero(new)
        run_n, run_id = np.diff(np.concatenate([at, [len(owner)]])), owner[at]
        run_first = np.searchsorted(at, first)
        run_count = np.diff(np.concatenate([run_first, [len(at)]]))
        out = {"counts": [], "runs": [], "owners": []}
        for w in which:
            pick = ranges(run_first[w], run_count[w])
            out["counts"].append(squeeze(run_count[w].astype(np.int32).tobytes()))
            out["runs"].append(squeeze(run_n[pick].astype(np.int32).tobytes()))
            out["owners"].append(squeeze(run_id[pick].tobytes()))
        return pa.table([bucket.column("block").combine_chunks(), bucket.column("bucket").combine_chunks()] + [pa.array(x, pa.binary()) for x in out.values()],
                        names=["block", "bucket", *out])

    return run


# --- step 4 ------------------------------------------------------------------------------


def covered(total: int, offs: np.ndarray, ids: np.ndarray, begin: np.ndarray, which: np.ndarray, counts: np.ndarray, runs: np.ndarray,
            owners: np.ndarray, length: int) -> np.ndarray:
    """Bytes under a window whose owner is below the id of the document it lies in."""
    first = np.cumsum(counts) - counts
    pick = ranges(first[which], counts[which])
    n, owner = runs[pick], owners[pick]
    inside = np.cumsum(n) - n
    occ_first = np.cumsum(counts[which]) - counts[which]
    base = np.repeat(inside[occ_first] if len(occ_first) else inside, counts[which])
    at = np.repeat(begin, counts[which]) + inside - base
    doc = np.searchsorted(offs, at, "right") - 1
    gone = owner < ids[doc]
    edge = np.zeros(total + 1, np.int32)
    np.add.at(edge, at[gone], 1)
    np.add.at(edge, at[gone] + n[gone] + length - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(own: T.StructType, text: str, length: int, gram: int, buckets: int):
    schema = to_arrow_schema(T.StructType([*own.fields, T.StructField("dedup", _RESULT)]))

    def run(batches) -> Iterator[pa.RecordBatch]:
        import hashlib

        grow = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for path, shared, answers in zip(*[batch.column(c).to_pylist() for c in ("path", "shared", "answers")], strict=True):
                t, raw, offs, ids = _texts(path)
                gone = np.zeros(len(raw), bool)
                if answers:
                    _, _, begin, which, _ = outgoing(raw, offs, shared, length, gram, buckets)
                    answers.sort(key=lambda x: x["bucket"])
                    counts, runs, owners = (np.concatenate([np.frombuffer(grow(x[k]), kind) for x in answers]).astype(np.int64) for k, kind in (("counts", np.int32), ("runs", np.int32), ("owners", np.int64)))
                    gone = covered(len(raw), offs, ids, begin, which, counts, runs, owners, length)
                kept = raw[~gone].tobytes()
                before = np.concatenate([[0], np.cumsum(gone)])
                removed = before[offs[1:]] - before[offs[:-1]]
                opens = np.zeros(len(gone) + 1, bool)
                opens[offs] = True  # a document begins
                edge = gone.copy()
                edge[1:] &= ~gone[:-1] | opens[1:-1]
                spans = np.concatenate([[0], np.cumsum(edge)])
                spans = spans[offs[1:]] - spans[offs[:-1]]
                ends = np.cumsum(np.diff(offs) - removed).tolist()
                parts = [kept[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                result = {"n_bytes": pa.array(np.diff(offs)), "n_removed": pa.array(removed.astype(np.int64)), "n_spans": pa.array(spans.astype(np.int64)),
                          "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string())}
                rows = t.column("__row").combine_chunks()
                rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows
                columns = []
                for f in schema:
                    if f.name == text:
                        columns.append(pa.array([x.decode("utf-8", "ignore") for x in parts], pa.string()).cast(f.type))
                    elif f.name == "dedup":
                        columns.append(pa.StructArray.from_arrays(list(result.values()), fields=list(f.type)))
                    else:
                        columns.append(rows.field(f.name).cast(f.type))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run, T.StructType([*own.fields, T.StructField("dedup", _RESULT)])


_RESULT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
                        T.StructField("kept_sha256", T.StringType())])


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, gram: int = GRAM, hot: int = HOT,
                   block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with the text that stays and a struct ``dedup``: n_bytes, n_removed, n_spans
    and kept_sha256 (of the bytes that stay; of the text, the rest of a character that was
    cut in the middle goes too).

    Ids are whole numbers; null ids come after all others and, like rows of one id, are no
    copies of each other.  Null and empty texts keep nothing (the text becomes "") and lose
    nothing.  An empty table gives an empty result; any other columns stay as they are, a
    column named dedup is an error."""
    if "dedup" in docs.columns:
        raise ValueError("the input has a column named dedup")
    if not 16 <= gram <= min(24, length):
        raise ValueError("gram must be 16 to 24, and no more than length")
    spark = ready(docs.sparkSession)
    stored = blocks(docs, text, doc_id, block_bytes)
    total = stored.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(shuffle_partitions(spark), ceil(total / bucket_bytes))
    # Tables of blocks have few rows with much work or large values behind each: they are dealt
    # out by number, and their joins never broadcast (the estimate would be that of the rows).
    many = shuffle_partitions(spark)
    keys = stored.select("block", "path").repartition(buckets, "block").mapInArrow(tidy(_keys(length, gram, buckets)), "bucket int, block long, keys binary, times binary")
    shared = keys.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_shared(hot), "block long, bucket int, cool binary, hot binary")
    shared = shared.groupBy("block").agg(F.collect_list(F.struct("bucket", "cool", "hot")).alias("shared"))
    todo = staged(stored.select("block", "path").join(shared.hint("shuffle_merge"), "block", "left"), "suffixes")
    sent = todo.where("shared is not null").repartition(many, "block").mapInArrow(
        tidy(_sent(length, gram, buckets)), "block long, bucket int, sizes binary, ids binary, data binary")
    answers = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(
        _shard(length, gram), "block long, bucket int, counts binary, runs binary, owners binary")
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "counts", "runs", "owners")).alias("answers"))
    own = T.StructType([docs.schema[c] for c in docs.columns])
    run, schema = _cut(own, text, length, gram, buckets)
    joined = todo.join(answers.hint("shuffle_merge"), "block", "left").select("path", "shared", "answers")
    return joined.repartition(many).mapInArrow(tidy(run), schema)
