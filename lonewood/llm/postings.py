"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` cuts the training documents into shards of about ``SHARD_BYTES`` of text.
Each shard is one row of a stored table: its distinct words, and for each word the sorted
token positions where it occurs.  A test set is searched in blocks of bounded size: the
block's windows travel to the shards; in a shard, the lists of a window are taken from its
rarest word on (by the count over all shards) and intersected after subtracting each
word's place in the window.

* proximity match: every word of the window occurs within ``slop`` words of an occurrence
  of its rarest word, in one document;
* exact match: all words in their places.  Exact matches lie among the proximity matches,
  so the cheaper proximity test runs first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import new_path
from .common import ready, shuffle_partitions, staged, tidy, utf8
from .files import NewFile, pack_rows, read_file, task_name, unpack_rows

WINDOW = 10
SLOP = 20
SHARD_BYTES = 4 << 20
#: Bytes of test text that are searched at once: what each broadcast is bounded by.
BLOCK_BYTES = 8 << 20

#: Bytes to words: A-Z become lower-case; other ASCII than digits and letters separates.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_TABLE).split()


class Numbers(dict):
    """Numbers words in the order of their first look-up."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def invert(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(length of the posting list of each of ``n`` words, positions list by list)."""
    return np.bincount(ids, minlength=n).astype(np.int32), np.argsort(ids, kind="stable").astype(np.int32)


_INDEX = "shard long, path string, n_words binary, terms binary, sizes binary, postings binary"


def build_index(docs: DataFrame, text: str = "text", keep: list[str] | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The stored index of ``docs``: one row per shard.  The columns ``keep`` (default: all) of
    its documents are in a file of the shard's (``path``), which no shuffle moves.  Null texts
    have no words."""
    ready(docs.sparkSession)
    folder = new_path(docs.sparkSession, "shards")
    keep = docs.columns if keep is None else keep
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    # a text that is kept is sent once, within its row
    columns = [row.alias("row")] if text in keep else [row.alias("row"), F.col(text).alias("text")]

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, rows, ids, counts, size, terms = TaskContext.get().partitionId(), 0, [], [], [], 0, Numbers()
        squeeze = zstandard.ZstdCompressor(level=1).compress

        def flush():
            sizes, at = invert(np.concatenate(ids) if ids else np.zeros(0, np.int32), len(terms))
            gaps = np.diff(at, prepend=np.int32(0))
            first = np.cumsum(sizes) - sizes
            gaps[first] = at[first]
            path = f"{folder}/{task_name()}-{seq:06d}.arrow"
            f = NewFile(path)
            f.write(pack_rows(rows))
            f.close()
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + seq], pa.int64()), pa.array([path])] + [pa.array([x], pa.binary()) for x in (
                np.array(counts, np.int64).tobytes(), squeeze(b"\n".join(terms)), squeeze(sizes.tobytes()), squeeze(gaps.tobytes()))],
                names=["shard", "path", "n_words", "terms", "sizes", "postings"])

        for b in batches:
            data, offs = utf8(b.column(0).field(text) if text in keep else b.column(1))
            raw = memoryview(data)
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + shard_bytes - size, "right")) - 1)
                rows.append(b.slice(lo, hi - lo).select([0]))
                for s, e in zip(offs[lo:hi].tolist(), offs[lo + 1:hi + 1].tolist(), strict=True):
                    mine = words_of(raw[s:e].tobytes())
                    counts.append(len(mine))
                    ids.append(np.fromiter(map(terms.__getitem__, mine), np.int32, len(mine)))
                size += int(offs[hi] - offs[lo])
                lo = hi
                if size >= shard_bytes or lo < b.num_rows:
                    yield flush()
                    rows, ids, counts, size, terms, seq = [], [], [], 0, Numbers(), seq + 1
        if rows:
            yield flush()

    return staged(docs.select(*columns).mapInArrow(tidy(run), _INDEX), "postings")


class Windows:
    """Windows of a block of test items, each window once.  ``vocabulary``: its words.
    ``words``: for each window the vocabulary numbers, -1 beyond its length.  ``items``: the
    items that have each window."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = {}
        for item, raw in items:
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(raw)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[i:i + window]), set()).add(item)
        self.vocabulary = list(vocabulary)
        self.words = np.full((len(found), window), -1, np.int64)
        for row, w in zip(self.words, found, strict=True):
            row[:len(w)] = w
        self.items = [sorted(x for x in s if x is not None) for s in found.values()]


class Shard:
    """Posting lists of one shard for a vocabulary."""

    def __init__(self, n_words: bytes, terms: bytes, sizes: bytes, postings: bytes | None, vocabulary: pa.Array):
        grow = zstandard.ZstdDecompressor().decompress
        self.ends = np.cumsum(np.frombuffer(n_words, np.int64))
        self.sizes = np.frombuffer(grow(sizes), np.int32).astype(np.int64)
        have = pa.array(grow(terms).split(b"\n") if len(self.sizes) else [], pa.binary())
        at = pc.index_in(vocabulary, value_set=have).to_numpy(zero_copy_only=False)
        self.at = np.where(np.isnan(at), -1, at).astype(np.int64) if at.dtype.kind == "f" else at.astype(np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.gaps = np.frombuffer(grow(postings), np.int32) if postings is not None else None
        self.lists: dict[int, np.ndarray] = {}

    def count(self) -> np.ndarray:
        out = np.zeros(len(self.at), np.int64)
        out[self.at >= 0] = self.sizes[self.at[self.at >= 0]]
        return out

    def positions(self, word: int) -> np.ndarray:
        if word not in self.lists:
            k = self.at[word]
            self.lists[word] = np.cumsum(self.gaps[self.first[k]:self.first[k] + self.sizes[k]], dtype=np.int64)
        return self.lists[word]

    def search(self, words: np.ndarray, rarity: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(start of each exact match, rarest word's place of each proximity match) of one
        window, which lies in a document whole."""
        offsets = np.argsort(rarity[words], kind="stable")
        lead = int(offsets[0])
        a = self.positions(int(words[lead]))
        doc = np.searchsorted(self.ends, a, "right")
        low = np.maximum(a - slop, np.where(doc > 0, self.ends[doc - 1], 0))
        high = np.minimum(a + slop, self.ends[doc] - 1)
        tried = {int(words[lead])}
        for k in offsets[1:].tolist():
            w = int(words[k])
            if w in tried:
                continue
            tried.add(w)
            p = self.positions(w)
            i = np.searchsorted(p, low)
            ok = (i < len(p)) & (p[np.minimum(i, len(p) - 1)] <= high)
            a, low, high = a[ok], low[ok], high[ok]
            if not len(a):
                return a, a
        s = a - lead
        for k in offsets[1:].tolist():
            p = self.positions(int(words[k]))
            i = np.searchsorted(p, s + k)
            s = s[(i < len(p)) & (p[np.minimum(i, len(p) - 1)] == s + k)]
            if not len(s):
                return s, a
        s = s[s >= 0]
        whole = np.searchsorted(self.ends, s, "right") == np.searchsorted(self.ends, s + len(words) - 1, "right")
        return s[whole], a


_HITS = "shard long, place int, begins array<long>, ends array<long>, items array<string>, near array<string>"


def _counts(block):
    def run(batches):
        vocabulary = pa.array(block.value.vocabulary, pa.binary())
        total = np.zeros(len(vocabulary), np.int64)
        for b in batches:
            for n, t, s in zip(*[b.column(c).to_pylist() for c in ("n_words", "terms", "sizes")], strict=True):
                total += Shard(n, t, s, None, vocabulary).count()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(total[some])], names=["word", "n"])

    return run


def _hits(block, rarity, slop: int):
    def run(batches):
        windows, rare = block.value, rarity.value
        vocabulary = pa.array(windows.vocabulary, pa.binary())
        length = (windows.words >= 0).sum(axis=1)
        for b in batches:
            for shard, n, t, z, p in zip(*[b.column(c).to_pylist() for c in ("shard", "n_words", "terms", "sizes", "postings")], strict=True):
                s = Shard(n, t, z, p, vocabulary)
                there = np.concatenate([s.at >= 0, [True]])  # the last answers for -1
                found: dict[int, tuple[list, list, set, set]] = {}
                for k in np.flatnonzero(there[windows.words].all(axis=1)).tolist():
                    begins, near = s.search(windows.words[k, :length[k]], rare, slop)
                    if not len(near):
                        continue
                    for d in np.unique(np.searchsorted(s.ends, near, "right")).tolist():
                        found.setdefault(d, ([], [], set(), set()))[3].update(windows.items[k])
                    at = np.searchsorted(s.ends, begins, "right")
                    for d in np.unique(at).tolist():
                        f = found.setdefault(d, ([], [], set(), set()))
                        x = begins[at == d] - (s.ends[d - 1] if d else 0)
                        f[0].extend(x.tolist())
                        f[1].extend((x + length[k]).tolist())
                        f[2].update(windows.items[k])
                if found:
                    f = list(found.values())
                    yield pa.RecordBatch.from_arrays([
                        pa.array([shard] * len(f), pa.int64()), pa.array(list(found), pa.int32()), pa.array([x[0] for x in f], pa.list_(pa.int64())),
                        pa.array([x[1] for x in f], pa.list_(pa.int64())), pa.array([sorted(x[2]) for x in f], pa.list_(pa.string())),
                        pa.array([sorted(x[3]) for x in f], pa.list_(pa.string()))], names=["shard", "place", "begins", "ends", "items", "near"])

    return run


def search(index: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", window: int = WINDOW, slop: int = SLOP,
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Matches of the test items' windows: per shard and document (place in the shard), the
    begins and ends (in words) of exact matches, their items and the items of proximity
    matches.  Items of several blocks are several rows.  Items without words have no
    windows; items with a null id mark words but are not listed."""
    if slop < window - 1:
        raise ValueError("slop must be at least window - 1")
    spark = ready(index.sparkSession)
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    size = items.agg(F.sum(F.octet_length("t") + 32)).first()[0] or 0
    n = max(1, ceil(size / block_bytes))
    parts = []
    for k in range(n):
        mine = items.where(F.pmod(F.xxhash64("item", "t"), F.lit(n)) == k).distinct()
        windows = Windows([(r["item"], r["t"].encode()) for r in mine.toLocalIterator()], window)
        block = spark.sparkContext.broadcast(windows)
        counted = index.select("n_words", "terms", "sizes").mapInArrow(tidy(_counts(block)), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
        rarity = np.zeros(len(windows.vocabulary) + 1, np.int64)
        for r in counted.toLocalIterator():
            rarity[r["word"]] = r["n"]
        parts.append(index.select("shard", "n_words", "terms", "sizes", "postings").mapInArrow(tidy(_hits(block, spark.sparkContext.broadcast(rarity), slop)), _HITS))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


_RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
                        T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()), T.StructField("n_near", T.LongType()),
                        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])))])


def _joined(hits: list[dict]) -> tuple[list[tuple[int, int]], list[str], int]:
    """Spans of one document, merged; its items; the number of items nearby."""
    spans: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for h in hits for a, b in zip(h["begins"], h["ends"], strict=True)):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    return spans, sorted({i for h in hits for i in h["items"]}), len({i for h in hits for i in h["near"]})


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", keep: list[str] | None = None,
                  window: int = WINDOW, slop: int = SLOP, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all) and a struct ``leak``: n_words, n_hit
    (words inside an exact match), n_items and items_sha256 (of the items' ids, sorted as
    strings and joined by commas), contaminated (n_hit > 0), n_near (items with a proximity
    match) and spans (begin and end of the merged matches, in words).

    Null and empty texts have no words and are clean; repeated rows are judged each for
    itself, and repeated items count once.  An empty benchmark leaves all documents clean;
    an empty table gives an empty result."""
    keep = docs.columns if keep is None else keep
    if "leak" in keep:
        raise ValueError("the input has a column named leak")
    index = build_index(docs, text, keep, shard_bytes)
    hits = search(index, benchmark, item_text, item_id, window, slop, block_bytes)
    by_shard = hits.groupBy("shard").agg(F.collect_list(F.struct("place", "begins", "ends", "items", "near")).alias("hits"))
    own = T.StructType([docs.schema[c] for c in keep])
    out = T.StructType([*own.fields, T.StructField("leak", _RESULT)])
    schema = to_arrow_schema(out)

    def run(batches):
        none = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            for path, n_words, hits in zip(*[batch.column(c).to_pylist() for c in ("path", "n_words", "hits")], strict=True):
                found: dict[int, list] = {}
                for h in hits or []:
                    found.setdefault(h["place"], []).append(h)
                leaks = []
                for place, n in enumerate(np.frombuffer(n_words, np.int64).tolist()):
                    if place in found:
                        spans, items, near = _joined(found[place])
                        leaks.append({"n_words": n, "n_hit": sum(b - a for a, b in spans), "n_items": len(items), "items_sha256": hashlib.sha256(",".join(items).encode()).hexdigest(),
                                      "contaminated": bool(spans), "n_near": near, "spans": [{"begin": a, "end": b} for a, b in spans]})
                    else:
                        leaks.append({"n_words": n, "n_hit": 0, "n_items": 0, "items_sha256": none, "contaminated": False, "n_near": 0, "spans": []})
                mine = unpack_rows(read_file(path))
                columns = [mine.field(f.name).cast(f.type) if f.name != "leak" else pa.array(leaks, f.type) for f in schema]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    joined = index.select("shard", "path", "n_words").join(by_shard.hint("shuffle_merge"), "shard", "left").select("path", "n_words", "hits")
    # few rows with a shard of work behind each: as many tasks as for any shuffle
    return joined.repartition(shuffle_partitions(docs.sparkSession)).mapInArrow(tidy(run), out)
