"""Token ids in seekable Zstandard files.

A file is a row of independent frames, then two skippable frames: the table of documents
(zstd: ids, valid flags, frames of each) and the seek table of the Zstandard seekable
format (compressed size, size and checksum of every frame; the checksum is the low half of
the XXH64 of the frame's content).  Every document begins a frame, so a reader decompresses
only the documents it is asked for; a document above ``FRAME_IDS`` ids takes several frames.
Ids are little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import new_path
from .common import ready, shuffle_partitions, staged, tidy
from .files import NewFile, filesystem, task_name
from .tokens import encoder

# Fixed values of the file format.
SKIPPABLE = 0x184D2A50
SEEK_TABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1

END = 2
FRAME_IDS = 1 << 22
FILE_IDS = 1 << 25
LEVEL = 3


class Writer:
    """Writes one file."""

    def __init__(self, path: str):
        self.out = NewFile(path)
        self.squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.n_frames: list[int] = []
        self.n_ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        ids = ids.astype("<u4")
        starts = range(0, max(1, len(ids)), FRAME_IDS)
        for s in starts:
            raw = ids[s:s + FRAME_IDS].tobytes()
            data = self.squeeze(raw)
            self.out.write(data)
            self.frames.append((len(data), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.ids.append(doc_id)
        self.n_frames.append(len(starts))
        self.n_ids += len(ids)

    def close(self) -> None:
        valid = np.array([x is not None for x in self.ids], np.uint8)
        table = self.squeeze(struct.pack("<I", len(self.ids)) + np.array([x or 0 for x in self.ids], "<i8").tobytes() + valid.tobytes() + np.array(self.n_frames, "<u4").tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        entries = np.array(self.frames, "<u4").reshape(-1, 3).tobytes()
        self.out.write(struct.pack("<II", SEEK_TABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE))
        self.out.close()


class TokenFile:
    """Reads single documents of one file; every frame is checked against its checksum."""

    def __init__(self, path: str):
        fs, path = filesystem(path)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError(f"{path} has no seek table with checksums")
        at = size - 9 - 12 * n - 8
        head = self.file.read_at(8 + 12 * n, at)
        if struct.unpack("<II", head[:8]) != (SEEK_TABLE, 12 * n + 9):
            raise ValueError(f"{path} has a broken seek table")
        self.entries = np.frombuffer(head, "<u4", 3 * n, 8).reshape(n, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.entries[:, 0])])
        table = self.file.read_at(at - int(self.starts[-1]), int(self.starts[-1]))
        magic, length = struct.unpack("<II", table[:8])
        if magic != SKIPPABLE or length != len(table) - 8:
            raise ValueError(f"{path} has a broken table of documents")
        self.grow = zstandard.ZstdDecompressor().decompress
        raw = self.grow(table[8:])
        docs = struct.unpack_from("<I", raw)[0]
        ids, valid = np.frombuffer(raw, "<i8", docs, 4), np.frombuffer(raw, np.uint8, docs, 4 + 8 * docs)
        self.ids = [i if v else None for i, v in zip(ids.tolist(), valid.tolist(), strict=True)]
        self.first = np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<u4", docs, 4 + 9 * docs).astype(np.int64))])

    def document(self, k: int) -> np.ndarray:
        """Ids of the ``k``-th document of the file."""
        a, b = int(self.first[k]), int(self.first[k + 1])
        data = self.file.read_at(int(self.starts[b] - self.starts[a]), int(self.starts[a]))
        parts = []
        for f in range(a, b):
            lo = int(self.starts[f] - self.starts[a])
            raw = self.grow(data[lo:lo + int(self.entries[f, 0])])
            if len(raw) != self.entries[f, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.entries[f, 2]:
                raise ValueError(f"frame {f} does not match its checksum")
            parts.append(raw)
        return np.frombuffer(b"".join(parts), "<u4")


def write_tokens(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", end: int | None = END, folder: str | None = None,
                 file_ids: int = FILE_IDS) -> DataFrame:
    """Encodes ``docs`` and writes the files in ascending id order.  Returns the table of
    files: part, file (their order), path, n_docs, n_ids and start (ids in all files before).

    Null ids come first; rows of one id are ordered by a hash of their text.  Null and empty texts are
    the end id alone.  An empty table gives no files."""
    spark = ready(docs.sparkSession)
    folder = folder or new_path(spark, "tokens")
    d = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keys = ["id", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row")]
    ranged = d.select("text", *keys).repartitionByRange(shuffle_partitions(spark), F.asc_nulls_first("id"), "tie", "row").sortWithinPartitions(F.asc_nulls_first("id"), "tie", "row")

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, e, writer, number = TaskContext.get().partitionId(), encoder(path), None, 0
        last = np.array([] if end is None else [end], np.uint32)

        def done():
            name = f"{folder}/part-{task_name()}-{number:06d}.zst"
            writer.close()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([name]), pa.array([len(writer.ids)], pa.int64()),
                                               pa.array([writer.n_ids], pa.int64())], names=["part", "file", "path", "n_docs", "n_ids"])

        for b in batches:
            flat, counts = e.encode(b.column(1).to_pylist())
            ends = np.cumsum(counts)
            for i, s, t in zip(b.column(0).to_pylist(), (ends - counts).tolist(), ends.tolist(), strict=True):
                if writer is None:
                    writer = Writer(f"{folder}/part-{task_name()}-{number:06d}.zst")
                writer.add(i, np.concatenate([flat[s:t], last]))
                if writer.n_ids >= file_ids:
                    yield done()
                    writer, number = None, number + 1
        if writer is not None:
            yield done()

    files = staged(ranged.select("id", "text").mapInArrow(tidy(run), "part int, file int, path string, n_docs long, n_ids long"), "tokens")
    # running totals: over the files of a task, and over tasks (a row each)
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("all")).select("part", F.coalesce(F.sum("all").over(before.orderBy("part")), F.lit(0)).alias("parts_before"))
    start = F.col("parts_before") + F.coalesce(F.sum("n_ids").over(before.partitionBy("part").orderBy("file")), F.lit(0))
    return files.join(parts, "part").select("part", "file", "path", "n_docs", "n_ids", start.alias("start"))


def read_tokens(files: DataFrame, ids: bool = False) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before), n_tokens,
    ids_crc32 and, on request, ids."""
    ready(files.sparkSession)

    def run(batches):
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = TokenFile(path)
                at, out = start, {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": [], "ids": []}
                for k, i in enumerate(f.ids):
                    x = f.document(k)
                    for name, v in (("doc_id", i), ("start", at), ("n_tokens", len(x)), ("ids_crc32", crc32(x.tobytes()))):
                        out[name].append(v)
                    if ids:
                        out["ids"].append(x.astype(np.int32))
                    at += len(x)
                    if k % 1000 == 999 or k == len(f.ids) - 1:
                        columns = [pa.array(out[c], pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")] + ([pa.array(out["ids"], pa.list_(pa.int32()))] if ids else [])
                        yield pa.RecordBatch.from_arrays(columns, names=list(out)[:len(columns)])
                        out = {c: [] for c in out}

    spread = files.select("path", "start").repartition(shuffle_partitions(files.sparkSession), "path")
    return spread.mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else ""))
