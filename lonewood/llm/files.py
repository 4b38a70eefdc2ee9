"""Files of our own in the shared folder that ``spark.checkpoint.dir`` names, written and
read by the tasks themselves."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.fs as pafs


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:/"):
        return pafs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


def task_name() -> str:
    """Partition and attempt of the running task.  Attempts never share a file: a table row
    names the file of the attempt that wrote it, also if an input comes in another order the
    second time or two attempts run side by side."""
    from pyspark import TaskContext

    return f"{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}"


class NewFile:
    """A stream under a temporary name; ``close`` gives the file its own name in one step, so
    readers see whole files only."""

    def __init__(self, path: str):
        self.fs, self.path = filesystem(path)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary, compression=None)

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temporary, self.path)


def read_file(path: str) -> bytes:
    fs, path = filesystem(path)
    with fs.open_input_file(path) as f:
        return f.read()


def pack_rows(batches: list[pa.RecordBatch]) -> bytes:
    """An Arrow stream of whole rows, compressed."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        for b in batches:
            w.write_batch(b)
    return sink.getvalue().to_pybytes()


def unpack_table(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all().combine_chunks()


def unpack_rows(blob: bytes) -> pa.StructArray:
    """The rows of a stream with one struct column."""
    rows = unpack_table(blob).column(0)
    return rows.chunk(0) if rows.num_chunks else pa.array([], rows.type)
