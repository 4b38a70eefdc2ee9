"""Versions of a saved table set under one path.

A version is written into a folder of its own; then one small file under ``manifest`` names
it.  That file appears in one rename, so readers see the old version or the new one whole,
and a writer that fails before it leaves nothing but an unused folder."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def new_folder(path: str) -> str:
    return f"{path.rstrip('/')}/versions/{uuid.uuid4().hex}"


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, folder = _fs(spark, f"{path.rstrip('/')}/manifest")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def read(spark: SparkSession, path: str, number: int) -> dict:
    text = "\n".join(r.value for r in spark.read.text(f"{path.rstrip('/')}/manifest/{number:012d}.json").collect())
    return json.loads(text)


def latest(spark: SparkSession, path: str) -> dict | None:
    """The entry of the last committed version: its number, folder and what ``commit`` was given."""
    numbers = _numbers(spark, path)
    return read(spark, path, numbers[-1]) if numbers else None


def commit(spark: SparkSession, path: str, folder: str, after: int | None = None, **more) -> dict:
    """Makes ``folder`` the next version.  ``after``: the version it was made from (0: none);
    an error if another one has come since."""
    numbers = _numbers(spark, path)
    number = (numbers[-1] if numbers else 0) + 1
    if after is not None and number != after + 1:
        raise RuntimeError(f"version {after} of {path} is not the last one any more")
    entry = {"version": number, "folder": folder[len(path.rstrip("/")) + 1:], **more}
    fs, target = _fs(spark, f"{path.rstrip('/')}/manifest/{number:012d}.json")
    _, temporary = _fs(spark, f"{path.rstrip('/')}/manifest/.{uuid.uuid4().hex}")
    out = fs.create(temporary, True)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    # a rename onto an existing file fails where file systems have that; elsewhere the check tells
    if fs.exists(target) or not fs.rename(temporary, target):
        raise RuntimeError(f"version {number} of {path} was written by another job")
    return entry


def resolve(spark: SparkSession, path: str) -> str:
    """The folder of the last version; ``path`` itself if it has none."""
    entry = latest(spark, path)
    return f"{path.rstrip('/')}/{entry['folder']}" if entry else path
