"""Session-level helpers: where persisted intermediates live.

Model bundles and lineage cuts are written under the shared folder that the cluster
names in ``spark.checkpoint.dir``.  Only when that setting is absent *and* the master
is local (tests, notebooks on one machine) do we create a folder ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        ck = sc.getCheckpointDir()
        if ck:
            base = ck
        elif sc.master.startswith("local"):
            base = tempfile.mkdtemp(prefix="lonewood-ckpt-")
            spark.conf.set("spark.checkpoint.dir", base)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    # a path without a scheme means the cluster's default file system, not the driver's disk
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/lonewood/{kind}/{uuid.uuid4().hex}"


PARTITION_BYTES = 64 << 20


def partitions_for(df, partition_bytes: int = PARTITION_BYTES) -> int:
    """Partitions for a shuffle of ``df`` by the optimizer's size estimate (no job runs);
    ``spark.sql.shuffle.partitions`` where there is no estimate, and at least that many
    once the data is larger than one partition each."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if size >= 1 << 50:  # unknown, or a product of estimates
        return usual
    # files hold columns compressed: about a third of their size in a shuffle
    return max(1, min(usual, 1 + 3 * size // (4 << 20)), 3 * size // partition_bytes)


def local_fs_path(path: str) -> str | None:
    """Path of a file: URI on the driver's disk; None for any other file system."""
    if path.startswith("file:"):
        return path[len("file:"):]
    if "://" in path:
        return None
    return path if os.path.isabs(path) else None


def put_file(spark: SparkSession, folder: str, name: str, data: bytes) -> str:
    """Writes a file of the shared storage unless it is there; returns its path."""
    local = local_fs_path(folder)
    if local is not None:
        os.makedirs(local, exist_ok=True)
        path = os.path.join(local, name)
        if not os.path.exists(path):
            tmp = path + f".{uuid.uuid4().hex}.part"
            with open(tmp, "wb") as fh:
                fh.write(data)
            os.replace(tmp, path)
        return path
    # shared storage of the cluster (hdfs://, s3a://, ...): write through Hadoop's FileSystem
    path = f"{folder}/{name}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        out = fs.create(jpath, True)
        out.write(bytearray(data))
        out.close()
    return path


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``lonewood`` importable in executors' Python workers (like --py-files).

    The package is zipped once per session into the shared folder (``spark.checkpoint.dir``)
    and added with ``addPyFile``; a no-op when it is already shipped.
    """
    import hashlib
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    files = []
    for root, _dirs, names in os.walk(pkg_dir):
        if "__pycache__" in root:
            continue
        for nm in sorted(names):
            if nm.endswith(".py"):
                files.append(os.path.join(root, nm))
    h = hashlib.sha1()
    for f in sorted(files):
        with open(f, "rb") as fh:
            h.update(f.encode() + fh.read())
    import io

    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        base = os.path.dirname(pkg_dir)
        for f in sorted(files):
            z.write(f, os.path.relpath(f, base))
    data = buf.getvalue()
    name = f"lonewood-{h.hexdigest()[:12]}.zip"
    target = shared_dir(spark) + "/lonewood/pyfiles"
    zpath = put_file(spark, target, name, data)
    sc.addPyFile(zpath)
    _SHIPPED.add(key)
