"""WARC archives: one gzip member per record, and a sequential reader.

Of records with equal payloads of at least ``MIN_BYTES`` bytes, that with the least page id
is the response; the others are revisit records, which refer to it and carry no payload.
The reader decompresses a stream piece by piece, frames records by their content length and
checks block and payload digests; it holds one record at a time.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_path
from .common import ready, shuffle_partitions, staged, tidy
from .files import NewFile, filesystem, task_name

MIN_BYTES = 100
FILE_BYTES = 256 << 20
CHUNK = 1 << 20
SALTS = 8

# Fixed values of the format (WARC 1.1).
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
URN = "urn:x-page:"


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def _uri(url: str) -> str:
    """Characters that would end a header line are written as percent escapes."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str | None = None) -> bytes:
    """One record as a gzip member."""
    digest = digest or hashlib.sha256(payload).hexdigest()
    head = _http(len(payload))
    block = head if refers_to is not None else head + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{URN}{'' if page_id is None else page_id}>"), ("WARC-Date", DATE)]
    fields += [("WARC-Target-URI", _uri(url))] if url is not None else []
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{URN}{refers_to}>")] if refers_to is not None else []
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
               ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    text = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(text) + gz.flush()


class WarcError(ValueError):
    """A broken archive."""


def members(stream: BinaryIO, chunk: int = CHUNK) -> Iterator[bytes]:
    """Contents of the gzip members of a stream, one at a time."""
    data = stream.read(chunk)
    while data:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not data:
                raise WarcError("the last gzip member is cut off")
            try:
                parts.append(z.decompress(data))
            except zlib.error as e:
                raise WarcError(f"broken gzip member: {e}") from e
            data = z.unused_data or (b"" if z.eof else stream.read(chunk))
        yield b"".join(parts)
        data = data or stream.read(chunk)


def parse(text: bytes) -> tuple[dict[str, str], bytes]:
    """(fields, block) of one record, its framing and block digest checked."""
    head, found, rest = text.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] != VERSION:
        raise WarcError("a gzip member does not begin with a WARC record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon:
            raise WarcError(f"broken header line {line!r}")
        fields[name.lower()] = value.strip()
    size = fields.get("content-length", "")
    if not size.isdigit() or len(rest) != int(size) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("the content length does not frame the record")
    block = rest[:-4]
    if fields.get("warc-block-digest", "") != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise WarcError("the block does not match its digest")
    return fields, block


def records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(fields, payload, bytes of the full payload) of every response and revisit record; a
    revisit's payload is empty here."""
    for text in members(stream):
        fields, block = parse(text)
        http, _, payload = block.partition(b"\r\n\r\n")
        size = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
        if fields.get("warc-type") not in ("response", "revisit") or not size:
            raise WarcError("not a record of an HTTP response")
        if fields["warc-type"] == "response" and (len(payload) != int(size[1]) or fields["warc-payload-digest"] != f"sha256:{hashlib.sha256(payload).hexdigest()}"):
            raise WarcError("the payload does not match its length or digest")
        yield fields, payload, int(size[1])


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(rf"<{URN}(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def write_warc(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None,
               min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the archives and returns the table of files: path and n_records.

    Null html is an empty payload, a null url is left out.  Rows of the least id of their
    payload are all responses (repeated rows), and so are rows of null id without any other
    id.  An empty table gives no files."""
    spark = ready(pages.sparkSession)
    folder = folder or new_path(spark, "warc")
    p = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    first = p.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # a payload that very many pages have is spread over several tasks
    first = first.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    p = p.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int"))
    rows = p.join(first, ["digest", "salt"], "left").select(
        "id", "url", "payload", "digest", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        number, out, size, n = 0, None, 0, 0

        def path():
            return f"{folder}/part-{task_name()}-{number:06d}.warc.gz"

        def done():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path()]), pa.array([n], pa.int64())], names=["path", "n_records"])

        for b in batches:
            for i, u, payload, digest, to in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if out is None:
                    out, size, n = NewFile(path()), 0, 0
                data = record(i, u, payload, to, digest)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= file_bytes:
                    yield done()
                    out, number = None, number + 1
        if out is not None:
            yield done()

    return staged(rows.mapInArrow(tidy(run), "path string, n_records long"), "warc")


def read_warc(files: DataFrame, payload: bool = False) -> DataFrame:
    """Records of the archives (column ``path``): page_id, url, payload_bytes and
    payload_digest of the full payload, record_type, refers_to and, on request, the payload
    (null for revisits)."""
    spark = ready(files.sparkSession)
    columns = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    columns |= {"payload": pa.binary()} if payload else {}

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, inner = filesystem(path)
                held, size = [], 0
                with fs.open_input_stream(inner, compression=None) as stream:
                    for f, data, full in records(stream):
                        kind = f["warc-type"]
                        held.append((_page(f["warc-record-id"]), f.get("warc-target-uri"), full, f["warc-payload-digest"].removeprefix("sha256:"), kind,
                                     _page(f.get("warc-refers-to")), data if kind == "response" else None)[:len(columns)])
                        size += len(data) if payload else 0
                        if len(held) >= 1000 or size > 32 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), columns.values(), strict=True)], names=list(columns))
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), columns.values(), strict=True)], names=list(columns))

    return files.select("path").repartition(shuffle_partitions(spark), "path").mapInArrow(
        tidy(run), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if payload else ""))
