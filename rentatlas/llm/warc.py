"""Web archives: one gzip member per record, read back in sequence.

``write_archives`` stores pages as WARC files, ``read_archives`` streams them: each member is
inflated piece by piece, its headers are parsed, the block is framed by its content length and the
payload is checked against its digest. Nothing is held beyond one record.

Of records with equal payloads of at least ``min_bytes`` bytes the one with the largest ``page_id``
is stored in full, the others as revisits of it. Defined results: a missing html is an empty payload;
repeated rows with the largest ``page_id`` are all responses; a missing ``page_id`` revisits if any
equal payload has an id and is a response if none has; an empty table yields no files; further
columns are ignored; texts of any length are streamed.

Files: tasks write under names of their own, so a repeated task never touches what another attempt
wrote. The manifest that names the valid files is itself stored in the shared folder.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import io
import os
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentatlas.llm.common import stage
from rentatlas.session import shared_dir

CHUNK = 1 << 18
VERSION = b"WARC/1.1"
HEADER_END = b"\r\n\r\n"
EPOCH = dt.datetime(2000, 1, 1, tzinfo=dt.timezone.utc)


class BrokenArchive(ValueError):
    """A record that does not keep to its framing or its digest."""


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record_bytes(
    page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool
) -> bytes:
    """One record, not yet compressed. A revisit keeps the digest and length of its payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + HEADER_END
    block = http if revisit else http + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Target-URI", "".join((url or "").split())),
        ("WARC-Date", EPOCH.strftime("%Y-%m-%dT%H:%M:%SZ")),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        headers += [
            ("WARC-Refers-To", record_id(refers_to)),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ]
    headers += [
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "\r\n".join(f"{k}: {v}" for k, v in headers).encode()
    return VERSION + b"\r\n" + head + HEADER_END + block + HEADER_END


def gzip_member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Record(NamedTuple):
    headers: dict[str, str]
    payload: bytes
    offset: int

    @property
    def type(self) -> str:
        return self.headers.get("warc-type", "")


def members(stream: BinaryIO, chunk: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """(offset, inflated bytes) of each gzip member, inflated as the input arrives."""
    inflate, parts, offset, position = zlib.decompressobj(31), [], 0, 0
    data = stream.read(chunk)
    while data:
        parts.append(inflate.decompress(data))
        position += len(data)
        if inflate.eof:
            data = inflate.unused_data
            position -= len(data)
            yield offset, b"".join(parts)
            inflate, parts, offset = zlib.decompressobj(31), [], position
            data = data or stream.read(chunk)
        else:
            data = stream.read(chunk)
    if offset != position:
        raise BrokenArchive(f"the member at {offset} is cut off")


def parse(data: bytes, offset: int = 0) -> Record:
    """A record from its bytes, framed by its content length and checked by its digest."""
    head, mark, rest = data.partition(HEADER_END)
    lines = head.split(b"\r\n")
    if not mark or not lines[0].startswith(b"WARC/"):
        raise BrokenArchive(f"no record header at {offset}")
    headers = {}
    for line in lines[1:]:
        name, _, value = line.decode().partition(":")
        headers[name.strip().lower()] = value.strip()
    size = int(headers.get("content-length", -1))
    if size < 0 or rest[size:] != HEADER_END:
        raise BrokenArchive(f"the block at {offset} does not end where its length says")
    payload = rest[:size].partition(HEADER_END)[2]
    expected = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if headers.get("warc-type") == "response" and expected != payload_digest(payload):
        raise BrokenArchive(f"the payload at {offset} does not match its digest")
    return Record(headers, payload, offset)


def records(stream: BinaryIO, chunk: int = CHUNK) -> Iterator[Record]:
    for offset, data in members(stream, chunk):
        yield parse(data, offset)


def page_of(identifier: str | None) -> int | None:
    digits = (identifier or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, keeper``: the page that holds an equal payload in full.

    Equal payloads meet as two 64-bit hashes and a length; only the largest id of each goes back
    to the pages, by a join that splits a payload many pages share.
    """
    chosen = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    ).withColumns({
        "h1": F.xxhash64("payload"), "h2": F.xxhash64(F.lit(1), "payload"),
        "size": F.octet_length("payload"),
    })
    same = ["h1", "h2", "size"]
    large = F.col("size") >= min_bytes
    keepers = chosen.where(large).groupBy(*same).agg(F.max("page_id").alias("keeper"))
    return chosen.join(keepers, same, "left").drop(*same)


MANIFEST = "file string, records long, bytes long"


def write_archives(
    pages: DataFrame, path: str | None = None, min_bytes: int = 0, level: int = 6
) -> DataFrame:
    """Store ``pages`` as ``*.warc.gz`` files under ``path``; the manifest of the valid files.

    ``path`` is a folder all executors share, a new one in the shared folder by default.
    """
    spark = pages.sparkSession
    root = path or os.path.join(shared_dir(spark), f"warc-{uuid.uuid4().hex}")
    uri = root if "://" in root or root.startswith("file:") else f"file://{os.path.abspath(root)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(uri)
        task = TaskContext.get()
        name = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        out, count, size = None, 0, 0
        for batch in batches:
            columns = (batch.column(c) for c in ("page_id", "url", "payload", "keeper"))
            for page_id, url, payload, keeper in zip(*columns, strict=True):
                if out is None:
                    store.create_dir(folder, recursive=True)
                    out = store.open_output_stream(name, compression=None)
                page_id, keeper = page_id.as_py(), keeper.as_py()
                revisit = keeper is not None and keeper != page_id
                member = gzip_member(
                    record_bytes(page_id, url.as_py(), payload.as_py(), keeper, revisit), level
                )
                out.write(member)
                count, size = count + 1, size + len(member)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [count], "bytes": [size]})

    return stage(mark_revisits(pages, min_bytes).mapInArrow(run, MANIFEST), "warc-manifest")


RECORDS = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, file string, offset long, payload binary"
)


def read_archives(files: DataFrame, uri: str = "file:///", payloads: bool = True) -> DataFrame:
    """Every record of the archives named in column ``file``, one file per sequential reader.

    ``uri`` names the store the paths belong to. Payloads of revisits are empty;
    ``payloads=False`` leaves all of them out after they have been checked.
    """
    kinds = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("file", pa.string()), ("offset", pa.int64()), ("payload", pa.binary()),
    ])

    def rows(file: str) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(uri)
        with store.open_input_stream(file, compression=None) as raw:
            for record in records(raw):
                h = record.headers
                yield (
                    page_of(h.get("warc-record-id")), h.get("warc-target-uri"),
                    int(h.get("x-payload-length", len(record.payload))),
                    h.get("warc-payload-digest", "").removeprefix("sha1:"), record.type,
                    page_of(h.get("warc-refers-to")), file, record.offset,
                    record.payload if payloads else None,
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for file in batch.column(0).to_pylist():
                for row in rows(file):
                    held.append(row)
                    size += len(row[-1] or b"") + 300
                    if size > CHUNK * 16:
                        yield _batch(held, kinds)
                        held, size = [], 0
        if held:
            yield _batch(held, kinds)

    # One file to a task as far as the cluster has room: file names are few and short.
    spread = files.select("file").repartition(max(1, _parallelism(files.sparkSession)), "file")
    return spread.mapInArrow(run, RECORDS)


def _parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def _batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=kinds)


def read_bytes(data: bytes) -> list[Record]:
    """All records of an archive held in memory, for small ones."""
    return list(records(io.BytesIO(data)))
