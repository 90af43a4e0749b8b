"""WARC archives: one gzip member a record, written and read back as streams.

Files go to the shared folder through pyarrow's file systems under a name of their own for each
attempt, and are moved to their final name when complete; the manifest says which files count.
The reader inflates incrementally, follows Content-Length and checks every payload digest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_as_bytes, materialize, new_path

MIN_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
READ_BYTES = 1 << 16
#: Payload bytes after which a task starts a new archive file.
FILE_BYTES = 256 << 20


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """Any store that pyarrow knows; a path without a scheme is local."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _one_line(value: object) -> str:
    return "".join(c if c.isprintable() and c not in "\r\n" else f"%{ord(c):02X}" for c in str(value))


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, digest: str) -> bytes:
    """One record as a gzip member. A revisit holds the HTTP head only; its digest and length are of the full payload."""
    block = HTTP_HEAD if revisit else HTTP_HEAD + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {_one_line(url)}"] if url else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"WARC-Block-Digest: {_sha1(block)}",
        f"WARC-Payload-Digest: {digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{'none' if refers_to is None else refers_to}>"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return packer.compress(raw) + packer.flush()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]


def read_records(stream) -> Iterator[Record]:
    """Sequential reader: holds one record and one input block; raises ValueError on a broken frame or digest."""
    pending = b""
    while True:
        if not pending:
            pending = stream.read(READ_BYTES)
            if not pending:
                return
        unpack, got, head, need = zlib.decompressobj(31), bytearray(), None, None
        while not unpack.eof:
            if not pending:
                pending = stream.read(READ_BYTES)
                if not pending:
                    raise ValueError("the archive ends inside a record")
            got += unpack.decompress(pending)
            pending = unpack.unused_data if unpack.eof else b""
            if head is None and (end := got.find(b"\r\n\r\n")) >= 0:
                lines = got[:end].decode().split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError("not a WARC record")
                head = dict(x.split(": ", 1) for x in lines[1:])
                need = end + 4 + int(head["Content-Length"])
            if need is not None and len(got) > need + 4:
                raise ValueError("the record is longer than its Content-Length")
        if need is None or len(got) != need + 4 or bytes(got[need:]) != b"\r\n\r\n":
            raise ValueError("the record does not end where its Content-Length says")
        block = bytes(got[need - int(head["Content-Length"]) : need])
        record = Record(head, block)
        if head["WARC-Block-Digest"] != _sha1(block):
            raise ValueError("block digest differs")
        if head["WARC-Type"] == "response" and head["WARC-Payload-Digest"] != _sha1(record.payload):
            raise ValueError("payload digest differs")
        yield record


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_fs(folder)
        store.create_dir(base, recursive=True)
        out = name = None
        count = size = 0
        done: list[tuple[str, int, int]] = []

        def close():
            out.close()
            store.move(f"{base}/{name}.part", f"{base}/{name}")
            done.append((f"{folder}/{name}", count, size))

        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "refers_to", "revisit")), columns_as_bytes(batch, "html"))
            for page, url, refers, revisit, payload in rows:
                if out is None or size >= FILE_BYTES:
                    if out is not None:
                        close()
                    name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{name}.part", compression=None)
                out.write(record_bytes(page, url, payload, refers, revisit, _sha1(payload)))
                count, size = count + 1, size + len(payload)
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "payload_bytes"])

    return run


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Writes every row as a record; returns the manifest (path, records, payload_bytes), already stored.

    Of records with equal payloads of at least min_revisit bytes, that with the largest id is the
    response and the others revisit it; shorter ones are all responses. A null payload is empty.
    Rows that repeat the largest id are all responses. An empty table gives an empty manifest.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("html"))
    long = rows.where(F.octet_length("html") >= min_revisit).select("page_id", F.unhex(F.sha2("html", 256)).alias("digest"))
    long = materialize(long, "payloads")
    groups = long.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = long.join(groups, "digest").where("not page_id <=> refers_to").select(F.col("page_id").alias("own"), F.col("digest").alias("of"), "refers_to").distinct()
    revisits = materialize(revisits, "revisits")
    # Ids may repeat with other payloads: id and digest together name a revisit. Shorter payloads have no digest.
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= min_revisit, F.unhex(F.sha2("html", 256))))
    joined = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("of")), "left")
    told = joined.select("page_id", "url", "html", "refers_to", F.col("refers_to").isNotNull().alias("revisit"))
    return materialize(told.mapInArrow(_writer(folder), "path string, records long, payload_bytes long"), "manifest")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())

    def page(urn: str | None) -> int | None:
        value = urn and urn.strip("<>").rpartition(":")[2]
        return None if not value or value == "none" else int(value)

    for batch in batches:
        for path in batch.column("path").to_pylist():
            store, where = open_fs(path)
            rows, held = [], 0
            with store.open_input_stream(where, compression=None) as stream:
                for r in read_records(stream):
                    h, revisit = r.headers, r.headers["WARC-Type"] == "revisit"
                    if not revisit and int(h["X-Payload-Length"]) != len(r.payload):
                        raise ValueError("payload length differs")
                    digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    rows.append((page(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), int(h["X-Payload-Length"]), digest, h["WARC-Type"], page(h.get("WARC-Refers-To")), None if revisit else r.payload))
                    held += len(r.payload)
                    if held > 8 << 20 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def read_warc(manifest: DataFrame) -> DataFrame:
    """Every record of the manifest's archives; payload is null for revisits, as are refers_to and url where absent."""
    files = manifest.select("path").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism), "path")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return files.mapInArrow(_reader, schema)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    folder = new_path(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, folder))
