"""WARC archives: a writer of one gzip member per record, and a sequential reader.

The reader holds one compressed chunk and one record: members are inflated incrementally, the
payload is cut out by Content-Length, and its SHA-256 is compared with the record's digest. Both
sides open files by pyarrow's file systems, so the folder may be local, HDFS or an object store.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import IO, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logspark.llm.common import prepare, scratch_path, stored

#: Payloads below this many bytes are never replaced by a revisit.
MIN_REVISIT = 100
CHUNK = 1 << 16
_HEAD_END = b"\r\n\r\n"


class Record(NamedTuple):
    headers: dict[str, str]
    payload: bytes


class DamagedRecord(ValueError):
    """A record whose framing or digest is wrong."""


def encode_record(kind: str, uri: str, record_id: str, digest: str, payload: bytes, more: dict[str, str]) -> bytes:
    """One record as one gzip member."""
    head = {
        "WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "text/html", **more, "Content-Length": str(len(payload)),
    }
    lines = ["WARC/1.1", *(f"{k}: {_one_line(v)}" for k, v in head.items())]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    raw = "\r\n".join(lines).encode("utf-8", "surrogatepass") + _HEAD_END
    return packer.compress(raw) + packer.compress(payload) + packer.compress(_HEAD_END) + packer.flush()


def _one_line(value: str) -> str:
    return value.replace("\r", " ").replace("\n", " ")


def read_records(stream: IO[bytes], chunk: int = CHUNK) -> Iterator[Record]:
    """The records of an archive, one gzip member each, in order."""
    rest = b""
    while True:
        rest = rest or stream.read(chunk)
        if not rest:
            return
        unpack, plain = zlib.decompressobj(31), bytearray()
        while not unpack.eof:
            if not rest:
                rest = stream.read(chunk)
                if not rest:
                    raise DamagedRecord("the archive ends within a record")
            plain += unpack.decompress(rest)
            rest = unpack.unused_data
        yield parse_record(bytes(plain))


def parse_record(plain: bytes) -> Record:
    head, found, body = plain.partition(_HEAD_END)
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not found or not first.startswith("WARC/"):
        raise DamagedRecord("no record head")
    headers = dict(line.split(": ", 1) for line in lines)
    size = int(headers["Content-Length"])
    payload = body[:size]
    if len(payload) != size or body[size:] != _HEAD_END:
        raise DamagedRecord("the payload isn't as long as its head says")
    if headers["WARC-Type"] == "response" and f"sha256:{hashlib.sha256(payload).hexdigest()}" != headers["WARC-Payload-Digest"]:
        raise DamagedRecord("the payload's digest differs")
    return Record(headers, payload)


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _write(folder: str):
    schema = pa.schema([("file", pa.string()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        name, n, out = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            for page, uri, html, digest, size, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or store.open_output_stream(name)
                more = {"X-Payload-Bytes": str(size)} | ({"X-Page-Id": str(page)} if page is not None else {})
                if to is not None:
                    more |= {"WARC-Refers-To": f"<urn:page:{to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
                payload = b"" if to is not None else (html or "").encode("utf-8", "surrogatepass")
                out.write(encode_record("revisit" if to is not None else "response", uri or "", f"<urn:uuid:{uuid.uuid4()}>", digest, payload, more))
                n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], schema=schema)

    return run


def write_archives(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Writes one archive per task into ``folder`` and returns (file, records).

    Of records with equal payloads of at least ``min_revisit`` bytes, that with the smallest
    page_id is a response and the others revisit it. Only files named in the returned table
    count: a task that ran twice leaves a file that the table doesn't name.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html",
        F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("size"),
    )
    firsts = rows.filter(F.col("size") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = stored(firsts.filter("n > 1").select("digest", "first"), "firsts")
    to = F.when(F.col("page_id") != F.col("first"), F.col("first"))
    marked = rows.join(firsts, "digest", "left").select("page_id", "url", F.when(to.isNull(), F.col("html")).alias("html"), "digest", "size", to.alias("to"))
    return stored(marked.mapInArrow(_write(folder), "file string, records long"), "archives")


def _read(with_payload: bool):
    names = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema(names + [("payload", pa.binary())] * with_payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                store, path = _open(file)
                rows, held = [], 0
                with store.open_input_stream(path) as stream:
                    for r in read_records(stream):
                        h = r.headers
                        to, page = h.get("WARC-Refers-To"), h.get("X-Page-Id")
                        row = (
                            None if page is None else int(page), h["WARC-Target-URI"], int(h["X-Payload-Bytes"]) if to else len(r.payload), h["WARC-Payload-Digest"].removeprefix("sha256:"),
                            h["WARC-Type"], int(to[len("<urn:page:") : -1]) if to else None,
                        )
                        rows.append((*row, r.payload) if with_payload else row)
                        held += len(r.payload) if with_payload else 100
                        if held > 8_000_000:
                            yield _batch(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of the archives named in column ``file``; one task reads whole files, in order.

    A record that is cut off or whose digest is wrong raises ``DamagedRecord``.
    """
    n = max(1, archives.count())
    kind = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return archives.select("file").repartition(n).mapInArrow(_read(with_payload), kind)


def warc_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) and reads them back, a row per page.

    Null and empty html are records of no bytes. Of equal payloads the smallest page_id stays the
    response; rows that repeat that page_id are responses too. A null page_id is written without
    a number and read back as null; it revisits another page where payloads are equal only if it
    has a number to compare, so it stays a response. Other columns aren't read. No rows give no
    archives and no rows.
    """
    spark = prepare(pages.sparkSession)
    return read_archives(write_archives(pages, folder or scratch_path(spark, "warc")))
