"""WARC archives: writing them as one gzip stream, and normalising such streams.

A crawler's archive is often one gzip stream over the whole file, in which no record can be
reached by itself. The normaliser inflates the stream once, writes every record as a gzip
member of its own and puts the members' offsets into a sidecar index, so that any record
can be read with one seek. Archives are files in a folder that all executors share; a file's
name is used by one attempt of a task only, and only names that a finished task reported are
read, so lost executors and repeated tasks leave no half archives behind.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import save
from gradeloom.session import scratch_path

MIN_REVISIT_BYTES = 1000
ARCHIVE_BYTES = 1 << 30  # a task begins another archive beyond this many bytes of records
DATE = "1970-01-01T00:00:00Z"
CHUNK = 1 << 20
GZIP = 31  # zlib's window setting for the gzip format

# Words of the WARC format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}')}>"


def _digest(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_bytes(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
    revisit: bool,
) -> bytes:
    """One record. A revisit holds the HTTP head, with the payload's length, but no payload."""
    head = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = head if revisit else head + payload
    lines = [
        VERSION.decode(),
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: {_digest(digest)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        safe = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)
        lines.append(f"WARC-Target-URI: {safe}")
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if revisit:
        lines += [
            f"WARC-Profile: {PROFILE}",
            f"WARC-Refers-To: {_record_id(refers_to)}",
            f"Refers-To-Page-ID: {refers_to}",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_duplicates(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Add ``payload, digest, refers_to, revisit``.

    Of equal payloads of at least ``min_bytes`` the page with the largest id is the response.
    Only digests that occur again form the table that the pages are joined with.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    pages = pages.select("page_id", "url", payload.alias("payload")).withColumn(
        "digest", F.sha1("payload")
    )
    copies = (
        pages.where(F.octet_length("payload") >= min_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 AND first IS NOT NULL")
        .drop("n")
    )
    other = ~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull()
    return pages.join(save(copies, "warc-copies"), "digest", "left").select(
        "page_id", "url", "payload", "digest",
        F.when(other, F.col("first")).alias("refers_to"),
        other.alias("revisit"),
    )


def write_monolithic(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write each partition as archives of one gzip stream each: ``archive, n_records``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        done: list[tuple[str, int]] = []
        sink, packer, size, n, name = None, None, 0, 0, ""

        def finish() -> None:
            nonlocal sink
            if sink is not None:
                sink.write(packer.flush())
                sink.close()
                done.append((name, n))
                sink = None

        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(6))):
                page_id, url, payload, digest, refers_to, revisit = (x.as_py() for x in row)
                if sink is None:
                    name, size, n = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink = store.open_output_stream(name, compression=None)
                    packer = zlib.compressobj(1, zlib.DEFLATED, GZIP)
                record = record_bytes(page_id, url, payload, digest, refers_to, revisit)
                sink.write(packer.compress(record))
                size, n = size + len(record), n + 1
                if size >= archive_bytes:
                    finish()
        finish()
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in done], pa.string()), pa.array([x for _, x in done], pa.int64())],
            ["archive", "n_records"],
        )

    return save(records.mapInArrow(run, "archive string, n_records bigint"), "warc-archives")


class _Stream:
    """Reads an inflated gzip file, of one member or many, piece by piece."""

    def __init__(self, source):
        self.source, self.unpack = source, zlib.decompressobj(GZIP)
        self.held, self.at = b"", 0

    def more(self) -> bool:
        while True:
            if self.unpack.eof:
                raw, self.unpack = self.unpack.unused_data, zlib.decompressobj(GZIP)
            else:
                raw = b""
            raw = raw or self.source.read(CHUNK)
            if not raw:
                return False
            got = self.unpack.decompress(raw)
            if got:
                self.held, self.at = self.held[self.at :] + got, 0
                return True

    def head(self) -> bytes | None:
        """Up to and with the next empty line; None at the end of the file."""
        while True:
            end = self.held.find(b"\r\n\r\n", self.at)
            if end >= 0:
                out, self.at = self.held[self.at : end + 4], end + 4
                return out
            if not self.more():
                if self.held[self.at :].strip():
                    raise ValueError("the archive ends inside a record's head")
                return None

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if self.at == len(self.held) and not self.more():
                raise ValueError("the archive ends inside a record")
            out = self.held[self.at : self.at + n]
            self.at += len(out)
            n -= len(out)
            yield out


def fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        key, colon, value = line.partition(":")
        if colon:
            out[key.strip().lower()] = value.strip()
    return out


def normalise_archive(source, sink) -> Iterator[tuple[int, int]]:
    """Copy a WARC stream with one gzip member per record; offset and length of each."""
    stream, at = _Stream(source), 0
    while (head := stream.head()) is not None:
        packer = zlib.compressobj(6, zlib.DEFLATED, GZIP)
        parts = stream.take(int(fields(head)["content-length"]) + 4)
        size = 0
        for packed in chain((packer.compress(x) for x in chain([head], parts)), map(packer.flush, [zlib.Z_FINISH])):
            sink.write(packed)
            size += len(packed)
        yield at, size
        at += size


def _per_file(archives: DataFrame, column: str) -> DataFrame:
    """One archive per task, as far as there are tasks."""
    n = max(1, archives.count())
    return archives.select(column).repartition(min(n, 10_000), column)


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """``archive, index, n_records`` of the rewritten archives. The sidecar index has one line
    ``offset length`` per record, in file order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                name = f"{root}/{uuid.uuid4().hex}.warc.gz"
                with store.open_input_stream(path, compression=None) as source, \
                        store.open_output_stream(name, compression=None) as sink, \
                        store.open_output_stream(name + ".idx", compression=None) as index:
                    n = 0
                    for at, size in normalise_archive(source, sink):
                        index.write(f"{at} {size}\n".encode())
                        n += 1
                out.append((name, name + ".idx", n))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(x), t) for x, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64()))],
                ["archive", "index", "n_records"],
            )

    done = _per_file(archives, "archive").mapInArrow(run, "archive string, index string, n_records bigint")
    return save(done, "warc-normal")


def read_member(packed: bytes) -> tuple:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to`` of one member.
    A response's digest is made anew from its payload and must equal the one it states."""
    data = zlib.decompress(packed, GZIP)
    head, _, block = data.partition(b"\r\n\r\n")
    f = fields(head + b"\r\n")
    block = block[: int(f["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex()
    length = int(fields(http + b"\r\n")["content-length"])
    if f["warc-type"] == "response":
        found = hashlib.sha1(payload).hexdigest()
        if found != stated or length != len(payload):
            raise ValueError(f"record {f['warc-record-id']} is damaged")
    number: Callable = lambda k: int(f[k]) if k in f else None
    return (
        number("page-id"), f.get("warc-target-uri"), length, stated, f["warc-type"],
        number("refers-to-page-id"),
    )


RECORDS = (
    "page_id bigint, url string, payload_bytes bigint, payload_digest string, "
    "record_type string, refers_to bigint"
)


def read_records(normal: DataFrame, folder: str) -> DataFrame:
    """All records of normalised archives, each read by its offset in the sidecar index."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def rows(got: list[tuple]) -> pa.RecordBatch:
        columns = zip(*got) if got else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(path + ".idx", compression=None) as f:
                    index = f.read().decode().split("\n")[:-1]
                got = []
                with store.open_input_file(path) as archive:
                    for line in index:
                        at, size = map(int, line.split())
                        archive.seek(at)
                        got.append(read_member(archive.read(size)))
                        if len(got) == 10_000:
                            yield rows(got)
                            got = []
                yield rows(got)

    return _per_file(normal, "archive").mapInArrow(run, RECORDS)


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as archives, normalise them, read them back.

    One row per page: ``page_id, url, payload_bytes, payload_digest, record_type,
    refers_to``. A null html is an empty payload; a null url has no target; control
    characters and spaces of a url are percent-encoded in the archive. Rows that share the
    largest page_id of their payload are all responses. A page without an id revisits the
    one with the largest id, and is a response if no page of its payload has one. Repeated
    rows are records of their own; other columns are not read; no pages give no archive.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    raw = write_monolithic(with_duplicates(pages), f"{folder}/raw")
    return read_records(normalise(raw, f"{folder}/normal"), f"{folder}/normal")


SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(strlen(html), 0)::BIGINT AS n, sha1(coalesce(html, '')) AS d
  FROM pages
), m AS (SELECT d, max(page_id) AS first FROM p WHERE n >= {MIN_REVISIT_BYTES} GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit'
    ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN m ON p.d = m.d
"""
