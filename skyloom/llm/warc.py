"""WARC bundles in seekable Zstandard: independent frames, a footer seek table, and an index into the frames.

Writing takes two passes. The first digests every payload and keeps, for digests that occur more than
once, the smallest id: partial aggregation keeps a hot payload to one row a task. The second joins that
small table to the pages (broadcast when its size is checked to be small, else a shuffled join whose
skewed partitions Spark splits) and writes bundles, one row a bundle, as binary columns of a Parquet
table in the shared folder: a lost executor's bundles are written anew by Spark's commit protocol.

A bundle is a run of frames. A frame is an independent Zstandard frame of whole records; the seek table
at the end, a skippable frame, has each frame's compressed and decompressed size. The index gives each
record its bundle, frame and offset within the decompressed frame, so one record costs one frame.

Edge cases: a null or empty html is a record with an empty payload, and all of them share a digest. Rows
that repeat an id with an equal payload are responses if the id is the smallest of their payload, else
revisits. A null id is ignored when the smallest is sought; when a payload has null ids only, its rows
are responses. Very long pages get a frame of their own. An empty table writes an empty archive. Columns
other than id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_small, staged

#: Fixed values of the seekable Zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

BUNDLE_SCHEMA = "bundle string, n_records long, archive binary, index array<struct<record_id:string,frame:int,offset:long,length:long>>"
RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


@dataclass(frozen=True)
class Layout:
    #: A frame is closed once it holds so many bytes, a bundle once it has so many compressed bytes.
    frame_bytes: int = 256 << 10
    bundle_bytes: int = 16 << 20
    level: int = 3
    #: Payloads shorter than this are always responses.
    revisit_bytes: int = 0


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: the HTTP header block, and for a response the payload after it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = "" if page_id is None else str(page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = http if refers_to is not None else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


class BundleWriter:
    """Gathers records into frames; ``finish`` gives the archive and its index."""

    def __init__(self, layout: Layout):
        self.layout, self.zstd = layout, zstandard.ZstdCompressor(level=layout.level, write_checksum=True)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open = bytearray()
        self.index: list[dict] = []

    def add(self, record_id: str, data: bytes) -> None:
        if self.open and len(self.open) + len(data) > self.layout.frame_bytes:
            self.close()
        self.index.append({"record_id": record_id, "frame": len(self.frames), "offset": len(self.open), "length": len(data)})
        self.open += data

    def close(self) -> None:
        if self.open:
            self.frames.append(self.zstd.compress(bytes(self.open)))
            self.sizes.append((len(self.frames[-1]), len(self.open)))
            self.open = bytearray()

    @property
    def full(self) -> bool:
        return sum(c for c, _ in self.sizes) >= self.layout.bundle_bytes

    def finish(self) -> tuple[bytes, list[dict]]:
        self.close()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        table = struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer
        return b"".join(self.frames) + table, self.index


def seek_table(archive: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of each frame, from the footer alone."""
    n, flags, magic = struct.unpack("<IBI", archive[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    at, start, found = len(archive) - 9 - n * width, 0, []
    for i in range(n):
        packed, size = struct.unpack_from("<II", archive, at + i * width)
        found.append((start, packed, size))
        start += packed
    return found


def read_frame(archive: bytes, frame: tuple[int, int, int]) -> bytes:
    start, packed, size = frame
    return zstandard.ZstdDecompressor().decompress(archive[start : start + packed], max_output_size=size)


def read_record(archive: bytes, frame: int, offset: int, length: int) -> bytes:
    """One record by its place in the index; only its frame is decompressed."""
    return read_frame(archive, seek_table(archive)[frame])[offset : offset + length]


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record that starts at ``at``, checked against its own digest, and where the next one starts."""
    end = data.index(b"\r\n\r\n", at)
    head = dict(x.split(": ", 1) for x in data[at:end].decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = data[end + 4 : end + 4 + int(head["Content-Length"])]
    cut = block.index(b"\r\n\r\n") + 4
    http = dict(x.split(": ", 1) for x in block[: cut - 4].decode().split("\r\n")[1:])
    bare = head["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
    if head["WARC-Type"] == "response" and digest(block[cut:]) != bare:
        raise ValueError(f"{head['WARC-Record-ID']}: the payload does not match its digest")
    return {
        "page_id": number(head["WARC-Record-ID"]),
        "url": head["WARC-Target-URI"],
        "payload_bytes": int(http["Content-Length"]),
        "payload_digest": bare,
        "record_type": head["WARC-Type"],
        "refers_to": number(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None,
        "payload": block[cut:],
    }, end + 4 + int(head["Content-Length"]) + 4


def repeated_payloads(pages: DataFrame) -> DataFrame:
    """(raw_digest, first_id) of payloads that occur more than once."""
    return (
        pages.select("page_id", F.unhex(F.sha1(F.coalesce("html", F.lit("")).cast("binary"))).alias("raw_digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size"))
        .groupBy("raw_digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"), F.max("size").alias("size"))
        .where("n > 1")
        .drop("n")
    )


def write_bundles(pages: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """The archive as a staged table of bundles, BUNDLE_SCHEMA."""
    pages = pages.select("page_id", "url", "html")
    firsts = staged(repeated_payloads(pages).where(F.col("size") >= layout.revisit_bytes).select("raw_digest", "first_id"), "warc-firsts")
    source = join_small(pages.withColumn("raw_digest", F.unhex(F.sha1(F.coalesce("html", F.lit("")).cast("binary")))), firsts, ["raw_digest"], "left", 96)
    source = source.select("page_id", "url", "html", "first_id")

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        task = TaskContext.get()
        made = 0
        writer = BundleWriter(layout)

        def bundle():
            archive, index = writer.finish()
            row = {"bundle": f"part-{task.partitionId():05d}-{made:05d}.warc.zst", "n_records": len(index), "archive": archive, "index": index}
            return pa.RecordBatch.from_pylist([row], schema)

        schema = pa.schema([("bundle", pa.string()), ("n_records", pa.int64()), ("archive", pa.binary()), ("index", pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])))])
        for batch in batches:
            for page_id, url, html, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (html or "").encode("utf-8", "surrogatepass")
                refers_to = None if first is None or first == page_id else first
                writer.add("" if page_id is None else str(page_id), record(page_id, url, payload, digest(payload), refers_to))
                if writer.full:
                    yield bundle()
                    made, writer = made + 1, BundleWriter(layout)
        if writer.index:
            yield bundle()

    return staged(source.mapInArrow(run, BUNDLE_SCHEMA), "warc-bundles")


def read_bundles(bundles: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record of the archives, RECORD_SCHEMA, with the payload bytes (null for revisits) on demand."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    schema = pa.schema(list(zip(names, kinds, strict=False)))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for archive in batch.column(0):
                archive = archive.as_py()
                for frame in seek_table(archive):
                    data, at, rows = read_frame(archive, frame), 0, []
                    while at < len(data):
                        row, at = parse(data, at)
                        if payloads and row["record_type"] == "revisit":
                            row["payload"] = None
                        rows.append({n: row[n] for n in names})
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return bundles.select("archive").mapInArrow(run, RECORD_SCHEMA + ", payload binary" * payloads)
