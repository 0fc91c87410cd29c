"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding whole WARC
records, and a seek table in a skippable frame at its end (the public seekable
format: 8 bytes a frame, frame count, descriptor, magic number). An index maps
each record to its bundle, frame and place inside the frame, so one record is
read by one range of the file and one frame's decompression.

Records with equal payloads of at least ``REVISIT_BYTES`` are written once: that
with the smallest id is the response, the others are revisits that refer to it.
The digest column comes from the JVM, the smallest id from a partial aggregate
over digests, and the join back is on the digest, where Spark splits hot keys.

Bundles go to the shared folder through pyarrow's file systems, under a name
that only a finished bundle gets: a task that is run again writes the same
records to a name of its own, and the manifest lists only what the successful
task wrote.

Defined results: a null page has an empty payload. Equal rows with one id are
all responses. A null id sorts after all others and is kept. An empty table
makes no bundle. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .scratch import Scratch

REVISIT_BYTES = 100
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 26
LEVEL = 3
FRAMES_A_TASK = 64
# The seekable format's magic numbers.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_SEEK_ENTRY, _SEEK_FOOTER = struct.Struct("<II"), struct.Struct("<IBI")


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder that the driver has qualified with its scheme."""
    path = re.sub(r"^s3[an]://", "s3://", path)
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def record(page_id, url: str | None, payload: bytes, digest: str, kind: str, refers_to, length: int) -> bytes:
    """One WARC/1.1 record with an HTTP block."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = head + payload if kind == "response" else head
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    clean = " ".join((url or "").split())
    if clean:
        lines.append(f"WARC-Target-URI: {clean}")
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {length}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, HTTP payload and end of the record that starts at ``at``."""
    stop = data.index(b"\r\n\r\n", at)
    first, *rest = data[at:stop].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no record starts here")
    headers = dict(line.split(": ", 1) for line in rest)
    begin = stop + 4
    end = begin + int(headers["Content-Length"])
    block = data[begin:end]
    if len(block) != end - begin or data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("a record is cut off")
    return headers, block[block.index(b"\r\n\r\n") + 4 :], end + 4


class BundleWriter:
    """One file of frames; ``index`` gets (record key, frame, offset, size)."""

    def __init__(self, folder: str):
        self.fs, base = _open(folder)
        self.fs.create_dir(base, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.path, self.temporary = f"{folder}/{self.name}", f"{base}/.{self.name}.part"
        self.final = f"{base}/{self.name}"
        self.out = self.fs.open_output_stream(self.temporary)
        self.frames: list[tuple[int, int]] = []
        self.index: list[tuple] = []
        self.buffer, self.filled, self.size = [], 0, 0

    def add(self, key, data: bytes):
        self.index.append((key, len(self.frames), self.filled, len(data)))
        self.buffer.append(data)
        self.filled += len(data)
        if self.filled >= FRAME_BYTES:
            self._frame()

    def _frame(self):
        if self.buffer:
            raw = b"".join(self.buffer)
            packed = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True).compress(raw)
            self.out.write(packed)
            self.frames.append((len(packed), len(raw)))
            self.size += len(packed)
            self.buffer, self.filled = [], 0

    def close(self):
        self._frame()
        table = b"".join(_SEEK_ENTRY.pack(*f) for f in self.frames) + _SEEK_FOOTER.pack(len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        self.fs.move(self.temporary, self.final)


class BundleReader:
    def __init__(self, path: str):
        self.fs, self.place = _open(path)
        self.file = self.fs.open_input_file(self.place)
        size = self.file.size()
        count, _, magic = _SEEK_FOOTER.unpack(self.file.read_at(_SEEK_FOOTER.size, size - _SEEK_FOOTER.size))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        table = self.file.read_at(8 * count, size - _SEEK_FOOTER.size - 8 * count)
        self.frames, at = [], 0
        for packed, raw in _SEEK_ENTRY.iter_unpack(table):
            self.frames.append((at, packed, raw))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, raw = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=raw)

    def record(self, frame: int, offset: int):
        """One record, by its index entry."""
        return parse_record(self.frame(frame), offset)

    def close(self):
        self.file.close()


def with_types(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_digest, payload_bytes, refers_to (null for a response)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    first = p.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "first_id")
    return p.join(first, "payload_digest", "left").select(
        "page_id", "url", "html", "payload_digest", "payload_bytes", F.when(F.coalesce(F.col("page_id") != F.col("first_id"), F.col("first_id").isNotNull()), F.col("first_id")).alias("refers_to")
    )


def write_archives(pages: DataFrame, folder: str, scratch: Scratch) -> DataFrame:
    """Writes every page; returns the index (page_id, bundle, frame, offset, size)."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        writer, done = None, []

        def finish():
            writer.close()
            keys, frames, offsets, sizes = zip(*writer.index)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, key_type), pa.array([writer.path] * len(keys), pa.string()), pa.array(frames, pa.int32()), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64())],
                names=["page_id", "bundle", "frame", "offset", "size"],
            )

        for batch in batches:
            key_type = batch.schema.field(0).type
            for i in range(0, batch.num_rows, 256):
                for page_id, url, page, digest, size, refers in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns)):
                    if writer is None:
                        writer = BundleWriter(folder)
                    revisit = refers is not None
                    data = record(page_id, url, b"" if revisit else (page or "").encode(), digest, "revisit" if revisit else "response", refers, size)
                    writer.add(page_id, data)
                    if writer.size >= BUNDLE_BYTES:
                        yield finish()
                        writer = None
        if writer is not None:
            yield finish()

    index = with_types(pages).mapInArrow(run, f"page_id {kind}, bundle string, frame int, offset long, size long")
    return scratch.keep(index, "index")


def read_archives(index: DataFrame, id_type: str) -> DataFrame:
    """Every record of the bundles in the index, read frame by frame."""

    def run(batches):
        for batch in batches:
            reader, path = None, None
            for bundle, frame in zip(*(c.to_pylist() for c in batch.columns)):
                if bundle != path:
                    if reader:
                        reader.close()
                    reader, path = BundleReader(bundle), bundle
                data, at, rows = reader.frame(frame), 0, []
                while at < len(data):
                    headers, payload, at = parse_record(data, at)
                    revisit = headers["WARC-Type"] == "revisit"
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    size = int(headers["X-Payload-Length"])
                    if not revisit and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                        raise ValueError("a payload differs from its digest")
                    key, refers = (headers.get(h, "<urn:page:>")[len("<urn:page:") : -1] for h in ("WARC-Record-ID", "WARC-Refers-To"))
                    rows.append((key or None, size, digest, headers["WARC-Type"], refers or None, headers.get("WARC-Target-URI"), payload.decode() if not revisit else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])
            if reader:
                reader.close()

    # frames are few bytes in this table but much work: a count of partitions of
    # its own, or adaptive execution would read them all in one task
    frames = index.select("bundle", "frame").distinct()
    frames = frames.repartition(max(1, -(-frames.count() // FRAMES_A_TASK)), "bundle", "frame").sortWithinPartitions("bundle", "frame")
    out = frames.mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, payload string")
    return out.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def op4(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every
    page, as read back from the archives that it writes."""
    scratch = Scratch(spark, "warc")
    index = write_archives(pages, f"{scratch.root}/bundles", scratch)
    read = read_archives(index, pages.schema["page_id"].dataType.simpleString())
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
