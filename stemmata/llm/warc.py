"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding a group of
whole WARC records, then two skippable frames: the record index (record id,
frame, offset in the frame's content, length) and the seek table of the public
seekable format (sizes of every frame, number of frames, magic number).  A
reader that knows the file's length finds the seek table from the end, and
fetches one record by decompressing one frame.

Records with equal payloads are written once: the smallest page_id holds it as a
``response``, others ``revisit`` it.  Digests are taken by Spark; only digests
that occur twice or more are joined back.  While these are few they are
broadcast.  Beyond that a bitmap of ``FILTER_BITS`` hashed places, of one size at
any scale, tells pages whose digest surely occurs once: these are written where
they stand, and only the others are shuffled by digest.

Tasks write to names of their own in the shared folder and report them as rows;
the rows are kept before they are used, so a task that runs again leaves at
worst a file that no row names.

Defined cases: null html is an empty payload; null urls are written as empty;
equal (page_id, payload) rows are all responses if theirs is the smallest id; a
null page_id never is the smallest unless all are null, in which case all are
responses; an empty table writes no bundle; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemmata.llm.shared import BROADCAST_ROWS, cut, new_folder, small_batches

FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 64 << 20
#: Places of the bitmap, 2 ** 27: 16 MB.
FILTER_BITS = 1 << 27
#: Fixed values of the public seekable format: magic numbers of a skippable frame and of the seek table's footer.
SKIPPABLE, INDEX, SEEK_FOOTER = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
_DATE = "1970-01-01T00:00:00Z"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has no payload but its digest, its length and the record it refers to."""
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers of a record, and its payload (empty for a revisit)."""
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


class BundleWriter:
    """Writes one bundle; ``add`` records, then ``close``."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES):
        self.out, self.frame_bytes = out, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=3)
        self.buffer, self.size, self.written = [], 0, 0
        self.frames: list[tuple[int, int]] = []
        self.index: list[tuple[int | None, int, int, int]] = []

    def add(self, page_id: int | None, record: bytes) -> None:
        self.index.append((page_id, len(self.frames), self.size, len(record)))
        self.buffer.append(record)
        self.size += len(record)
        if self.size >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.buffer:
            packed = self.packer.compress(b"".join(self.buffer))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.written += len(packed)
            self.buffer, self.size = [], 0

    def close(self) -> None:
        self._flush()
        index = self.packer.compress(json.dumps(self.index).encode())
        self.out.write(struct.pack("<II", INDEX, len(index)) + index)
        self.frames.append((len(index) + 8, 0))
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEK_FOOTER)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class BundleReader:
    """Random access to a bundle through its footer."""

    def __init__(self, uri: str):
        fs, path = FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        end = self.file.size()
        n, _, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEK_FOOTER:
            raise ValueError(f"{uri} has no seek table")
        sizes = list(struct.iter_unpack("<II", self._at(end - 9 - 8 * n, 8 * n)))
        self.frames, at = [], 0
        for packed, plain in sizes:
            self.frames.append((at, packed, plain))
            at += packed
        start, packed, _ = self.frames.pop()
        self.index = json.loads(zstandard.decompress(self._at(start + 8, packed - 8)))

    def _at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def frame(self, k: int) -> bytes:
        start, packed, plain = self.frames[k]
        return zstandard.decompress(self._at(start, packed), max_output_size=plain)

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        """All records, each frame decompressed once."""
        held, content = -1, b""
        for _, k, offset, size in self.index:
            if k != held:
                held, content = k, self.frame(k)
            yield parse_record(content[offset : offset + size])

    def record(self, page_id: int) -> tuple[dict[str, str], bytes]:
        """One record by its id, from one frame."""
        _, k, offset, size = next(x for x in self.index if x[0] == page_id)
        return parse_record(self.frame(k)[offset : offset + size])

    def close(self) -> None:
        self.file.close()


def _write(folder: str, frame_bytes: int, bundle_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        writer, name, done = None, "", []

        def finish():
            writer.close()
            done.append((f"{folder}/{name}", len(writer.index)))

        for batch in batches:
            for page_id, url, html, sha1, first, revisit in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(fs.open_output_stream(f"{path}/{name}", compression=None), frame_bytes)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                writer.add(page_id, record_bytes(page_id, url, html, digest, first, revisit))
                if writer.written >= bundle_bytes:
                    finish()
                    writer = None
        if writer is not None:
            finish()
        yield pa.record_batch({"bundle": pa.array([b for b, _ in done], pa.string()), "records": pa.array([n for _, n in done], pa.int64())})

    return run


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as bundles below ``folder``; returns bundle (its URI) and records (their number).

    ``folder`` is a URI of a store that executors share (file:, hdfs:, s3:, gs:);
    by default one is made in the folder that spark.checkpoint.dir names.
    Payloads of fewer than ``min_bytes`` bytes are never written as revisits.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or new_folder(spark, "warc")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("html")).withColumn("sha1", F.sha1("html"))
    shared = rows.filter(F.length("html") >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").drop("n")
    shared = cut(shared)
    if shared.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(shared), "sha1", "left")
    else:
        once, maybe = _sifted(rows, shared)
        joined = once.withColumn("first", F.lit(None).cast("long")).unionByName(maybe.join(shared, "sha1", "left"))
    first = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    out = joined.select("page_id", "url", "html", "sha1", first.alias("refers"), (F.col("first").isNotNull() & first.isNotNull()).alias("revisit"))
    return cut(out.mapInArrow(_write(folder, frame_bytes, bundle_bytes), "bundle string, records bigint"))


def _sifted(rows: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose digest is surely not in ``shared``, and the others, by a bitmap of fixed size."""
    place = F.pmod(F.xxhash64("sha1"), F.lit(FILTER_BITS))
    held = shared.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    held = F.broadcast(cut(held))
    here = F.bitmap_bit_position(place)
    byte = F.ascii(F.decode(F.substring("bits", (here / 8).cast("int") + 1, F.lit(1)), "ISO-8859-1"))
    tested = rows.join(held, F.bitmap_bucket_number(place) == F.col("bucket"), "left")
    tested = tested.withColumn("maybe", F.coalesce(_bit(byte, here), F.lit(False))).drop("bucket", "bits")
    return tested.filter(~F.col("maybe")).drop("maybe"), tested.filter("maybe").drop("maybe")


def _bit(byte: Column, here: Column) -> Column:
    """Whether the bit of place ``here`` is set in its byte."""
    return F.floor(byte / F.pow(F.lit(2), here % 8)) % 2 == 1


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = lambda urn: int(x) if (x := urn[len("<urn:page:") : -1]) else None
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            reader = BundleReader(uri)
            rows = []
            for headers, payload in reader.records():
                revisit = headers["WARC-Type"] == "revisit"
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if not revisit and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"a payload in {uri} does not match its digest")
                size = int(headers["X-Payload-Length"]) if revisit else len(payload)
                rows.append((number(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], size, digest, headers["WARC-Type"], number(headers["WARC-Refers-To"]) if revisit else None))
            reader.close()
            kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


def read_archives(bundles: DataFrame) -> DataFrame:
    """One row per record of the ``bundles``: page_id, url, payload_bytes, payload_digest, record_type and refers_to."""
    n = max(1, min(bundles.count(), 4 * bundles.sparkSession.sparkContext.defaultParallelism))
    small_batches(bundles.sparkSession)
    return bundles.select("bundle").repartition(n).mapInArrow(_read, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
