"""WARC archives compressed with Zstandard, one frame for each record.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the
dictionary for all frames after it; the reader takes a dictionary that is itself
compressed as well. Each task writes one archive to the shared
folder and reports it in a manifest; only archives of tasks that ended well are
in the manifest, so a lost executor leaves at most an orphan file. The reader
streams an archive, decodes frame by frame and validates every record.

Defined results: a null html is an empty payload; a null url becomes an empty
target; control characters and spaces in a url are percent-encoded in the header;
a null page_id is allowed, gets no page header and never answers for another
page; rows that repeat the largest page_id of a group are all responses, and the one
with the greatest url is referred to; a record's id is made of page_id, url and
payload digest, so that only rows equal in all three share one; a very long html is
one record, held whole by the task that writes or reads it; an empty table gives an
empty manifest and no records. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import releasing, scratch_path, small_batches, staged

SKIPPABLE = 0x184D2A5D
ZSTD_FRAME = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 1000
DICT_BYTES = 32_768
#: Of an archive, so many bytes of payloads at most train its dictionary; at most as many are held before the first is written.
SAMPLE_BYTES = 2_000_000
SAMPLE_PIECE = 4_096
READ_BYTES = 65_536
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, records long, bytes long"
RECORDS = (
    "page_id long, record_type string, target_uri string, record_id string, refers_to long, "
    "payload_digest string, payload_bytes long, payload binary"
)


def plan_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, response_id, response_url): the page and url that a record revisits, null for responses."""
    base = small_batches(pages).select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url"), F.lit("")).alias("url"),
        F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumns({"digest": F.sha1("payload"), "key": F.sha2("payload", 256)})
    long_enough = F.octet_length("payload") >= REVISIT_BYTES
    copies = base.where(long_enough).groupBy("key").agg(F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("r"), F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("copy_key"), F.col("r.page_id").alias("response_id"), F.col("r.url").alias("response_url"))
    joined = base.join(copies, (base.key == F.col("copy_key")) & long_enough, "left")
    revisits = F.coalesce(F.col("page_id") < F.col("response_id"), F.col("response_id").isNotNull())
    return joined.select("page_id", "url", "payload", "digest", F.when(revisits, F.col("response_id")).alias("response_id"), F.when(revisits, F.col("response_url")).alias("response_url"))


def _uri(url: str) -> bytes:
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url.encode("utf-8", "replace"))


def record_id(page_id: int | None, url: str, digest: str) -> bytes:
    place = hashlib.sha1(f"{url}\n{digest}".encode("utf-8", "replace")).hexdigest()[:24]
    return f"<urn:page:{'none' if page_id is None else page_id}:{place}>".encode()


def record_bytes(page_id: int | None, url: str, payload: bytes, digest: str, response_id: int | None = None, response_url: str = "", date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC record. A revisit keeps the HTTP header, with the full payload's length, and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if response_id is None else http
    lines = [
        VERSION,
        b"WARC-Type: " + (b"response" if response_id is None else b"revisit"),
        b"WARC-Record-ID: " + record_id(page_id, url, digest),
        b"WARC-Date: " + date.encode(),
        b"WARC-Target-URI: " + _uri(url),
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
        b"WARC-Block-Digest: sha1:" + hashlib.sha1(block).hexdigest().encode(),
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % len(block),
    ]
    if page_id is not None:
        lines.append(b"X-Page-ID: %d" % page_id)
    if response_id is not None:
        lines += [b"WARC-Refers-To: " + record_id(response_id, response_url, digest), b"WARC-Profile: " + PROFILE.encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of a record; ValueError if a header or a length is not as it must be."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not gap or first != VERSION:
        raise ValueError("not a WARC/1.1 record")
    h: dict[str, str] = {}
    for x in lines:
        name, colon, value = x.partition(b":")
        if not colon:
            raise ValueError(f"header line without a colon: {x[:80]!r}")
        h[name.decode("ascii").lower()] = value.strip().decode("utf-8", "replace")
    for name in ("warc-type", "warc-record-id", "warc-date", "warc-payload-digest", "warc-block-digest", "content-length"):
        if name not in h:
            raise ValueError(f"record without {name}")
    if h["warc-type"] not in ("response", "revisit"):
        raise ValueError(f"unknown record type {h['warc-type']}")
    n = int(h["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(rest) - 4} bytes; the header says {n}")
    block = rest[:n]
    if h["warc-block-digest"] != "sha1:" + hashlib.sha1(block).hexdigest():
        raise ValueError("block digest differs")
    http, gap, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"\r\nContent-Length: (\d+)", http)
    if not gap or not length:
        raise ValueError("block without an HTTP header and length")
    digest = h["warc-payload-digest"].removeprefix("sha1:")
    revisit = h["warc-type"] == "revisit"
    if revisit:
        m = re.fullmatch(r"<urn:page:(-?\d+):[0-9a-f]+>", h.get("warc-refers-to", ""))
        if not m or payload:
            raise ValueError("revisit without a reference, or with a payload")
        refers = int(m[1])
    else:
        refers = None
        if len(payload) != int(length[1]) or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError("payload differs from its length or digest")
    return {
        "page_id": int(h["x-page-id"]) if "x-page-id" in h else None,
        "record_type": h["warc-type"],
        "target_uri": h.get("warc-target-uri", ""),
        "record_id": h["warc-record-id"],
        "refers_to": refers,
        "payload_digest": digest,
        "payload_bytes": int(length[1]),
        "payload": None if revisit else payload,
    }


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of the samples: trained if they are many enough, else their own bytes."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICT_BYTES]


class ArchiveWriter:
    """Writes records to a file object. The first SAMPLE_BYTES are held until the dictionary is made."""

    def __init__(self, out: BinaryIO, level: int = 3):
        self.out, self.level, self.held, self.held_bytes, self.packer, self.written = out, level, [], 0, None, 0

    def add(self, record: bytes) -> None:
        if self.packer:
            self._frame(record)
            return
        self.held.append(record)
        self.held_bytes += len(record)
        if self.held_bytes >= SAMPLE_BYTES:
            self._begin()

    def _begin(self) -> None:
        import zstandard

        words = train_dictionary([r[:SAMPLE_PIECE] for r in self.held])
        self._put(struct.pack("<II", SKIPPABLE, len(words)) + words)
        self.packer = zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(words) if words else None, write_checksum=True)
        for r in self.held:
            self._frame(r)
        self.held = []

    def _frame(self, record: bytes) -> None:
        self._put(self.packer.compress(record))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def close(self) -> None:
        if not self.packer:
            self._begin()


def read_archive(src: BinaryIO) -> Iterator[dict]:
    """Records of an archive, in order. Holds one record and one buffer at a time."""
    import zstandard

    head = _exactly(src, 8)
    magic, n = struct.unpack("<II", head)
    if magic != SKIPPABLE:
        raise ValueError("archive without a leading dictionary frame")
    words = _exactly(src, n)
    if words[:4] == ZSTD_FRAME:
        words = zstandard.ZstdDecompressor().stream_reader(words).read()
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    data = src.read(READ_BYTES)
    while data:
        frame, parts = unpack.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data or src.read(READ_BYTES)
                break
            data = src.read(READ_BYTES)
            if not data:
                raise ValueError("archive ends within a frame")
        yield parse_record(b"".join(parts))


def _exactly(src: BinaryIO, n: int) -> bytes:
    data = src.read(n)
    if len(data) != n:
        raise ValueError("archive ends within its dictionary frame")
    return bytes(data)


def write_warc(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes pages (page_id, url, html) to archives in a folder that driver and executors share, by default one beside
    the staged tables; the manifest (path, records, bytes)."""
    folder = folder.rstrip("/") if folder else scratch_path(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        writer = out = None
        n = 0
        for b in batches:
            for page_id, url, payload, digest, response_id, response_url in zip(*(b.column(i) for i in range(6)), strict=True):
                if writer is None:
                    store, root = fs.FileSystem.from_uri(folder)
                    store.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    out = store.open_output_stream(f"{root}/{name}", compression=None)  # not by the name's ending
                    writer = ArchiveWriter(out)
                writer.add(record_bytes(*(x.as_py() for x in (page_id, url, payload, digest, response_id, response_url))))
                n += 1
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [os.path.join(folder, name)], "records": pa.array([n], pa.int64()), "bytes": pa.array([writer.written], pa.int64())})

    # A row for each task: one file holds them.
    manifest, _ = staged(plan_records(pages).mapInArrow(releasing(write), MANIFEST).repartition(1), "warc-manifest")
    return manifest


def read_warc(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of all archives of a manifest. With payloads=False the payload column is null
    (payloads are read and validated all the same)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()), ("record_id", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        for b in batches:
            for path in b.column(0).to_pylist():
                store, root = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_stream(root, compression=None) as src:
                    for r in read_archive(src):
                        held += len(r["payload"] or b"") if payloads else 64
                        rows.append(r if payloads else r | {"payload": None})
                        if held > 4_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    spark = manifest.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return manifest.select("path").repartition(n).mapInArrow(releasing(read), RECORDS)
