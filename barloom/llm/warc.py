"""WARC archives in seekable Zstandard bundles.

Every task packs its records into bundles.  A bundle is a row of independent
Zstandard frames, each holding whole WARC records, followed by a seek table in
a skippable frame (the public seekable format: compressed and decompressed
size of every frame, number of frames, magic number).  The index maps each
record id to its bundle, frame, offset inside the decompressed frame and
length, so one record costs one seek and one small frame.

Records with an equal payload are stored once: the one with the largest id is
a response, the others are revisit records that refer to it.

Bundles are written through ``pyarrow.fs`` to the shared folder under names of
their own for every task attempt; the index, a Parquet table that Spark
commits, names only bundles of attempts that succeeded.  So lost executors and
repeated tasks leave at most files that nothing refers to.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import Any

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.llm.common import narrow, new_folder, written

#: Fixed values of the seekable format: magic number of its skippable frame, and of the footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Payloads below this are always stored.
REVISIT_BYTES = 1000
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 64 << 20
LEVEL = 3
#: Bytes of records that one task reads back.
READ_BYTES = 64 << 20
#: Pages come without the head of their response; a record gets this one.
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

INDEX = "page_id long, record_id string, bundle string, frame int, frame_offset long, record_bytes long, record_type string"
READ = "page_id long, record_id string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None, digest: str) -> str:
    """URN of a record, the same in every run; records of null ids are told apart by payload."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest if page_id is None else ""}')}"


def pack_record(row: dict[str, Any], date: str) -> bytes:
    """One WARC/1.1 record.

    Its block is an HTTP response whose body is the payload; a revisit's has
    the head alone, its payload being that of the record it refers to.
    """
    revisit = row["record_type"] == "revisit"
    payload = HTTP_HEAD + (b"" if revisit else row["payload"])
    head = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}", f"WARC-Payload-Length: {row['payload_bytes']}",
    ]
    if row["page_id"] is not None:
        head.append(f"WARC-Page-ID: {row['page_id']}")
    if row["url"] is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else "%%%02X" % ord(c) for c in row["url"]))
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{record_id(row['refers_to'], '')}>", f"WARC-Refers-To-Page-ID: {row['refers_to']}",
        ]
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def info_record(name: str, date: str) -> bytes:
    """The record that opens a bundle: what wrote it and in which format."""
    body = b"software: barloom\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {date}",
            f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Head fields and payload of a record; of an HTTP response, its body."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("no WARC record begins here")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("record length and Content-Length differ")
    block = rest[:size]
    return fields, block.partition(b"\r\n\r\n")[2] if fields.get("Content-Type", "").startswith("application/http") else block


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """Skippable frame with (compressed, decompressed) sizes and the footer."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(f: Any, size: int) -> list[tuple[int, int]]:
    """(start, compressed size) of every frame of an open bundle of ``size`` bytes."""
    f.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    f.seek(size - 9 - 8 * n)
    table, starts, at = f.read(8 * n), [], 0
    for packed, _ in struct.iter_unpack("<II", table):
        starts.append((at, packed))
        at += packed
    return starts


class BundleWriter:
    """Packs records into frames and frames into bundles of bounded size below ``folder``."""

    def __init__(self, folder: str, date: str) -> None:
        self.store, self.base = fs.FileSystem.from_uri(folder)
        self.date, self.opening = date, b""
        self.out, self.frames, self.records, self.held = None, [], [], 0
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)

    def add(self, row: dict[str, Any]) -> Iterator[tuple]:
        data = pack_record(row, self.date)
        self.records.append((row, data))
        self.held += len(data)
        if self.held >= FRAME_BYTES:
            yield from self.frame()

    def frame(self) -> Iterator[tuple]:
        if not self.records:
            return
        if self.out is None:
            self.name = f"bundle-{uuid.uuid4().hex}.warc.zst"
            self.store.create_dir(self.base, recursive=True)
            self.out, self.frames, self.size = self.store.open_output_stream(f"{self.base}/{self.name}", compression=None), [], 0
            self.opening = info_record(self.name, self.date)
        raw = self.opening + b"".join(d for _, d in self.records)
        packed = self.packer.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw)))
        self.size += len(packed)
        at, self.opening = len(self.opening), b""
        for row, data in self.records:
            yield row["page_id"], row["record_id"], self.name, len(self.frames) - 1, at, len(data), row["record_type"]
            at += len(data)
        self.records, self.held = [], 0
        if self.size >= BUNDLE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.write(seek_table(self.frames))
            self.out.close()
            self.out = None


def write_bundles(records: DataFrame, folder: str) -> DataFrame:
    """Write ``records`` (page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) and return their index, lazily."""
    schema, date = records.schema.names, datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter(folder, date)
        for batch in batches:
            found: list[tuple] = []
            columns = [batch.column(schema.index(c)) for c in schema]
            for i in range(batch.num_rows):
                row = {c: v[i].as_py() for c, v in zip(schema, columns)}
                row["record_id"] = record_id(row["page_id"], row["payload_digest"])
                found += writer.add(row)
            yield _index_batch(found)
        yield _index_batch([*writer.frame()])
        writer.close()

    return records.mapInArrow(run, INDEX)


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    names = [c.split(" ")[0] for c in INDEX.split(", ")]
    cols = list(zip(*rows)) or [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Read every record of the index back from its bundle; payload length and digest are computed anew for stored payloads."""
    # Tasks follow the bytes they will read, not those of the index.
    size = index.agg(F.sum("record_bytes")).first()[0] or 0
    frames = index.repartition(max(1, -(-size // READ_BYTES), min(64, -(-size // FRAME_BYTES))), "bundle", "frame").groupBy("bundle", "frame").agg(F.collect_list(F.struct("page_id", "frame_offset", "record_bytes")).alias("records"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        unpack, opened = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            found: list[tuple] = []
            for bundle, frame, records in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if bundle not in opened:
                    for old, _ in opened.values():
                        old.close()
                    opened.clear()
                    f = store.open_input_file(f"{base}/{bundle}")
                    opened[bundle] = f, read_seek_table(f, f.size())
                f, starts = opened[bundle]
                f.seek(starts[frame][0])
                raw = unpack.decompress(f.read(starts[frame][1]))
                for r in records:
                    head, payload = parse_record(raw[r["frame_offset"] : r["frame_offset"] + r["record_bytes"]])
                    name, revisit = head["WARC-Record-ID"].strip("<>"), head["WARC-Type"] == "revisit"
                    page = int(head["WARC-Page-ID"]) if "WARC-Page-ID" in head else None
                    if page != r["page_id"]:
                        raise ValueError(f"the index leads to a record of page {page} instead of {r['page_id']}")
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"damaged payload in {name}")
                    size = int(head["WARC-Payload-Length"]) if revisit else len(payload)
                    found.append((page, name, size, digest, head["WARC-Type"], int(head["WARC-Refers-To-Page-ID"]) if revisit else None))
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            cols = list(zip(*found)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[c.split(" ")[0] for c in READ.split(", ")])
        for old, _ in opened.values():
            old.close()

    return frames.mapInArrow(run, READ)


def archive(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> tuple[str, DataFrame]:
    """Write one record per row; returns the folder and the committed index.

    A null payload counts as empty.  Of equal payloads of at least
    ``REVISIT_BYTES`` bytes the row with the largest id is the response; if
    that row is repeated, every repetition is a response, and rows without an
    id are responses unless another equal payload has one.  Smaller payloads
    are always responses.  An empty table gives an empty index.  Further
    columns are dropped.
    """
    own = narrow(pages, **{id_col: "long", url_col: "string", payload_col: "string"}).toDF("page_id", "url", "html")
    own = own.withColumn("payload", F.coalesce(F.encode("html", "utf-8"), F.lit(b""))).drop("html")
    own = own.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    large = F.col("payload_bytes") >= REVISIT_BYTES
    # Only digests that occur again are joined; each brings the id its copies refer to.
    again = own.where(large).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    again = again.where("n > 1").drop("n")
    joined = own.join(again, ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    records = joined.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("last")).alias("refers_to"),
    )
    folder = folder or new_folder(pages.sparkSession, "warc")
    return folder, written(write_bundles(records, folder), "warc-index")


def read_record(spark: SparkSession, index: DataFrame, folder: str, name: str) -> DataFrame:
    """The record of one id: one row of the index, one seek, one frame."""
    return read_records(index.where(F.col("record_id") == name), folder)
