"""WARC records in seekable Zstandard bundles: written by tasks, mapped to frames, read back."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import shared_folder

FRAME_BYTES = 1 << 18  #: record bytes after which a frame is closed
BUNDLE_BYTES = 1 << 26  #: record bytes after which a bundle is closed
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # fixed values of the Zstandard seekable format
_PAGE = "<urn:page:{}>"


def revisits(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): refers_to names the page with the same payload and the largest id.

    Payloads under `min_payload` bytes refer to none. Groups are found by digest and counted in the map
    tasks; the join may split a payload that a third of the pages share.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    keepers = (
        rows.where(F.length("payload") >= min_payload)
        .groupBy("digest").agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("n")).where("n > 1")
        .select(F.encode("digest", "utf-8").alias("key"), "newest")
    )
    # another form of the digest as key: both sides are dealt out anew and a hot digest can be split
    return rows.withColumn("key", F.encode("digest", "utf-8")).join(keepers, "key", "left").select(
        "page_id", "url", "payload",
        F.when(~F.col("page_id").eqNullSafe(F.col("newest")), F.col("newest")).alias("refers_to"),
    )


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit holds the HTTP header alone."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: {_PAGE.format('' if page_id is None else page_id)}",
        f"WARC-Target-URI: {target}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_PAGE.format(refers_to)}",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Bundle:
    """Independent frames and a seek table. add() says where a record lies: frame, offset in it, length."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self._sink, self._limit, self._zstd = sink, frame_bytes, zstandard.ZstdCompressor(level=3)
        self._open, self._size, self._table, self.written = [], 0, [], 0

    def add(self, data: bytes) -> tuple[int, int, int]:
        if self._size and self._size + len(data) > self._limit:
            self._close_frame()
        place = (len(self._table), self._size, len(data))
        self._open.append(data)
        self._size += len(data)
        self.written += len(data)
        return place

    def _close_frame(self) -> None:
        frame = self._zstd.compress(b"".join(self._open))
        self._sink.write(frame)
        self._table.append((len(frame), self._size))
        self._open, self._size = [], 0

    def close(self) -> None:
        if self._open:
            self._close_frame()
        entries = b"".join(struct.pack("<II", *x) for x in self._table)
        footer = struct.pack("<IBI", len(self._table), 0, SEEKABLE)
        self._sink.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self._sink.close()


def seek_table(source) -> list[tuple[int, int, int]]:
    """(offset, compressed bytes, bytes) of each frame, from the end of a bundle."""
    end = source.size()
    source.seek(end - 9)
    count, _, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    source.seek(end - 9 - 8 * count)
    entries, frames, at = source.read(8 * count), [], 0
    for packed, size in struct.iter_unpack("<II", entries):
        frames.append((at, packed, size))
        at += packed
    return frames


def read_frame(source, frame: tuple[int, int, int]) -> bytes:
    import zstandard

    source.seek(frame[0])
    return zstandard.ZstdDecompressor().decompress(source.read(frame[1]), max_output_size=frame[2])


def read_record(uri: str, frame: int, offset: int, length: int) -> bytes:
    """One record through the seek table: its frame alone is read."""
    from pyarrow.fs import FileSystem

    fs, path = FileSystem.from_uri(uri)
    with fs.open_input_file(path) as source:
        return read_frame(source, seek_table(source)[frame])[offset:offset + length]


def write_bundles(pages: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write a record per row of revisits(); the written index (bundle, page_id, frame, offset, length) is returned.

    A bundle's name is new for each attempt of a task, and the index lists those of the attempts that Spark
    committed, so a task that runs again or twice leaves no record twice. Rows stream: a task holds one frame.
    """
    schema = "bundle string, page_id long, frame int, offset long, length long"

    def run(batches):
        import pyarrow as pa
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        bundle = name = None
        for batch in batches:
            index = []
            for page_id, url, payload, refers_to in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "payload", "refers_to"))):
                if bundle is None or bundle.written >= bundle_bytes:
                    if bundle is not None:
                        bundle.close()
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    bundle = Bundle(fs.open_output_stream(f"{root}/{name}", compression=None), frame_bytes)
                index.append((f"{folder}/{name}", page_id, *bundle.add(record(page_id, url, payload, refers_to))))
            if index:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*index), (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
                    names=["bundle", "page_id", "frame", "offset", "length"],
                )
        if bundle is not None:
            bundle.close()

    index = f"{folder}/index"
    pages.mapInArrow(run, schema).write.parquet(index)
    return pages.sparkSession.read.schema(schema).parquet(index)


def parse(data: bytes):
    """(headers, block) of each record in the bytes of a frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        headers = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:] if ": " in line)
        size = int(headers["Content-Length"])
        yield headers, data[end + 4:end + 4 + size]
        at = end + 4 + size + 4


def _page(name: str) -> int | None:
    number = name[len("<urn:page:"):-1]
    return int(number) if number else None


def read_bundles(index: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of all records in the indexed bundles.

    A response's payload is held against its digest; a revisit has a null payload.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"

    def run(batches):
        import pyarrow as pa
        from pyarrow.fs import FileSystem

        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        for batch in batches:
            for uri in batch["bundle"].to_pylist():
                fs, path = FileSystem.from_uri(uri)
                with fs.open_input_file(path) as source:
                    for frame in seek_table(source):
                        rows = []
                        for headers, block in parse(read_frame(source, frame)):
                            http, payload = block.split(b"\r\n\r\n", 1)
                            size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                            digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                            if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                                raise ValueError(f"payload of {headers['WARC-Record-ID']} differs from its digest")
                            refers_to = _page(headers["WARC-Refers-To"]) if kind == "revisit" else None
                            rows.append((_page(headers["WARC-Record-ID"]), size, digest, kind, refers_to, payload if kind == "response" else None))
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

    bundles = index.select("bundle").distinct()
    # a name is a few bytes and stands for a whole bundle: a partition for each, which Spark doesn't merge by size
    return bundles.repartition(max(1, bundles.count()), "bundle").mapInArrow(run, schema)


def archive(pages: DataFrame, folder: str | None = None, min_payload: int = 0) -> DataFrame:
    """Write all rows of `pages` as records below `folder` and read them back; see read_bundles().

    Null html is an empty payload and a null url an empty target. Equal payloads with equal largest ids
    are all responses; a null id refers to the largest id of its group, and is a response if all are null.
    Other columns are ignored; an empty table gives no bundle and no rows.
    """
    folder = folder or shared_folder(pages.sparkSession)
    return read_bundles(write_bundles(revisits(pages, min_payload), folder))
