"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames. A frame holds whole records, ``frame_bytes`` of them or one longer
record. The last frame is a skippable one: the seek table of the public seekable format (compressed and full size of
every frame, their number, and a magic number), so any Zstandard tool unpacks a bundle, and a reader finds every frame
from the last bytes. A table beside the bundles maps record identifiers to bundle, frame, place of the frame in the
file, and place of the record in the frame: one record costs one frame.

Records: of rows with equal payloads (by SHA-1) of at least ``least_revisit`` bytes, those of the smallest number are
response records, the others revisit records that name the response and keep the HTTP head. Writing needs two passes:
digests and the smallest number of each payload that occurs twice; then every task writes the rows it has. Payloads
are shuffled only where the table of repeated payloads is too large to broadcast, which Spark decides by bytes.

Lost executors: a task writes bundles under names of its own, and the index names only those of tasks that succeeded;
what a lost attempt leaves isn't in the index and isn't read. Bundles lie in a shared folder that ``pyarrow.fs`` can
open on the executors.

Null html is an empty payload. A null url leaves the target URI out; control characters in a url are percent-encoded. A null
number comes after all others: it refers to the numbered response of its payload, or is a response if there is none.
Repeated rows of the smallest number are all responses. An empty table gives an index without rows. Columns other than
page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallscope.llm.common import give_back
from stallscope.session import Staging

# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FOOTER = 9
READ_BYTES = 32 << 20  # of frames in a reading task
READ_BYTES = 32 << 20  # of frames in a reading task

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id string, page_id long, bundle string, frame int, frame_start long, frame_bytes long, record_start long, record_bytes long"
RECORD = "record_id string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long"


@dataclass(frozen=True)
class Bundle:
    frame_bytes: int = 1 << 20  # of records in a frame, before compression
    bundle_bytes: int = 256 << 20  # of a file, after compression
    level: int = 3
    least_revisit: int = 0  # bytes of a payload that may be revisited
    date: str = "2020-01-01T00:00:00Z"  # of every record; pages carry no time


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: int | None, of: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{of}>"


def _number(name: str) -> int | None:
    number = name.split(":")[2]
    return int(number) if number else None


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x1F\x7F]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, bundle: Bundle) -> tuple[str, bytes]:
    """Identifier and bytes of a record; a revisit of the page ``first``, if there is one."""
    of = digest(payload)
    name = record_name(page_id, of)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if first is not None else head + payload
    fields = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", name), ("WARC-Date", bundle.date)]
    if url is not None:
        fields.append(("WARC-Target-URI", _uri(url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{of}"))
    if first is not None:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_name(first, of))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return name, "".join(["WARC/1.1\r\n", *[f"{k}: {v}\r\n" for k, v in fields], "\r\n"]).encode() + block + b"\r\n\r\n"


@dataclass(frozen=True)
class Parsed:
    fields: dict[str, str]
    http: dict[str, str]
    payload: bytes

    def row(self) -> tuple:
        """What ``RECORD`` names. A response's payload must agree with its digest and length."""
        name, kind = self.fields["warc-record-id"], self.fields["warc-type"]
        of, n = self.fields["warc-payload-digest"].removeprefix("sha1:"), int(self.http["content-length"])
        if kind == "response" and (digest(self.payload) != of or len(self.payload) != n):
            raise ValueError(f"the payload of {name} isn't the one that was written")
        first = self.fields.get("warc-refers-to")
        return name, _number(name), self.fields.get("warc-target-uri"), kind, of, n, first and _number(first)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}


def parse(data: bytes, start: int = 0) -> Iterator[tuple[int, int, Parsed]]:
    """Start, length and content of the records in a frame, from ``start`` on."""
    while start < len(data):
        body = data.index(b"\r\n\r\n", start) + 4
        fields = _fields(data[start : body - 4])
        end = body + int(fields["content-length"])
        http = data.index(b"\r\n\r\n", body) + 4
        yield start, end + 4 - start, Parsed(fields, _fields(data[body : http - 4]), data[http:end])
        start = end + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame that ends a bundle, from compressed and full size of each frame."""
    entries = b"".join(struct.pack("<II", *f) for f in frames)
    return struct.pack("<II", SKIPPABLE, len(entries) + FOOTER) + entries + struct.pack("<IBI", len(frames), 0, SEEKABLE)


def read_seek_table(source: pa.NativeFile) -> list[tuple[int, int, int]]:
    """Start, compressed and full size of every frame, from the end of a bundle."""
    size = source.size()
    source.seek(size - FOOTER)
    n, _, magic = struct.unpack("<IBI", source.read(FOOTER))
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    source.seek(size - FOOTER - 8 * n)
    entries, out, at = struct.iter_unpack("<II", source.read(8 * n)), [], 0
    for packed, full in entries:
        out.append((at, packed, full))
        at += packed
    return out


class _Writer:
    """The bundles of one task."""

    def __init__(self, folder: str, bundle: Bundle) -> None:
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.bundle, self.press = bundle, zstandard.ZstdCompressor(level=bundle.level, write_content_size=True, write_checksum=True)
        self.out: pa.NativeFile | None = None
        self.records: list[bytes] = []
        self.names: list[tuple] = []
        self.waiting = 0

    def add(self, page_id: int | None, url: str | None, payload: bytes, first: int | None) -> list[tuple]:
        name, data = record(page_id, url, payload, first, self.bundle)
        done = self.frame() if self.records and self.waiting + len(data) > self.bundle.frame_bytes else []
        self.names.append((name, page_id, self.waiting, len(data)))
        self.records.append(data)
        self.waiting += len(data)
        return done

    def frame(self) -> list[tuple]:
        """Write what waits as a frame; its rows of the index."""
        if not self.records:
            return []
        if self.out is None:
            self.name, self.frames, self.at = f"{uuid.uuid4().hex}.warc.zst", [], 0
            self.out = self.store.open_output_stream(f"{self.folder}/{self.name}", compression=None)  # else the name decides
        packed = self.press.compress(b"".join(self.records))
        self.out.write(packed)
        rows = [(name, page_id, self.name, len(self.frames), self.at, len(packed), start, size) for name, page_id, start, size in self.names]
        self.frames.append((len(packed), self.waiting))
        self.at += len(packed)
        self.records, self.names, self.waiting = [], [], 0
        if self.at >= self.bundle.bundle_bytes:
            self.close()
        return rows

    def close(self) -> None:
        if self.out is not None:
            self.out.write(seek_table(self.frames))
            self.out.close()
            self.out = None


def _arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def write_bundles(pages: DataFrame, staging: Staging, bundle: Bundle = Bundle()) -> DataFrame:
    """Write the bundles; the index (``INDEX``), a row for each record, as a staged table."""
    folder = f"{staging.root}/bundles"
    held = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    often = held.where(F.octet_length("html") >= bundle.least_revisit).groupBy("sha1").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first"))
    often = staging.write("often", often.where("n > 1 and first is not null").select("sha1", "first"))
    first = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = held.join(often, "sha1", "left").select("page_id", "url", "html", first.alias("first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer(folder, bundle)
        out.store.create_dir(out.folder, recursive=True)
        for batch in batches:
            done: list[tuple] = []
            for page_id, url, html, of in zip(*[batch.column(c) for c in ("page_id", "url", "html", "first")], strict=True):
                done += out.add(page_id.as_py(), url.as_py(), html.as_buffer().to_pybytes(), of.as_py())
            yield _arrow(done, INDEX)
        yield _arrow(out.frame(), INDEX)
        out.close()
        give_back()

    return staging.write("index", rows.mapInArrow(write, INDEX))


def _open(folder: str, store: dict, name: str) -> pa.NativeFile:
    if "fs" not in store:
        store["fs"], store["folder"] = fs.FileSystem.from_uri(folder)
    return store["fs"].open_input_file(f"{store['folder']}/{name}")


def frames(bundles: DataFrame, folder: str) -> DataFrame:
    """bundle, frame, frame_start, frame_bytes of every frame of the files in ``bundles`` (bundle), from their seek tables."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store: dict = {}
        for batch in batches:
            for name in batch.column("bundle").to_pylist():
                with _open(folder, store, name) as source:
                    found = [(name, k, start, packed) for k, (start, packed, _) in enumerate(read_seek_table(source))]
                yield _arrow(found, "bundle string, frame int, frame_start long, frame_bytes long")

    return bundles.select("bundle").mapInArrow(find, "bundle string, frame int, frame_start long, frame_bytes long")


def _frame(source: pa.NativeFile, start: int, size: int) -> bytes:
    source.seek(start)
    return zstandard.ZstdDecompressor().decompress(source.read(size))


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of frames, dealt by frame to tasks of about ``READ_BYTES``. The number of parts is given, since a row says little
    about the bytes that it leads to."""
    size = rows.select("bundle", "frame_start", "frame_bytes").distinct().agg(F.sum("frame_bytes")).first()[0] or 0
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // READ_BYTES))
    return rows.repartition(parts, "bundle", "frame_start").sortWithinPartitions("bundle", "frame_start")


def read_records(found: DataFrame, folder: str) -> DataFrame:
    """The records (``RECORD``) of the frames in ``found`` (bundle, frame_start, frame_bytes)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store: dict = {}
        for batch in batches:
            for name, start, size in zip(*[batch.column(c).to_pylist() for c in ("bundle", "frame_start", "frame_bytes")], strict=True):
                with _open(folder, store, name) as source:
                    yield _arrow([r.row() for _, _, r in parse(_frame(source, start, size))], RECORD)
        give_back()

    return _dealt(found.select("bundle", "frame_start", "frame_bytes")).mapInArrow(read, RECORD)


def fetch(index: DataFrame, folder: str) -> DataFrame:
    """record_id, page_id, url, html of the rows of the index: one read of each frame that holds any of them. A revisit gets null
    html; its payload is the record's it refers to. The rows of the index are read twice."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store: dict = {}
        held: tuple = ()
        data = b""
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if held != (r["bundle"], r["frame_start"]):
                    held = (r["bundle"], r["frame_start"])
                    with _open(folder, store, r["bundle"]) as source:
                        data = _frame(source, r["frame_start"], r["frame_bytes"])
                _, _, found = next(parse(data[: r["record_start"] + r["record_bytes"]], r["record_start"]))
                name, page_id, url, kind, *_ = found.row()
                rows.append((name, page_id, url, found.payload.decode() if kind == "response" else None))
            yield _arrow(rows, "record_id string, page_id long, url string, html string")

    return _dealt(index).mapInArrow(read, "record_id string, page_id long, url string, html string")


def archive(pages: DataFrame, bundle: Bundle = Bundle()) -> tuple[DataFrame, DataFrame, str]:
    """Write ``pages`` and read them back: the index, the records (from the bundles alone), and the folder."""
    staging = Staging(pages.sparkSession, "warc")
    index = write_bundles(pages, staging, bundle)
    folder = f"{staging.root}/bundles"
    found = staging.write("frames", frames(index.select("bundle").distinct(), folder))
    return index, read_records(found, folder), folder
