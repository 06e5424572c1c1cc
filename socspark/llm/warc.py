"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames that are compressed each for itself; a skippable
frame at the end of a bundle lists the sizes of all frames, as in the public
seekable format, and an index maps each record to its bundle, frame and offset
in the frame. Bundles are written by the tasks into a folder that all executors
share, under names that differ between attempts; the index, which Spark commits,
names those that count.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import shared_path, stored

SEEK_TABLE_MAGIC = 0x184D2A5E  # a skippable frame
SEEKABLE_MAGIC = 0x8F92EAB1
LEAST_DEDUP_BYTES = 100
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id, url: str | None, payload: bytes, digest: str, size: int, refers_to, date: str) -> bytes:
    """One WARC/1.1 record. A revisit, which has ``refers_to``, holds the HTTP header alone."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    block = http if revisit else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_record(data: bytes, offset: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(fields, payload, offset of the next record); HTTP's own length is the field ``Payload-Length``."""
    end = data.index(b"\r\n\r\n", offset)
    lines = data[offset:end].decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at {offset}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    after = end + 4 + int(fields["Content-Length"])
    block = data[end + 4 : after]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["Payload-Length"] = next(x.split(b": ")[1] for x in http.split(b"\r\n") if x.startswith(b"Content-Length")).decode()
    return fields, payload, after + 4


class BundleWriter:
    """Writes frames and, on close, the seek table."""

    def __init__(self, path: str, level: int = 3):
        import zstandard

        self.path, self.sizes, self.written = path, [], 0
        fs, inner = pafs.FileSystem.from_uri(path)
        fs.create_dir(inner.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(inner, compression=None)  # the name alone would have it compressed again
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)

    def frame(self, data: bytes) -> int:
        """Number of the frame that now holds ``data``."""
        packed = self.compressor.compress(data)
        self.out.write(packed)
        self.sizes.append((len(packed), len(data)))
        self.written += len(packed)
        return len(self.sizes) - 1

    def close(self) -> None:
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SEEK_TABLE_MAGIC, len(table)) + table)
        self.out.close()


class BundleReader:
    """Reads single frames of a bundle by its seek table."""

    def __init__(self, path: str):
        import zstandard

        fs, inner = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(inner)
        size = self.file.size()
        count, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{path} has no seek table")
        entries = list(struct.iter_unpack("<II", self._at(size - 9 - 8 * count, 8 * count)))
        self.frames, at = [], 0
        for packed, plain in entries:
            self.frames.append((at, packed, plain))
            at += packed
        self.decompressor = zstandard.ZstdDecompressor()

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.frames[number]
        return self.decompressor.decompress(self._at(at, packed), max_output_size=plain)


def read_record(path: str, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its place, as the index has it."""
    fields, payload, _ = parse_record(BundleReader(path).frame(frame), offset)
    return fields, payload


def with_revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", broadcast_rows: int = 200_000) -> DataFrame:
    """``pages`` with ``_digest``, ``_size`` and ``_first``, the smallest id of rows with an equal payload.

    Only payloads that occur twice or more are looked up. Their table is
    broadcast when a count shows it to be small; beyond that it is joined by
    its key, and adaptive execution splits a hot payload.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    pages = pages.withColumns({"_digest": F.sha2(payload.cast("binary"), 256), "_size": F.octet_length(payload).cast("long")})
    copies = pages.where(F.col("_size") >= LEAST_DEDUP_BYTES).groupBy("_digest").agg(F.min(id_col).alias("_first"), F.count(F.lit(1)).alias("_n"))
    copies = stored(copies.where(F.col("_n") > 1).drop("_n"), "payload-copies")
    return pages.join(F.broadcast(copies) if copies.count() <= broadcast_rows else copies, "_digest", "left")


def write_archive(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    frame_bytes: int = 1 << 18,
    bundle_bytes: int = 1 << 27,
    date: str = "2000-01-01T00:00:00Z",
) -> DataFrame:
    """Writes a record per row of ``pages`` and returns the index: (page id, bundle, frame, offset).

    Of rows with equal payloads of LEAST_DEDUP_BYTES or more, that with the
    smallest id is a response and the others are revisits of it; rows that
    share that id are all responses. A null html is an empty payload, a null
    url leaves the field out, and a null id an empty name. Memory holds one
    frame, or one longer record.
    """
    marked = with_revisits(pages, id_col, html_col)
    revisit: Column = F.when(F.col(id_col) == F.col("_first"), None).otherwise(F.col("_first"))
    rows = marked.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.when(revisit.isNull(), F.coalesce(html_col, F.lit(""))).cast("binary").alias("payload"), F.col("_digest").alias("digest"), F.col("_size").alias("size"), revisit.alias("refers_to"))
    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField("bundle", T.StringType()), T.StructField("frame", T.IntegerType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        writer, made, waiting, size, ids = None, 0, [], 0, []

        def flush() -> pa.RecordBatch:
            nonlocal waiting, size, ids
            frame = writer.frame(b"".join(waiting))
            offsets, at = [], 0
            for x in waiting:
                offsets.append(at)
                at += len(x)
            out = pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array([writer.path] * len(ids)), pa.array([frame] * len(ids), pa.int32()), pa.array(offsets, pa.int64())], names=[id_col, "bundle", "frame", "offset"])
            waiting, size, ids = [], 0, []
            return out

        for batch in batches:
            id_type = batch.column(0).type
            for row in zip(*batch.columns, strict=True):
                page_id, url, payload, digest, n, refers_to = (x.as_py() for x in row)
                if writer is None:
                    writer, made = BundleWriter(f"{folder}/part-{part:06d}-{made:04d}-{attempt}.warc.zst"), made + 1
                waiting.append(record(page_id, url, payload or b"", digest, n, refers_to, date))
                ids.append(page_id)
                size += len(waiting[-1])
                if size >= frame_bytes:
                    yield flush()
                    if writer.written >= bundle_bytes:
                        writer.close()
                        writer = None
        if waiting:
            yield flush()
        if writer is not None:
            writer.close()

    return stored(rows.mapInArrow(run, schema), "warc-index")


def read_archive(index: DataFrame, id_col: str = "page_id", with_payload: bool = False) -> DataFrame:
    """The records that ``index`` lists, frame by frame.

    A response's digest and size are computed from its payload, and a digest
    that differs from the header's is an error.
    """
    spark = index.sparkSession
    id_type = index.schema[id_col].dataType
    frames = index.select("bundle", "frame").distinct()
    tasks = max(spark.sparkContext.defaultParallelism, -(-index.count() // 20_000))
    schema = "id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string" + (", payload binary" if with_payload else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, reader = None, None
        for batch in batches:
            for bundle, frame in sorted(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if bundle != path:
                    path, reader = bundle, BundleReader(bundle)
                data, at, rows = reader.frame(frame), 0, []
                while at < len(data):
                    fields, payload, at = parse_record(data, at)
                    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["Payload-Length"])
                    if fields["WARC-Type"] == "response":
                        own, size = hashlib.sha256(payload).hexdigest(), len(payload)
                        if own != digest:
                            raise ValueError(f"{bundle}, frame {frame}: the payload's digest differs from its record's")
                    name = lambda key, f=fields: f[key][len("<urn:x-page:") : -1] or None if key in f else None
                    rows.append((name("WARC-Record-ID"), fields.get("WARC-Target-URI"), fields["WARC-Type"], size, digest, name("WARC-Refers-To"), payload)[: 7 if with_payload else 6])
                yield pa.RecordBatch.from_pylist([dict(zip(NAMES, r, strict=False)) for r in rows], schema=pa.schema(TYPES[: 7 if with_payload else 6]))

    out = frames.repartition(tasks, "bundle", "frame").mapInArrow(run, schema)
    return out.select(F.col("id").cast(id_type).alias(id_col), "url", "record_type", "payload_bytes", "payload_digest", F.col("refers_to").cast(id_type).alias("refers_to"), *(["payload"] if with_payload else []))


TYPES = [("id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())]
NAMES = [n for n, _ in TYPES]


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes ``pages`` into a new folder below the shared one and reads the archives back."""
    index = write_archive(pages, shared_path(pages.sparkSession, "warc"), **options)
    return read_archive(index, options.get("id_col", "page_id"))
