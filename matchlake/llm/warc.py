"""WARC archives in seekable Zstandard bundles.

Each task writes its records into bundles: records are grouped into independent Zstandard frames, and
a skippable frame with a seek table ends the file, so any frame can be read alone. An index table
maps every record to its bundle, its frame and its offset inside the frame. Which records are
revisits is settled before by one grouped maximum over payload digests, without moving payloads.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import staged, staging_folder

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
LEVEL = 3
#: Pages carry no time of their own.
DATE = "1970-01-01T00:00:00Z"

#: Fixed values of the formats.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, bundle string, frame int, start long, length long"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response with its payload, or a revisit with the header of the response it stands for."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    target = quote(url, safe="%:/?#[]@!$&'()*+,;=~") if url else f"urn:page:{page_id}"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>",
            f"WARC-Target-URI: {target}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {_REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """What a record says; a response's payload is held against its digest and length."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    stated = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])

    def number(name: str) -> int | None:
        text = fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text not in ("", "None") else None

    out = {"page_id": number("WARC-Record-ID"), "payload_bytes": int(stated["Content-Length"]),
           "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "record_type": fields["WARC-Type"],
           "refers_to": number("WARC-Refers-To"), "url": fields["WARC-Target-URI"], "payload": None}
    if out["record_type"] == "response":
        got = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if (len(payload), got) != (out["payload_bytes"], out["payload_digest"]):
            raise ValueError(f"record of page {out['page_id']} is damaged")
        out["payload"] = payload
    return out


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class BundleWriter:
    """Writes frames and, at the end, the seek table."""

    def __init__(self, folder: str):
        self.uri = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.warc.zst"
        store, path = _store(self.uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = store.open_output_stream(path, compression=None)  # else guessed from the name
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.sizes: list[tuple[int, int]] = []
        self.written = 0

    def frame(self, data: bytes) -> None:
        packed = self.compressor.compress(data)
        self.out.write(packed)
        self.sizes.append((len(packed), len(data)))
        self.written += len(data)

    def close(self) -> None:
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        self.out.close()


class BundleReader:
    """Reads single frames of a bundle by its seek table."""

    def __init__(self, uri: str):
        store, path = _store(uri)
        self.file = store.open_input_file(path)
        end = self.file.size()
        frames, flags, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != _SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        entry = 12 if flags & 0x80 else 8
        raw = self.file.read_at(frames * entry, end - 9 - frames * entry)
        self.sizes = [struct.unpack_from("<II", raw, i * entry) for i in range(frames)]
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)

    def frame(self, i: int) -> bytes:
        packed, size = self.sizes[i]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, self.starts[i]), max_output_size=size)


def revisits(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """(_page, _sha1, _refers): pages whose payload another page with a larger id has too.

    Rows without an id are never referred to; those of equal payload refer to the largest id there is.
    """
    keys = pages.select(
        F.col("page_id").cast("long").alias("_page"), F.coalesce(F.col("html"), F.lit("")).alias("_html")
    ).select("_page", F.sha1(F.encode("_html", "UTF-8")).alias("_sha1"), F.octet_length("_html").alias("_bytes"))
    largest = (
        keys.filter(F.col("_bytes") >= min_payload).groupBy("_sha1")
        .agg(F.max("_page").alias("_refers"), F.count(F.lit(1)).alias("_n")).filter("_n > 1 AND _refers IS NOT NULL").drop("_n")
    )
    return keys.join(largest, "_sha1").filter(~F.col("_page").eqNullSafe(F.col("_refers"))).select("_page", "_sha1", "_refers").distinct()


def write(pages: DataFrame, folder: str | None = None, min_payload: int = 0,
          frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write a record per row and return the index: page_id, bundle, frame, start, length.

    Of rows with equal payloads of at least ``min_payload`` bytes the one with the largest page_id is
    the response, the others revisit it; exact repeats of that row are responses too. A null html is an
    empty payload. Files have names of their own per attempt, and the index, written before it is
    returned, lists those of finished tasks only, so a task may run again. An empty table writes nothing.
    """
    spark = pages.sparkSession
    folder = folder or f"{staging_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("_own", F.sha1(F.encode("html", "UTF-8")))
    again = revisits(pages, min_payload)
    joined = rows.join(again, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("_own") == F.col("_sha1")), "left").select(
        "page_id", "url", "html", "_refers"
    )
    kind = spark.createDataFrame([], INDEX).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer: BundleWriter | None = None
        index: list[tuple] = []
        held: list[bytes] = []
        size = 0

        def cut() -> None:
            nonlocal held, size
            if held:
                writer.frame(b"".join(held))
                held, size = [], 0

        def rows_of(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()),
                 pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())],
                names=["page_id", "bundle", "frame", "start", "length"])

        for batch in batches:
            for page_id, url, html, refers in zip(*(c.to_pylist() for c in batch.columns)):
                writer = writer or BundleWriter(folder)
                data = record(page_id, url, html.encode("utf-8", "surrogatepass"), refers, refers is not None)
                index.append((page_id, writer.uri, len(writer.sizes), size, len(data)))
                held.append(data)
                size += len(data)
                if size >= frame_bytes:
                    cut()
                if writer.written >= bundle_bytes:
                    writer.close()
                    writer = None
                    yield rows_of(index)
                    index = []
        if writer:
            cut()
            writer.close()
            yield rows_of(index)

    return staged(joined.mapInArrow(run, kind))


def read(index: DataFrame, payloads: bool = False) -> DataFrame:
    """Records of an index, read frame by frame: page_id, payload_bytes, payload_digest, record_type, refers_to.

    With ``payloads`` also url and payload (null for revisits). A frame is read once for all its records.
    """
    spark = index.sparkSession
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["url", "payload"] * payloads
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    frames = index.groupBy("bundle", "frame").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, BundleReader] | None = None
        for batch in batches:
            for bundle, frame, at in zip(*(c.to_pylist() for c in batch.columns)):
                if not opened or opened[0] != bundle:
                    opened = (bundle, BundleReader(bundle))
                data = opened[1].frame(frame)
                found = [parse(data[x["start"] : x["start"] + x["length"]]) for x in at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[n] for r in found], t) for n, t in zip(names, types)], names=names)

    kind = spark.createDataFrame([], schema + (", url string, payload binary" if payloads else "")).schema
    return frames.sortWithinPartitions("bundle", "frame").mapInArrow(run, kind)
