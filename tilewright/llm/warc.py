"""WARC in seekable Zstandard bundles: independent frames, a seek table in the footer, offsets by record."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import materialise

# Fixed values of the public Zstandard seekable format: skippable frame, then footer magic.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
ID = "<urn:tilewright:page:%s>"
BUNDLE_SCHEMA = "bundle string, content binary, records array<struct<record_id:string,frame:int,offset:long,length:long>>"
RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(page_id, url, html, refers_to) -> tuple[str, bytes]:
    """(record id, bytes). A revisit has the HTTP header of the response but no payload."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    rid = ID % ("null" if page_id is None else page_id)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {rid}", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", " ", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {ID % refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest32(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return rid, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Bundle:
    """One bundle in the making: records are gathered into frames of about frame_bytes."""

    def __init__(self, frame_bytes: int):
        self.frame_bytes, self.frames, self.table, self.records, self.open, self.size = frame_bytes, [], [], [], bytearray(), 0
        self.codec = zstandard.ZstdCompressor(level=6)

    def add(self, rid: str, record: bytes) -> None:
        self.records.append({"record_id": rid, "frame": len(self.frames), "offset": len(self.open), "length": len(record)})
        self.open += record
        if len(self.open) >= self.frame_bytes:
            self.cut()

    def cut(self) -> None:
        if self.open:
            frame = self.codec.compress(bytes(self.open))
            self.frames.append(frame)
            self.table.append((len(frame), len(self.open)))
            self.size += len(frame)
            self.open = bytearray()

    def content(self) -> bytes:
        self.cut()
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(body)) + body


def seek_table(content: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of each frame, from the footer alone."""
    n, flags, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    step = 12 if flags & 0x80 else 8
    at, out, base = 0, [], len(content) - 9 - n * step
    for k in range(n):
        packed, plain = struct.unpack_from("<II", content, base + k * step)
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(content: bytes, entry: tuple[int, int, int]) -> bytes:
    at, packed, plain = entry
    return zstandard.ZstdDecompressor().decompress(content[at : at + packed], max_output_size=max(plain, 1))


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record that starts at a place of a frame, and where the next starts."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) for x in lines[1:])
    size = int(head["Content-Length"])
    block = data[end + 4 : end + 4 + size]
    http, _, payload = block.partition(b"\r\n\r\n")
    whole = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind, number = head["WARC-Type"], lambda x: None if x == "null" else int(x)
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != whole or digest32(payload) != digest):
        raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
    page = lambda x: number(x.rsplit(":", 1)[1].rstrip(">"))
    row = {
        "page_id": page(head["WARC-Record-ID"]), "url": head.get("WARC-Target-URI"), "payload_bytes": whole, "payload_digest": digest,
        "record_type": kind, "refers_to": page(head["WARC-Refers-To"]) if kind == "revisit" else None,
        "html": payload.decode("utf-8", "surrogatepass") if kind == "response" else None,
    }
    return row, end + 4 + size + 4


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with refers_to: the smallest page_id of the rows of equal payload, on all others.

    Payloads under min_bytes are never referred to. Digests alone are grouped, partially on the side of
    the scan, and only payloads that several rows have are joined back, so a payload shared by a third of
    all rows is one row of the small side (an adaptive skew join can split its pages).
    """
    keyed = pages.select("page_id", "url", "html").withColumn("_bytes", F.octet_length(F.coalesce("html", F.lit(""))))
    keyed = keyed.withColumn("_sha", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")))
    firsts = keyed.where(F.col("_bytes") >= min_bytes).groupBy("_sha", "_bytes").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
    firsts = firsts.where("_n > 1")
    out = keyed.join(firsts, ["_sha", "_bytes"], "left")
    other = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return out.select("page_id", "url", "html", F.when(other, F.col("_first")).alias("refers_to"))


def write_bundles(marked: DataFrame, frame_bytes: int = 1 << 18, bundle_bytes: int = 8 << 20) -> DataFrame:
    """Bundles of the records of mark_revisits(): (bundle, content, records), a row for each bundle.

    records maps each record id to (frame, offset in the frame, length). A record is never split; one
    longer than frame_bytes has a frame of its own, so memory is bounded by bundle_bytes and one record.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, now = TaskContext.get().partitionId(), 0, Bundle(frame_bytes)
        schema = pa.schema([("bundle", pa.string()), ("content", pa.binary()), ("records", pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])))])

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"bundle": f"part-{part:06d}-{made:05d}.warc.zst", "content": now.content(), "records": now.records}], schema)

        for batch in batches:
            for page_id, url, html, refers_to in zip(*[batch.column(c) for c in ("page_id", "url", "html", "refers_to")], strict=True):
                now.add(*warc_record(page_id.as_py(), url.as_py(), html.as_py(), refers_to.as_py()))
                if now.size >= bundle_bytes:
                    yield done()
                    made, now = made + 1, Bundle(frame_bytes)
        if now.records:
            yield done()

    return marked.mapInArrow(build, BUNDLE_SCHEMA)


def read_bundles(bundles: DataFrame) -> DataFrame:
    """All records of bundles, frame by frame; raises on a damaged payload or a missing record."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.string())])
        for batch in batches:
            for content in batch.column("content"):
                content = content.as_py()
                for entry in seek_table(content):
                    data, at, rows = read_frame(content, entry), 0, []
                    while at < len(data):
                        row, at = parse_record(data, at)
                        rows.append(row)
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return bundles.select("content").mapInArrow(scan, RECORD_SCHEMA)


def lookup(bundles: DataFrame, record_ids: DataFrame) -> DataFrame:
    """Records by id (column record_id): only the frames that hold them are inflated."""
    places = bundles.select("bundle", F.explode("records").alias("r")).select("bundle", "r.*").join(record_ids.select("record_id").distinct(), "record_id")
    wanted = places.groupBy("bundle").agg(F.collect_list(F.struct("frame", "offset")).alias("places"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.string())])
        for batch in batches:
            for content, places in zip(batch.column("content"), batch.column("places"), strict=True):
                content, rows = content.as_py(), []
                table, frames = seek_table(content), {}
                for p in places.as_py():
                    k = p["frame"]
                    if k not in frames:
                        frames[k] = read_frame(content, table[k])
                    rows.append(parse_record(frames[k], p["offset"])[0])
                yield pa.RecordBatch.from_pylist(rows, schema)

    return bundles.select("bundle", "content").join(wanted, "bundle").select("content", "places").mapInArrow(fetch, RECORD_SCHEMA)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as WARC bundles, then read them back: a row for each page.

    Null html is an empty payload; pages without page_id revisit the smallest page_id of their payload or
    are responses; repeated rows of a smallest page_id are all responses. An empty table gives no rows.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    bundles = materialise(write_bundles(mark_revisits(pages)), "bundles")
    return read_bundles(bundles).drop("html", "url")


# Five hex digits of the SHA-1 are four base-32 digits.
OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS sha FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY sha, payload_bytes) AS first FROM h)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(sha, 1 + 5 * (i // 4)::INTEGER, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31))::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""
