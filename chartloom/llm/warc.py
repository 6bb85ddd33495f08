"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; each bundle ends with a seek table in a
skippable frame (the public seekable format's footer), and an index maps record ids to a bundle, a
frame and the offset within that frame, so one record is read by decompressing one frame.

Records with equal payloads: the smallest id is the response, the others are revisits that name it.
A block is an HTTP message whose body is the payload; reading checks both digests.
Payloads are compared in whole (digest and length); those shorter than ``min_payload`` are always
responses. Null payloads count as empty; repeated ids each get a record; records without an id are
responses; an empty frame gives no bundles. Bundles are rows of a table in shared storage; a bundle closes at ``bundle_bytes``, so
neither a task nor a row holds more than that and one record.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow

# Fixed values of the seekable format: the skippable frame's magic, the footer's magic.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

#: The pages have no time of their own.
DATE = "1970-01-01T00:00:00Z"
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20

BUNDLE_SCHEMA = T.StructType(
    [
        T.StructField("bundle", T.StringType()),
        T.StructField("content", T.BinaryType()),
        T.StructField(
            "entries",
            T.ArrayType(T.StructType([T.StructField("record_id", T.LongType()), T.StructField("frame", T.IntegerType()), T.StructField("offset", T.IntegerType()), T.StructField("length", T.IntegerType())])),
        ),
    ]
)
RECORD_SCHEMA = T.StructType(
    [
        T.StructField("record_id", T.LongType()),
        T.StructField("uri", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("refers_to", T.LongType()),
    ]
)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_urn(record_id: int | None) -> str:
    """A record's URI: a version 8 UUID whose free bits hold the 64-bit id; the lowest of the middle bits says that there is one."""
    n = 0 if record_id is None else record_id & (1 << 64) - 1
    bits = (0x77617263 << 96) | (8 << 76) | ((n >> 62) << 65) | (int(record_id is not None) << 64) | (2 << 62) | (n & (1 << 62) - 1)
    return f"<urn:uuid:{uuid.UUID(int=bits)}>"


def record_number(urn: str) -> int | None:
    bits = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int
    n = ((bits >> 65 & 3) << 62) | (bits & (1 << 62) - 1)
    return None if not bits >> 64 & 1 else n - (1 << 64) if n >> 63 else n


def record_bytes(record_id: int | None, uri: str, kind: str, payload: bytes, digest: str, length: int, refers_to: int | None, refers_uri: str | None = None) -> bytes:
    """One WARC/1.1 record whose block is an HTTP message; a revisit keeps its head, the payload's digest and length but not its bytes."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_urn(record_id)}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: {record_urn(refers_to)}", f"WARC-Refers-To-Target-URI: {refers_uri or uri}", f"WARC-Refers-To-Date: {DATE}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at ``at``."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    start = stop + 4
    end = start + int(headers["Content-Length"])
    return headers, data[start:end], end + 4


class BundleWriter:
    def __init__(self, frame_bytes: int, level: int = 3):
        import zstandard

        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.frame_bytes = frame_bytes
        self.body, self.table, self.entries, self.open = bytearray(), [], [], bytearray()

    def add(self, record_id: int, record: bytes) -> None:
        if self.open and len(self.open) + len(record) > self.frame_bytes:
            self._close_frame()
        self.entries.append({"record_id": record_id, "frame": len(self.table), "offset": len(self.open), "length": len(record)})
        self.open += record

    def _close_frame(self) -> None:
        if self.open:
            frame = self.pack(bytes(self.open))
            self.table.append((len(frame), len(self.open)))
            self.body += frame
            self.open = bytearray()

    def size(self) -> int:
        return len(self.body) + len(self.open)

    def finish(self) -> bytes:
        self._close_frame()
        table = b"".join(struct.pack("<II", *row) for row in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        return bytes(self.body) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(content: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed, decompressed) of each frame, from the footer."""
    n, flags, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table")
    out, start = [], 0
    for packed, size in struct.iter_unpack("<II", content[-9 - 8 * n : -9]):
        out.append((start, packed, size))
        start += packed
    return out


def read_frame(content: bytes, frame: tuple[int, int, int]) -> bytes:
    import zstandard

    start, packed, size = frame
    data = zstandard.ZstdDecompressor().decompress(content[start : start + packed])
    if len(data) != size:
        raise ValueError("frame size differs from the seek table's")
    return data


def _row(headers: dict[str, str], block: bytes) -> tuple:
    """A record's columns; the digests of what was read are checked against the headers."""
    if sha1_base32(block) != headers["WARC-Block-Digest"].removeprefix("sha1:"):
        raise ValueError("a block differs from its digest")
    end = block.index(b"\r\n\r\n") + 4
    http, payload = block[:end].decode(), block[end:]
    length, digest = int(http.split("Content-Length: ", 1)[1].split("\r\n", 1)[0]), headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response":
        if len(payload) != length or sha1_base32(payload) != digest:
            raise ValueError("a payload differs from its digest")
        length, digest = len(payload), sha1_base32(payload)
    refers = headers.get("WARC-Refers-To")
    return record_number(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], headers["WARC-Type"], payload, length, digest, None if refers is None else record_number(refers)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
    cols = list(zip(*rows, strict=True)) if rows else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=RECORD_SCHEMA.fieldNames())


# ---- operators ----------------------------------------------------------------------
def mark_revisits(pages: DataFrame, id_col: str, uri_col: str, payload_col: str, min_payload: int = 0) -> DataFrame:
    """record_id, uri, payload, kind, refers_to, refers_uri. Only digests, ids and addresses are shuffled for the grouping."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("long").alias("record_id"),
        F.regexp_replace(F.coalesce(F.col(uri_col), F.lit("")), r"[\r\n]", "").alias("uri"),
        payload.alias("payload"),
        F.struct(F.sha2(payload, 256).alias("sha"), F.length(payload).alias("n")).alias("same"),
    )
    firsts = rows.where(F.length("payload") >= min_payload).groupBy(F.col("same").alias("first_same")).agg(F.min("record_id").alias("first"), F.min_by("uri", "record_id").alias("first_uri"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.join(firsts, F.col("same") == F.col("first_same"), "left")
    revisit = F.col("first").isNotNull() & (F.col("first") != F.col("record_id"))
    return joined.select("record_id", "uri", "payload", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first")).alias("refers_to"), F.when(revisit, F.col("first_uri")).alias("refers_uri"))


def write_bundles(records: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Bundles of WARC records: bundle, content (the archive file's bytes), entries (the index)."""

    def emit(name: str, w: BundleWriter) -> pa.RecordBatch:
        kind = pa.list_(pa.struct([("record_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([w.finish()], pa.binary()), pa.array([w.entries], kind)], names=BUNDLE_SCHEMA.fieldNames())

    def write(batches):
        from pyspark import TaskContext

        part, made, w = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                record_id, uri, payload, kind, refers_to, refers_uri = row
                w = w or BundleWriter(frame_bytes)
                w.add(record_id, record_bytes(record_id, uri, kind, payload, sha1_base32(payload), len(payload), refers_to, refers_uri))
                if w.size() >= bundle_bytes:
                    yield emit(f"{part:06d}-{made:06d}.warc.zst", w)
                    made, w = made + 1, None
        if w:
            yield emit(f"{part:06d}-{made:06d}.warc.zst", w)

    return map_arrow(records.select("record_id", "uri", "payload", "kind", "refers_to", "refers_uri"), write, BUNDLE_SCHEMA)


def record_index(bundles: DataFrame) -> DataFrame:
    return bundles.select("bundle", F.explode("entries").alias("e")).select("e.record_id", "bundle", "e.frame", "e.offset", "e.length")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """All records of all bundles, frame by frame by the seek table."""

    def read(batches):
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                for frame in seek_table(data):
                    plain, at, rows = read_frame(data, frame), 0, []
                    while at < len(plain):
                        headers, block, at = parse_record(plain, at)
                        rows.append(_row(headers, block))
                    yield _batch(rows)

    return map_arrow(bundles.select("content"), read, RECORD_SCHEMA)


def lookup_records(bundles: DataFrame, ids: DataFrame, id_col: str = "record_id") -> DataFrame:
    """The records of ``ids``: joined to the index, then one frame is read for each that holds any."""
    wanted = record_index(bundles).join(ids.select(F.col(id_col).cast("long").alias("record_id")).distinct(), "record_id")
    places = wanted.groupBy("bundle").agg(F.collect_list(F.struct("frame", "offset")).alias("places"))  # at most a bundle's records

    def seek(batches):
        for batch in batches:
            for content, places in zip(batch.column(0), batch.column(1), strict=True):
                data = content.as_py()
                table, rows, frames = seek_table(data), [], {}
                for p in places.as_py():
                    frames.setdefault(p["frame"], []).append(p["offset"])
                for frame, offsets in frames.items():
                    plain = read_frame(data, table[frame])
                    rows += [_row(*parse_record(plain, at)[:2]) for at in offsets]
                yield _batch(rows)

    return map_arrow(bundles.join(places, "bundle").select("content", "places"), seek, RECORD_SCHEMA)
