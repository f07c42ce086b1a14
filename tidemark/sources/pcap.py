"""Packet captures (PCAP and PCAP-NG) as a Spark data source: spark.read.format("capture").load(path).

Files are read as streams, a packet at a time. A PCAP file is split into ranges of bytes, which tasks read apart: one
starts at the first record whose chain of records holds for longer than any record may be. PCAP-NG files are read whole.
Rows that aren't IPv4, or whose IP payload has fewer than 20 bytes, are left out, as are malformed ones (skipped() counts
them); what the file's header says about the link decides where the IP packet starts.
"""

from __future__ import annotations

import io
import os
import struct
from collections import Counter
from collections.abc import Iterator
from glob import glob

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.dimensions import FLAG_BITS
from tidemark.errors import CaptureError, InvalidCapturePath
from tidemark.functions.packets import entropy_of, protocol_name
from tidemark.sources.adapters import bucket_of, routed

# Link types of captures.
ETHERNET, RAW, LINUX_SLL = 1, 101, 113
LEAST_PAYLOAD = 20
SCHEMA = "capture_id string, timestamp double, size int, protocol_number int, src_port int, dst_port int, flags long, payload_bytes long, entropy double"


def check_path(path: str) -> str:
    """The path, if it is a file that can be read."""
    if not os.path.exists(path):
        raise InvalidCapturePath(f"no such file: {path}")
    if not os.path.isfile(path):
        raise InvalidCapturePath(f"not a file: {path}")
    if not os.access(path, os.R_OK):
        raise InvalidCapturePath(f"not readable: {path}")
    return path


#: Bytes of a PCAP file that one task reads, and the longest record that is taken for one.
SPLIT_BYTES = 128 << 20
MOST_RECORD = 1 << 18
_MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1e6), b"\xa1\xb2\xc3\xd4": (">", 1e6), b"\x4d\x3c\xb2\xa1": ("<", 1e9), b"\xa1\xb2\x3c\x4d": (">", 1e9)}
_SECTION = b"\x0a\x0d\x0d\x0a"


def frames(source, start: int = 0, end: int | None = None) -> Iterator[tuple[float, int, bytes]]:
    """(time, link type, frame) of each packet of a capture (bytes or a stream that can seek), told apart by its first
    bytes; of a PCAP only the records that begin in the range of bytes."""
    stream = io.BytesIO(source) if isinstance(source, bytes) else source
    head = stream.read(24)
    if len(head) < 4:
        return
    if head[:4] == _SECTION:
        stream.seek(0)
        yield from _blocks(stream)
        return
    if head[:4] not in _MAGIC or len(head) < 24:
        raise CaptureError("neither PCAP nor PCAP-NG")
    order, unit = _MAGIC[head[:4]]
    link = struct.unpack_from(order + "I", head, 20)[0] & 0x0FFFFFFF
    record = struct.Struct(order + "IIII")
    at = 24 if start <= 24 else _first_record(stream, start, record, unit)
    if at is None:
        return
    stream.seek(at)
    while (end is None or at < end) and len(top := stream.read(16)) == 16:
        sec, part, kept, _ = record.unpack(top)
        data = stream.read(kept)
        if len(data) < kept:
            return
        yield sec + part / unit, link, data
        at += 16 + kept


def _first_record(stream, start: int, record: struct.Struct, unit: float) -> int | None:
    """Where the first record at or after start begins; None if none does.

    The search begins two longest records before. A chain of records that a packet carries in its payload ends within
    that packet, or goes on as the file's own chain: so what is found is the file's by the time it reaches start.
    """
    longest = MOST_RECORD + 16
    base = max(24, start - 2 * longest)
    stream.seek(base)
    data = stream.read(start - base + 2 * longest)
    last = len(data) < start - base + 2 * longest
    for at in range(min(len(data), 1 if base == 24 else longest)):
        place, records, reached = at, 0, None
        while place + 16 <= len(data):
            if reached is None and base + place >= start:
                reached = base + place
            sec, part, kept, whole = record.unpack_from(data, place)
            if base > 24 and (part >= unit or not 0 < kept <= min(whole, MOST_RECORD)):
                break
            place, records = place + 16 + kept, records + 1
            # Longer than what one record could hold, or up to the end, which may cut off the last record.
            if reached is not None and (place - at > longest or base == 24):
                return reached
        else:
            if base == 24 or last and (place == len(data) or records > 8):
                return reached
    return None


def _blocks(stream) -> Iterator[tuple[float, int, bytes]]:
    order, links, units = "<", [], []
    while len(top := stream.read(8)) == 8:
        if top[:4] == _SECTION:
            mark = stream.read(4)
            order = "<" if mark == b"\x4d\x3c\x2b\x1a" else ">"
            links, units = [], []
            stream.seek(-4, io.SEEK_CUR)
        kind, size = struct.unpack(order + "II", top)
        if size < 12:
            return
        body = stream.read(size - 8)
        if len(body) < size - 8:
            return
        body = body[:-4]
        if kind == 1:
            links.append(struct.unpack_from(order + "H", body)[0])
            units.append(_resolution(body[8:], order))
        elif kind == 6 and len(body) >= 20:
            face, high, low, kept, _ = struct.unpack_from(order + "IIIII", body)
            if face < len(links):
                yield ((high << 32) | low) / units[face], links[face], body[20 : 20 + kept]
        elif kind == 3 and links:
            yield 0.0, links[0], body[4:]


def _resolution(options: bytes, order: str) -> float:
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(order + "HH", options, at)
        if code == 9 and size == 1:
            v = options[at + 4]
            return float(2 ** (v & 0x7F)) if v & 0x80 else float(10**v)
        if code == 0:
            break
        at += 4 + size + (-size % 4)
    return 1e6


def ip_packet(link: int, frame: bytes) -> bytes | None:
    """The IPv4 packet of a frame, None where there is none."""
    if link == ETHERNET:
        at = 12
        while frame[at : at + 2] in (b"\x81\x00", b"\x88\xa8"):
            at += 4
        start = at + 2 if frame[at : at + 2] == b"\x08\x00" else -1
    elif link == LINUX_SLL:
        start = 16 if frame[14:16] == b"\x08\x00" else -1
    else:
        start = 0
    packet = frame[start:] if start >= 0 else b""
    return packet if len(packet) >= 20 and packet[0] >> 4 == 4 else None


def parse(time: float, link: int, frame: bytes) -> tuple | None:
    """A row without its capture, None for a frame that is left out."""
    packet = ip_packet(link, frame)
    if packet is None:
        return None
    head = (packet[0] & 15) * 4
    total = struct.unpack_from(">H", packet, 2)[0]
    body = packet[head : max(total, head) if total else len(packet)]
    if len(body) < LEAST_PAYLOAD or head < 20:
        return None
    number, src, dst, flags, payload = packet[9], -1, -1, 0, body
    if number == 6:
        src, dst = struct.unpack_from(">HH", body)
        flags, payload = body[13], body[(body[12] >> 4) * 4 :]
    elif number == 17:
        src, dst = struct.unpack_from(">HH", body)
        payload = body[8:]
    return time, len(frame), number, src, dst, flags, len(payload), entropy_of(payload)


def rows_of(source, start: int = 0, end: int | None = None, counts: Counter | None = None) -> Iterator[tuple]:
    """Rows of the frames that are IPv4 and well formed; counts gets how many of each kind there were."""
    counts = Counter() if counts is None else counts
    for time, link, frame in frames(source, start, end):
        counts["frames"] += 1
        try:
            row = parse(time, link, frame)
        except (struct.error, IndexError):
            counts["malformed"] += 1
            continue
        if row:
            counts["rows"] += 1
            yield row
        else:
            counts["left_out"] += 1


class _Range(InputPartition):
    def __init__(self, path: str, start: int = 0, end: int | None = None):
        self.path, self.start, self.end = path, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        path = options.get("path") or ""
        self.paths = sorted(glob(f"{path}/*.pcap*")) if os.path.isdir(path) else [check_path(path)]
        self.split = int(options.get("splitBytes") or SPLIT_BYTES)

    def partitions(self):
        out = []
        for path in self.paths:
            size = os.path.getsize(path)
            with open(path, "rb") as f:
                whole = f.read(4) not in _MAGIC
            out += [_Range(path)] if whole or size <= self.split else [_Range(path, at, at + self.split) for at in range(0, size, self.split)]
        return out

    def read(self, partition):
        name = os.path.basename(partition.path)
        with open(partition.path, "rb", buffering=1 << 20) as f:
            for row in rows_of(f, partition.start, partition.end):
                yield (name, *row)


class CaptureSource(DataSource):
    """Reads from a path that all executors see."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def _parsed(batches):
    import pyarrow as pa

    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = [pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            rows = []
            for row in rows_of(content):
                rows.append((path.rsplit("/", 1)[-1], *row))
                if len(rows) >= 20_000:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_captures(spark: SparkSession, path: str, bucket_seconds: float = 1.0) -> DataFrame:
    """Packets of the captures at a path of any store that Spark reads, ready for windows.

    Such files are held whole, of 2 GB at most, as Spark reads them; larger ones go through the format "capture", by a
    path that executors can open.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return as_packets(files.mapInArrow(_parsed, SCHEMA), bucket_seconds)


def skipped(spark: SparkSession, path: str) -> DataFrame:
    """capture_id, frames, rows, left_out (not IPv4, or too short) and malformed of each capture at a path of any store."""

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                counts = Counter()
                for _ in rows_of(content, counts=counts):
                    pass
                yield pa.record_batch([pa.array([name.rsplit("/", 1)[-1]]), *(pa.array([counts[k]], pa.int64()) for k in kinds)], names=["capture_id", *kinds])

    kinds = ("frames", "rows", "left_out", "malformed")
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(count, "capture_id string, frames long, rows long, left_out long, malformed long")


def as_packets(rows: DataFrame, bucket_seconds: float = 1.0) -> DataFrame:
    """Rows of the source with names, flags, direction and bucket (whole buckets of epoch time)."""
    flags = [((F.col("flags").bitwiseAND(F.lit(bit).cast("long"))) != 0).cast("int").alias(f"tcp_flags_{f}") for f, bit in FLAG_BITS.items()]
    df = rows.select(
        "capture_id", "timestamp", bucket_of(F.round(F.col("timestamp") * 1e6).cast("long"), bucket_seconds).alias("bucket"), "size", "entropy", protocol_name(F.col("protocol_number")).alias("protocol"),
        "src_port", "dst_port", *flags, "payload_bytes",
    )
    return routed(df)
