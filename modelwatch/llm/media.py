"""Media columns: bytes as MPEG transport streams and back.

A payload is cut into access units; each travels in one elementary packet with a
presentation timestamp. Every few units a random-access point carries the program
tables and a clock reference. The reader parses the tables to find the stream,
checks sync bytes and continuity counters, and reassembles the elementary packets.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.shared import arrow_map, arrow_schema, text_bytes_list

PACKET = 188
BODY = 184
TABLE_PID, MAP_PID, STREAM_PID, PROGRAM = 0x0000, 0x1000, 0x0100, 1
STREAM_TYPE, STREAM_ID = 0x06, 0xBD  # private data in elementary packets
TICKS = 3000  # of the 90 kHz clock between access units
UNIT = 16 << 10
UNITS_PER_POINT = 4
_POINT_FIELD = 8  # length, flags and clock reference
_COLUMNS = np.arange(PACKET)


class MediaError(ValueError):
    """A stream that doesn't hold what its tables and counters say."""


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << np.uint32(24)
    for _ in range(8):
        table = np.where(table >> np.uint32(31), (table << np.uint32(1)) ^ np.uint32(0x04C11DB7), table << np.uint32(1))
    return table


_CRC = _crc_table().tolist()


def section_crc(data: bytes) -> int:
    """The CRC-32 of program tables: polynomial 0x04C11DB7, not reflected, from all ones."""
    crc = 0xFFFFFFFF
    for b in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ _CRC[(crc >> 24) ^ b]
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    raw = bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section
    return np.frombuffer(raw.ljust(PACKET, b"\xff"), np.uint8)


_TABLES = np.stack([
    _table_packet(TABLE_PID, _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | MAP_PID).to_bytes(2, "big"))),
    _table_packet(MAP_PID, _section(0x02, PROGRAM, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00")),
])


def _timestamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 30 & 7) << 1, pts >> 22 & 255, 1 | (pts >> 15 & 127) << 1, pts >> 7 & 255, 1 | (pts & 127) << 1])


def _unit_packets(unit: bytes, pts: int, point: bool, counter: int) -> np.ndarray:
    """One access unit as transport packets, continuity counters from ``counter``."""
    length = len(unit) + 8
    pes = np.frombuffer(b"\x00\x00\x01" + bytes([STREAM_ID]) + (length if length < 65536 else 0).to_bytes(2, "big") + b"\x80\x80\x05" + _timestamp(pts) + unit, np.uint8)
    first = BODY - _POINT_FIELD * point
    rest = max(0, len(pes) - first)
    whole, tail = divmod(rest, BODY)
    n = 1 + whole + (tail > 0)
    out = np.full((n, PACKET), 0xFF, np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = 0x47, STREAM_PID >> 8, STREAM_PID & 255
    out[0, 1] |= 0x40
    out[:, 3] = 0x10 | (counter + np.arange(n)) & 15
    if whole:
        out[1 : 1 + whole, 4:] = pes[first : first + whole * BODY].reshape(whole, BODY)
    head = min(first, len(pes))
    if point or head < first:
        size = BODY - head
        out[0, 3] |= 0x20
        out[0, 4] = size - 1
        if size > 1:
            out[0, 5] = 0x50 if point else 0
        if point:
            clock = (pts << 15 | 0x7E00).to_bytes(6, "big")
            out[0, 6:12] = np.frombuffer(clock, np.uint8)
    out[0, PACKET - head :] = pes[:head]
    if tail:
        size = BODY - tail
        out[-1, 3] |= 0x20
        out[-1, 4] = size - 1
        if size > 1:
            out[-1, 5] = 0
        out[-1, PACKET - tail :] = pes[-tail:]
    return out


def mux(payload: bytes) -> bytes:
    """``payload`` as a transport stream; an empty payload is one empty access unit."""
    parts, counter, tables = [], 0, 0
    for k, at in enumerate(range(0, max(1, len(payload)), UNIT)):
        point = k % UNITS_PER_POINT == 0
        if point:
            pair = _TABLES.copy()
            pair[:, 3] |= tables & 15
            tables += 1
            parts.append(pair)
        unit = _unit_packets(payload[at : at + UNIT], k * TICKS & (1 << 33) - 1, point, counter)
        counter += len(unit)
        parts.append(unit)
    return np.concatenate(parts).tobytes()


@dataclass
class Stream:
    """A parsed stream. access_points: (timestamp, byte offset in the payload, packet number)."""

    payload: bytes
    program: int
    pid: int
    stream_type: int
    packets: int
    counter_errors: int
    timestamps: list[int] = field(default_factory=list)
    access_points: list[tuple[int, int, int]] = field(default_factory=list)

    def feature(self) -> str:
        """A short description, the same for equal payloads."""
        points = hashlib.sha256(repr(self.access_points).encode()).hexdigest()[:16]
        return json.dumps({"program": self.program, "pid": self.pid, "type": self.stream_type, "packets": self.packets, "units": len(self.timestamps), "first_pts": self.timestamps[0], "last_pts": self.timestamps[-1], "points": len(self.access_points), "points_sha256": points, "counter_errors": self.counter_errors})


def _body(packet: np.ndarray) -> bytes:
    """A packet's payload."""
    if not packet[3] & 0x10:
        return b""
    return packet[5 + int(packet[4]) if packet[3] & 0x20 else 4 :].tobytes()


def _section_of(packets: np.ndarray) -> bytes:
    """The first section that begins in these packets, gathered over as many of them as it takes, its checksum verified."""
    raw: bytes | None = None
    for p in packets:
        body = _body(p)
        if p[1] & 0x40 and body:
            raw = raw or b""
            raw = (raw + body[1 : 1 + body[0]]) if raw else body[1 + body[0] :]
        elif raw is not None:
            raw += body
        if raw is not None and len(raw) >= 3:
            size = 3 + ((raw[1] & 15) << 8 | raw[2])
            if len(raw) >= size:
                if section_crc(raw[:size]):
                    raise MediaError("a program table is damaged")
                return raw[:size]
    raise MediaError("a program table is missing")


def programs(packets: np.ndarray, pids: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """(program, [(stream type, pid)]) of every program that the tables list."""
    table, out = _section_of(packets[pids == TABLE_PID]), []
    for at in range(8, len(table) - 4, 4):
        number, map_pid = int.from_bytes(table[at : at + 2], "big"), int.from_bytes(table[at + 2 : at + 4], "big") & 0x1FFF
        if not number:  # the network's own table
            continue
        mapped, streams = _section_of(packets[pids == map_pid]), []
        k = 12 + (int.from_bytes(mapped[10:12], "big") & 0x0FFF)
        while k + 5 <= len(mapped) - 4:
            streams.append((mapped[k], int.from_bytes(mapped[k + 1 : k + 3], "big") & 0x1FFF))
            k += 5 + (int.from_bytes(mapped[k + 3 : k + 5], "big") & 0x0FFF)
        out.append((number, streams))
    return out


def demux(media: bytes, program: int | None = None, pid: int | None = None) -> Stream:
    """Parses one stream of a transport stream; raises MediaError where it is damaged.

    Without ``program`` or ``pid`` it is the first that the tables list. Packets without a
    payload don't count, a packet may come twice, and a marked discontinuity is no break.
    Other breaks of the counter are counted; the payload's loss then shows in a unit's
    length.
    """
    raw = np.frombuffer(media, np.uint8)
    if not len(raw) or len(raw) % PACKET:
        raise MediaError("not a whole number of packets")
    packets = raw.reshape(-1, PACKET)
    if (packets[:, 0] != 0x47).any():
        raise MediaError("a sync byte is missing")
    pids = (packets[:, 1] & 0x1F).astype(np.int32) << 8 | packets[:, 2]
    listed = [(n, kind, p) for n, streams in programs(packets, pids) for kind, p in streams if program in (None, n) and pid in (None, p)]
    if not listed:
        raise MediaError("no table lists the stream")
    program, stream_type, pid = listed[0]
    numbers = np.flatnonzero((pids == pid) & (packets[:, 3] & 0x10 > 0))
    own = packets[numbers]
    adapted = (own[:, 3] & 0x20) > 0
    start = np.where(adapted, 5 + own[:, 4].astype(np.int32), 4)
    if (start > PACKET).any():
        raise MediaError("an adaptation field is too long")
    counters = (own[:, 3] & 15).astype(np.int16)
    twice = np.zeros(len(own), bool)
    for k in (np.flatnonzero(counters[1:] == counters[:-1]) + 1).tolist():
        twice[k] = not twice[k - 1] and start[k] == start[k - 1] and (own[k, start[k] :] == own[k - 1, start[k] :]).all()
    numbers, own, adapted, start, counters = numbers[~twice], own[~twice], adapted[~twice], start[~twice], counters[~twice]
    if not len(own):
        raise MediaError("the stream has no packets")
    marked = adapted & (own[:, 4] > 0) & (own[:, 5] & 0x80 > 0)
    errors = int((((counters[1:] - counters[:-1]) & 15 != 1) & ~marked[1:]).sum())
    data = own[_COLUMNS >= start[:, None]].tobytes()
    begins = np.flatnonzero(own[:, 1] & 0x40)
    offsets = np.concatenate([[0], np.cumsum(PACKET - start)])
    out = Stream(b"", program, pid, stream_type, len(packets), errors)
    units, done = [], 0
    for i, end in zip(begins.tolist(), [*begins[1:].tolist(), len(own)], strict=True):
        pes = data[offsets[i] : offsets[end]]
        if len(pes) < 14 or pes[:3] != b"\x00\x00\x01" or not pes[7] & 0x80:
            raise MediaError("an elementary packet has no start code or timestamp")
        if (size := int.from_bytes(pes[4:6], "big")) and size + 6 != len(pes):
            raise MediaError("an elementary packet is incomplete")
        pts = (pes[9] >> 1 & 7) << 30 | pes[10] << 22 | (pes[11] >> 1) << 15 | pes[12] << 7 | pes[13] >> 1
        out.timestamps.append(pts)
        if adapted[i] and own[i, 4] and own[i, 5] & 0x40:
            out.access_points.append((pts, done, int(numbers[i])))
        units.append(pes[9 + pes[8] :])
        done += len(units[-1])
    out.payload = b"".join(units)
    return out


MEDIA = "doc_id long, n_bytes long, media binary"
PARSED = "doc_id long, n_bytes long, payload binary, media_bytes long, media_sha256 string, feature string, timestamps array<long>, access_points array<struct<pts: long, offset: long, packet: long>>"


def padded(raw: bytes) -> bytes:
    """``raw`` with bytes 0 up to a positive multiple of 64."""
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\x00")


def encode_media(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text (null: empty) as UTF-8, padded, as a transport stream.

    One row out per row in, whatever repeats or has no doc_id; other columns are dropped. An
    empty text is 64 bytes 0. A very long text is a slice of its own; memory follows the
    longest text. An empty table gives an empty table.
    """
    schema = arrow_schema(MEDIA)

    def make():
        def step(rows: pa.RecordBatch):
            texts = text_bytes_list(rows.column("text"))
            media = [mux(padded(t)) for t in texts]
            return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], schema=schema)

        return step

    return arrow_map(documents.select(F.col("doc_id").cast("long"), "text"), make, MEDIA, "text", 2 << 20)


_DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, timestamps array<long>, access_points array<struct<pts: long, offset: long, packet: long>>"


def decode_media(media: DataFrame, digest_only: bool = False) -> DataFrame:
    """Reads media columns back: payload, timestamps, random-access points and a feature string.

    digest_only: instead of the payload, payload_bytes, payload_sha256 and tail_crc32 (of
    the last 64 bytes), so that the bytes don't leave the worker. A null cell gives nulls;
    a damaged one raises MediaError. Other columns are dropped.
    """
    wide = _DIGESTS if digest_only else PARSED
    schema = arrow_schema(wide)

    def make():
        def step(rows: pa.RecordBatch):
            cells: list[list] = [[] for _ in range(len(schema) - 2)]
            for m in rows.column("media").to_pylist():
                if m is None:
                    row = [None] * len(cells)
                else:
                    s = demux(m)
                    head = [len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-64:])] if digest_only else [s.payload]
                    row = [*head, len(m), hashlib.sha256(m).hexdigest(), s.feature(), s.timestamps, [dict(zip(("pts", "offset", "packet"), p, strict=True)) for p in s.access_points]]
                for cell, v in zip(cells, row, strict=True):
                    cell.append(v)
            return pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("n_bytes"), *(pa.array(c, f.type) for c, f in zip(cells, list(schema)[2:], strict=True))], schema=schema)

        return step

    return arrow_map(media.select("doc_id", "n_bytes", "media"), make, wide, "media", 2 << 20)


def query(spark, sf_dir: str) -> DataFrame:
    """Every document through a transport stream and back: digests of what was read."""
    return decode_media(encode_media(spark.read.parquet(f"{sf_dir}/documents.parquet")), digest_only=True)
