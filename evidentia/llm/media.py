"""Media columns held as MPEG transport streams.

A payload of 8-bit samples is cut into access units, each a packetized elementary stream (PES) packet with a
presentation timestamp, and carried in 188-byte transport packets: program tables (PAT and PMT, with checksums)
before each random-access point, continuity counters for each packet id, a random-access flag and a clock reference in the
adaptation field of the first packet of every fourth unit, and stuffing in the last packet of each. Reading goes
the other way from the stored bytes alone: it finds the elementary stream by the program tables, checks continuity,
reassembles the PES packets and returns samples, timestamps and random-access points.

Defined results: a null text is empty; a payload is zero-padded to a positive multiple of 64 bytes; bytes that
are no transport stream are read as nothing, with an error counted; repeated rows are rows of their own; an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices

PACKET = 188
UNIT = 16384
UNITS_PER_ACCESS = 4
SAMPLE_RATE = 8000
#: Ticks of the 90 kHz clock.
UNIT_TICKS = 90_000 * UNIT // SAMPLE_RATE
PAD = 64

_PROGRAM, _PMT_PID, _DATA_PID, _PRIVATE_STREAM, _PRIVATE_TYPE = 1, 0x1000, 0x0100, 0xBD, 0x06


@lru_cache(maxsize=None)
def _checksum_table() -> list[int]:
    out = []
    for b in range(256):
        x = b << 24
        for _ in range(8):
            x = ((x << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if x & 0x80000000 else x << 1
        out.append(x)
    return out


@lru_cache(maxsize=1024)
def section_checksum(section: bytes) -> int:
    """The checksum of program tables: 0 over a section that ends with its own."""
    x, by = 0xFFFFFFFF, _checksum_table()
    for b in section:
        x = ((x << 8) & 0xFFFFFFFF) ^ by[(x >> 24) ^ b]
    return x


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255]) + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_checksum(head + body).to_bytes(4, "big")


@lru_cache(maxsize=64)
def _tables(counter: int) -> np.ndarray:
    """The two packets of the program tables."""
    pat = _section(0, 1, _PROGRAM.to_bytes(2, "big") + (0xE000 | _PMT_PID).to_bytes(2, "big"))
    stream = bytes([_PRIVATE_TYPE]) + (0xE000 | _DATA_PID).to_bytes(2, "big") + b"\xf0\x00"
    pmt = _section(2, _PROGRAM, (0xE000 | _DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + stream)
    out = np.full((2, PACKET), 0xFF, np.uint8)
    for row, pid, section in ((0, 0, pat), (1, _PMT_PID, pmt)):
        data = bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10 | counter & 15, 0]) + section
        out[row, : len(data)] = np.frombuffer(data, np.uint8)
    return out


def _timestamp(ticks: int) -> bytes:
    return bytes([0x21 | (ticks >> 29) & 0x0E, (ticks >> 22) & 255, 1 | (ticks >> 14) & 0xFE, (ticks >> 7) & 255, 1 | (ticks << 1) & 0xFE])


def mux(payload: np.ndarray) -> bytes:
    """The transport stream of a payload of bytes."""
    out, counter = [], 0
    for k, first in enumerate(range(0, max(1, len(payload)), UNIT)):
        unit, ticks, access = payload[first : first + UNIT], k * UNIT_TICKS, k % UNITS_PER_ACCESS == 0
        head = b"\x00\x00\x01" + bytes([_PRIVATE_STREAM]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _timestamp(ticks % (1 << 33))
        body = np.concatenate([np.frombuffer(head, np.uint8), unit])
        field_bytes = 8 if access else 0
        n = -(-(len(body) + field_bytes) // (PACKET - 4))
        packets = np.full((n, PACKET), 0xFF, np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = 0x47, _DATA_PID >> 8, _DATA_PID & 255
        packets[0, 1] |= 0x40
        packets[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter += n
        spare = n * (PACKET - 4) - len(body) - field_bytes
        flat = packets[:, 4:]
        if access:
            reference = (ticks % (1 << 33)) << 15 | 0x7E00
            packets[0, 3] |= 0x20
            packets[0, 4:12] = np.frombuffer(bytes([7, 0x50]) + reference.to_bytes(6, "big"), np.uint8)
        if spare:
            if n == 1 and access:
                packets[0, 4] = 7 + spare
            else:
                packets[-1, 3] |= 0x20
                packets[-1, 4] = spare - 1
                if spare > 1:
                    packets[-1, 5] = 0
        room = np.ones((n, PACKET - 4), bool)
        room[0, :field_bytes] = False
        if spare:
            room[-1, (field_bytes if n == 1 else 0) : (field_bytes if n == 1 else 0) + spare] = False
        flat[room] = body
        if access:
            out.append(_tables((k // UNITS_PER_ACCESS) & 15))
        out.append(packets)
    return np.concatenate(out).tobytes()


@dataclass
class Stream:
    payload: bytes = b""
    timestamps: list[int] = field(default_factory=list)
    #: Positions in `timestamps` of the random-access points.
    access: list[int] = field(default_factory=list)
    errors: int = 0


@lru_cache(maxsize=1024)
def _section_pids(data: bytes, table: int) -> tuple[int, ...] | None:
    """Packet ids that a section names, or None of a broken one."""
    section = data[1 + data[0] :]
    length = 3 + ((section[1] & 15) << 8 | section[2])
    section = section[:length]
    if section[0] != table or len(section) < length or section_checksum(section):
        return None
    found, at = [], 8 if table == 0 else 12 + ((section[10] & 15) << 8 | section[11])
    while at < length - 4:
        if table == 0:
            if section[at : at + 2] != b"\x00\x00":
                found.append((section[at + 2] & 31) << 8 | section[at + 3])
            at += 4
        else:
            found.append((section[at + 1] & 31) << 8 | section[at + 2])
            at += 5 + ((section[at + 3] & 15) << 8 | section[at + 4])
    return tuple(found)


def _table_pids(packets: np.ndarray, pid: np.ndarray, wanted: int, table: int) -> tuple[list[int], int]:
    """Packet ids that the sections of one table name, and the number of broken sections."""
    found, broken = [], 0
    for row in packets[(pid == wanted) & (packets[:, 1] & 0x40 > 0), 4:]:
        own = _section_pids(row.tobytes(), table)
        broken += own is None
        found += own or ()
    return list(dict.fromkeys(found)), broken


def demux(media: bytes) -> Stream:
    """What a transport stream holds; errors counts lost or broken packets."""
    out = Stream()
    if not media or len(media) % PACKET:
        out.errors = 1
        return out
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    out.errors += int((packets[:, 0] != 0x47).sum())
    pid = (packets[:, 1].astype(np.int32) & 31) << 8 | packets[:, 2]
    programs, broken = _table_pids(packets, pid, 0, 0)
    streams = []
    for program in programs:
        own, more = _table_pids(packets, pid, program, 2)
        streams += own
        broken += more
    out.errors += broken
    if not streams:
        out.errors += 1
        return out
    rows = packets[pid == streams[0]]
    carries = rows[:, 3] & 0x10 > 0
    counters = rows[carries, 3] & 15
    out.errors += int(((np.diff(counters.astype(np.int32)) - 1) % 16 != 0).sum())
    rows = rows[carries]
    has_field = rows[:, 3] & 0x20 > 0
    start = 4 + np.where(has_field, 1 + rows[:, 4].astype(np.int32), 0)
    body = rows[np.arange(PACKET)[None, :] >= start[:, None]]
    begins = np.flatnonzero(rows[:, 1] & 0x40)
    at = np.concatenate([[0], np.cumsum(PACKET - start)])
    parts = []
    for k, row in enumerate(begins.tolist()):
        end = at[begins[k + 1]] if k + 1 < len(begins) else at[-1]
        pes = body[at[row] : end]
        head = pes[:14].tobytes()
        if head[:3] != b"\x00\x00\x01" or len(head) < 14:
            out.errors += 1
            continue
        size, skip = head[4] << 8 | head[5], 9 + head[8]
        if size and size + 6 > len(pes):
            out.errors += 1
        if head[7] & 0x80:
            out.timestamps.append((head[9] & 0x0E) << 29 | head[10] << 22 | (head[11] & 0xFE) << 14 | head[12] << 7 | head[13] >> 1)
        if has_field[row] and rows[row, 4] and rows[row, 5] & 0x40:
            out.access.append(k)
        parts.append(pes[skip : size + 6] if size else pes[skip:])
    out.payload = b"".join(p.tobytes() for p in parts)
    return out


def media_column(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, media: the text's padded UTF-8 bytes as a transport stream."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=4 << 20):
                sizes, media = [], []
                for text in part.column("text").cast(pa.large_binary()).to_pylist():
                    text = text or b""
                    sizes.append(len(text))
                    padded = text + bytes(-len(text) % PAD or (0 if text else PAD))
                    media.append(mux(np.frombuffer(padded, np.uint8)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_bytes long, media binary")


def media_features(column: DataFrame) -> DataFrame:
    """media_column's rows -> what reading the stored bytes back gives, and features of the samples."""
    id_type = column.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, timestamps array<bigint>, access_points array<int>, errors int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media", 8 << 20):
                rows = []
                for media in part.column("media").to_pylist():
                    stream = demux(media)
                    samples = np.frombuffer(stream.payload, np.uint8)
                    n, total = len(samples), int(samples.sum(dtype=np.int64))
                    squares = int(np.square(samples, dtype=np.int64).sum()) if n else 0
                    peak = int(samples.max()) if n else 0
                    feature = (
                        f"units={len(stream.timestamps)};last_pts={stream.timestamps[-1] if stream.timestamps else -1};access={len(stream.access)};"
                        f"errors={stream.errors};mean={total / max(1, n):.6f};power={squares / max(1, n):.6f};peak={peak}"
                    )
                    rows.append((n, hashlib.sha256(stream.payload).hexdigest(), zlib.crc32(stream.payload[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature, stream.timestamps, stream.access, stream.errors))
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32()]
                arrays = [pa.array(values, kind) for values, kind in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *arrays], [x.split()[0] for x in schema.split(", ")])

    return column.select("doc_id", "n_bytes", F.coalesce("media", F.lit(b"")).alias("media")).mapInArrow(run, schema)
