"""Operator 10 - media columns as MPEG transport streams.

``transport_streams`` stores a payload per row as an MPEG-2 transport stream
(188-byte packets): program tables (PAT, PMT), one elementary stream of private
data, one packetised elementary packet (PES) for every 576 payload bytes, with a
presentation timestamp each and a random-access point every twelve packets. The
stored bytes are then read back by a demultiplexer that knows nothing of the
writer: it parses the program tables, checks continuity counters, reassembles
the PES packets and collects timestamps and random-access points.

Defined cases: null text is the empty text; the empty text is one unit of 576
bytes 255. Every row of the input gives one row; equal texts give equal values;
repeated rows repeat; a null id is carried; an empty table gives an empty result. Other columns of the input are ignored, whatever their
names. Memory is bounded by a few copies of the largest text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKET, UNIT, GOP, TICK = 188, 576, 12, 3600
PMT_PID, ES_PID, PROGRAM, STREAM_TYPE = 0x1000, 0x0100, 1, 0x06
PES_HEADER = 14


def padded(data: bytes, unit: int = UNIT) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of ``unit``."""
    return data + b"\xff" * ((-len(data)) % unit if data else unit)


def _crc_table() -> np.ndarray:
    out = np.zeros(256, np.uint32)
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out[i] = c
    return out


_CRC = _crc_table().tolist()


def crc32_mpeg(data: bytes) -> int:
    """The CRC of program tables; 0 over a section that ends in its own CRC."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    length = 5 + len(body) + 4
    head = bytes([table_id, 0xB0 | length >> 8, length & 255, number >> 8, number & 255, 0xC1, 0, 0])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    raw = bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section
    return np.frombuffer(raw.ljust(PACKET, b"\xff"), np.uint8)


_PAT = _table_packet(0, _section(0x00, 1, bytes([PROGRAM >> 8, PROGRAM & 255, 0xE0 | PMT_PID >> 8, PMT_PID & 255])))
_PMT = _table_packet(PMT_PID, _section(0x02, PROGRAM, bytes([0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0, STREAM_TYPE, 0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0])))


def mux(payload: bytes) -> bytes:
    """The transport stream of ``payload``, whose length is a positive multiple of 576."""
    units = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    n = len(units)
    clock = np.arange(n, dtype=np.int64) * TICK
    pes = np.empty((n, PES_HEADER + UNIT), np.uint8)
    length = UNIT + 8
    pes[:, :9] = (0, 0, 1, 0xBD, length >> 8, length & 255, 0x84, 0x80, 5)
    pes[:, 9] = 0x21 | (clock >> 30 & 7) << 1
    pes[:, 10] = clock >> 22 & 255
    pes[:, 11] = (clock >> 15 & 127) << 1 | 1
    pes[:, 12] = clock >> 7 & 255
    pes[:, 13] = (clock & 127) << 1 | 1
    pes[:, PES_HEADER:] = units

    own = np.empty((n, 4, PACKET), np.uint8)
    own[:, :, 0] = 0x47
    own[:, :, 1] = ES_PID >> 8
    own[:, 0, 1] |= 0x40
    own[:, :, 2] = ES_PID & 255
    own[:, :, 3] = (np.arange(4 * n) & 15).reshape(n, 4) | np.array([0x30, 0x10, 0x10, 0x30])
    own[:, 0, 4] = 7
    own[:, 0, 5] = 0x10
    own[::GOP, 0, 5] |= 0x40
    own[:, 0, 6] = clock >> 25 & 255
    own[:, 0, 7] = clock >> 17 & 255
    own[:, 0, 8] = clock >> 9 & 255
    own[:, 0, 9] = clock >> 1 & 255
    own[:, 0, 10] = (clock & 1) << 7 | 0x7E
    own[:, 0, 11] = 0
    own[:, 0, 12:] = pes[:, :176]
    own[:, 1, 4:] = pes[:, 176:360]
    own[:, 2, 4:] = pes[:, 360:544]
    rest = pes.shape[1] - 544
    own[:, 3, 4] = PACKET - 5 - rest
    own[:, 3, 5] = 0
    own[:, 3, 6 : PACKET - rest] = 255
    own[:, 3, PACKET - rest :] = pes[:, 544:]

    groups = -(-n // GOP)
    at = np.arange(n) * 4 + 2 * (np.arange(n) // GOP + 1)
    out = np.empty((4 * n + 2 * groups, PACKET), np.uint8)
    out[at[:, None] + np.arange(4)] = own
    first = np.arange(groups) * (4 * GOP + 2)
    for k, packet in enumerate((_PAT, _PMT)):
        out[first + k] = packet
        out[first + k, 3] |= (np.arange(groups) & 15).astype(np.uint8)
    return out.tobytes()


def _sections(packets: np.ndarray, start: np.ndarray) -> list[bytes]:
    """The distinct tables that begin in these packets, each with a valid CRC."""
    found = []
    for raw in dict.fromkeys(p[s:].tobytes() for p, s in zip(packets, start, strict=True)):
        body = raw[1 + raw[0] :]
        section = body[: 3 + ((body[1] & 15) << 8 | body[2])]
        if crc32_mpeg(section):
            raise ValueError("a program table has a wrong CRC")
        found.append(section)
    return found


def demux(media: bytes) -> dict:
    """Read a transport stream back: payload, timestamps, random-access points, faults.

    It handles adaptation fields of any length and any packet ids.
    """
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != 0x47).any():
        raise ValueError("a packet lacks its sync byte")
    pid = (packets[:, 1].astype(np.int32) & 31) << 8 | packets[:, 2]
    begins = packets[:, 1] & 0x40 != 0
    field = packets[:, 3] & 0x20 != 0
    filled = packets[:, 3] & 0x10 != 0
    start = np.where(field, 5 + packets[:, 4].astype(np.int32), 4)
    cc = packets[:, 3] & 15

    tables = (pid == 0) & begins
    programs = {}
    for s in _sections(packets[tables], start[tables]):
        for k in range(8, len(s) - 4, 4):
            if number := s[k] << 8 | s[k + 1]:
                programs[number] = (s[k + 2] & 31) << 8 | s[k + 3]
    streams = {}
    for table_pid in programs.values():
        maps = (pid == table_pid) & begins
        for s in _sections(packets[maps], start[maps]):
            k = 12 + ((s[10] & 15) << 8 | s[11])
            while k < len(s) - 4:
                streams[(s[k + 1] & 31) << 8 | s[k + 2]] = s[k]
                k += 5 + ((s[k + 3] & 15) << 8 | s[k + 4])
    if not streams:
        raise ValueError("no elementary stream is announced")
    jumps = 0
    for one in {0, *programs.values(), *streams}:
        seen = cc[(pid == one) & filled]
        jumps += int(((seen[1:] - seen[:-1]) & 15 != 1).sum())

    es = min(streams)
    own = np.flatnonzero((pid == es) & filled)
    body = packets[own]
    flat = body[np.arange(PACKET) >= start[own][:, None]]
    where = np.concatenate([[0], np.cumsum(PACKET - start[own])])
    heads = where[:-1][begins[own]]
    at = heads[:, None] + np.arange(PES_HEADER)
    head = flat[at].astype(np.int64)
    if (head[:, :3] != (0, 0, 1)).any():
        raise ValueError("a PES packet lacks its start code")
    first = heads + 9 + head[:, 8]
    last = heads + 6 + (head[:, 4] << 8 | head[:, 5])
    edge = np.zeros(len(flat) + 1, np.int8)
    edge[first] = 1
    edge[last] -= 1
    payload = flat[np.cumsum(edge[:-1], dtype=np.int8) > 0].tobytes()
    pts = (head[:, 9] >> 1 & 7) << 30 | head[:, 10] << 22 | head[:, 11] >> 1 << 15 | head[:, 12] << 7 | head[:, 13] >> 1
    openers = own[begins[own]]
    access = field[openers] & (packets[openers, 4] > 0) & (packets[openers, 5] & 0x40 != 0)
    return {
        "payload": payload, "pts": pts, "packet": openers, "access": access, "packets": len(packets),
        "programs": len(programs), "stream_type": streams[es], "jumps": jumps,
    }


def describe(read: dict) -> str:
    """The features of a stream that was read back, as ``name=value`` pairs."""
    samples = np.frombuffer(read["payload"], np.uint8)
    return (
        f"packets={read['packets']};programs={read['programs']};type={read['stream_type']};units={len(read['pts'])}"
        f";jumps={read['jumps']};pts={read['pts'][0]}-{read['pts'][-1]};access={int(read['access'].sum())}"
        f";sum={int(samples.sum(dtype=np.int64))};peak={int(samples.max())}"
    )


MEDIA_SCHEMA = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
)
INDEX_SCHEMA = "timestamps array<long>, access_points array<struct<pts: long, packet: long>>"


def transport_streams(df: DataFrame, key: str = "doc_id", text: str = "text", keep_media: bool = True) -> DataFrame:
    """One row per input row: ``key``, the digest columns, the timestamps of all units, the table of
    random-access points (timestamp and packet number) and, with ``keep_media``, the stored bytes.
    """

    number, text_ = pa.int64(), pa.string()
    # Stated, not inferred: inferred structs have their fields in alphabetical order.
    shape = pa.schema({
        "n_bytes": number, "payload_bytes": number, "payload_sha256": text_, "tail_crc32": number, "media_bytes": number, "media_sha256": text_, "feature": text_,
        "timestamps": pa.list_(number), "access_points": pa.list_(pa.struct([("pts", number), ("packet", number)])), **({"media": pa.binary()} if keep_media else {}),
    })

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part, rows = batch.slice(k, 512), []
                for body in part.column(1):
                    data = body.as_py() or b""
                    media = mux(padded(data))
                    read = demux(media)
                    got = read["payload"]
                    row = {
                        "n_bytes": len(data), "payload_bytes": len(got), "payload_sha256": hashlib.sha256(got).hexdigest(), "tail_crc32": zlib.crc32(got[-32:]),
                        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": describe(read),
                    }
                    points = zip(read["pts"][read["access"]].tolist(), read["packet"][read["access"]].tolist(), strict=True)
                    row |= {"timestamps": read["pts"].tolist(), "access_points": [{"pts": p, "packet": q} for p, q in points]}
                    if keep_media:
                        row["media"] = media
                    rows.append(row)
                out = pa.Table.from_pylist(rows, schema=shape)
                yield pa.RecordBatch.from_arrays([part.column(0), *(out.column(c).combine_chunks() for c in out.column_names)], names=[key, *out.column_names])

    kind = df.select(key).schema[0].dataType.simpleString()
    schema = f"`{key}` {kind}, {MEDIA_SCHEMA}, {INDEX_SCHEMA}" + ", media binary" * keep_media
    return df.select(key, F.col(text).cast("binary").alias("body")).mapInArrow(encode, schema)
