"""Media columns: MPEG transport streams.

A payload is stored as one programme with one private-data elementary stream: a program association table, a program
map table, then the payload cut into PES packets of PES_BYTES with presentation timestamps, each split over 188-byte
transport packets. The first packet of a PES packet marks a random-access point and carries the clock reference; a
short last packet is filled by adaptation-field stuffing, so the payload comes back byte by byte.

Reading checks sync bytes, the tables' CRCs and every continuity counter, follows the program tables to the stream's
packets, reassembles the PES packets, and returns the payload with the timestamps and their random-access points. It
also takes tables over several packets, several programmes and streams, null packets, packets that carry an adaptation
field alone or are sent twice, indicated discontinuities, and PES packets of no stated length or without a timestamp.
All work on one document stays in its task; memory is about four times its size.

Defined results: a null text is an empty payload (64 zero bytes). Damaged streams raise ValueError. Repeated rows give
equal rows; columns beside doc_id and text aren't read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docloom.llm.shared import slices, table

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, STREAM_PID, PROGRAM = 0x0000, 0x1000, 0x0100, 1
#: Stream type 0x06 (PES packets of private data), stream id 0xBD (private stream 1).
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
PES_BYTES = 16384
#: 90 kHz ticks between PES packets: 25 a second.
TICKS = 3600
UNIT = 64


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    """CRC-32/MPEG-2, as program tables use it."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (5 + len(body) + 4), number, 0xC1, 0, 0)
    return head + body + struct.pack(">I", crc32_mpeg(head + body))


def _table_packet(pid: int, section: bytes) -> bytes:
    return struct.pack(">BHBB", SYNC, 0x4000 | pid, 0x10, 0) + section + b"\xff" * (PACKET - 5 - len(section))


_TABLES = _table_packet(PAT_PID, _section(0x00, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))) + _table_packet(
    PMT_PID, _section(0x02, PROGRAM, struct.pack(">HHBHH", 0xE000 | STREAM_PID, 0xF000, STREAM_TYPE, 0xE000 | STREAM_PID, 0xF000))
)


def _pts(t: int) -> bytes:
    return struct.pack(">BHH", 0x21 | (t >> 29) & 0x0E, (t >> 14) & 0xFFFE | 1, (t << 1) & 0xFFFE | 1)


def _pcr(t: int) -> bytes:
    return struct.pack(">IH", (t >> 1) & 0xFFFFFFFF, (t & 1) << 15 | 0x7E00)


def mux(payload: bytes) -> bytes:
    """The payload's transport stream."""
    out, counter = [_TABLES], 0
    for k, at in enumerate(range(0, len(payload), PES_BYTES)):
        part, t = payload[at : at + PES_BYTES], k * TICKS
        pes = struct.pack(">3sBHBBB", b"\0\0\1", STREAM_ID, len(part) + 8, 0x84, 0x80, 5) + _pts(t) + part
        field = b"\x50" + _pcr(t)  # random access and a clock reference
        first = min(len(pes), PACKET - 5 - len(field))
        fill = PACKET - 5 - len(field) - first
        out.append(struct.pack(">BHBB", SYNC, 0x4000 | STREAM_PID, 0x30 | counter & 15, len(field) + fill) + field + b"\xff" * fill + pes[:first])
        rest = pes[first:]
        full, last = divmod(len(rest), PACKET - 4)
        if full:
            packets = np.empty((full, PACKET), np.uint8)
            packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, STREAM_PID >> 8, STREAM_PID & 255
            packets[:, 3] = 0x10 | (counter + 1 + np.arange(full)) & 15
            packets[:, 4:] = np.frombuffer(rest, np.uint8, full * (PACKET - 4)).reshape(full, PACKET - 4)
            out.append(packets.tobytes())
        if last:
            room = PACKET - 4 - last  # at least one byte: the field's length
            field = bytes([room - 1]) + (b"\0" + b"\xff" * (room - 2) if room > 1 else b"")
            out.append(struct.pack(">BHB", SYNC, STREAM_PID, 0x30 | (counter + 1 + full) & 15) + field + rest[full * (PACKET - 4) :])
        counter += 1 + full + bool(last)
    return b"".join(out)


@dataclass
class Stream:
    payload: bytes
    #: Of each PES packet: its timestamp (null without one) and whether it starts at a random-access point.
    timestamps: list[int | None]
    random_access: list[bool]
    packets: int
    stream_type: int
    pid: int


@dataclass
class _Carried:
    """The payloads of a pid's packets, one after another, with each one's start and what its header says."""

    data: bytes
    at: np.ndarray
    starts: np.ndarray
    random_access: np.ndarray


def _carried(packets: np.ndarray) -> _Carried:
    """Check the counters of one pid. Packets without payload and those sent twice carry nothing."""
    has_field, has_payload = packets[:, 3] & 0x20 != 0, packets[:, 3] & 0x10 != 0
    size = np.where(has_field, packets[:, 4].astype(np.int32), 0)
    if (size > PACKET - 5).any():
        raise ValueError("an adaptation field longer than its packet")
    flags = np.where(size > 0, packets[:, 5], 0)
    # An indicated discontinuity holds for the next packet with a payload too.
    jump = flags & 0x80 != 0
    own, jump = packets[has_payload], np.logical_or.reduceat(jump, np.append(0, np.flatnonzero(has_payload)[:-1] + 1)) if has_payload.any() else jump[:0]
    flags, skip = flags[has_payload], np.where(has_field, 5 + size, 4)[has_payload]
    step = np.diff(own[:, 3] & 15) & 15
    again = np.append(False, (step == 0) & (own[1:, 4:] == own[:-1, 4:]).all(axis=1))
    if (~((step == 1) | again[1:] | jump[1:])).any() or (again[1:] & again[:-1]).any():
        raise ValueError("a continuity counter is wrong")
    own, flags, skip = own[~again], flags[~again], skip[~again]
    data = own[np.arange(PACKET) >= skip[:, None]].tobytes()
    return _Carried(data, np.concatenate(([0], np.cumsum(PACKET - skip))), np.flatnonzero(own[:, 1] & 0x40), flags & 0x40 != 0)


def _table(packets: np.ndarray, pids: np.ndarray, pid: int, table_id: int) -> tuple[int, bytes]:
    """Number and body of the first section in force, which may lie in several packets."""
    found = _carried(packets[pids == pid])
    for i in found.starts:
        body = found.data[found.at[i] :]
        body = body[1 + body[0] :] if body else body
        while len(body) >= 3 and body[0] != 0xFF:
            size = 3 + (struct.unpack(">H", body[1:3])[0] & 0x0FFF)
            if body[0] == table_id and len(body) >= size > 12:
                if crc32_mpeg(body[:size]):
                    raise ValueError(f"the table with pid {pid} has a wrong CRC")
                if body[5] & 1:
                    return struct.unpack(">H", body[3:5])[0], body[8 : size - 4]
            body = body[size:]
    raise ValueError(f"no table with pid {pid}")


def streams(media: bytes) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """The packets, their pids, and programme, type and pid of every elementary stream that the tables list."""
    if not media or len(media) % PACKET:
        raise ValueError("not a whole number of transport packets")
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any() or (packets[:, 1] & 0x80).any():
        raise ValueError("a packet without its sync byte, or marked as damaged")
    pids = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    _, programmes = _table(packets, pids, PAT_PID, 0x00)
    out = []
    for at in range(0, len(programmes) - 3, 4):
        number, pid = struct.unpack(">HH", programmes[at : at + 4])
        if number:  # 0 is the network's table
            _, body = _table(packets, pids, pid & 0x1FFF, 0x02)
            at_stream = 4 + (struct.unpack(">H", body[2:4])[0] & 0x0FFF)
            while at_stream + 5 <= len(body):
                kind, stream_pid, info = struct.unpack(">BHH", body[at_stream : at_stream + 5])
                out.append((number, kind, stream_pid & 0x1FFF))
                at_stream += 5 + (info & 0x0FFF)
    if not out:
        raise ValueError("no stream")
    return packets, pids, out


def demux(media: bytes, number: int = 0) -> Stream:
    """Parse the tables, check the counters, put the PES packets of the stream with this number in the tables together."""
    packets, pids, found = streams(media)
    _, kind, pid = found[number]
    own = _carried(packets[pids == pid])
    parts, times = [], []
    for i, j in zip(own.starts, [*own.starts[1:], len(own.at) - 1], strict=True):
        pes = own.data[own.at[i] : own.at[j]]
        size = struct.unpack(">H", pes[4:6])[0]  # 0: up to the next start
        if len(pes) < 14 or pes[:3] != b"\0\0\1" or size and len(pes) != 6 + size:
            raise ValueError("a broken PES packet")
        time = None
        if pes[7] & 0x80:
            a, b, c = struct.unpack(">BHH", pes[9:14])
            time = (a & 0x0E) << 29 | (b & 0xFFFE) << 14 | c >> 1
        times.append(time)
        parts.append(pes[9 + pes[8] :])
    return Stream(b"".join(parts), times, own.random_access[own.starts].tolist(), len(packets), kind, pid)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts = batch.column("text").to_pylist()
        cols: dict[str, list] = {k: [] for k in ("n_bytes", "media", "payload", "timestamps", "random_access")}
        for text in texts:
            raw = (text or "").encode()
            media = mux(padded(raw))
            stream = demux(media)
            for k, v in zip(cols, (len(raw), media, stream.payload, stream.timestamps, stream.random_access), strict=True):
                cols[k].append(v)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(cols[k], t) for k, t in (("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("timestamps", pa.list_(pa.int64())), ("random_access", pa.list_(pa.bool_()))))],
            ["doc_id", *cols],
        )


def store(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the stream), payload (read back), timestamps and random_access of each PES packet."""
    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(_read_back, f"doc_id {kind}, n_bytes long, media binary, payload binary, timestamps array<long>, random_access array<boolean>")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _read_back(batches):
        rows = batch.to_pylist()
        stored, back = [r["media"] for r in rows], [r["payload"] for r in rows]
        feature = [f"mpegts packets={len(m) // PACKET} pes={len(r['timestamps'])} random_access={sum(r['random_access'])} last_pts={r['timestamps'][-1]}" for m, r in zip(stored, rows, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("n_bytes"), pa.array([len(p) for p in back], pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p in back]), pa.array([zlib.crc32(p[-UNIT:]) for p in back], pa.int64()),
                pa.array([len(m) for m in stored], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in stored]), pa.array(feature),
            ],
            ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def digests(documents: DataFrame) -> DataFrame:
    """The digests of store()'s columns, without moving the media out of the task."""
    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(_digests, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op2_mpegts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
