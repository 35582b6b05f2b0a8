"""Media columns: MPEG transport streams (ISO/IEC 13818-1) written to and parsed from binary columns.

mux() carries a payload of 8-bit samples as one private elementary stream: access units of UNIT bytes, each in a packetised
elementary-stream packet with a presentation time stamp; at each random-access point the program tables are repeated and
the packet carries a clock reference. demux() parses streams of 188-byte packets: program association and map tables
(reassembled over packet borders, several in a packet, checksums verified, the latest version of each), continuity counters for each PID, elementary
packets reassembled over packet borders, time stamps with byte offsets and random-access flags.

A null text is carried like an empty one; demux of null is null. Packets without the sync byte, packets marked as damaged and a last packet cut short
are counted as sync errors and left out. A section with a wrong checksum, or one that doesn't end, is counted and ignored; so is one that isn't in force yet, without
being counted. A packet may be sent twice: the second one, of equal counter and payload, is left out and no error. Any other
step of the counter but one is a continuity error, unless the packet announces a discontinuity; the data are kept. An elementary stream without
any unit has an empty payload; a stream in several programs is listed in each. Texts are taken whole, however long; equal texts give equal streams; an empty table gives an
empty one. The columns that results go to are parameters and replace columns of that name.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostra.llm.staging import bound_batches, stage

PACKET = 188
SYNC = 0x47
PMT_PID, STREAM_PID = 0x1000, 0x0100
#: Payload bytes of one access unit, units between random-access points, samples a second, clock ticks a second.
UNIT, RAP_EVERY, RATE, CLOCK = 15_360, 8, 48_000, 90_000
#: A payload is padded with this byte to a positive multiple of FRAME.
PAD, FRAME = b" ", 192
_PRIVATE_TYPE, _PRIVATE_ID = 0x06, 0xBD


@functools.lru_cache(maxsize=1024)
def section_crc(data: bytes) -> int:
    """CRC-32 as program tables use it: polynomial 04C11DB7, not reflected, all ones at the start, no final inversion."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0) + body
    return head + struct.pack(">I", section_crc(head))


def _table_packet(pid: int, counter: int, section: bytes) -> bytes:
    head = struct.pack(">BHBB", SYNC, 0x4000 | pid, 0x10 | counter & 15, 0)
    return (head + section).ljust(PACKET, b"\xff")


_PAT = _section(0, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))
_PMT = _section(2, 1, struct.pack(">HH", 0xE000 | STREAM_PID, 0xF000) + struct.pack(">BHH", _PRIVATE_TYPE, 0xE000 | STREAM_PID, 0xF006) + b"\x05\x04PCM8")


def _stamp(ticks: int) -> bytes:
    return struct.pack(">BHH", 0x21 | (ticks >> 29) & 0x0E, (ticks >> 14) & 0xFFFE | 1, (ticks << 1) & 0xFFFE | 1)


def _unit_packets(data: bytes, counter: int, clock: int | None) -> bytes:
    """The transport packets of one elementary packet; a clock reference marks a random-access point."""
    field = b"" if clock is None else struct.pack(">BIH", 0x50, (clock >> 1) & 0xFFFFFFFF, (clock & 1) << 15 | 0x7E00)
    out, at, first = [], 0, True
    while first or at < len(data):
        room = 184 - (len(field) + 1 if first and field else 0)
        whole = (len(data) - at) // 184 if not (first and field) else 0
        if not first and whole > 1:  # the packets without an adaptation field, at once
            block = np.empty((whole, PACKET), np.uint8)
            block[:, 0], block[:, 1], block[:, 2] = SYNC, STREAM_PID >> 8, STREAM_PID & 255
            block[:, 3] = 0x10 | (counter + np.arange(whole)) & 15
            block[:, 4:] = np.frombuffer(data, np.uint8, whole * 184, at).reshape(whole, 184)
            out.append(block.tobytes())
            at, counter = at + whole * 184, counter + whole
            continue
        piece = data[at : at + room]
        own = field if first else b""
        if len(piece) < room and not own:
            spare = room - len(piece)
            adaptation = b"\x00" if spare == 1 else bytes([spare - 1, 0]) + b"\xff" * (spare - 2)
        elif own:
            stuffing = b"\xff" * (room - len(piece))
            adaptation = bytes([len(own) + len(stuffing)]) + own + stuffing
        else:
            adaptation = b""
        out.append(struct.pack(">BHB", SYNC, (0x4000 if first else 0) | STREAM_PID, (0x30 if adaptation else 0x10) | counter & 15) + adaptation + piece)
        at, counter, first = at + len(piece), counter + 1, False
    return b"".join(out)


def mux(payload: bytes, unit: int = UNIT) -> bytes:
    """A transport stream that carries the payload."""
    out, counter = [], 0
    for k, at in enumerate(range(0, len(payload), unit)):
        rap = k % RAP_EVERY == 0
        if rap:
            out += [_table_packet(0, k // RAP_EVERY, _PAT), _table_packet(PMT_PID, k // RAP_EVERY, _PMT)]
        samples = payload[at : at + unit]
        ticks = at * CLOCK // RATE
        head = b"\x00\x00\x01" + struct.pack(">BHBBB", _PRIVATE_ID, 8 + len(samples), 0x84, 0x80, 5) + _stamp(ticks)
        packets = _unit_packets(head + samples, counter, ticks if rap else None)
        counter += len(packets) // PACKET
        out.append(packets)
    return b"".join(out)


@dataclass
class Unit:
    """An elementary packet: PID, time stamp (None: not given), byte offset in the stream, payload size, random access."""

    pid: int
    pts: int | None
    offset: int
    size: int
    random_access: bool


@dataclass
class Stream:
    pid: int
    kind: int
    packets: int = 0
    continuity_errors: int = 0
    payload: bytes = b""


@dataclass
class Parsed:
    programs: list[tuple[int, int, int]] = field(default_factory=list)  # number, PID of the map, PID of the clock
    streams: list[Stream] = field(default_factory=list)
    units: list[Unit] = field(default_factory=list)
    packets: int = 0
    sync_errors: int = 0
    table_errors: int = 0


def _kept(rows: np.ndarray) -> np.ndarray:
    """Which packets of one PID, all with payload, are no repeats of the one before."""
    same = np.zeros(len(rows), bool)
    same[1:] = (rows[1:, 3] & 15 == rows[:-1, 3] & 15) & (rows[1:, 4:] == rows[:-1, 4:]).all(axis=1)
    same[1:] &= ~same[:-1]  # a packet may be repeated once
    return ~same


def _gaps(rows: np.ndarray) -> np.ndarray:
    """Which packets of one PID, repeats left out, don't follow the one before by their counter; an announced discontinuity is none."""
    gap = np.zeros(len(rows), bool)
    gap[1:] = (rows[1:, 3] - rows[:-1, 3] & 15) != 1
    announced = (rows[:, 3] & 0x20 > 0) & (rows[:, 4] > 0) & (rows[:, 5] & 0x80 > 0)
    return gap & ~announced


def _sections(rows: np.ndarray, starts: np.ndarray, table_id: int, parsed: Parsed) -> list[bytes]:
    """The valid sections of a table in force that the packets of one PID hold, in order, each distinct one once."""
    found: dict[bytes, None] = {}
    held = b""  # of a section that goes on

    def take(data: bytes) -> bytes:
        """Keep the whole sections at the begin of data; returns the rest of one that goes on."""
        while data and data[0] != 0xFF:  # what follows the last section is filled up with ones
            size = 3 + (int.from_bytes(data[1:3]) & 0x0FFF) if len(data) >= 3 else len(data) + 1
            if size > len(data):
                return data
            section, data = data[:size], data[size:]
            if size < 12 or section_crc(section[:-4]) != int.from_bytes(section[-4:]):
                parsed.table_errors += 1
            elif section[0] == table_id and section[5] & 1:
                found.pop(section, None)
                found[section] = None
        return b""

    for row, start, gap in zip(rows, starts, _gaps(rows), strict=True):
        payload = row[start:].tobytes()
        if gap and held:
            parsed.table_errors += 1
            held = b""
        if not row[1] & 0x40:
            held = take(held + payload) if held else held
        elif payload:
            if held and take(held + payload[1 : 1 + payload[0]]):
                parsed.table_errors += 1
            held = take(payload[1 + payload[0] :])
    parsed.table_errors += bool(held)
    return list(found)


def demux(media: bytes) -> Parsed:
    """Everything the transport stream holds."""
    parsed = Parsed()
    whole = len(media) // PACKET
    rows = np.frombuffer(media, np.uint8, whole * PACKET).reshape(whole, PACKET)
    good = (rows[:, 0] == SYNC) & (rows[:, 1] & 0x80 == 0)
    parsed.sync_errors = int(whole - good.sum()) + (len(media) % PACKET > 0)
    offsets = np.flatnonzero(good) * PACKET
    rows = rows[good]
    parsed.packets = len(rows)
    pids = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    control = rows[:, 3] >> 4 & 3
    starts = np.minimum(np.where(control & 2 > 0, 5 + rows[:, 4].astype(np.int32), 4), PACKET)

    def of(pid: int) -> np.ndarray:
        own = np.flatnonzero((pids == pid) & (control & 1 > 0))
        return own[_kept(rows[own])] if len(own) else own

    def table(pid: int, table_id: int) -> dict[tuple[int, int], bytes]:
        """The sections of the latest version of each table of a PID, by (number of the table, number of the section)."""
        latest: dict[tuple[int, int], bytes] = {}
        for section in _sections(rows[of(pid)], starts[of(pid)], table_id, parsed):
            number = int.from_bytes(section[3:5])
            for key in [k for k, old in latest.items() if k[0] == number and (old[5] ^ section[5]) & 0x3E]:
                del latest[key]
            latest[number, section[6]] = section
        return latest

    maps: dict[int, dict[tuple[int, int], bytes]] = {}
    for section in table(0, 0).values():
        for at in range(8, len(section) - 4, 4):
            number, pid = (x & mask for x, mask in zip(struct.unpack_from(">HH", section, at), (0xFFFF, 0x1FFF), strict=True))
            if not number:
                continue
            if pid not in maps:
                maps[pid] = table(pid, 2)
            for (program, _), own in maps[pid].items():
                if program != number:
                    continue
                clock, info = struct.unpack_from(">HH", own, 8)
                parsed.programs.append((number, pid, clock & 0x1FFF))
                at_stream = 12 + (info & 0x0FFF)
                while at_stream + 5 <= len(own) - 4:
                    kind, elementary, extra = struct.unpack_from(">BHH", own, at_stream)
                    mine = of(elementary & 0x1FFF)
                    parsed.streams.append(_elementary(Stream(elementary & 0x1FFF, kind), rows[mine], control[mine], starts[mine], offsets[mine], parsed))
                    at_stream += 5 + (extra & 0x0FFF)
    return parsed


def _elementary(stream: Stream, mine: np.ndarray, control: np.ndarray, begin: np.ndarray, offsets: np.ndarray, parsed: Parsed) -> Stream:
    """Reassemble the elementary packets of one PID's packets; counts them and their continuity errors and appends their units."""
    stream.packets = len(mine)
    if not len(mine):
        return stream
    stream.continuity_errors = int(_gaps(mine).sum())
    data = mine[np.arange(PACKET) >= begin[:, None]].tobytes()
    places = np.concatenate([[0], np.cumsum(PACKET - begin)])
    heads = np.flatnonzero(mine[:, 1] & 0x40)
    pieces = []
    for k, head in enumerate(heads):
        at, end = int(places[head]), int(places[heads[k + 1]] if k + 1 < len(heads) else places[-1])
        if end - at < 9 or data[at : at + 3] != b"\x00\x00\x01":
            parsed.table_errors += 1
            continue
        length = int.from_bytes(data[at + 4 : at + 6])
        body = at + 9 + data[at + 8]
        end = min(end, at + 6 + length) if length else end
        stamp = None
        if data[at + 7] & 0x80 and body - at >= 14:
            a, b, c = struct.unpack_from(">BHH", data, at + 9)
            stamp = (a >> 1 & 7) << 30 | b >> 1 << 15 | c >> 1
        marked = bool(control[head] & 2 and mine[head, 4] and mine[head, 5] & 0x40)
        parsed.units.append(Unit(stream.pid, stamp, int(offsets[head]), max(0, end - body), marked))
        pieces.append(data[body:end])
    stream.payload = b"".join(pieces)
    return stream


MEDIA_SCHEMA = (
    "struct<programs:array<struct<number:int,map_pid:int,clock_pid:int>>,"
    "streams:array<struct<pid:int,kind:int,packets:long,continuity_errors:long,payload:binary>>,"
    "units:array<struct<pid:int,pts:long,offset:long,size:long,random_access:boolean>>,"
    "packets:long,sync_errors:long,table_errors:long>"
)
_STREAMS = pa.struct(
    [
        ("programs", pa.list_(pa.struct([("number", pa.int32()), ("map_pid", pa.int32()), ("clock_pid", pa.int32())]))),
        ("streams", pa.list_(pa.struct([("pid", pa.int32()), ("kind", pa.int32()), ("packets", pa.int64()), ("continuity_errors", pa.int64()), ("payload", pa.binary())]))),
        ("units", pa.list_(pa.struct([("pid", pa.int32()), ("pts", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("random_access", pa.bool_())]))),
        ("packets", pa.int64()),
        ("sync_errors", pa.int64()),
        ("table_errors", pa.int64()),
    ]
)


def padded(text: bytes) -> bytes:
    """The text with PAD appended up to a positive multiple of FRAME bytes."""
    return text.ljust(max(1, -(-len(text) // FRAME)) * FRAME, PAD)


def _arrow(f, kind: str):
    f.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(f, kind)


def write_media(df: DataFrame, text: str = "text", column: str = "media") -> DataFrame:
    """df with a transport stream of each whole text (null: empty text) in a binary column."""
    bound_batches(df.sparkSession)

    def run(values: pa.Array) -> pa.Array:
        return pa.array([mux(padded(t or b"")) for t in values.cast(pa.binary()).to_pylist()], pa.binary())

    return df.withColumn(column, _arrow(run, "binary")(F.col(text)))


def read_media(df: DataFrame, media: str = "media", column: str = "parsed") -> DataFrame:
    """df with all that a binary column of transport streams holds, as a struct (MEDIA_SCHEMA)."""
    bound_batches(df.sparkSession)

    def row(m: bytes) -> dict:
        p = demux(m)
        return {
            "programs": [dict(zip(("number", "map_pid", "clock_pid"), x, strict=True)) for x in p.programs],
            "streams": [vars(s) for s in p.streams],
            "units": [vars(u) for u in p.units],
            "packets": p.packets,
            "sync_errors": p.sync_errors,
            "table_errors": p.table_errors,
        }

    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if m is None else row(m) for m in values.to_pylist()], _STREAMS)

    return df.withColumn(column, _arrow(run, MEDIA_SCHEMA)(F.col(media)))


_DIGEST = "struct<payload_bytes:long,payload_sha256:string,tail_crc32:long,media_bytes:long,media_sha256:string,feature:string>"


def digest(media: bytes) -> tuple:
    """Sizes and checksums of a stored stream and of the payload read back from it, and its features as text."""
    p = demux(media)
    payload = b"".join(s.payload for s in p.streams)
    stamps = [u.pts for u in p.units if u.pts is not None]
    samples = np.frombuffer(payload, np.uint8)
    feature = ";".join(
        [
            f"programs={len(p.programs)}",
            f"streams={','.join(f'{s.pid}:{s.kind}' for s in p.streams)}",
            f"packets={p.packets}",
            f"units={len(p.units)}",
            f"random_access={','.join(str(u.offset) for u in p.units if u.random_access)}",
            f"pts={min(stamps, default=-1)}..{max(stamps, default=-1)}",
            f"continuity_errors={sum(s.continuity_errors for s in p.streams)}",
            f"errors={p.sync_errors + p.table_errors}",
            f"level={int(samples.sum(dtype=np.int64)) // max(1, len(samples))}",
        ]
    )
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature


def digests(df: DataFrame, media: str = "media", column: str = "digest") -> DataFrame:
    """df with digest() of a binary column of transport streams, as a struct; null media: null."""
    bound_batches(df.sparkSession)
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(values: pa.Array) -> pa.Array:
        rows = [None if m is None else dict(zip(names, digest(m), strict=True)) for m in values.to_pylist()]
        return pa.array(rows, pa.struct(list(zip(names, kinds, strict=True))))

    return df.withColumn(column, _arrow(run, _DIGEST)(F.col(media)))


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of every document, written to the shared folder and read back."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return stage(write_media(rows).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "media"), "media")
