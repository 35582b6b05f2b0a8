import hashlib
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from rostra.llm import transport as T
from tests.llm.data import docs, texts


@settings(deadline=None, max_examples=60)
@given(st.binary(max_size=700) | st.integers(1, 700).map(lambda n: bytes(n % 251 for _ in range(n * 97))))
def test_round_trip(data):
    media = T.mux(data)
    p = T.demux(media)
    assert len(media) % T.PACKET == 0 and b"".join(s.payload for s in p.streams) == data
    assert p.sync_errors == p.table_errors == 0 and all(s.continuity_errors == 0 for s in p.streams)


def test_tables_stamps_and_random_access():
    data = bytes(range(256)) * 1200
    p = T.demux(T.mux(data))
    assert p.programs == [(1, T.PMT_PID, T.STREAM_PID)] and [(s.pid, s.kind) for s in p.streams] == [(T.STREAM_PID, 6)]
    assert [u.pts for u in p.units] == [k * T.UNIT * T.CLOCK // T.RATE for k in range(len(p.units))]
    assert [k for k, u in enumerate(p.units) if u.random_access] == list(range(0, len(p.units), T.RAP_EVERY))
    assert all(T.mux(data)[u.offset] == T.SYNC for u in p.units) and sum(u.size for u in p.units) == len(data)


def test_damage_is_counted():
    media = T.mux(bytes(5000))
    rows = [media[k : k + 188] for k in range(0, len(media), 188)]
    lost = T.demux(b"".join(rows[:5] + rows[6:]))
    assert lost.streams[0].continuity_errors == 1
    unsynced = T.demux(b"".join([*rows[:5], b"x" + rows[5][1:], *rows[6:], b"tail"]))
    assert unsynced.sync_errors == 2
    broken = T.demux(rows[0][:10] + b"\x00" + rows[0][11:] + b"".join(rows[1:]))
    assert broken.table_errors == 1 and not broken.streams
    assert T.demux(b"").packets == 0 and T.section_crc(b"123456789") == 0x0376E6E7


def test_table(spark):
    table = docs(spark)
    got = {}
    for r in T.digests(T.store(table)).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, text in texts():
        raw = (text or "").encode()
        full = raw + b" " * (-len(raw) % 192 or (192 if not raw else 0))
        mine = [r for r in got[i] if r.n_bytes == len(raw)][0]
        assert (mine.digest.payload_bytes, mine.digest.payload_sha256) == (len(full), hashlib.sha256(full).hexdigest())
        assert mine.digest.tail_crc32 == zlib.crc32(full[-16:]) and mine.digest.media_bytes % 188 == 0
        assert "continuity_errors=0;errors=0" in mine.digest.feature
    parsed = T.read_media(T.write_media(table.where("doc_id = 21"))).first().parsed
    assert parsed.streams[0].payload.rstrip() == dict(texts())[21].encode() and parsed.units[0].random_access
    assert T.digests(T.store(docs(spark, []))).count() == 0


def packets(media):
    return [media[k : k + 188] for k in range(0, len(media), 188)]


def of(media, pid):
    return [k for k, p in enumerate(packets(media)) if (p[1] & 0x1F) << 8 | p[2] == pid]


def test_repeated_packets_and_announced_jumps():
    data = bytes(k % 251 for k in range(200_000))
    media = T.mux(data)
    rows, own = packets(media), of(media, T.STREAM_PID)
    twice = [q for k, p in enumerate(rows) for q in ([p, p] if k in own[2::7] or k == 0 else [p])]
    p = T.demux(b"".join(twice))
    assert p.streams[0].payload == data and p.streams[0].continuity_errors == 0 and p.table_errors == 0
    thrice = T.demux(b"".join(rows[: own[3]] + [rows[own[3]]] * 3 + rows[own[3] + 1 :]))
    assert thrice.streams[0].continuity_errors == 1
    # A jump of the counter at a random-access point, whose adaptation field announces it.
    at = own[[k for k, o in enumerate(own) if rows[o][3] & 0x20 and rows[o][5] & 0x40][-1]]
    jumped = [bytearray(p) for p in rows]
    for k in own[own.index(at) :]:
        jumped[k][3] = jumped[k][3] & 0xF0 | (jumped[k][3] + 5) & 15
    assert T.demux(b"".join(jumped)).streams[0].continuity_errors == 1
    jumped[at][5] |= 0x80
    p = T.demux(b"".join(jumped))
    assert p.streams[0].continuity_errors == 0 and p.streams[0].payload == data


def in_packets(pid, sections, first=0):
    """Sections one after the other over as many packets as they take."""
    data, out, starts, at = b"".join(sections), [], [], 0
    for s in sections:
        starts.append(at)
        at += len(s)
    at = 0
    while at < len(data):
        begins = [s for s in starts if at <= s < at + 183]
        head = bytes([T.SYNC, (0x40 if begins else 0) | pid >> 8, pid & 255, 0x10 | (first + len(out)) & 15]) + (bytes([begins[0] - at]) if begins else b"")
        piece = data[at : at + 188 - len(head)]
        out.append((head + piece).ljust(188, b"\xff"))
        at += len(piece)
    return out


def test_long_tables_several_sections_and_programs():
    """A map longer than a packet, two programs' maps on one PID, several sections in a packet, a newer version, one not in force, one cut off."""
    stream = lambda pid: bytes([6, 0xE0 | pid >> 8, pid & 255, 0xF0, 0])
    first = T._section(2, 1, b"\xe1\x00\xf0\x00" + b"".join(stream(0x100 + k) for k in range(90)))
    second = T._section(2, 2, b"\xe2\x00\xf0\x00" + stream(0x200))
    newer = bytearray(T._section(2, 2, b"\xe2\x00\xf0\x00" + stream(0x201)))
    newer[5] = 0xC3
    newer = bytes(newer[:-4]) + T.section_crc(bytes(newer[:-4])).to_bytes(4)
    later = bytearray(T._section(2, 2, b"\xe2\x00\xf0\x00" + stream(0x202)))
    later[5] = 0xC4
    later = bytes(later[:-4]) + T.section_crc(bytes(later[:-4])).to_bytes(4)
    programs = T._section(0, 1, b"".join(bytes([0, n, 0xF0, 0]) for n in (1, 2)) + b"\x00\x00\xe0\x10")
    tables = in_packets(0, [programs]) + in_packets(T.PMT_PID, [second, first, newer, later])
    data = bytes(range(200)) * 30
    media = b"".join(tables + [p for p in packets(T.mux(data)) if (p[1] & 0x1F) << 8 | p[2] == T.STREAM_PID])
    p = T.demux(media)
    assert p.table_errors == 0 and p.programs == [(1, T.PMT_PID, 0x100), (2, T.PMT_PID, 0x200)]
    assert [s.pid for s in p.streams] == [*range(0x100, 0x100 + 90), 0x201] and p.streams[0].payload == data
    cut = tables[:-1] if len(first) > 180 else tables
    assert T.demux(b"".join(cut)).table_errors == 1
    lost = T.demux(b"".join([tables[0], *tables[2:]]))
    assert (1, T.PMT_PID, 0x100) not in lost.programs


def test_clashing_columns_and_very_long_text(spark):
    table = docs(spark, [(1, "x" * 5_000_000), (1, "x" * 5_000_000), (2, None)]).selectExpr("*", "1 AS media", "2 AS digest", "3 AS n_bytes")
    rows = T.digests(T.store(table)).collect()
    assert sorted(r.digest.payload_bytes for r in rows) == [192, 5_000_064, 5_000_064] and rows[0].digest == rows[1].digest or rows[1].digest == rows[2].digest
