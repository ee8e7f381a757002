"""Transport streams: round trips, and streams that are damaged."""

import os
import random
import zlib

from recollect.llm import mpegts, queries
from recollect.llm.mpegts import PACKET, parse, seek, store


def test_round_trips():
    for n in [*range(0, 380), 2047, 2048, 2049, 2048 * 8, 2048 * 9 + 5, 70_000]:
        data = os.urandom(n)
        stream = store(data)
        got = parse(stream)
        assert got.samples == data and len(stream) % PACKET == 0
        assert (got.lost, got.repeated, got.broken) == (0, 0, 0)
        assert [u[3] for u in got.units] == [k % 8 == 0 for k in range(-(-n // 2048))]
        assert [u[0] for u in got.units] == [k * mpegts.UNIT_TICKS for k in range(len(got.units))]


def test_damage():
    stream = store(os.urandom(6000))
    lost = parse(stream[: PACKET * 5] + stream[PACKET * 6 :])
    assert lost.lost == 1 and lost.broken == 1
    twice = parse(stream[: PACKET * 6] + stream[PACKET * 5 :])
    assert twice.repeated == 1 and twice.samples == parse(stream).samples
    bad_table = bytearray(stream)
    bad_table[20] ^= 1
    assert parse(bytes(bad_table)).broken == 1
    assert parse(None).samples == parse(b"").samples == parse(b"\0" * 400).samples == b""
    r = random.Random(1)
    for _ in range(300):  # nothing crashes
        damaged = bytearray(stream[: r.randrange(len(stream))])
        for _ in range(r.randrange(30)):
            if damaged:
                damaged[r.randrange(len(damaged))] = r.randrange(256)
        parse(bytes(damaged))


def test_seek():
    units = parse(store(bytes(2048 * 20))).units
    assert seek(units, 0) == 0
    assert seek(units, 9 * mpegts.UNIT_TICKS) == 8 * 2048
    assert seek(units, 10**9) == 16 * 2048


def test_query(spark, tmp_path):
    texts = [None, "", "a" * 64, "é" * 100, "x" * 5000, "x" * 5000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in queries.op9_mpegts(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert (rows[i]["n_bytes"], rows[i]["payload_bytes"], rows[i]["tail_crc32"]) == (len(data), len(payload), zlib.crc32(payload[-64:]))
        assert rows[i]["media_bytes"] == len(store(payload))
    assert [c for c in rows[4] if c != 4] == [c for c in rows[5] if c != 5]


# a reader and a writer of their own, from the public standard (ISO/IEC 13818-1), as plainly as can be


def demuxed(stream):
    """PID -> joined payloads by packet start, in order, and each PES packet's (PTS, data, random access)."""
    tables, pes, access = {}, {}, {}
    for at in range(0, len(stream), 188):
        packet = stream[at : at + 188]
        assert len(packet) == 188 and packet[0] == 0x47
        pid, start, control = (packet[1] & 0x1F) << 8 | packet[2], packet[1] >> 6 & 1, packet[3] >> 4 & 3
        body, point = packet[4:], False
        if control & 2:
            point = bool(body[0] and body[1] & 0x40)
            body = body[1 + body[0] :]
        if not control & 1:
            continue
        if pid in (0, 0x100):
            if start:
                tables.setdefault(pid, []).append(body[1 + body[0] :])
            continue
        if start:
            pes.setdefault(pid, []).append(b"")
            access.setdefault(pid, []).append(point)
        pes[pid][-1] += body
    units = {}
    for pid, packets in pes.items():
        for data, point in zip(packets, access[pid], strict=True):
            assert data[:3] == b"\0\0\1" and data[6] >> 6 == 2
            length = int.from_bytes(data[4:6], "big")
            head = data[8]
            p = data[9:14]
            pts = (p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1 if data[7] & 0x80 else None
            payload = data[9 + head : 6 + length] if length else data[9 + head :]
            units.setdefault(pid, []).append((pts, payload, point))
    return tables, units


def test_another_reader_finds_the_samples():
    for n in (1, 64, 500, 2048, 2049, 40_000):
        data = os.urandom(n)
        tables, units = demuxed(store(data))
        assert set(tables) == {0, 0x100} and len(units) == 1
        for section in tables[0] + tables[0x100]:
            size = 3 + ((section[1] & 0xF) << 8 | section[2])
            crc = 0xFFFFFFFF
            for byte in section[:size]:  # over a whole section, its CRC included, nothing is left
                crc ^= byte << 24
                for _ in range(8):
                    crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
            assert crc == 0
        (own,) = units.values()
        assert b"".join(x for _, x, _ in own) == data
        assert [t for t, _, _ in own] == [k * 23040 for k in range(-(-n // 2048))]  # 2,048 samples at 8 kHz in 90 kHz ticks
        assert [p for _, _, p in own] == [k % 8 == 0 for k in range(-(-n // 2048))]


def crc(data):
    value = 0xFFFFFFFF
    for byte in data:
        value ^= byte << 24
        for _ in range(8):
            value = (value << 1 ^ 0x04C11DB7 if value >> 31 else value << 1) & 0xFFFFFFFF
    return value.to_bytes(4, "big")


def test_a_stream_of_another_writer():
    """Other PIDs, table numbers and packet sizes than the operator's own, with stuffing and a foreign stream between."""

    def section(table, number, body):
        head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0"
        return head + body + crc(head + body)

    def packet(pid, start, counter, data, point=False):
        room = 184 - len(data)
        if room or point:
            flags = bytes([0x40 if point else 0]) if room > 1 else b""
            field = bytes([room - 1]) + flags + b"\xff" * (room - 1 - len(flags))
            return bytes([0x47, start << 6 | pid >> 8, pid & 255, 0x30 | counter]) + field + data
        return bytes([0x47, start << 6 | pid >> 8, pid & 255, 0x10 | counter]) + data

    pmt, es = 0x50, 0x1AB
    out = packet(0, 1, 3, b"\0" + section(0, 9, (4).to_bytes(2, "big") + (0xE000 | pmt).to_bytes(2, "big")))
    out += packet(pmt, 1, 8, b"\0" + section(2, 4, (0xE000 | es).to_bytes(2, "big") + b"\xf0\0" + b"\x06" + (0xE000 | es).to_bytes(2, "big") + b"\xf0\0"))
    counter, want = 5, b""
    for k, size in enumerate((30, 170, 900)):
        data = bytes((7 * k + i) % 251 for i in range(size))
        t = 1000 + 5000 * k
        stamp = bytes([0x21 | t >> 29 & 14, t >> 22 & 255, t >> 14 & 254 | 1, t >> 7 & 255, t << 1 & 254 | 1])
        pes = b"\0\0\1\xbd" + (len(data) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + stamp + data
        want += data
        begins = True
        while pes:
            take = 150 if begins else 184
            out += packet(es, begins, counter & 15, pes[:take], point=begins and k != 1)
            out += packet(0x1FFF, 0, 0, b"\0" * 184)
            pes, begins, counter = pes[take:], False, counter + 1
    got = parse(out)
    assert got.samples == want and (got.lost, got.repeated, got.broken) == (0, 0, 0)
    assert [(u[0], u[3]) for u in got.units] == [(1000, True), (6000, False), (11000, True)]
