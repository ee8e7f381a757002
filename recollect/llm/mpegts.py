"""Media columns: byte samples in MPEG transport streams.

``store`` writes 8-bit samples as one private elementary stream: access units of 2,048
samples become PES packets with presentation timestamps, every eighth unit is a
random-access point, and program tables stand before each of those.  ``parse`` reads any
transport stream: it follows the program association table to the program maps and the
elementary streams, checks continuity counters, reassembles the PES packets and returns
their timestamps and random-access points.

Defined results: null samples count as none and give a stream of program tables alone;
a stream that is null, or in which no packet is in order, parses to empty samples, no
units and its errors; lost or repeated packets are counted, and a repeated packet is used
once; rows that repeat are independent; carried columns keep their values.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from recollect.shipping import ship
from recollect.llm.textbatch import pieces

PACKET, SYNC = 188, 0x47
MAP_PID, STREAM_PID, NULL_PID = 0x100, 0x101, 0x1FFF
PRIVATE_DATA, PRIVATE_STREAM = 0x06, 0xBD
UNIT_SAMPLES, UNITS_A_POINT = 2048, 8
#: 90 kHz ticks of a unit at 8,000 samples a second.
UNIT_TICKS = UNIT_SAMPLES * 90_000 // 8_000
TIME_BITS = (1 << 33) - 1


def _crc_table() -> list[int]:
    """MPEG-2's CRC-32: polynomial 0x04C11DB7, most significant bit first."""
    out = []
    for byte in range(256):
        crc = byte << 24
        for _ in range(8):
            crc = (crc << 1 & 0xFFFFFFFF) ^ (0x04C11DB7 if crc >> 31 else 0)
        out.append(crc)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc = (crc << 8 & 0xFFFFFFFF) ^ _CRC[crc >> 24 ^ byte]
    return crc


def _table(pid: int, table_id: int, number: int, body: bytes) -> tuple[int, bytes]:
    """A program table's PID and the packet content behind the header."""
    length = len(body) + 9
    section = bytes([table_id, 0xB0 | length >> 8, length & 0xFF, number >> 8, number & 0xFF, 0xC1, 0, 0]) + body
    section += section_crc(section).to_bytes(4, "big")
    return pid, (b"\0" + section).ljust(PACKET - 4, b"\xff")


_ASSOCIATION = _table(0, 0, 1, bytes([0, 1, 0xE0 | MAP_PID >> 8, MAP_PID & 0xFF]))
_MAP = _table(MAP_PID, 2, 1, bytes([0xE0 | STREAM_PID >> 8, STREAM_PID & 0xFF, 0xF0, 0, PRIVATE_DATA, 0xE0 | STREAM_PID >> 8, STREAM_PID & 0xFF, 0xF0, 0]))


def _time(prefix: int, t: int) -> bytes:
    """A timestamp's 33 bits between marker bits."""
    return bytes([prefix << 4 | t >> 29 & 0x0E | 1, t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, t << 1 & 0xFE | 1])


def store(samples: bytes) -> bytes:
    """The samples as a transport stream."""
    out: list[bytes] = []
    counters = {0: 0, MAP_PID: 0, STREAM_PID: 0}

    def head(pid: int, begins: bool, control: int) -> bytes:
        counter = counters[pid]
        counters[pid] = counter + 1 & 0x0F
        return bytes([SYNC, begins << 6 | pid >> 8, pid & 0xFF, control << 4 | counter])

    def tables() -> None:
        for pid, content in (_ASSOCIATION, _MAP):
            out.extend((head(pid, True, 1), content))

    if not samples:
        tables()
    for k in range(0, -(-len(samples) // UNIT_SAMPLES)):
        unit = samples[k * UNIT_SAMPLES : (k + 1) * UNIT_SAMPLES]
        pts = k * UNIT_TICKS & TIME_BITS
        point = k % UNITS_A_POINT == 0
        if point:
            tables()
        length = len(unit) + 8
        data = bytes([0, 0, 1, PRIVATE_STREAM, length >> 8, length & 0xFF, 0x84, 0x80, 5]) + _time(2, pts) + unit
        # the first packet of a random-access unit has the indicator and a clock reference
        field_ = bytes([0x50, pts >> 25 & 0xFF, pts >> 17 & 0xFF, pts >> 9 & 0xFF, pts >> 1 & 0xFF, (pts & 1) << 7 | 0x7E, 0]) if point else b""
        at = 0
        while at < len(data):
            room = PACKET - 4 - (len(field_) + 1 if field_ else 0)
            left = len(data) - at
            if left >= room:
                part = data[at : at + room]
                adapt = bytes([len(field_)]) + field_ if field_ else b""
            else:
                part = data[at:]
                size = PACKET - 4 - left
                adapt = b"\0" if size == 1 else bytes([size - 1]) + (field_ or b"\0").ljust(size - 1, b"\xff")
            out.extend((head(STREAM_PID, at == 0, 3 if adapt else 1), adapt, part))
            at += len(part)
            field_ = b""
    return b"".join(out)


@dataclass
class Parsed:
    samples: bytes = b""
    #: (timestamp or None, offset, size, random access) of every unit of the first elementary stream
    units: list[tuple[int | None, int, int, bool]] = field(default_factory=list)
    n_packets: int = 0
    #: packets that are lost by the continuity counters, repeated packets, packets or sections out of order
    lost: int = 0
    repeated: int = 0
    broken: int = 0
    #: PID -> stream type
    streams: dict[int, int] = field(default_factory=dict)


def _section(payload: bytes) -> bytes | None:
    """The table body of a payload that begins with a whole, intact section."""
    at = payload[0] + 1
    length = (payload[at + 1] & 0x0F) << 8 | payload[at + 2]
    whole = payload[at : at + 3 + length]
    if len(whole) < 3 + length or length < 9 or section_crc(whole):
        return None
    return whole


_intact: dict[bytes, bytes | None] = {}


def _read_section(payload: bytes) -> bytes | None:
    """Program tables are few and repeat, so a section is checked once."""
    if payload not in _intact:
        if len(_intact) > 1000:
            _intact.clear()
        try:
            _intact[payload] = _section(payload)
        except IndexError:
            _intact[payload] = None
    return _intact[payload]


def parse(stream: bytes | None) -> Parsed:
    """The first elementary stream's samples and units, and what is wrong with the packets."""
    out = Parsed()
    if not stream:
        return out
    out.broken += len(stream) % PACKET != 0
    maps: set[int] = set()
    last: dict[int, int] = {}
    units: dict[int, list[tuple[bool, list[bytes]]]] = defaultdict(list)
    for at in range(0, len(stream) - PACKET + 1, PACKET):
        sync, high, low, control = stream[at : at + 4]
        out.n_packets += 1
        if sync != SYNC or high & 0x80:
            out.broken += 1
            continue
        pid = (high & 0x1F) << 8 | low
        if pid == NULL_PID:  # filling, without a counter
            continue
        begin, access = at + 4, False
        if control & 0x20:
            size = stream[begin]
            if size > PACKET - 5:
                out.broken += 1
                continue
            access = size > 0 and bool(stream[begin + 1] & 0x40)
            begin += 1 + size
        if not control & 0x10:
            continue
        counter = control & 0x0F
        if (before := last.get(pid)) is not None:
            if counter == before:
                out.repeated += 1
                continue
            out.lost += counter - before - 1 & 0x0F
        last[pid] = counter
        payload = stream[begin : at + PACKET]
        if pid == 0 or pid in maps:
            if not high & 0x40:
                continue
            if (table := _read_section(payload)) is None:
                out.broken += 1
            elif pid == 0 and table[0] == 0:
                maps |= {(table[k + 2] & 0x1F) << 8 | table[k + 3] for k in range(8, len(table) - 4, 4) if table[k] or table[k + 1]}
            elif table[0] == 2:
                k = 12 + ((table[10] & 0x0F) << 8 | table[11])
                while k < len(table) - 4:
                    out.streams[(table[k + 1] & 0x1F) << 8 | table[k + 2]] = table[k]
                    k += 5 + ((table[k + 3] & 0x0F) << 8 | table[k + 4])
        elif pid in out.streams:
            if high & 0x40:
                units[pid].append((access, [payload]))
            elif units[pid]:
                units[pid][-1][1].append(payload)
    if not out.streams:
        return out
    samples, total = [], 0
    for access, parts in units[min(out.streams)]:
        data = b"".join(parts)
        if len(data) < 9 or data[:3] != b"\0\0\1":
            out.broken += 1
            continue
        length = data[4] << 8 | data[5]
        pts = None
        if data[7] & 0x80:
            a, b, c, d, e = data[9:14]
            pts = (a >> 1 & 7) << 30 | b << 22 | c >> 1 << 15 | d << 7 | e >> 1
        part = data[9 + data[8] : 6 + length if length else None]
        out.broken += length > 0 and len(data) < 6 + length
        out.units.append((pts, total, len(part), access))
        samples.append(part)
        total += len(part)
    out.samples = b"".join(samples)
    return out


def seek(units: Sequence[tuple[int | None, int, int, bool]], pts: int) -> int:
    """The sample offset of the last random-access point at or before a timestamp."""
    return max((offset for t, offset, _, access in units if access and t is not None and t <= pts), default=0)


def feature(parsed: Parsed) -> str:
    """A short description of what was read back."""
    times = [t for t, *_ in parsed.units if t is not None]
    data = np.frombuffer(parsed.samples, np.uint8)
    mean = f"{data.mean():.4f}" if len(data) else "-"
    return f"packets={parsed.n_packets} units={len(parsed.units)} points={sum(u[3] for u in parsed.units)} pts={times[0] if times else '-'}..{times[-1] if times else '-'} lost={parsed.lost} repeated={parsed.repeated} broken={parsed.broken} mean={mean}"


def _mapped(df: DataFrame, column: str, carry: Sequence[str], make, results: str, types: list[pa.DataType]) -> DataFrame:
    names = [x.split(" ")[0] for x in results.split(", ")]
    if clash := set(carry) & set(names):
        raise ValueError(f"carried columns are named like results: {sorted(clash)}")
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in pieces(batches, "_in"):
            found = [make(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays(batch.columns[1:] + [pa.array([x[k] for x in found], t) for k, t in enumerate(types)], names=batch.schema.names[1:] + names)

    rows = df.select(F.col(column).alias("_in"), *(F.col(c).alias(f"_{k}") for k, c in enumerate(carry)))
    schema = ", ".join([f"_{k} {rows.schema[f'_{k}'].dataType.simpleString()}" for k in range(len(carry))] + [results])
    return rows.mapInArrow(run, schema).withColumnsRenamed({f"_{k}": c for k, c in enumerate(carry)})


def padded(text: Column, multiple: int = 64) -> Column:
    """UTF-8 bytes with zero bytes up to a positive multiple."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    size = F.octet_length(data)
    length = F.greatest(F.lit(multiple), ((size + multiple - 1) / multiple).cast("int") * multiple)
    return F.concat(data, F.repeat(F.lit("\0"), length - size).cast("binary"))


def stored(df: DataFrame, samples: str, *, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The carried columns and ``media``, the transport stream of a binary column."""
    return _mapped(df, samples, carry, lambda x: (store(x or b""),), "media binary", [pa.binary()])


def parsed(df: DataFrame, media: str = "media", *, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The carried columns, samples, units (pts, position, size, access), lost, repeated, broken and feature of a stream."""
    unit = pa.list_(pa.struct([("pts", pa.int64()), ("position", pa.int64()), ("size", pa.int64()), ("access", pa.bool_())]))

    def make(x: bytes | None) -> tuple:
        p = parse(x)
        return p.samples, [dict(zip(("pts", "position", "size", "access"), u, strict=True)) for u in p.units], p.lost, p.repeated, p.broken, feature(p)

    results = "samples binary, units array<struct<pts:bigint,position:bigint,size:bigint,access:boolean>>, lost bigint, repeated bigint, broken bigint, feature string"
    return _mapped(df, media, carry, make, results, [pa.binary(), unit, pa.int64(), pa.int64(), pa.int64(), pa.string()])
