"""Media columns: MPEG transport streams in a binary column.

``store`` packs each payload as an elementary stream: program tables (PAT, PMT with their CRC), packetised units with
presentation times, random-access flags and clock references, all in 188-byte packets with continuity counters.
``parse`` reads any transport stream back: it finds the packet grid (again after lost sync), parses the tables, checks
counters, drops duplicate packets, reassembles each elementary stream's packets and lists its units with their times and
random-access points.

Both are maps over Arrow batches with no shuffle; packets are handled as numpy arrays, and results leave in batches of
about ``CHUNK`` bytes, so memory is bounded by the longest row.

Defined results: a null or empty payload is stored as 64 zero bytes by ``pad``; a null stream, or one without a program
table, has no elementary streams; equal payloads give equal bytes; other columns pass through.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from isoweave.runtime import column, map_arrow, table

PACKET, SYNC, GRID = 188, 0x47, 64
PMT_PID, STREAM_PID, STREAM_TYPE, STREAM_ID = 0x1000, 0x100, 0x06, 0xBD
#: bytes of a unit, units from one random-access point to the next, ticks of 90 kHz from unit to unit
UNIT, EVERY, TICKS = 16384, 8, 3600
CHUNK = 1 << 20
AT = np.arange(PACKET)


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c >> 31 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


CRC = _crc_table()


def section_crc(body: bytes) -> int:
    c = 0xFFFFFFFF
    for b in body:
        c = (c << 8 & 0xFFFFFFFF) ^ CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, number, 0xC1, 0, 0) + body
    return head + struct.pack(">I", section_crc(head))


PAT = _section(0, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))
PMT = _section(2, 1, struct.pack(">HHBHH", 0xE000 | STREAM_PID, 0xF000, STREAM_TYPE, 0xE000 | STREAM_PID, 0xF000))


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    return (struct.pack(">BHBB", SYNC, 0x4000 | pid, 0x10 | counter & 15, 0) + section).ljust(PACKET, b"\xff")


def _time(mark: int, t: int) -> bytes:
    return bytes([mark << 4 | t >> 29 & 14 | 1, t >> 22 & 255, t >> 14 & 254 | 1, t >> 7 & 255, t << 1 & 254 | 1])


def mux(payload: bytes, unit: int = UNIT, every: int = EVERY) -> bytes:
    """A transport stream of one program with one elementary stream that holds ``payload``."""
    out, counter = [], 0
    for n, at in enumerate(range(0, max(1, len(payload)), unit)):
        part, pts, access = payload[at:at + unit], n * TICKS, n % every == 0
        body = b"\0\0\1" + struct.pack(">BHBBB", STREAM_ID, len(part) + 8, 0x84, 0x80, 5) + _time(2, pts) + part
        field = b""
        if access:
            out += [_table_packet(0, PAT, n // every), _table_packet(PMT_PID, PMT, n // every)]
            field = b"\x50" + struct.pack(">IH", pts >> 1, (pts & 1) << 15 | 0x7E00)
        first = PACKET - 4 - (1 + len(field) if field else 0)
        packets = 1 + max(0, -(-(len(body) - first) // (PACKET - 4)))
        rows = np.full((packets, PACKET), 0xFF, np.uint8)
        rows[:, 0], rows[:, 1], rows[:, 2] = SYNC, STREAM_PID >> 8, STREAM_PID & 255
        rows[0, 1] |= 0x40
        rows[:, 3] = 0x10 | counter + np.arange(packets) & 15
        start = np.full(packets, 4)
        start[0] = PACKET - first
        short = first + (packets - 1) * (PACKET - 4) - len(body)
        start[-1] += short
        if field:
            rows[0, 3] |= 0x20
            rows[0, 4] = start[0] - 5
            rows[0, 5:5 + len(field)] = np.frombuffer(field, np.uint8)
        if short and not (packets == 1 and field):
            rows[-1, 3] |= 0x20
            rows[-1, 4] = start[-1] - 5
            if start[-1] > 5:
                rows[-1, 5] = 0
        rows[AT >= start[:, None]] = np.frombuffer(body, np.uint8)
        counter += packets
        out.append(rows.tobytes())
    return b"".join(out)


def _grid(media: bytes) -> tuple[np.ndarray, int]:
    """Packets as rows, and how often sync was lost."""
    raw = np.frombuffer(media, np.uint8)
    if len(raw) % PACKET == 0 and (raw[::PACKET] == SYNC).all():
        return raw.reshape(-1, PACKET), 0
    starts, at, lost = [], 0, 0
    while at + PACKET <= len(raw):
        held = bool(starts) and starts[-1] + PACKET == at  # out of sync, the next packet has to confirm the grid
        if raw[at] == SYNC and (held or at + PACKET == len(raw) or raw[at + PACKET] == SYNC):
            starts.append(at)
            at += PACKET
        else:
            lost += held or not (starts or lost)
            further = (raw[at + 1:] == SYNC).argmax() if at + 1 < len(raw) else 0
            if at + 1 >= len(raw) or raw[at + 1 + further] != SYNC:
                break
            at += 1 + int(further)
    rows = np.stack([raw[s:s + PACKET] for s in starts]) if starts else np.zeros((0, PACKET), np.uint8)
    return rows, lost


def _sections(rows: np.ndarray, start: np.ndarray, begins: np.ndarray) -> Iterator[tuple[bytes, bool]]:
    """(section, its CRC is right) of one PID's packets."""
    held = b""
    for row, s, first in zip(rows, start, begins):
        body = row[s:].tobytes()
        if first:
            tail, body = body[1:1 + body[0]], body[1 + body[0]:]
            done, held = held + tail, body
            yield from _whole(done)
        else:
            held += body
    yield from _whole(held)


def _whole(body: bytes) -> Iterator[tuple[bytes, bool]]:
    while len(body) >= 3 and body[0] != 0xFF:
        n = 3 + ((body[1] & 15) << 8 | body[2])
        if len(body) < n:
            return
        yield body[:n], section_crc(body[:n]) == 0
        body = body[n:]


def _programs(section: bytes) -> list[tuple[int, int]]:
    """(program, PID) of a PAT; the network table has program 0 and is left out."""
    pairs = [struct.unpack(">HH", section[i:i + 4]) for i in range(8, len(section) - 4, 4)]
    return [(n, pid & 0x1FFF) for n, pid in pairs if n]


def _streams(section: bytes) -> list[tuple[int, int]]:
    """(PID, stream type) of a PMT."""
    at, out = 12 + ((section[10] & 15) << 8 | section[11]), []
    while at + 5 <= len(section) - 4:
        out.append(((section[at + 1] & 31) << 8 | section[at + 2], section[at]))
        at += 5 + ((section[at + 3] & 15) << 8 | section[at + 4])
    return out


def _stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def demux(media: bytes | None) -> list[dict]:
    """Every elementary stream that the tables name, in PID order."""
    rows, lost = _grid(media or b"")
    if not len(rows):
        return []
    pid = (rows[:, 1].astype(int) & 31) << 8 | rows[:, 2]
    field = rows[:, 3] & 0x20 != 0
    width = np.where(field, 1 + rows[:, 4].astype(int), 0)
    start = np.minimum(4 + width, PACKET)
    flags = np.where(field & (rows[:, 4] > 0), rows[:, 5], 0)
    carries = (rows[:, 3] & 0x10 != 0) & (rows[:, 1] & 0x80 == 0)
    begins = rows[:, 1] & 0x40 != 0
    found, bad = {}, 0

    def read(p: int) -> Iterator[bytes]:
        nonlocal bad
        own = (pid == p) & carries
        for section, right in _sections(rows[own], start[own], begins[own]):
            bad += not right
            if right:
                yield section

    programs = {x for s in read(0) if s[0] == 0 for x in _programs(s)}
    for _, table_pid in sorted(programs):
        for s in read(table_pid):
            if s[0] == 2:
                found.update(_streams(s))
    return [_elementary(p, kind, rows, (pid == p) & carries, start, flags, begins, lost, bad) for p, kind in sorted(found.items())]


def _elementary(p, kind, rows, own, start, flags, begins, lost, bad) -> dict:
    at = own.nonzero()[0]
    counter = rows[at, 3] & 15
    step = (counter[1:].astype(int) - counter[:-1]) % 16
    twin = np.concatenate([[False], step == 0])
    for i in twin.nonzero()[0]:
        twin[i] = (rows[at[i], 4:] == rows[at[i - 1], 4:]).all()
    told = flags[at] & 0x80 != 0
    breaks = int(((step != 1) & ~twin[1:] & ~told[1:]).sum()) if len(at) else 0
    at = at[~twin]
    body = rows[at][AT >= start[at][:, None]]
    ends = np.cumsum(PACKET - start[at])
    first = begins[at].nonzero()[0]
    units, parts, offset = [], [], 0
    for n, i in enumerate(first):
        lo = ends[i] - (PACKET - start[at[i]])
        hi = ends[first[n + 1] - 1] if n + 1 < len(first) else (ends[-1] if len(ends) else 0)
        b = body[lo:hi].tobytes()
        if len(b) < 9 or b[:3] != b"\0\0\1":
            breaks += 1
            continue
        pts = _stamp(b[9:14]) if b[7] & 0x80 else None
        dts = _stamp(b[14:19]) if b[7] & 0xC0 == 0xC0 else pts
        length, head = b[4] << 8 | b[5], 9 + b[8]
        data = b[head:6 + length] if length else b[head:]
        units.append((pts, dts, bool(flags[at[i]] & 0x40), offset, len(data)))
        parts.append(data)
        offset += len(data)
    return {"pid": p, "stream_type": kind, "packets": len(at), "counter_errors": breaks, "duplicates": int(twin.sum()), "lost_sync": lost, "table_errors": bad, "payload": b"".join(parts),
            "units": [dict(zip(("pts", "dts", "random_access", "offset", "length"), u)) for u in units]}


UNITS = pa.list_(pa.struct([("pts", pa.int64()), ("dts", pa.int64()), ("random_access", pa.bool_()), ("offset", pa.int64()), ("length", pa.int64())]))
STREAMS = pa.list_(pa.struct([("pid", pa.int32()), ("stream_type", pa.int32()), ("packets", pa.int64()), ("counter_errors", pa.int64()), ("duplicates", pa.int64()), ("lost_sync", pa.int64()), ("table_errors", pa.int64()), ("payload", pa.binary()), ("units", UNITS)]))
STREAMS_SQL = "array<struct<pid:int,stream_type:int,packets:long,counter_errors:long,duplicates:long,lost_sync:long,table_errors:long,payload:binary,units:array<struct<pts:long,dts:long,random_access:boolean,offset:long,length:long>>>>"


def _mapped(df: DataFrame, source: str, target: str, kind: str, arrow: pa.DataType, f) -> DataFrame:
    """``df`` with ``target`` = f(``source``), in Arrow batches of about ``CHUNK`` source bytes."""
    columns = [c for c in df.columns if c != target]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values = 0, batch.column(batch.schema.get_field_index(source))
            sizes = [len(v.as_py() or b"") for v in values]
            while at < len(sizes):
                end, n = at, 0
                while end < len(sizes) and (end == at or n + sizes[end] <= CHUNK):
                    n += sizes[end]
                    end += 1
                part = batch.slice(at, end - at)
                made = pa.array([f(v.as_py()) for v in part.column(part.schema.get_field_index(source))], arrow)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in columns), made], [*columns, target])
                at = end

    fields = [f for f in df.schema.fields if f.name in columns] + [StructField(target, StructType.fromDDL(f"made {kind}")["made"].dataType)]
    return map_arrow(df.select(*map(column, columns)), run, StructType(fields))


def pad(payload: bytes | None) -> bytes:
    """``payload`` with zero bytes up to a positive multiple of 64."""
    body = payload or b""
    return body + b"\0" * (-len(body) % GRID or (0 if body else GRID))


def store(df: DataFrame, payload: str = "payload", media: str = "media") -> DataFrame:
    """``df`` with a transport stream of the padded payload (binary) of each row."""
    return _mapped(df, payload, media, "binary", pa.binary(), lambda b: mux(pad(b)))


def parse(df: DataFrame, media: str = "media", streams: str = "streams") -> DataFrame:
    """``df`` with the elementary streams of each row's transport stream."""
    return _mapped(df, media, streams, STREAMS_SQL, STREAMS, demux)


def op2_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload"))
    held = store(docs).select("doc_id", F.length("payload").cast("long").alias("n_bytes"), "media")
    first = F.get("streams", F.lit(0))
    back = parse(held).select("doc_id", "n_bytes", "media", first["payload"].alias("back"), first.alias("stream"))
    units = F.col("stream.units")
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("pid="), F.col("stream.pid")),
        F.concat(F.lit("type="), F.col("stream.stream_type")),
        F.concat(F.lit("packets="), F.col("stream.packets")),
        F.concat(F.lit("units="), F.size(units)),
        F.concat(F.lit("first_pts="), F.get(units, F.lit(0))["pts"]),
        F.concat(F.lit("last_pts="), F.element_at(units, -1)["pts"]),
        F.concat(F.lit("access="), F.array_join(F.transform(F.filter(units, lambda u: u["random_access"]), lambda u: F.concat_ws("@", u["offset"], u["pts"])), ",")),
        F.concat(F.lit("counter_errors="), F.col("stream.counter_errors")),
    )
    return back.select(
        "doc_id", "n_bytes", F.length("back").cast("long").alias("payload_bytes"), F.sha2("back", 256).alias("payload_sha256"),
        F.crc32(F.substring("back", -64, 64)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )


QUERIES = {"op2_transport_stream": op2_transport_stream}
ORACLES: dict[str, str] = {}
