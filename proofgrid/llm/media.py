"""Media columns: MPEG transport streams.

Bytes are stored as the units of one private elementary stream: packets of 188 bytes with program tables, continuity
counters, timestamps, clock references and random-access marks. Reading parses the tables, checks their CRCs and the
counters, puts the elementary packets together again, and gives the payload with its access points.

Defined cases: a null or empty text is 192 spaces; each input row gives one result row; lost or repeated packets are
counted, a repeated one is dropped, and what can't be read is left out; equal texts have equal streams; a very long text is more
units of one stream, a row at a time; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize

BLOCK, UNIT, TICKS, RANDOM_EVERY = 192, 192 * 48, 3600, 8
#: Fixed values of the format (ISO/IEC 13818-1).
SYNC, SIZE, PAT_PID, PMT_PID, DATA_PID, STREAM_TYPE, STREAM_ID, CRC_POLY = 0x47, 188, 0, 0x1000, 0x100, 0x06, 0xBD, 0x04C11DB7


def crc32(data: bytes) -> int:
    """The CRC of program tables: most significant bit first, no final inversion."""
    c = 0xFFFFFFFF
    for byte in data:
        c ^= byte << 24
        for _ in range(8):
            c = (c << 1 ^ (CRC_POLY if c & 0x80000000 else 0)) & 0xFFFFFFFF
    return c


def table(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 0xFF]) + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32(head + body).to_bytes(4, "big")


def packet(pid: int, counter: int, payload: bytes, start: bool, adaptation: bytes = b"") -> bytes:
    """adaptation: flags and fields; it is stuffed so that the packet is full."""
    room = SIZE - 4 - len(payload)
    if room or adaptation:
        adaptation = b"\x00" if room == 1 else bytes([room - 1]) + (adaptation or b"\x00") + b"\xff" * (room - 1 - max(1, len(adaptation)))
    return bytes([SYNC, start << 6 | pid >> 8, pid & 0xFF, (0x30 if adaptation else 0x10) | counter & 15]) + adaptation + payload


PROGRAM_TABLES = b"".join(
    packet(pid, 0, b"\x00" + t + b"\xff" * (SIZE - 5 - len(t)), True)
    for pid, t in ((PAT_PID, table(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))), (PMT_PID, table(2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")))
)


def timestamp(t: int) -> bytes:
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, t << 1 & 0xFE | 1])


def mux(payload: bytes) -> bytes:
    out, counter = [PROGRAM_TABLES], 0
    for i, at in enumerate(range(0, len(payload), UNIT)):
        unit, time = payload[at : at + UNIT], i * TICKS & (1 << 33) - 1
        data = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + timestamp(time) + unit
        clock = bytes([0x50]) + ((time << 15) | 0x7E00).to_bytes(6, "big") if i % RANDOM_EVERY == 0 else b""
        first = SIZE - 4 - (len(clock) + 1 if clock else 0)
        out.append(packet(DATA_PID, counter, data[:first], True, clock))
        counter += 1
        for k in range(first, len(data), SIZE - 4):
            out.append(packet(DATA_PID, counter, data[k : k + SIZE - 4], False))
            counter += 1
    return b"".join(out)


@dataclass
class Stream:
    payload: bytes = b""
    times: list = field(default_factory=list)  # (time, place of its first packet, is a random-access point)
    stream_type: int = -1
    pid: int = -1
    packets: int = 0
    gaps: int = 0
    repeats: int = 0
    bad_tables: int = 0


def section(data: bytes) -> bytes | None:
    """What a table says after its header; None where the packet has no whole table, or its checksum is wrong."""
    t = data[1 + data[0] :] if data else b""
    size = 3 + ((t[1] & 0x0F) << 8 | t[2]) if len(t) > 2 else 0
    return t[8 : size - 4] if 12 <= size <= len(t) and crc32(t[:size]) == 0 else None


def program_stream(table: bytes) -> tuple[int, int] | None:
    """(type, packet id) of a program's first stream."""
    own = table[4 + ((table[2] & 0x0F) << 8 | table[3]) :] if len(table) > 3 else b""
    return (own[0], (own[1] & 0x1F) << 8 | own[2]) if len(own) > 2 else None


def demux(ts: bytes) -> Stream:
    s, counters, parts, program, units = Stream(), {}, [], -1, []
    known: dict[bytes, bytes | None] = {}
    for at in range(0, len(ts) - SIZE + 1, SIZE):
        p = ts[at : at + SIZE]
        if p[0] != SYNC:
            s.gaps += 1
            continue
        s.packets += 1
        start, pid, control = p[1] & 0x40, (p[1] & 0x1F) << 8 | p[2], p[3] & 0x30
        body = 4 + (1 + p[4] if control & 0x20 else 0)
        random_access = bool(control & 0x20 and p[4] and p[5] & 0x40)
        if not control & 0x10:
            continue
        if body >= SIZE:  # it names a payload and leaves no byte for it
            s.gaps += 1
            continue
        if pid in counters and p[3] & 15 != counters[pid] + 1 & 15:
            if p[3] & 15 == counters[pid]:
                s.repeats += 1
                continue
            s.gaps += 1
        counters[pid] = p[3] & 15
        if pid == PAT_PID or pid == program:
            raw = p[body:]
            if raw not in known:
                known[raw] = section(raw)
            t = known[raw]
            if t is None or len(t) < 4:
                s.bad_tables += 1
            elif pid == PAT_PID:
                program = (t[2] & 0x1F) << 8 | t[3]
            elif found := program_stream(t):
                s.stream_type, s.pid = found
            else:
                s.bad_tables += 1
        elif pid == s.pid:
            if start:
                units.append((at // SIZE, random_access, parts := []))
            if units:
                parts.append(p[body:])
    out = []
    for first, random_access, parts in units:
        d = b"".join(parts)
        if len(d) < 9 or d[:3] != b"\x00\x00\x01":
            s.gaps += 1  # a unit whose head is lost
            continue
        size = d[4] << 8 | d[5]
        t = d[9:14]
        time = (t[0] & 0x0E) << 29 | t[1] << 22 | (t[2] & 0xFE) << 14 | t[3] << 7 | t[4] >> 1 if d[7] & 0x80 and len(t) == 5 else None
        s.times.append((time, first, random_access))
        out.append(d[9 + d[8] : 6 + size])
    s.payload = b"".join(out)
    return s


def payload_of(text: Column) -> Column:
    """UTF-8 bytes with spaces up to a positive multiple of BLOCK."""
    n = F.octet_length(text)
    size = F.greatest(F.lit(1), F.ceil(n / BLOCK)) * BLOCK
    return F.encode(F.concat(text, F.repeat(F.lit(" "), (size - n).cast("int"))), "UTF-8")


def stored(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media), written to the shared folder."""

    @F.pandas_udf("binary")
    def to_stream(payload: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in payload:
            yield p.map(mux)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return materialize(documents.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), to_stream(payload_of(text)).alias("media")), "media", compression="zstd")


def read(media: DataFrame) -> DataFrame:
    """The media rows with payload, feature and access array<struct<time, packet, random_access>>."""
    kind = "payload binary, feature string, access array<struct<time: long, packet: int, random_access: boolean>>"

    @F.pandas_udf(kind)
    def from_stream(media: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for m in media:
            rows = []
            for s in map(demux, m):
                times = [t for t, _, _ in s.times if t is not None]
                feature = f"pid={s.pid};type={s.stream_type};packets={s.packets};units={len(s.times)};random={sum(r for *_, r in s.times)};gaps={s.gaps};repeats={s.repeats};bad_tables={s.bad_tables};last_time={max(times, default=-1)}"
                rows.append((s.payload, feature, [{"time": t, "packet": p, "random_access": r} for t, p, r in s.times]))
            yield pd.DataFrame(rows, columns=["payload", "feature", "access"])

    return media.withColumn("__r", from_stream("media")).select("*", "__r.payload", "__r.feature", "__r.access").drop("__r")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(stored(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return r.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", F.to_json("access").alias("access"),
    )
