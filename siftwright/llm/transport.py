"""Operator 8: media columns as MPEG transport streams.

``mux`` stores bytes as private PES packets in a single-program transport stream; ``demux`` parses any transport stream:
program association and map tables (CRC checked), continuity counters, elementary packets put together again, timestamps,
clock references and random-access points. Both work on whole packet matrices of numpy bytes, one stream at a time.

Defined results: null and empty payloads store one padded block of zeros; equal texts give equal streams; repeated rows
and other columns have no effect; an empty table gives no rows. Bytes past the last whole packet, packets without the
sync byte and those marked as damaged are counted as lost and left out; so are, in a count of their own, scrambled payloads.
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

from siftwright.llm import flat

PACKET = 188
SYNC = 0x47
MAP_PID, DATA_PID = 0x1000, 0x0100
PRIVATE_STREAM, PRIVATE_TYPE = 0xBD, 0x06
UNIT_BYTES = 16384
UNIT_TICKS = 3600
#: How long a unit's clock reference is ahead of its timestamp.
AHEAD_TICKS = 9000
#: Bytes of the adaptation field of a unit's first packet (flags and clock reference), and what payload stands after it.
ADAPTATION, FIRST = 7, 188 - 4 - 8
BLOCK = 64


@lru_cache(maxsize=1024)
def section_crc(data: bytes) -> int:
    """CRC-32 of program tables (polynomial 0x04C11DB7, not reflected)."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table: int, key: int, body: bytes) -> bytes:
    head = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, key >> 8, key & 255, 0xC1, 0, 0]) + body
    return head + section_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


@lru_cache(maxsize=1)
def _tables() -> np.ndarray:
    pat = _section(0, 1, bytes([0, 1, 0xE0 | MAP_PID >> 8, MAP_PID & 255]))
    pmt = _section(2, 1, bytes([0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0, PRIVATE_TYPE, 0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0]))
    return np.frombuffer(_table_packet(0, pat) + _table_packet(MAP_PID, pmt), np.uint8).reshape(-1, PACKET)


def _stamp(ticks: int) -> bytes:
    t = ticks & (1 << 33) - 1
    return bytes([0x21 | t >> 29 & 14, t >> 22 & 255, t >> 14 & 254 | 1, t >> 7 & 255, t << 1 & 254 | 1])


def _clock(ticks: int) -> np.ndarray:
    """A clock reference of 90 kHz ticks, without the extension of finer ticks."""
    return np.frombuffer(((ticks & (1 << 33) - 1) << 15 | 0x7E00).to_bytes(6, "big"), np.uint8)


def mux(payload: bytes) -> bytes:
    """A transport stream of one program whose private stream holds the payload in units with timestamps."""
    parts, counter = [_tables()], 0
    for k, at in enumerate(range(0, max(len(payload), 1), UNIT_BYTES)):
        unit = payload[at : at + UNIT_BYTES]
        head = bytes([0, 0, 1, PRIVATE_STREAM]) + (len(unit) + 8).to_bytes(2, "big") + bytes([0x80, 0x80, 5]) + _stamp(k * UNIT_TICKS + AHEAD_TICKS)
        data = np.frombuffer(head + unit, np.uint8)
        n = 1 + max(0, -(-(len(data) - FIRST) // 184))
        block = np.full((n, PACKET), 0xFF, np.uint8)
        block[:, 0], block[:, 1], block[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 255
        block[0, 1] |= 0x40
        block[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter = (counter + n) & 15
        block[0, 3] |= 0x20
        block[0, 4], block[0, 5] = ADAPTATION, 0x50
        block[0, 6:12] = _clock(k * UNIT_TICKS)
        if n == 1:
            block[0, 4] = 183 - len(data)
            block[0, PACKET - len(data) :] = data
        else:
            block[0, PACKET - FIRST :] = data[:FIRST]
            whole = (len(data) - FIRST) // 184
            block[1 : 1 + whole, 4:] = data[FIRST : FIRST + 184 * whole].reshape(whole, 184)
            if rest := len(data) - FIRST - 184 * whole:
                block[-1, 3] |= 0x20
                block[-1, 4] = 183 - rest
                if rest < 183:
                    block[-1, 5] = 0
                block[-1, PACKET - rest :] = data[-rest:]
        parts.append(block)
    return np.concatenate(parts).tobytes()


@dataclass
class Unit:
    """One elementary packet: its stream, timestamp, random-access flag, payload, and the clock reference it came with."""

    pid: int
    stamp: int | None
    random_access: bool
    data: bytes
    complete: bool = True
    clock: int | None = None


@dataclass
class Stream:
    """What a transport stream holds."""

    packets: int = 0
    lost: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    table_errors: int = 0
    continuity_errors: int = 0
    scrambled: int = 0
    units: list[Unit] = field(default_factory=list)


def _payload_at(packets: np.ndarray) -> np.ndarray:
    control = packets[:, 3] >> 4 & 3
    at = np.where(control & 2, 5 + packets[:, 4].astype(np.int64), 4)
    return np.where(control & 1, np.minimum(at, PACKET), PACKET)


def _repeats(rows: np.ndarray) -> np.ndarray:
    """Packets of one stream that are sent a second time: the counter and all bytes of the one before, with a payload."""
    again = np.zeros(len(rows), bool)
    if len(rows) > 1:
        again[1:] = (rows[1:, 3] & 0x10 > 0) & (rows[1:] == rows[:-1]).all(axis=1)
    return again


def _sections(packets: np.ndarray, pid: int, pids: np.ndarray, out: Stream) -> Iterator[bytes]:
    """Whole sections of a table. A section may end in a packet that starts the next one: the pointer field tells where the
    old one's last bytes stand. One with a packet missing is given up, and counts as a table error."""
    chosen = packets[pids == pid]
    chosen = chosen[~_repeats(chosen) & (chosen[:, 3] & 0x10 > 0)]
    held: bytes | None = None
    last = -1
    for row, at in zip(chosen, _payload_at(chosen)):
        data, count = row[at:].tobytes(), int(row[3] & 15)
        if held and last >= 0 and count != (last + 1) & 15:
            out.table_errors += 1
            held = None
        last = count
        if row[1] & 0x40 and data:
            ends = 1 + data[0]
            if held:
                yield from _whole(held + data[1:ends], out)[0]
            held = data[ends:]
        elif held is not None:
            held += data
        if held:
            found, held = _whole(held, out)
            yield from found


def _whole(held: bytes, out: Stream) -> tuple[list[bytes], bytes]:
    """(sections that are complete and have the right checksum, the rest)."""
    found = []
    while len(held) >= 3 and held[0] != 0xFF and len(held) >= (size := 3 + ((held[1] & 15) << 8 | held[2])):
        if size >= 12 and section_crc(held[: size - 4]) == int.from_bytes(held[size - 4 : size], "big"):
            found.append(held[:size])
        else:
            out.table_errors += 1
        held = held[size:]
    return found, b"" if held[:1] == b"\xff" else held


def demux(media: bytes) -> Stream:
    """Parse a transport stream."""
    rows = np.frombuffer(media, np.uint8)[: len(media) // PACKET * PACKET].reshape(-1, PACKET)
    good = (rows[:, 0] == SYNC) & (rows[:, 1] & 0x80 == 0)
    packets = rows[good]
    out = Stream(packets=len(packets), lost=int((~good).sum()) + (len(media) % PACKET > 0))
    pids = (packets[:, 1].astype(np.int64) & 31) << 8 | packets[:, 2]
    for s in _sections(packets, 0, pids, out):
        for k in range(8, len(s) - 4, 4):
            if number := s[k] << 8 | s[k + 1]:
                out.programs[number] = (s[k + 2] & 31) << 8 | s[k + 3]
    for pid in dict.fromkeys(out.programs.values()):
        for s in _sections(packets, pid, pids, out):
            k = 12 + ((s[10] & 15) << 8 | s[11])
            while k + 5 <= len(s) - 4:
                out.streams[(s[k + 1] & 31) << 8 | s[k + 2]] = s[k]
                k += 5 + ((s[k + 3] & 15) << 8 | s[k + 4])
    for pid in out.streams:
        _elementary(packets[pids == pid], pid, out)
    return out


def _elementary(rows: np.ndarray, pid: int, out: Stream) -> None:
    at = _payload_at(rows)
    filled = (rows[:, 3] & 0x10) > 0
    adapted = (rows[:, 3] & 0x20) > 0
    count = rows[:, 3] & 15
    jump = adapted & (rows[:, 4] > 0) & ((rows[:, 5] & 0x80) > 0)
    flags = adapted & (rows[:, 4] > 0) & ((rows[:, 5] & 0x40) > 0)
    again = _repeats(rows)
    if len(rows) > 1:
        due = (count[:-1] + filled[1:]) & 15
        broken = (count[1:] != due) & ~again[1:] & ~jump[1:]
        out.continuity_errors += int(broken.sum())
    secret = filled & (rows[:, 3] & 0xC0 > 0)
    out.scrambled += int((secret & ~again).sum())
    take = filled & ~again & ~secret
    timed = adapted & (rows[:, 4] >= ADAPTATION) & ((rows[:, 5] & 0x10) > 0)
    rows, at, flags, timed = rows[take], at[take], flags[take], timed[take]
    heads = np.flatnonzero(rows[:, 1] & 0x40)
    if not len(heads):
        return
    rows, at, flags, timed = rows[heads[0] :], at[heads[0] :], flags[heads[0] :], timed[heads[0] :]
    data = rows[np.arange(PACKET) >= at[:, None]].tobytes()
    ends = np.concatenate([[0], np.cumsum(PACKET - at)])
    bounds = [*(heads - heads[0]).tolist(), len(rows)]
    for a, b in zip(bounds, bounds[1:]):
        unit = data[ends[a] : ends[b]]
        if len(unit) < 9 or unit[:3] != b"\0\0\1":
            out.lost += 1
            continue
        size, stamp = unit[4] << 8 | unit[5], None
        if unit[7] & 0x80 and len(unit) >= 14:
            p = unit[9:14]
            stamp = (p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1
        body = unit[9 + unit[8] : 6 + size if size else len(unit)]
        clock = int.from_bytes(rows[a, 6:12].tobytes(), "big") >> 15 if timed[a] else None
        out.units.append(Unit(pid, stamp, bool(flags[a]), body, not size or len(unit) >= 6 + size, clock))


def padded(text: bytes) -> bytes:
    """Zero bytes appended up to a positive multiple of 64."""
    return text.ljust(max(BLOCK, -(-len(text) // BLOCK) * BLOCK), b"\0")


def store_documents(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_bytes and a transport stream per row of ``docs``."""
    schema = flat.schema_of(docs, keep, "n_bytes bigint, media binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.slices(batches):
            texts = [x.encode("utf-8", "surrogatepass") for x in flat.texts_of(batch)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([len(x) for x in texts]), pa.array([mux(padded(x)) for x in texts], pa.binary())], names=[*keep, "n_bytes", "media"])

    return flat.map_batches(docs.select(*keep, "text"), run, schema)


def access_units(media: DataFrame, column: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per elementary packet: ``keep``, pid, ordinal, stamp, clock, random_access, complete, data."""
    schema = flat.schema_of(media, keep, "pid int, ordinal int, stamp bigint, clock bigint, random_access boolean, complete boolean, data binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.slices(batches, column):
            rows = [(i, k, u) for i, m in enumerate(batch.column(column).to_pylist()) for k, u in enumerate(demux(m or b"").units)]
            at = pa.array([i for i, _, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in keep), pa.array([u.pid for *_, u in rows], pa.int32()), pa.array([k for _, k, _ in rows], pa.int32()), pa.array([u.stamp for *_, u in rows], pa.int64()), pa.array([u.clock for *_, u in rows], pa.int64()), pa.array([u.random_access for *_, u in rows], pa.bool_()), pa.array([u.complete for *_, u in rows], pa.bool_()), pa.array([u.data for *_, u in rows], pa.binary())],
                names=[*keep, "pid", "ordinal", "stamp", "clock", "random_access", "complete", "data"],
            )

    return flat.map_batches(media.select(*keep, column), run, schema)


def digest_documents(docs: DataFrame) -> DataFrame:
    """Store every text, read the stored bytes back and describe them."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.slices(batches):
            rows = []
            for key, text in zip(batch.column("doc_id").to_pylist(), flat.texts_of(batch)):
                raw = text.encode("utf-8", "surrogatepass")
                media = mux(padded(raw))
                found = demux(media)
                back = b"".join(u.data for u in found.units)
                stamps = [u.stamp for u in found.units]
                feature = f"programs={len(found.programs)};streams={','.join(f'{k}:{v}' for k, v in found.streams.items())};packets={found.packets};lost={found.lost};continuity={found.continuity_errors};tables={found.table_errors};units={len(stamps)};stamps={min(stamps)}-{max(stamps)};clocks={sum(u.clock is not None for u in found.units)};access={sum(u.random_access for u in found.units)}"
                rows.append((key, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if k in (0, 1, 2, 4, 5) else pa.string()) for k, x in enumerate(zip(*rows))], names=names)

    return flat.map_batches(docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
