"""Evidence containers: a metadata prefix followed by a ZIP archive, as a table of entries.

Tasks walk the central directories (ZIP64 too) as streams and cut them into ranges of bounded entries and bytes. The ranges are
dealt to tasks, of which each reads several and seeks to their entries, so a container of any size is spread over many tasks,
many small ones share a task, and one entry costs its own bytes. Stores are those of ``pyarrow.fs``.

Entries that are encrypted, damaged, packed by another method than storing or deflating, or larger than a binary value can be
have null content; ``read_range`` still reaches any part of the large ones.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.session import materialise
from siftwright.sources import files
from siftwright.sources.filewriter import store_of

SIGNATURE = b"PK\x03\x04"
PREFIX_BYTES = 16384
BATCH_BYTES = 16 << 20
#: A range of the directory has at most so many entries, or entries of so many packed bytes.
RANGE_ENTRIES = 2000
RANGE_BYTES = 64 << 20
#: Content of a larger entry isn't given as one value.
LARGEST = 1 << 30
#: Rows of a batch; containers of a task that cuts, entries of one that reads; so many ranges at least have tasks of their own.
BATCH_ROWS = 4096
TASK_CONTAINERS = 500
TASK_ENTRIES = 10_000
SPREAD = 64
_CHUNK = 1 << 20
SCHEMA = "container string, path string, is_dir boolean, size bigint, content binary"
KINDS = {"container": pa.string(), "path": pa.string(), "is_dir": pa.bool_(), "size": pa.int64(), "content": pa.binary()}
#: A range: ``count`` entries from the byte ``at`` of a container's directory; ``prefix`` is set for the first one, else -1.
RANGES = "container string, at bigint, count bigint, base bigint, prefix bigint, bytes bigint"
RANGE_KINDS = {"container": pa.string()} | {name: pa.int64() for name in ("at", "count", "base", "prefix", "bytes")}


@dataclass
class Entry:
    """An entry as the directory tells it."""

    path: str
    is_dir: bool
    method: int
    encrypted: bool
    crc: int
    packed: int
    size: int
    at: int


def _directory(file, size: int) -> tuple[int, int, int]:
    """(where the directory begins, its entries, what is to be added to offsets in it) of an archive at a file's end."""
    tail_at = max(0, size - (1 << 16) - 22)
    file.seek(tail_at)
    tail = file.read(size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0 or len(tail) - at < 22:
        raise ValueError("no end of an archive's directory")
    count, length, offset = struct.unpack("<HII", tail[at + 10 : at + 20])
    end = tail_at + at
    if end >= 76:
        file.seek(end - 20)
        mark, _, where, _ = struct.unpack("<4sIQI", file.read(20))
        if mark == b"PK\x06\x07":
            # the offset counts from the archive's beginning, which a prefix moves: the record ends where its locator begins
            for place in (where, end - 20 - 56):
                file.seek(place)
                record = file.read(56)
                if record[:4] == b"PK\x06\x06":
                    count, length, offset = struct.unpack("<QQQ", record[32:56])
                    end = place
                    break
    begins = end - length
    return begins, count, begins - offset


def _entries(file, at: int, count: int, base: int) -> Iterator[tuple[int, Entry]]:
    """(place in the directory, entry) of so many entries, reading the directory in chunks."""
    held, place = b"", at
    file.seek(at)
    for _ in range(count):
        while len(held) < 46 or len(held) < 46 + sum(struct.unpack("<HHH", held[28:34])):
            more = file.read(_CHUNK)
            if not more:
                raise ValueError("the archive's directory is cut off")
            held += more
        mark, flags, method, crc, packed, size, name_length, extra_length, comment = struct.unpack("<4s4xHH4xIIIHHH", held[:34])
        if mark != b"PK\x01\x02":
            raise ValueError("the archive's directory is damaged")
        (offset,) = struct.unpack("<I", held[42:46])
        name = held[46 : 46 + name_length].decode("utf-8" if flags & 0x800 else "cp437", "replace")
        extra = held[46 + name_length : 46 + name_length + extra_length]
        while len(extra) >= 4:
            kind, length = struct.unpack("<HH", extra[:4])
            if kind == 1:  # sizes beyond 32 bits, those that need it, in this order
                wide = iter(struct.unpack(f"<{length // 8}Q", extra[4 : 4 + length // 8 * 8]))
                size, packed, offset = (next(wide, x) if x == 0xFFFFFFFF else x for x in (size, packed, offset))
            extra = extra[4 + length :]
        whole = 46 + name_length + extra_length + comment
        yield place, Entry("/" + name.strip("/"), name.endswith("/"), method, bool(flags & 1), crc, packed, size, base + offset)
        held, place = held[whole:], place + whole


def _bytes(file, entry: Entry, begin: int = 0, length: int | None = None) -> bytes | None:
    """Content of an entry, or of a part of it, read from its place; null where it can't be told."""
    wanted = entry.size - begin if length is None else min(length, entry.size - begin)
    if wanted <= 0:
        return b""
    file.seek(entry.at)
    head = file.read(30)
    if entry.encrypted or entry.method not in (0, 8) or head[:4] != SIGNATURE:
        return None
    start = entry.at + 30 + sum(struct.unpack("<HH", head[26:30]))
    if entry.method == 0:
        file.seek(start + begin)
        return file.read(wanted)
    file.seek(start)
    unpack, out, done, left = zlib.decompressobj(-15), [], 0, entry.packed
    try:
        while left > 0 and done < begin + wanted:
            packed = file.read(min(_CHUNK, left))
            if not packed:
                return None
            left -= len(packed)
            while done < begin + wanted:
                piece = unpack.decompress(packed, _CHUNK)
                packed = unpack.unconsumed_tail
                lo, hi = max(begin - done, 0), begin + wanted - done
                out.append(piece[lo:hi] if hi > 0 else b"")
                done += len(piece)
                if not piece and not packed:
                    break
    except zlib.error:
        return None
    data = b"".join(out)
    return data if len(data) == wanted else None


def _prefix(file, container: str) -> int:
    """Bytes before the archive."""
    file.seek(0)
    at = file.read(PREFIX_BYTES).find(SIGNATURE)
    if at < 0:
        raise ValueError(f"{container}: no archive in the first {PREFIX_BYTES} bytes")
    return at


def _ranges(file, container: str, size: int, entry: str | None, range_entries: int, range_bytes: int) -> Iterator[tuple]:
    """RANGES of a container: all of its directory, or the places of one entry alone."""
    prefix = _prefix(file, container)
    at, count, base = _directory(file, size)
    if entry is not None:
        if entry == "/metadata.xml":
            yield container, at, 0, base, prefix, prefix
        for where, e in _entries(file, at, count, base):
            if e.path == entry:
                yield container, where, 1, base, -1, e.packed
        return
    begin, held, packed, first = at, 0, 0, prefix
    for where, e in _entries(file, at, count, base):
        if held and (held >= range_entries or packed + e.packed > range_bytes):
            yield container, begin, held, base, first, packed
            begin, held, packed, first = where, 0, 0, -1
        held, packed = held + 1, packed + e.packed
    yield container, begin, held, base, first, packed


def _planned(spark: SparkSession, folder: str, suffix: str = ".ufdr", entry: str | None = None, range_entries: int = RANGE_ENTRIES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """RANGES of all containers of a folder, cut by tasks and dealt to tasks by entries and bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for container in batch.column("path").to_pylist():
                store, place = store_of(container)
                with store.open_input_file(place) as file:
                    for found in _ranges(file, container, file.size(), entry, range_entries, range_bytes):
                        held.append(found)
                        if len(held) >= BATCH_ROWS:
                            yield _batch(held, RANGE_KINDS)
                            held = []
            if held:
                yield _batch(held, RANGE_KINDS)

    found = files.listing(spark, folder, hidden=True).where(F.endswith(F.lower("name"), F.lit(suffix)))
    ranges = materialise(files.dealt(found, sized=False, task_files=TASK_CONTAINERS).mapInArrow(cut, RANGES))
    told = ranges.agg(F.count("*").alias("n"), F.coalesce(F.sum("count"), F.lit(0)).alias("entries"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    return ranges.repartition(max(1, min(told.n, SPREAD), -(-told.entries // TASK_ENTRIES), -(-told.bytes // RANGE_BYTES)))


def _read(ranges: DataFrame, content: bool = True, entry: str | None = None, begin: int = 0, length: int | None = None) -> DataFrame:
    """SCHEMA of the entries of ranges, or of one entry and a part of its content."""

    def rows_of(file, part: dict) -> Iterator[tuple]:
        if part["prefix"] >= 0 and entry in (None, "/metadata.xml"):
            file.seek(min(begin, part["prefix"]))
            wanted = part["prefix"] - begin if length is None else min(length, part["prefix"] - begin)
            yield part["container"], "/metadata.xml", False, part["prefix"], file.read(max(0, wanted)) if content else None
        for e in [e for _, e in _entries(file, part["at"], part["count"], part["base"])]:
            wanted = content and not e.is_dir and (e.size if length is None else length) <= LARGEST
            data = _bytes(file, e, begin, length) if wanted else None
            if data is not None and length is None and not begin and zlib.crc32(data) != e.crc:
                data = None
            yield part["container"], e.path, e.is_dir, 0 if e.is_dir else e.size, data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in batch.to_pylist():
                store, place = store_of(part["container"])
                with store.open_input_file(place) as file:
                    for row in rows_of(file, part):
                        held.append(row)
                        size += len(row[4] or b"")
                        if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                            yield _batch(held, KINDS)
                            held, size = [], 0
        if held:
            yield _batch(held, KINDS)

    return ranges.mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds.values())], names=list(kinds))


def _scan(spark: SparkSession, folder: str, suffix: str = ".ufdr", entry: str | None = None, content: bool = True, begin: int = 0, length: int | None = None, **ranges: int) -> DataFrame:
    return _read(_planned(spark, folder, suffix, entry, **ranges), content, entry, begin, length)


def read(spark: SparkSession, folder: str, suffix: str = ".ufdr", content: bool = True, **options: int) -> DataFrame:
    """Entries of all containers of a folder, and every directory above them: container, path, is_dir, size, content.

    ``/metadata.xml`` is what stands before the archive. A folder that is missing or holds no container gives no rows; a
    container without an archive is an error. Of equal paths in an archive each is a row.
    """
    ranges = _planned(spark, folder, suffix, **options)
    found = _read(ranges, content).where("NOT is_dir")
    named = _read(ranges, content=False).select("container", "path", "is_dir")
    steps = F.split("path", "/")
    depth = F.size(steps) - F.when(F.col("is_dir"), 0).otherwise(1)
    above = F.transform(F.sequence(F.lit(1), depth), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(steps, 2, k - 1), "/")))
    folders = named.select("container", F.explode(above).alias("path")).distinct()
    return found.unionByName(folders.select("container", "path", F.lit(True).alias("is_dir"), F.lit(0).cast("bigint").alias("size"), F.lit(None).cast("binary").alias("content")))


def children(tree: DataFrame, folder: str) -> DataFrame:
    """Direct children of a directory: container, name, is_dir, size."""
    prefix = folder.rstrip("/") + "/"
    rest = F.substr("path", F.lit(len(prefix) + 1))
    below = tree.where(F.startswith("path", F.lit(prefix)) & (F.col("path") != prefix)).withColumn("name", rest)
    return below.where((F.col("name") != "") & ~F.contains("name", F.lit("/"))).select("container", "name", "is_dir", "size").distinct()


def read_range(spark: SparkSession, folder: str, path: str, offset: int, length: int, suffix: str = ".ufdr") -> DataFrame:
    """Bytes of an entry, of which no more is read than up to their end: container, data."""
    found = _scan(spark, folder, suffix=suffix, entry=path, begin=offset, length=length)
    return found.where("NOT is_dir").select("container", F.col("content").alias("data"))
