"""First and last lines of logs of any size, by reading bytes from their ends.

Each log is a row; a task reads blocks from the beginning, or from the end backwards, until it has seen enough line breaks, so
a log costs about as many bytes as its shown lines have. Stores are those of ``pyarrow.fs``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from siftwright.sources import files
from siftwright.sources.filewriter import store_of

BLOCK = 1 << 16
_SCHEMA = "path string, n bigint, line string, bytes_read bigint"


def first_lines(file, n: int, block: int = BLOCK) -> tuple[list[bytes], int]:
    """(the first n lines, bytes read)."""
    held, read = b"", 0
    while held.count(b"\n") < n:
        more = file.read(block)
        if not more:
            break
        held, read = held + more, read + len(more)
    return _lines(held)[:n], read


def last_lines(file, size: int, n: int, block: int = BLOCK) -> tuple[list[bytes], int]:
    """(the last n lines, bytes read); a break at the very end ends the last line."""
    parts: list[bytes] = []
    breaks, at = 0, size
    while at > 0 and breaks <= n:
        step = min(block, at)
        at -= step
        file.seek(at)
        parts.append(file.read(step))
        breaks += parts[-1].count(b"\n")
    lines = _lines(b"".join(reversed(parts)))
    return lines[-n:] if n else [], size - at


def _lines(data: bytes) -> list[bytes]:
    lines = data.split(b"\n")
    return [x.removesuffix(b"\r") for x in (lines[:-1] if not lines[-1] else lines)]


def _ends(spark: SparkSession, folder: str, n: int, last: bool, suffixes: tuple[str, ...]) -> DataFrame:
    listed = files.dealt(files.listing(spark, folder, suffixes).select("path", "length"), sized=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                store, place = store_of(path)
                with store.open_input_file(place) as file:
                    lines, read = last_lines(file, size, n) if last else first_lines(file, n)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(lines), pa.string()), pa.array(range(1, len(lines) + 1), pa.int64()), pa.array([x.decode("utf-8", "replace") for x in lines], pa.string()), pa.array([read] * len(lines), pa.int64())], names=["path", "n", "line", "bytes_read"])

    return listed.mapInArrow(run, _SCHEMA)


def head(spark: SparkSession, folder: str, n: int = 10, suffixes: tuple[str, ...] = (".log", ".txt")) -> DataFrame:
    """The first n lines of every log of a folder, which is the feature: path, n, line, bytes_read."""
    return _ends(spark, folder, n, False, suffixes)


def tail(spark: SparkSession, folder: str, n: int = 1000, suffixes: tuple[str, ...] = (".log", ".txt")) -> DataFrame:
    """The last n lines of every log of a folder, in file order: path, n (from 1), line, bytes_read."""
    return _ends(spark, folder, n, True, suffixes)
