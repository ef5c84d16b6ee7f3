"""Flat-array helpers: a batch of texts as one byte or code-point array with offsets.

Python tasks of this subpackage never loop over characters; they work on these arrays, in slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SLICE_BYTES = 1 << 19
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))


def bounded_batches(spark: SparkSession, rows: int = 500, size: str = "8m") -> None:
    """Keep the Arrow batches sent to Python small, for texts of any length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it where the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def schema_of(df: DataFrame, columns: Iterable[str], added: str) -> T.StructType:
    """A schema of some of a table's columns and of added ones in DDL."""
    return T.StructType([*(df.schema[c] for c in columns), *T.StructType.fromDDL(added).fields])


def map_batches(df: DataFrame, function, schema: str | T.StructType) -> DataFrame:
    """mapInArrow with bounded batches."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut and join batches so that each has about ``most`` bytes of text, or a single longer text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        at, lengths = 0, _lengths(batch.column(column))
        ends = np.cumsum(lengths)
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + most - size, "right")))
            held.append(batch.slice(at, upto - at))
            size += int(ends[upto - 1] - before)
            at = upto
            if size >= most or at < batch.num_rows:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _lengths(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts as Python strings; null is empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def bytes_of(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null is empty."""
    values = pc.fill_null(batch.column(column), "").cast(pa.large_string())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


@lru_cache(maxsize=4)
def byte_values(fold: bool, seed: int = 7) -> np.ndarray:
    """A random 64-bit value per byte; with ``fold`` A-Z get those of a-z."""
    values = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)
    if fold:
        values[65:91] = values[97:123]
    return values


_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=_U)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(29)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(32)
    return x


def segment_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the segments [start, end) of an array of 64-bit symbol values: equal segments, equal hashes."""
    up, down = _power_tables(len(values))
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    lengths = (ends - starts).astype(_U)
    return mix((sums[ends] - sums[starts]) * down[starts] + lengths * _U(0xD6E8FEB86659FD93))


def words_of(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes, offsets of each text's words) of maximal runs of bytes for which ``inside`` holds."""
    mask = inside[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = mask[:-1], mask[1:]
    first, last = offsets[:-1], offsets[1:]
    full = last > first
    before[first[full]] = False
    after[last[full] - 1] = False
    starts, ends = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    hashes = segment_hashes(byte_values(fold)[data], starts, ends)
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of start..start+length for each pair."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - at, lengths)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values over [offsets[i], offsets[i + 1]); empty segments give 0."""
    sums = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of texts; lone surrogates pass."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum(lengths)])


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    table = np.full(0x110000, 32, np.uint32)
    for i in range(0x10000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    table[0x20000:0x30000] = np.arange(0x20000, 0x30000)
    return table


def letters(points: np.ndarray) -> np.ndarray:
    """Lower-cased letters; everything else becomes a space."""
    return _letter_table()[points]
