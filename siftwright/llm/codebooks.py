"""Operator 13: vector code compression by Elkan's Lloyd rounds, one codebook for each of the equal parts of a vector.

Every vector keeps, in a table that is written anew each round, an upper bound of the distance from each of its parts to the
entry it is assigned to, and a lower bound of the distance to every entry. When entries have moved, upper bounds grow and
lower bounds shrink by the movement. A part stays where it is without any new distance if its upper bound lies strictly below
half the distance from its entry to the next one; else only entries whose lower bound and whose triangle bound don't lie
strictly above the upper bound are measured again, in whole numbers, and the lowest index wins ties. Bounds are whole
numbers, upper ones rounded up and lower ones down, so that rounding never prunes an entry that is as near.

A round maps the table without a shuffle; sums of the points come from its two narrow columns, one row per part, entry and
partition, merged by a groupBy into at most ``parts * entries`` rows. A lost executor repeats its share from the last table.

Defined results: vectors that are null, have another number of components, or hold null or non-finite ones give no row; of
fewer vectors than entries each starts one; rows that share an id are vectors of their own, ordered by their components where
they start entries; null ids come after all others; components beyond 2**27 count as 2**27; a total of errors beyond a long
is null; rows without a label form one group; empty tables give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.llm import centroids, flat, integers
from siftwright.session import shared_folder

DIMENSIONS = 64
SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Lower bounds are stored in 16 bits; one that would be larger counts as this, which is a lower bound still.
FARTHEST = (1 << 16) - 1
#: Groups whose totals go to every task; see ``integers.with_group_total``.
SEND_AT_MOST = 1_000_000
#: Rows of the table of bounds that a task holds at a time.
ROWS = 1000


def root_down(squares: np.ndarray) -> np.ndarray:
    """floor(sqrt(x)), exactly."""
    root = np.sqrt(squares.astype(float)).astype(np.int64)
    root -= root * root > squares
    return root + ((root + 1) ** 2 <= squares)


def root_up(squares: np.ndarray) -> np.ndarray:
    """ceil(sqrt(x)), exactly."""
    root = root_down(squares)
    return root + (root * root < squares)


def all_squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all entries, in whole numbers."""
    return (points * points).sum(1)[:, None] - 2 * (points @ entries.T) + (entries * entries).sum(1)[None, :]


def first_assignment(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(assigned entry, upper bound, lower bounds) of every point, all distances measured."""
    squares = all_squared(points, entries)
    own = squares.argmin(axis=1)
    return own, root_up(squares[np.arange(len(points)), own]), np.minimum(root_down(squares), FARTHEST)


def next_assignment(points: np.ndarray, entries: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The assignment after entries have moved by at most ``moved``, and how many distances were measured.

    ``apart`` holds lower bounds of the distances between entries, with the diagonal as large as can be.
    """
    own, upper, lower = own.copy(), upper + moved[own], np.maximum(lower - moved[None, :], 0)
    open_ = np.flatnonzero(~(2 * upper < apart.min(axis=1)[own]))
    off = points[open_] - entries[own[open_]]
    nearest = (off * off).sum(axis=1)
    upper[open_] = root_up(nearest)
    lower[open_, own[open_]] = np.minimum(root_down(nearest), FARTHEST)
    within = upper[open_][:, None]
    candidates = ~(within < lower[open_]) & ~(2 * within < apart[own[open_]])
    candidates[np.arange(len(open_)), own[open_]] = False
    row, entry = np.nonzero(candidates)
    off = points[open_[row]] - entries[entry]
    squares = (off * off).sum(axis=1)
    lower[open_[row], entry] = np.minimum(root_down(squares), FARTHEST)
    # the nearest of the entry held so far and of all that were measured; the lowest index of equally near ones
    row, entry, squares = np.concatenate([np.arange(len(open_)), row]), np.concatenate([own[open_], entry]), np.concatenate([nearest, squares])
    order = np.lexsort((entry, squares, row))
    first = np.ones(len(order), bool)
    first[1:] = row[order][1:] != row[order][:-1]
    best = order[first]
    own[open_], upper[open_] = entry[best], root_up(squares[best])
    return own, upper, lower, len(open_) + int(candidates.sum())


def _apart(entries: np.ndarray) -> np.ndarray:
    apart = root_down(all_squared(entries, entries))
    np.fill_diagonal(apart, 1 << 40)
    return apart


class _Codes:
    """Columns of the table of bounds: a vector's points, entries, upper and lower bounds as fixed-width binary values."""

    NAMES = ("points", "own", "upper", "lower")
    KINDS = (np.int32, np.int32, np.int64, np.uint16)

    @staticmethod
    def read(batch: pa.RecordBatch, name: str) -> np.ndarray:
        kind = dict(zip(_Codes.NAMES, _Codes.KINDS))[name]
        return np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(batch.num_rows, -1).astype(np.int64)

    @staticmethod
    def write(name: str, values: np.ndarray) -> pa.Array:
        kind = dict(zip(_Codes.NAMES, _Codes.KINDS))[name]
        flat_ = np.ascontiguousarray(values.reshape(len(values), -1).astype(kind))
        width = flat_.shape[1] * flat_.itemsize
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(values), [None, pa.py_buffer(flat_)]).cast(pa.binary())


def whole_vectors(rows: DataFrame, key: str, vector: str, label: str, dimensions: int, scale: int) -> DataFrame:
    """(key, label, point) of the vectors that count, as whole numbers."""
    return rows.where(integers.finite(vector, dimensions)).select(F.col(key).alias("key"), F.col(label).alias("label"), integers.scaled(vector, scale).alias("point"))


def starting_entries(points: DataFrame, entries: int = ENTRIES, parts: int = PARTS) -> np.ndarray:
    """(part, entry, component) of the points with the smallest keys."""
    first = points.select("key", "point").orderBy(F.asc_nulls_last("key"), "point").limit(entries).collect()  # at most ``entries`` rows
    found = np.array([r.point for r in first], np.int64)
    return found.reshape(len(first), parts, -1).transpose(1, 0, 2) if len(first) else np.zeros((parts, 0, 0), np.int64)


def _round(state: DataFrame, books: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """The table of bounds after an assignment to ``books``; ``before`` are the entries that its bounds refer to."""
    spark = state.sparkSession
    parts, n, _ = books.shape
    moved = None if before is None else np.stack([root_up(((books[p] - before[p]) ** 2).sum(axis=1)) for p in range(parts)])
    shared = spark.sparkContext.broadcast((books, moved, None if before is None else np.stack([_apart(b) for b in books])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, moved, apart = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                if moved is None:
                    points = np.asarray(batch.column("point").flatten()).astype(np.int64).reshape(batch.num_rows, parts, -1)
                    found = [first_assignment(points[:, p], books[p]) for p in range(parts)]
                else:
                    points, lower = _Codes.read(batch, "points").reshape(batch.num_rows, parts, -1), _Codes.read(batch, "lower").reshape(batch.num_rows, parts, n)
                    own, upper = _Codes.read(batch, "own"), _Codes.read(batch, "upper")
                    found = [next_assignment(points[:, p], books[p], own[:, p], upper[:, p], lower[:, p], moved[p], apart[p]) for p in range(parts)]
                new = [points, *(np.stack([f[i] for f in found], axis=1) for i in range(3))]
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), *(_Codes.write(name, x) for name, x in zip(_Codes.NAMES, new))], names=["key", "label", *_Codes.NAMES])

    flat.bounded_batches(spark, ROWS, "4m")
    return state.mapInArrow(run, flat.schema_of(state, ("key", "label"), ", ".join(f"{name} binary" for name in _Codes.NAMES)))


def _next_books(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries replaced by the floor of the means of their points; unused ones stay."""
    parts, n, width = books.shape
    names = [f"s{i}" for i in range(width)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * n, width), np.int64), np.zeros(parts * n, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            place = (_Codes.read(batch, "own") + n * np.arange(parts)[None, :]).ravel()
            points = _Codes.read(batch, "points").reshape(-1, width)
            order = np.argsort(place, kind="stable")
            found, at = np.unique(place[order], return_index=True)
            sums[found] += np.add.reduceat(points[order], at, axis=0)
            counts += np.bincount(place, minlength=parts * n)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), *(pa.array(sums[used, i]) for i in range(width))], names=["place", "n", *names])

    flat.bounded_batches(state.sparkSession, 20 * ROWS)
    partial = state.select("points", "own").mapInArrow(add, "place long, n long, " + ", ".join(f"{name} long" for name in names))
    merged = partial.groupBy("place").agg(F.sum("n").alias("n"), *(F.sum(name).alias(name) for name in names)).collect()
    sums, counts = np.zeros((parts * n, width), np.int64), np.zeros(parts * n, np.int64)
    for r in merged:  # at most one row a part and entry
        counts[r.place], sums[r.place] = r.n, [r[name] for name in names]
    return integers.floor_means(sums, counts, books.reshape(parts * n, width)).reshape(books.shape)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def compress(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", dimensions: int = DIMENSIONS, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(key, label, code, error) of every vector that counts, and the codebooks (part, entry, component).

    ``code`` has two hex digits a part; ``error`` is the squared distance to the entries that it names. The last table of
    bounds stays in the shared folder, as the codes are read from it; earlier ones are deleted once the next is written.
    """
    spark = rows.sparkSession
    points = whole_vectors(rows, key, vector, label, dimensions, scale)
    books = starting_entries(points, entries, parts)
    if not books.size:
        kinds = ", ".join(f"{name} {points.schema[name].dataType.simpleString()}" for name in ("key", "label"))
        return spark.createDataFrame([], f"{kinds}, code string, error long"), books
    folder = f"{shared_folder(spark)}/bounds_{uuid.uuid4().hex}"
    state, before = points, None
    for k in range(rounds + 1):
        _round(state, books, before).write.parquet(f"{folder}/{k}")
        state = spark.read.parquet(f"{folder}/{k}")
        if k:
            _delete(spark, f"{folder}/{k - 1}")
        if k < rounds:
            before, books = books, _next_books(state, books)
    return _codes(state, books), books


def _codes(state: DataFrame, books: np.ndarray) -> DataFrame:
    shared = state.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            own = _Codes.read(batch, "own")
            off = _Codes.read(batch, "points").reshape(batch.num_rows, len(books), -1) - np.stack([b[own[:, p]] for p, b in enumerate(books)], axis=1)
            codes = pa.array(["".join(f"{i:02x}" for i in row) for row in own.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), codes, pa.array((off * off).sum(axis=(1, 2)))], names=["key", "label", "code", "error"])

    flat.bounded_batches(state.sparkSession, 5 * ROWS)
    return state.select("key", "label", "points", "own").mapInArrow(run, flat.schema_of(state, ("key", "label"), "code string, error long"))


def describe(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, code, error, label_error and codebooks_sha256 of every vector that counts."""
    coded, books = compress(rows, key, vector, label)
    totalled = integers.with_group_total(coded, "label", "error", "label_error", SEND_AT_MOST)
    return totalled.select(F.col("key").alias(key), "code", "error", "label_error", F.lit(centroids.digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    floor = "CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END"
    square = "list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(v.p, c.p)])::BIGINT"
    assigned = lambda i: f"SELECT vec_id, v.q, min(struct_pack(d := {square}, k := c.k)) AS b, any_value(v.p) AS p FROM v JOIN c{i} c ON c.q = v.q GROUP BY vec_id, v.q"
    parts = [
        "w AS MATERIALIZED (SELECT vec_id, label, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS p FROM embeddings WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64)",
        "v AS MATERIALIZED (SELECT vec_id, q, p[16 * q + 1 : 16 * q + 16] AS p FROM w, range(4) r(q))",
        "s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM w ORDER BY vec_id LIMIT 256)",
        "c0 AS MATERIALIZED (SELECT q, k, p FROM v JOIN s USING (vec_id))",
    ]
    for i in range(ROUNDS):
        parts.append(f"a{i} AS MATERIALIZED ({assigned(i)})")
        parts.append(f"m{i} AS (SELECT q, k, list({floor} ORDER BY i) AS p FROM (SELECT q, k, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT q, b.k AS k, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM a{i}) GROUP BY q, k, i) GROUP BY q, k)")
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.q, c.k, coalesce(m.p, c.p) AS p FROM c{i} c LEFT JOIN m{i} m ON m.q = c.q AND m.k = c.k)")
    parts.append(f"z AS MATERIALIZED ({assigned(ROUNDS)})")
    parts.append("e AS MATERIALIZED (SELECT vec_id, string_agg(printf('%02x', b.k), '' ORDER BY q) AS code, sum(b.d)::BIGINT AS error FROM z GROUP BY vec_id)")
    parts.append(f"h AS (SELECT sha256(string_agg(array_to_string(p, ','), ',' ORDER BY q, k)) AS codebooks_sha256 FROM c{ROUNDS})")
    return f"WITH {', '.join(parts)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e JOIN w USING (vec_id), h"


ORACLE = _oracle()
