"""Approximate nearest neighbours: inverted lists with product quantisation, stored as tables, re-ranked exactly.

Building: coarse centres and the codebooks of residuals are fitted on a bounded sample (``SAMPLE_ROWS``); every row of the
gallery is then assigned to its list and coded, one byte a part, in one pass without a shuffle but the write's. Searching: a
query goes to its ``probes`` nearest lists; a task holds some queries and reads the codes of their lists in blocks of bounded
size; inner products with the decoded vectors rank the codes, and the best ``candidates`` of a query are ranked again by their
exact cosine with the vectors, which lie beside the codes: the task passes them once more, so that none is shuffled.

Vectors that are null, of another length, zero or not finite are in no list and find nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siftwright.operators import neighbours, similarity
from siftwright.session import materialise
from siftwright.sources.filewriter import store_of

#: Rows that centres and codebooks are fitted on, at most about.
SAMPLE_ROWS = 50_000
LISTS = 4096
ENTRIES = 256
ROUNDS = 10
#: Rows that the settings of a search are measured on.
TUNING_QUERIES = 300
#: Codes that a task reads at a time; queries that it holds at most, and at least where there are more tasks than work.
CODE_ROWS = 8192
QUERY_ROWS = 4096
FEWEST_QUERIES = 256
#: Candidates that a task holds about; where a query has many, it holds fewer queries.
HELD_ROWS = 1 << 20


@dataclass
class Index:
    """An index in a folder: coarse centres (list, component) and codebooks (part, entry, component)."""

    folder: str
    centres: np.ndarray
    books: np.ndarray

    def codes(self, spark: SparkSession) -> DataFrame:
        """The stored table: list, key, code and vector (in double precision)."""
        return spark.read.parquet(f"{self.folder}/codes")


def _means(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Lloyd rounds on a sample, from distinct points far apart by chance; empty centres keep their place."""
    random = np.random.default_rng(seed)
    different = np.unique(points, axis=0)
    centres = different[random.permutation(len(different))[:k]]
    for _ in range(ROUNDS):
        own = _nearest(points, centres)
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, points)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres * centres).sum(axis=1)
    return np.concatenate([(points[at : at + 4096] @ centres.T - half).argmax(axis=1) for at in range(0, len(points), 4096)]) if len(points) else np.zeros(0, np.int64)


def _coded(units: np.ndarray, centres: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(list, code) of unit vectors."""
    own = _nearest(units, centres)
    parts = np.split(units - centres[own], len(books), axis=1)
    return own, np.stack([_nearest(part, book) for part, book in zip(parts, books)], axis=1).astype(np.uint8)


def build(gallery: DataFrame, key: str, folder: str, vector: str = "embedding", lists: int | None = None, parts: int = 16, seed: int = 3) -> Index:
    """Fit, code every usable row and write the tables ``codes``, ``centres`` and ``books`` below a new folder."""
    spark = gallery.sparkSession
    size = gallery.where(F.col(vector).isNotNull()).agg(F.count("*").alias("n"), F.mode(F.size(vector), True).alias("d")).first()
    if not size.n:
        raise ValueError("the gallery holds no vector")
    if size.d % parts:
        raise ValueError(f"{size.d} components can't be cut into {parts} equal parts")
    good = gallery.where(neighbours.usable(vector, size.d)).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    share = min(1.0, SAMPLE_ROWS / size.n)
    sample = good.where(F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1 << 20)) < int((1 << 20) * share)).orderBy("key").select("v").toArrow()
    units = neighbours.unit_rows(sample["v"].combine_chunks(), size.d)
    centres = _means(units, lists or max(1, min(LISTS, round(size.n**0.5))), seed)
    rest = units - centres[_nearest(units, centres)]
    books = [_means(part, ENTRIES, seed + 1 + k) for k, part in enumerate(np.split(rest, parts, axis=1))]
    books = np.stack([np.concatenate([b, np.repeat(b[:1], ENTRIES - len(b), axis=0)]) for b in books])
    shared = spark.sparkContext.broadcast((centres, books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                units = neighbours.unit_rows(batch.column("v"), size.d)
                own, code = _coded(units, *shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch.column("key"), *(pa.array([row.tobytes() for row in x], pa.binary()) for x in (code, units))], names=["list", "key", "code", "vector"])

    schema = T.StructType([T.StructField("list", T.IntegerType()), good.schema["key"], T.StructField("code", T.BinaryType()), T.StructField("vector", T.BinaryType())])
    good.mapInArrow(run, schema).repartitionByRange("list", "key").sortWithinPartitions("list").write.parquet(f"{folder}/codes")
    spark.createDataFrame([(i, c) for i, c in enumerate(centres.tolist())], "list int, centre array<double>").coalesce(1).write.parquet(f"{folder}/centres")
    spark.createDataFrame([(p, e, v) for p, b in enumerate(books.tolist()) for e, v in enumerate(b)], "part int, entry int, centre array<double>").coalesce(1).write.parquet(f"{folder}/books")
    return Index(folder, centres, books)


def load(spark: SparkSession, folder: str) -> Index:
    """An index that ``build`` has written; its centres and codebooks have bounded sizes."""
    centres = [r.centre for r in spark.read.parquet(f"{folder}/centres").orderBy("list").collect()]
    books = [r.centre for r in spark.read.parquet(f"{folder}/books").orderBy("part", "entry").collect()]
    return Index(folder, np.array(centres), np.array(books).reshape(len(books) // ENTRIES, ENTRIES, -1))


class _Task:
    """What a task of a search does with its queries: the codes of their lists are passed, then what lies beside the best."""

    def __init__(self, folder: str, centres: np.ndarray, books: np.ndarray, probes: int, candidates: int) -> None:
        store, place = store_of(folder)
        self.codes = ds.dataset(place, filesystem=store, format="parquet")
        self.centres, self.books, self.probes, self.candidates = centres, books, probes, candidates

    def _batches(self, lists: np.ndarray, columns: list[str]) -> Iterator[tuple[int, pa.RecordBatch]]:
        """Batches of these lists, one after the other, each with the number of rows before it."""
        before = 0
        for batch in self.codes.to_batches(columns=columns, filter=ds.field("list").isin(lists.tolist()), batch_size=CODE_ROWS, use_threads=False, batch_readahead=1, fragment_readahead=1):
            if batch.num_rows:
                yield before, batch
                before += batch.num_rows

    def best(self, units: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray] | None]:
        """The lists of some queries, and query, row among those of the lists and estimate of the best codes."""
        near = np.argsort((self.centres * self.centres).sum(axis=1) - 2 * units @ self.centres.T, axis=1, kind="stable")[:, : self.probes]
        lists = np.unique(near)
        probed = np.zeros((len(self.centres), len(units)), bool)
        probed[near.ravel(), np.repeat(np.arange(len(units)), near.shape[1])] = True
        narrow, centres, most = units.astype(np.float32), self.centres.astype(np.float32), self.candidates
        entries, parts = self.books.reshape(-1, self.books.shape[2]).astype(np.float32), np.arange(len(self.books)) * ENTRIES
        best = neighbours.Best(len(units), most)
        for before, batch in self._batches(lists, ["list", "code"]):
            own = np.asarray(batch.column("list"))
            code = neighbours.packed(batch.column("code"), np.uint8, len(self.books))
            decoded = centres[own] + entries[code + parts].reshape(len(own), -1)
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1), len(own)]
            for low, high in zip(cuts, cuts[1:]):
                asking = np.flatnonzero(probed[own[low]])
                for first in range(0, len(asking), neighbours.TILE_ROWS):
                    some = asking[first : first + neighbours.TILE_ROWS]
                    estimate = narrow[some] @ decoded[low:high].T
                    floor = best.least[some]
                    fresh = ~np.isfinite(floor)
                    if high - low > most and fresh.any():  # none below the list's own best is wanted
                        floor[fresh] = np.partition(estimate[fresh], high - low - most, axis=1)[:, high - low - most]
                    query, at = neighbours.above(estimate, floor.astype(np.float32))
                    best.add(some[query], before + low + at, estimate[query, at])
        return lists, best.settled()

    def beside(self, lists: np.ndarray, rows: np.ndarray, columns: list[str]) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
        """Columns of rows, told by their places in order, and which of them a batch has."""
        for before, batch in self._batches(lists, columns):
            low, high = np.searchsorted(rows, (before, before + batch.num_rows))
            if low < high:
                yield np.arange(low, high), batch.take(pa.array(rows[low:high] - before))


def _searched(index: Index, queries: DataFrame, key: str, vector: str, probes: int, candidates: int, columns: str, found) -> DataFrame:
    """query, target and ``columns``: what ``found`` makes of a task, the keys and the unit vectors of up to ``QUERY_ROWS``
    queries."""
    spark = queries.sparkSession
    shared, folder = spark.sparkContext.broadcast((index.centres, index.books)), f"{index.folder}/codes"
    dimensions = index.centres.shape[1]
    asked = queries.where(neighbours.usable(vector, dimensions)).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    schema = T.StructType([T.StructField("query", asked.schema["key"].dataType), T.StructField("target", index.codes(spark).schema["key"].dataType), *T.StructType.fromDDL(columns).fields])
    types, query_rows = [f.type for f in to_arrow_schema(schema)], max(1, min(QUERY_ROWS, HELD_ROWS // candidates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Task(folder, *shared.value, probes, candidates)
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= query_rows:
                yield from answered(task, pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from answered(task, pa.Table.from_batches(held))

    def answered(task: _Task, wanted: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = wanted["key"].combine_chunks()
        rows = found(task, np.array(keys.to_pylist()), neighbours.unit_rows(wanted["v"].combine_chunks(), dimensions))
        if rows is not None:
            query, target, *others = rows
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(query)).cast(types[0]), pa.array(target.tolist(), types[1]), *(pa.array(x, t) for x, t in zip(others, types[2:]))], names=schema.names)

    n = asked.count()
    tasks = max(1, -(-n // query_rows), min(2 * spark.sparkContext.defaultParallelism, n // FEWEST_QUERIES))
    return asked.repartition(tasks, "key").mapInArrow(run, schema)


def candidates_of(index: Index, queries: DataFrame, key: str, vector: str = "embedding", probes: int = 24, candidates: int = 100) -> DataFrame:
    """query, target and estimated similarity of the best codes in a query's lists.

    A task holds up to ``QUERY_ROWS`` queries and reads the codes of their lists from the index, so that nothing is shuffled
    but the queries, and gives only the best codes of all lists.
    """

    def found(task: _Task, keys: np.ndarray, units: np.ndarray):
        lists, best = task.best(units)
        if best is None:
            return None
        query, row, estimate = best
        order = np.argsort(row, kind="stable")
        target = np.concatenate([np.array(batch["key"].to_pylist()) for _, batch in task.beside(lists, row[order], ["key"])])
        return query[order], target, estimate[order].astype(float)

    return _searched(index, queries, key, vector, probes, candidates, "estimate double", found)


def search(index: Index, queries: DataFrame, gallery: DataFrame, k: int, key: str, target: str, vector: str = "embedding", probes: int = 24, candidates: int = 100, exclude_self: bool = False) -> DataFrame:
    """query, target, similarity, rank: about the k nearest gallery rows of every query, by exact cosine (ties by target).

    The vectors are those that the index was built of; rows that the gallery has lost since are left out.
    """

    def found(task: _Task, keys: np.ndarray, units: np.ndarray):
        lists, rows = task.best(units)
        if rows is None:
            return None
        order = np.argsort(rows[1], kind="stable")
        asking, row = rows[0][order], rows[1][order]
        best = neighbours.Best(len(units), k)
        for part, batch in task.beside(lists, row, ["key", "vector"]):
            query, ids = asking[part], np.array(batch["key"].to_pylist())
            near = np.einsum("ij,ij->i", units[query], neighbours.packed(batch["vector"], float, units.shape[1])).round(12)
            kept = near >= best.least[query]
            if exclude_self:
                kept &= keys[query] != ids
            best.add(query[kept], ids[kept], near[kept])
        if (nearest := best.settled()) is None:
            return None
        query, ids, near = nearest
        return query, ids, near, np.arange(1, len(query) + 1) - np.searchsorted(query, query)

    hits = _searched(index, queries, key, vector, probes, candidates + exclude_self, "similarity double, rank bigint", found)
    return hits.join(gallery.select(F.col(target).alias("target")), "target", "left_semi").select("query", "target", "similarity", "rank")


def tune(index: Index, gallery: DataFrame, k: int, key: str, vector: str = "embedding", goal: float = 0.97, queries: int = TUNING_QUERIES) -> tuple[int, int]:
    """(probes, candidates) with which about ``queries`` rows of the gallery, chosen by a hash, find at least ``goal`` of their
    exact neighbours: lists are added until they hold enough of them, then candidates are doubled until the search finds them."""
    spark, dimensions = gallery.sparkSession, index.centres.shape[1]
    good = gallery.where(neighbours.usable(vector, dimensions))
    sample = good.orderBy(F.xxhash64(F.lit(41), F.col(key)), key).limit(queries)
    exact = materialise(similarity.batch_neighbours(sample, good, k, key, key, vector, exclude_self=True).select("query", "target"))
    placed = exact.join(index.codes(spark).select(F.col("key").alias("target"), "list"), "target").join(sample.select(F.col(key).alias("query"), F.col(vector).cast("array<double>").alias("v")), "query")
    rows = placed.select("v", "list").toArrow().combine_chunks()  # k rows a query of the sample
    if not rows.num_rows:
        return 1, k
    units = neighbours.unit_rows(rows["v"].combine_chunks(), dimensions)
    far = (index.centres**2).sum(axis=1) - 2 * units @ index.centres.T
    own = far[np.arange(len(units)), np.asarray(rows["list"])]
    probes = int(np.quantile((far < own[:, None]).sum(axis=1), 1 - (1 - goal) / 2, method="higher")) + 1
    candidates = 10 * k
    while candidates < 100_000:
        if recall(search(index, sample, good, k, key, key, vector, probes, candidates, exclude_self=True), exact).first().recall >= goal:
            break
        candidates *= 2
    return probes, candidates


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """queries, and the share of the exact neighbours (query, target) that were found."""
    hit = exact.select("query", "target").join(found.select("query", "target", F.lit(1).alias("hit")), ["query", "target"], "left")
    return hit.agg(F.countDistinct("query").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
