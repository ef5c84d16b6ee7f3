"""Exact nearest neighbours of a large query side: a join of blocks that the triangle inequality prunes.

Vectors at length 1 have the distance sqrt(2 - 2 cosine), so cosine order is distance order. Both sides are dealt by their
nearest pivot and by rings of the distance to it into blocks of bounded size; frequent vectors are spread over several. A
first pass compares each query block with two gallery blocks of its own cell and ring, which bounds how far its k-th neighbour
can be. A second pass takes every other gallery block whose lower bound (pivot distances and rings) doesn't lie beyond that.
Blocks of both sides are written once to the shared folder, and what is shuffled are their places alone: a task reads a few
query blocks and then, the nearest first, one gallery block at a time that any of them is paired with; it holds k rows a query.
Blocks are compared in single precision; what could be among the best within its error is compared again in double precision.

Vectors that are null, of another length, zero or not finite have no neighbours and are nobody's neighbours.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siftwright.session import materialise, shared_folder
from siftwright.sources.filewriter import store_of

#: Rows of a block, and gallery blocks that one task compares with a query block at most.
BLOCK_ROWS = 1024
SLICE_BLOCKS = 64
#: Query blocks that a task holds together at most, so that a gallery block is read once for all of them.
QUERY_BLOCKS = 16
#: Pivots at most; their distances to each other are sent to every task.
PIVOTS = 256
RINGS = 4
#: Tables of block counts up to this many rows are broadcast; beyond it they are joined by key.
SEND_AT_MOST = 500_000
#: What rounding may hide of a distance; no block is pruned by less.
SLACK = 4e-6
#: Rows of queries that are compared at a time, and pairs that are compared again at a time.
TILE_ROWS = 2048
AGAIN_ROWS = 8192


def usable(vector: str, dimensions: int) -> Column:
    """True for a finite vector of that many components that isn't zero."""
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    doubles = F.col(vector).cast("array<double>")
    return F.coalesce((F.size(vector) == dimensions) & F.forall(doubles, fits) & F.exists(doubles, lambda x: x != 0), F.lit(False))


def unit_rows(column: pa.Array, dimensions: int) -> np.ndarray:
    """Vectors of a list column at length 1."""
    rows = np.asarray(column.flatten()).astype(float).reshape(-1, dimensions)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True) if len(rows) else rows  # so that squares neither overflow nor vanish
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def distance(similarity: np.ndarray) -> np.ndarray:
    """The distance of unit vectors with a cosine."""
    return np.sqrt(np.maximum(2 - 2 * similarity, 0))


def pivots_of(gallery: DataFrame, key: str, vector: str, dimensions: int, n: int) -> np.ndarray:
    """Up to n different unit vectors, by a hash of their key."""
    rows = gallery.orderBy(F.xxhash64(F.lit(29), F.col(key)), F.col(key)).limit(n).select(F.col(vector).cast("array<double>").alias("v")).toArrow()
    return np.unique(unit_rows(rows["v"].combine_chunks(), dimensions), axis=0) if rows.num_rows else np.zeros((0, dimensions))


def _placed(rows: DataFrame, key: str, vector: str, within: str | None, dimensions: int, pivots: np.ndarray) -> DataFrame:
    """key, within, unit vector (binary), cell (nearest pivot) and distance to it of every usable row."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            units = unit_rows(batch.column("v"), dimensions)
            near = units @ shared.value.T
            cell = near.argmax(axis=1)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * dimensions), len(units), [None, pa.py_buffer(np.ascontiguousarray(units))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("within"), packed, pa.array(cell.astype(np.int32)), pa.array(distance(near[np.arange(len(units)), cell]))], names=["key", "within", "unit", "cell", "off"])

    chosen = rows.where(usable(vector, dimensions)).select(F.col(key).alias("key"), (F.lit(0) if within is None else F.col(within)).alias("within"), F.col(vector).cast("array<double>").alias("v"))
    chosen = chosen.where("within IS NOT NULL")
    return chosen.mapInArrow(run, T.StructType([*chosen.schema.fields[:2], *T.StructType.fromDDL("unit binary, cell int, off double").fields]))


def _blocks(placed: DataFrame, rings: DataFrame, block_rows: int) -> DataFrame:
    """Blocks: block (within, cell, ring, salt), rows (key, unit), n, lo and hi (distances to the pivot)."""
    ring = F.coalesce(F.size(F.filter("edges", lambda x: x < F.col("off"))), F.lit(0))
    ringed = placed.join(F.broadcast(rings), "cell", "left").withColumn("ring", ring).drop("edges")  # one row a pivot
    place = ["within", "cell", "ring"]
    large = ringed.groupBy(*place).agg(F.count("*").alias("n")).where(F.col("n") > block_rows).select(*place, F.ceil(F.col("n") / block_rows).alias("salts"))
    large = materialise(large)
    salted = ringed.join(F.broadcast(large) if large.count() <= SEND_AT_MOST else large, place, "left")
    block = F.struct(*place, F.pmod(F.xxhash64(F.lit(5), "key"), F.coalesce("salts", F.lit(1))).alias("salt"))
    return salted.select(block.alias("block"), "key", "unit", "off").groupBy("block").agg(F.collect_list(F.struct("key", "unit")).alias("rows"), F.count("*").alias("n"), F.min("off").alias("lo"), F.max("off").alias("hi"))  # about block_rows a group


def _stored(blocks: DataFrame, side: str) -> DataFrame:
    """Blocks written to files of the shared folder, a file a task: their columns with their place (file, at, size) for
    ``rows``."""
    folder = f"{shared_folder(blocks.sparkSession)}/blocks_{uuid.uuid4().hex}"
    others = [f for f in blocks.schema.fields if f.name != "rows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at = None, 0
        for batch in batches:
            places = []
            for rows in batch.column("rows"):
                if out is None:
                    name = f"{folder}/{uuid.uuid4().hex}"
                    store, place = store_of(name)
                    store.create_dir(place.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(place)
                held = pa.BufferOutputStream()
                record = pa.RecordBatch.from_struct_array(rows.values)
                with pa.ipc.new_stream(held, record.schema) as stream:
                    stream.write_batch(record)
                data = held.getvalue()
                out.write(data)
                places.append((name, at, data.size))
                at += data.size
            if places:
                kinds = (pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in others), *(pa.array(x, t) for x, t in zip(zip(*places), kinds))], names=[*(f.name for f in others), "file", "at", "size"])
        if out is not None:
            out.close()

    return blocks.mapInArrow(run, T.StructType([*others, *T.StructType.fromDDL("file string, at bigint, size bigint").fields])).withColumnRenamed("block", side)


def packed(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """Rows of numbers from a binary column, not empty, whose values all hold ``width`` of them."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(-1, width)


def above(values: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the values that reach the floor of their row; where there are few, eight are passed at a time."""
    wide = -(-values.shape[1] // 8) * 8
    mask = np.zeros((len(values), wide), bool)
    np.greater_equal(values, floor[:, None], out=mask[:, : values.shape[1]])
    some = np.flatnonzero(mask.view(np.uint64).ravel() != 0)
    at, bit = np.nonzero(mask.reshape(-1, 8)[some])
    return np.divmod(some[at] * 8 + bit, wide) if wide else (some, some)


class Best:
    """The k best of every query, and ``least``, what another has to reach; ties by the smaller id, or, of scores in single
    precision, by what was added first.

    What is added waits until it is as much as what is held, so that it is sorted only now and then.
    """

    def __init__(self, queries: int, k: int, least: np.ndarray | None = None) -> None:
        self.k, self.least = k, np.full(queries, -np.inf) if least is None else least
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting, self.room = 0, max(1, queries * k)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if len(query):
            self.held.append((query, ids, score))
            self.waiting += len(query)
            if self.waiting >= self.room:
                self.settled()

    def settled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """query (by its place), id and score in order, None where nothing was added."""
        if not self.held:
            return None
        q, ids, s = (np.concatenate(x) for x in zip(*self.held)) if len(self.held) > 1 else self.held[0]
        if s.dtype == np.float32:  # query and score in one number
            bits = s.view(np.int32)
            order = np.argsort((q << 32) - np.where(bits < 0, bits ^ 0x7FFFFFFF, bits), kind="stable")
        else:
            order = np.lexsort((np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids, -s, q))
        q, ids, s = q[order], ids[order], s[order]
        counts = np.bincount(q, minlength=len(self.least))
        place = np.arange(len(q)) - (np.cumsum(counts) - counts)[q]
        full, kept = place == self.k - 1, place < self.k
        self.least[q[full]] = np.maximum(self.least[q[full]], s[full])
        self.held, self.waiting = [(q[kept], ids[kept], s[kept])], 0
        return self.held[0]


def _opened(file: str, at: int, size: int, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and unit vectors of a stored block."""
    store, place = store_of(file)
    with store.open_input_file(place) as held:
        held.seek(at)
        rows = pa.ipc.open_stream(held.read(size)).read_all().combine_chunks()
    return np.array(rows["key"].to_pylist()), packed(rows["unit"].chunk(0), float, dimensions)


def _compared(queries: DataFrame, gallery: DataFrame, pairs: DataFrame, k: int, dimensions: int, exclude_self: bool) -> DataFrame:
    """query, target, similarity: for every query the k best rows of the gallery blocks that its block is paired with, of
    those that reach ``reach`` (its k-th similarity so far).

    ``pairs`` has q, slice, g and lower, ``queries`` q, place, key (a null of the key's type) and reach, ``gallery`` g, place
    and key.
    """
    place = F.struct("file", "at", "size")
    offered = pairs.join(gallery.select("g", place.alias("place")), "g").groupBy("q", "slice").agg(F.array_sort(F.collect_list(F.struct("lower", "place"))).alias("offered"))
    items = offered.join(queries.select("q", place.alias("own"), "reach"), "q").withColumn("_group", F.pmod(F.xxhash64(F.lit(31), "q"), F.lit(1 << 20)))
    items = materialise(items.select("slice", "_group", "own", "reach", "offered"))
    tasks = max(1, min(items.count(), max(items.sparkSession.sparkContext.defaultParallelism, -(-items.count() // QUERY_BLOCKS))))
    dealt = items.repartitionByRange(tasks, "slice", "_group").sortWithinPartitions("slice", "_group").drop("slice", "_group")
    schema = T.StructType([T.StructField("query", queries.schema["key"].dataType), T.StructField("target", gallery.schema["key"].dataType), T.StructField("similarity", T.DoubleType())])
    types = [f.type for f in to_arrow_schema(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, QUERY_BLOCKS):
                rows = batch.slice(first, QUERY_BLOCKS)
                blocks = [_opened(**own, dimensions=dimensions) for own in rows.column("own").to_pylist()]
                keys, units = (np.concatenate(x) for x in zip(*blocks))
                ends = np.cumsum([len(x) for x, _ in blocks])
                spans = [slice(end - len(x), end) for end, (x, _) in zip(ends, blocks)]
                least = [np.full(len(x), -np.inf) if reach is None else np.array(reach, float) for (x, _), reach in zip(blocks, rows.column("reach").to_pylist())]
                best, narrow = Best(len(keys), k, np.concatenate(least)), units.astype(np.float32)
                wanted: dict[tuple, list] = {}
                for span, offers in zip(spans, rows.column("offered").to_pylist()):
                    for offer in offers:
                        wanted.setdefault(tuple(offer["place"].values()), []).append((offer["lower"], span))
                for at in sorted(wanted, key=lambda x: min(lower for lower, _ in wanted[x])):
                    far = lambda span: distance(best.least[span].min().clip(-1, 1)) + SLACK
                    near = [span for lower, span in wanted[at] if lower <= far(span)]
                    if near:
                        ids, others = _opened(*at, dimensions)
                        some = np.concatenate([np.arange(len(keys))[span] for span in near])
                        for low in range(0, len(some), TILE_ROWS):
                            _improve(best, some[low : low + TILE_ROWS], keys, units, narrow, ids, others, exclude_self)
                if (found := best.settled()) is not None:
                    query, ids, value = found
                    yield pa.RecordBatch.from_arrays([pa.array(keys[query].tolist(), types[0]), pa.array(ids.tolist(), types[1]), pa.array(value)], names=schema.names)

    return dealt.mapInArrow(run, schema)


def _improve(best: Best, some: np.ndarray, keys: np.ndarray, units: np.ndarray, narrow: np.ndarray, ids: np.ndarray, others: np.ndarray, exclude_self: bool) -> None:
    """Take the rows of a gallery block into the best of some queries."""
    found = narrow[some] @ others.astype(np.float32).T
    error = (units.shape[1] + 8) * 2.0**-23  # of single precision, at most
    least, most = best.least[some], best.k + exclude_self
    floor = least - error
    bound = lambda rows: np.partition(rows, rows.shape[1] - most, axis=1)[:, rows.shape[1] - most] - 2 * error
    fresh = ~np.isfinite(least)
    if found.shape[1] > most and fresh.any():  # none below the block's own best is wanted
        floor[fresh] = bound(found[fresh])
    query, at = above(found, floor.astype(np.float32))
    if found.shape[1] > most and len(query) > 8 * most * len(some):
        query, at = above(found, np.maximum(floor, bound(found)).astype(np.float32))
    query = some[query]
    for low in range(0, len(query), AGAIN_ROWS):
        q, g = query[low : low + AGAIN_ROWS], at[low : low + AGAIN_ROWS]
        value = np.einsum("ij,ij->i", units[q], others[g]).round(12)
        kept = value >= best.least[q]
        if exclude_self:
            kept &= keys[q] != ids[g]
        best.add(q[kept], ids[g[kept]], value[kept])


def neighbour_join(queries: DataFrame, gallery: DataFrame, k: int, key: str, target: str, vector: str = "embedding", within: str | None = None, exclude_self: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query, target, similarity, rank: the k nearest gallery rows of every query by cosine (ties by target), exactly.

    With ``within`` only gallery rows with an equal value of that column count, and rows without one have no neighbours.
    Keys identify the rows of their table. Queries without a neighbour give no row; see ``with_hitless``.
    """
    spark = gallery.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(max(16, min(10_000, 16 * BLOCK_ROWS // block_rows))))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "32m")
    size = gallery.where(F.col(vector).isNotNull()).agg(F.count("*").alias("n"), F.mode(F.size(vector), True).alias("d")).first()
    kinds = T.StructType([T.StructField("query", queries.schema[key].dataType), T.StructField("target", gallery.schema[target].dataType), T.StructField("similarity", T.DoubleType())])
    dimensions = size.d or 0
    good = gallery.where(usable(vector, dimensions))
    pivots = pivots_of(good, target, vector, dimensions, max(1, min(PIVOTS, size.n // (2 * block_rows)))) if dimensions else np.zeros((0, 0))
    if not len(pivots):
        return spark.createDataFrame([], kinds).withColumn("rank", F.lit(None).cast("bigint"))
    placed = materialise(_placed(gallery, target, vector, within, dimensions, pivots))
    edges = [i / RINGS for i in range(1, RINGS)] if size.n > 2 * block_rows else [1.0]
    rings = materialise(placed.groupBy("cell").agg(F.array_distinct(F.percentile_approx("off", edges)).alias("edges")))  # one row a pivot
    block = lambda rows: materialise(_blocks(rows, rings, block_rows))
    key_of = lambda df, column: F.lit(None).cast(df.schema[column].dataType).alias("key")
    held = block(placed)
    g = materialise(_stored(held.withColumnsRenamed({"lo": "g_lo", "hi": "g_hi"}), "g"))
    if queries is gallery and key == target:  # a table with itself: its blocks are made once
        asked, q = held, g.withColumnsRenamed({"g": "q", "g_lo": "q_lo", "g_hi": "q_hi"})
    else:
        asked = block(_placed(queries, key, vector, within, dimensions, pivots))
        q = materialise(_stored(asked.withColumnsRenamed({"lo": "q_lo", "hi": "q_hi"}), "q"))
    g_places, q_places = g.select("g", "file", "at", "size", key_of(gallery, target)), q.select("q", "file", "at", "size", key_of(queries, key))
    slices = max(1, -(-g.count() // SLICE_BLOCKS))
    columns = lambda df, side: df.select(side, *(F.col(f"{side}.{c}").alias(f"{side}_{c}") for c in ("within", "cell", "ring", "salt")), f"{side}_lo", f"{side}_hi")
    g_blocks, q_blocks = columns(g, "g"), columns(q, "q")
    # pass 1: two blocks of the query's own cell and ring
    own = (F.col("q_within") == F.col("g_within")) & (F.col("q_cell") == F.col("g_cell")) & (F.col("q_ring") == F.col("g_ring"))
    near = q_blocks.join(g_blocks.where("g_salt < 2"), own).select("q", F.lit(0).alias("slice"), "g", F.lit(0.0).alias("lower"))
    first = materialise(_compared(q_places.withColumn("reach", F.lit(None).cast("array<double>")), g_places, near, k, dimensions, exclude_self))
    # how far the k-th neighbour of a query can be, and of a whole block
    kth = first.groupBy("query").agg(F.min("similarity").alias("s"), F.count("*").alias("n")).where(F.col("n") >= k).select("query", "s")
    members = asked.select(F.col("block").alias("q"), F.posexplode(F.transform("rows", lambda r: r["key"])).alias("at", "query")).join(kth, "query", "left")
    reach = members.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("s", F.lit(float("-inf"))).alias("s")))), lambda x: x["s"]).alias("reach"))
    reach = materialise(reach.withColumn("far", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.greatest(F.array_min("reach"), F.lit(-1.0)))) + SLACK))
    # pass 2: all other blocks that may hold a nearer row
    apart = distance(pivots @ pivots.T)
    between = spark.createDataFrame([(i, j, float(apart[i, j])) for i in range(len(pivots)) for j in range(len(pivots))], "q_cell int, g_cell int, apart double")
    lower = F.greatest(F.lit(0.0), F.col("apart") - F.col("q_hi") - F.col("g_hi"), F.col("g_lo") - F.col("apart") - F.col("q_hi"), F.col("q_lo") - F.col("apart") - F.col("g_hi"))
    done = own & (F.col("g_salt") < 2)
    cells = g_blocks.groupBy("g_cell").agg(F.min("g_lo").alias("c_lo"), F.max("g_hi").alias("c_hi"))  # one row a pivot
    reachable = q_blocks.join(reach.select("q", "far"), "q").join(F.broadcast(between.join(cells, "g_cell")), "q_cell").where((F.col("apart") - F.col("q_hi") - F.col("c_hi") <= F.col("far")) & (F.col("c_lo") - F.col("apart") - F.col("q_hi") <= F.col("far")))
    other = reachable.join(g_blocks, (F.col("q_within") == F.col("g_within")) & (reachable["g_cell"] == g_blocks["g_cell"])).drop(reachable["g_cell"]).where(~done).withColumn("lower", lower).where("lower <= far")
    rest = other.select("q", F.pmod(F.xxhash64("g"), F.lit(slices)).cast("int").alias("slice"), "g", "lower")
    second = _compared(q_places.join(reach.select("q", "reach"), "q"), g_places, rest, k, dimensions, exclude_self)
    best = Window.partitionBy("query").orderBy(F.desc("similarity"), "target")
    return first.unionByName(second).withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= k)


def with_hitless(queries: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """query, target, similarity, distance and rank; a query without a hit has one row, without a target, at distance 1."""
    joined = queries.select(F.col(key).alias("query")).join(hits, "query", "left")
    found = F.col("target").isNotNull()
    return joined.select("query", "target", F.when(found, F.col("similarity")).otherwise(0.0).alias("similarity"), F.when(found, 1 - F.col("similarity")).otherwise(1.0).alias("distance"), "rank")
