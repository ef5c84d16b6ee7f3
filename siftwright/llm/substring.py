"""Operator 5: substring dedup by content-defined chunking.

A gear rolling hash over ``GEAR`` bytes is computed at every byte; a chunk begins where the hash is lower than at any
other place within ``REACH`` bytes, so cuts depend on nearby bytes alone and an insertion shifts no cut beyond its
neighbourhood. Chunks are counted by digest; of a digest that occurs again, the occurrence in the document with the
smallest row key stays (the first one inside it) and all others are repeats. Runs of neighbouring repeats of at least
``LEAST_RUN`` bytes are removed.

Counting is one aggregation by digest with partial sums. The digests that repeat are then summed up in a bitmap of eight
bits a digest, 2**BITMAP_BITS bits at most, the only thing that is sent to the tasks: it lets through the chunks that may
repeat, and a join by digest, frequent digests salted, decides. Runs are told by a window over each document's repeats, in
order of their places. Documents are told apart by 128-bit row keys.

Defined results: null and empty texts have no chunks; equal rows count as one document; a document that repeats itself
loses the later copies; a text without cuts is cut every ``MOST`` bytes; cuts never fall inside a character; other
columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwright.llm import flat
from siftwright.session import materialise

GEAR = 16
REACH = 20
MOST = 512
LEAST_RUN = 160
BITMAP_BITS = 28
SALTS = 32
FREQUENT = 2_000
#: Frequent digests up to this many (13 bytes each) are sent to every task; with more of them all digests are salted.
SEND_AT_MOST = 100_000
_PAD = REACH + GEAR
_TOP = np.uint32(2**32 - 1)


@lru_cache(maxsize=1)
def _gear() -> np.ndarray:
    return np.random.default_rng(17).integers(0, 2**32, 256, dtype=np.uint32)


def _lowest(x: np.ndarray, width: int) -> np.ndarray:
    """out[i] = the lowest of x[i : i + width], shorter at the end."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = np.minimum(out[:-step], out[step:]) if step < len(out) else out[:-step]
        have += step
    return out


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the chunks of all texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lengths = np.diff(offsets)
    place = np.arange(n) + np.repeat(np.arange(len(lengths)) * _PAD, lengths) + _PAD
    size = n + _PAD * (len(lengths) + 1)
    rolled = np.zeros(size, np.uint32)
    rolled[place] = _gear()[data]
    span = 1
    while span < GEAR:
        later = rolled[:-span] << np.uint32(span)
        rolled[span:] += later
        span *= 2
    inside = np.zeros(size, bool)
    inside[place] = (data & 0xC0) != 0x80
    rolled[~inside] = _TOP
    right = _lowest(rolled, REACH + 1)
    left = np.full(size, _TOP, np.uint32)
    left[REACH:] = _lowest(rolled, REACH)[:-REACH]
    cut = ((rolled < left) & (rolled <= right) & (rolled < _TOP))[place]
    cut[offsets[:-1][lengths > 0]] = True
    starts = np.flatnonzero(cut)
    gaps = np.diff(np.append(starts, n))
    if (gaps > MOST).any():
        many = (gaps - 1) // MOST
        steps = flat.ranges(np.ones(len(many), np.int64), many)
        forced = np.repeat(starts, many) + MOST * steps
        for _ in range(3):
            forced -= (data[forced] & 0xC0) == 0x80
        cut[forced] = True
        starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], n)


_KEY = ("row", "row2")


def _chunker(wanted=None):
    """Chunks of every row; with a bitmap only those that it lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = wanted.value if wanted is not None else None
        for batch in flat.slices(batches):
            data, offsets = flat.bytes_of(batch)
            starts, ends = cuts(data, offsets)
            one = flat.segment_hashes(flat.byte_values(False, 21)[data], starts, ends).view(np.int64)
            two = (flat.segment_hashes(flat.byte_values(False, 22)[data], starts, ends) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            own = np.searchsorted(offsets, starts, "right") - 1
            if bitmap is not None:
                slot = one & (8 * len(bitmap) - 1)
                keep = np.flatnonzero(bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                starts, ends, one, two, own = starts[keep], ends[keep], one[keep], two[keep], own[keep]
            rows = [pa.array(np.asarray(batch.column(k))[own]) for k in _KEY]
            begin = starts - offsets[own]
            yield pa.RecordBatch.from_arrays([*rows, pa.array(one), pa.array(two), pa.array(begin.astype(np.int32)), pa.array((ends - starts).astype(np.int32))], names=[*_KEY, "d1", "d2", "start", "size"])

    return run


_CHUNK = "row bigint, row2 bigint, d1 bigint, d2 int, start int, size int"


def _row_key() -> list[Column]:
    """A 128-bit key of a row by its id and text; equal rows share it."""
    return [F.xxhash64("doc_id", "text").alias("row"), F.xxhash64(F.lit(1), "doc_id", "text").alias("row2")]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*_row_key(), "text").where(F.length("text") > 0)


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """Digests that occur again: d1, d2, n, first (smallest row key and place), shared (in more than one document)."""
    place = F.struct(*_KEY, "start")
    counted = flat.map_batches(_keyed(docs), _chunker(), _CHUNK).groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("last"))
    shared = (F.col("first.row") != F.col("last.row")) | (F.col("first.row2") != F.col("last.row2"))
    return materialise(counted.where(F.col("n") > 1).select("d1", "d2", "n", "first", shared.alias("shared")))


def _bitmap(repeated: DataFrame) -> np.ndarray:
    """Bits of the digests' low bits: eight a digest, at most 2**BITMAP_BITS, whatever the number of digests."""
    bits = min(BITMAP_BITS, max(16, (8 * repeated.count()).bit_length()))
    low = repeated.select((F.col("d1").bitwiseAND(F.lit((1 << bits) - 1)) + 1).alias("slot"))
    parts = low.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = np.zeros(1 << bits >> 3, np.uint8)
    for r in parts.toLocalIterator():
        at = (r.bucket - 1) * 4096
        out[at : at + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return out


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Per document with long repeats: row, row2, spans (array of start, end in bytes, to be removed), n_shared_bytes."""
    repeated = repeated_chunks(docs)
    wanted = docs.sparkSession.sparkContext.broadcast(_bitmap(repeated))
    found = flat.map_batches(_keyed(docs), _chunker(wanted), _CHUNK)
    frequent = repeated.where(F.col("n") > FREQUENT).select("d1", "d2", F.lit(True).alias("frequent"))
    if frequent.count() <= SEND_AT_MOST:
        found = found.join(F.broadcast(frequent), ["d1", "d2"], "left").withColumn("salt", F.when(F.col("frequent"), F.pmod("row", F.lit(SALTS))).otherwise(0).cast("int")).drop("frequent")
        salts = F.when(F.col("n") > FREQUENT, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    else:
        found = found.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
        salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    joined = found.join(repeated.select("d1", "d2", "first", "shared", F.explode(salts).alias("salt")), ["d1", "d2", "salt"])
    drop = F.struct(*_KEY, "start") != F.col("first")
    chunks = joined.select(*_KEY, "start", (F.col("start") + F.col("size")).alias("end"), drop.alias("drop"), "shared").dropDuplicates([*_KEY, "start"])
    return _runs(chunks)


def _runs(chunks: DataFrame) -> DataFrame:
    """Spans of neighbouring chunks to be dropped, and bytes in runs of shared ones, of each document: a chunk begins a run
    where the chunk before it in the document ends elsewhere or isn't of the kind."""
    places = Window.partitionBy(*_KEY).orderBy("start")
    kinds = ("drop", "shared")
    after = F.lag("end").over(places) == F.col("start")
    begins = {f"{k}_begins": F.when(F.col(k) & ~F.coalesce(after & F.lag(k).over(places), F.lit(False)), 1).otherwise(0) for k in kinds}
    numbered = chunks.withColumns(begins).withColumns({f"{k}_run": F.sum(f"{k}_begins").over(places) for k in kinds})
    kind = F.explode(F.array(*(F.when(F.col(k), F.struct(F.lit(k == "drop").alias("drop"), F.col(f"{k}_run").alias("run"))) for k in kinds)))
    each = numbered.select(*_KEY, "start", "end", kind.alias("of")).where("of IS NOT NULL").select(*_KEY, "start", "end", "of.*")
    runs = each.groupBy(*_KEY, "drop", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).where(F.col("end") - F.col("start") >= LEAST_RUN)
    spans = F.array_sort(F.collect_list(F.when(F.col("drop"), F.struct("start", "end"))))
    return runs.groupBy(*_KEY).agg(spans.alias("spans"), F.coalesce(F.sum(F.when(~F.col("drop"), F.col("end") - F.col("start"))), F.lit(0)).cast("bigint").alias("n_shared_bytes"))


def describe(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_shared_bytes, n_removed_bytes, spans (removed, as start:end), repeated."""
    slim = docs.select("doc_id", *_row_key(), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    removed = F.coalesce(F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"]), F.lit(0).cast("bigint"))
    written = F.coalesce(F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ","), F.lit(""))
    shared = F.coalesce("n_shared_bytes", F.lit(0).cast("bigint"))
    return slim.join(repeated_spans(docs), [*_KEY], "left").select("doc_id", "n_bytes", shared.alias("n_shared_bytes"), removed.alias("n_removed_bytes"), written.alias("spans"), (shared > 0).alias("repeated"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated spans cut out of ``text``."""
    one, two, cut = (flat.free_name(docs, x) for x in ("_row", "_row2", "_spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.slices(batches):
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column(cut).to_pylist()):
                if text and spans:
                    raw, at, kept = text.encode(), 0, []
                    for s in spans:
                        kept.append(raw[at : s["start"]])
                        at = s["end"]
                    text = b"".join([*kept, raw[at:]]).decode()
                out.append(text)
            names = [c for c in batch.schema.names if c != cut]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else batch.column(c) for c in names], names=names)

    found = repeated_spans(docs).select(F.col("row").alias(one), F.col("row2").alias(two), F.col("spans").alias(cut))
    joined = docs.withColumns(dict(zip((one, two), _row_key()))).join(found, [one, two], "left").drop(one, two)
    return flat.map_batches(joined, run, docs.schema)
