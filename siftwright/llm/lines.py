"""Operator 2: line dedup by distinct-site spread.

Every line hash gets a HyperLogLog sketch of the sites (sources) that it occurs on; the sketches merge by aggregation, on
the map side first, so a line that fills a third of all rows costs one small sketch per task. Lines whose estimate lies
within ``MARGIN`` of the threshold get an exact distinct count. Lines on at least ``least_sites`` sites are boilerplate
and are removed from every document. While their hashes are few they go to every task and documents are cleaned where they
are read; only with more of them are the places of their lines shuffled, to be joined to the documents.

Defined results: a null text stays null and has no lines; a null source is a site of its own; blank lines (white space
only) are never boilerplate and stay; a document all of whose lines go becomes the empty text; repeated rows count once
per site and are all cleaned alike; lines are compared exactly. An empty table gives no rows. Other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.llm import flat
from siftwright.session import materialise

LEAST_SITES = 5
MARGIN = 0.25
SKETCH_BITS = 10
#: Boilerplate lines up to this many are sent to every task (16 bytes each); more are joined by hash.
SEND_AT_MOST = 200_000
SALTS = 32
#: Files of the tables of widespread lines, which are few among all lines.
FILES = 16


def _row_key() -> list[Column]:
    """A 128-bit key of a row; equal rows share it and are cleaned alike."""
    return [F.xxhash64("doc_id", "text", "source").alias("row"), F.xxhash64(F.lit(1), "doc_id", "text", "source").alias("row2")]


def _lines(docs: DataFrame) -> DataFrame:
    """One row per non-blank line: row key, place, 128-bit line hash as two longs, site."""
    split = docs.select(*_row_key(), F.coalesce(F.col("source"), F.lit("\0")).alias("site"), F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    return split.where(F.col("line").rlike(r"\S")).select("row", "row2", "place", "site", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def boilerplate(docs: DataFrame, least_sites: int = LEAST_SITES) -> DataFrame:
    """Hashes of lines on at least ``least_sites`` sites: h1, h2, sites."""
    lines = _lines(docs).select("row", "h1", "h2", "site")
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", SKETCH_BITS).alias("sketch")).select("h1", "h2", F.hll_sketch_estimate("sketch").alias("estimate"))
    spread = materialise(spread.where(F.col("estimate") >= least_sites * (1 - MARGIN)).repartition(FILES))
    sure = spread.where(F.col("estimate") > least_sites * (1 + MARGIN)).select("h1", "h2", F.col("estimate").alias("sites"))
    near = spread.where(F.col("estimate") <= least_sites * (1 + MARGIN)).select("h1", "h2")
    exact = _matching(lines, near).groupBy("h1", "h2", "site").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("*").alias("sites"))
    return materialise(sure.unionByName(exact.where(F.col("sites") >= least_sites)).repartition(FILES))


def _matching(lines: DataFrame, chosen: DataFrame) -> DataFrame:
    """Line rows whose hash is among the chosen ones: the chosen hashes go to every task while they are few; else both
    sides are joined by hash and salt, so that a frequent line is dealt over many tasks."""
    if chosen.count() <= SEND_AT_MOST:
        return lines.join(F.broadcast(chosen), ["h1", "h2"])
    salted = lines.withColumn("salt", (F.pmod("row", F.lit(SALTS))).cast("int"))
    return salted.join(chosen.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["h1", "h2", "salt"]).drop("salt")


def remove_boilerplate(docs: DataFrame, least_sites: int = LEAST_SITES, into: str = "n_lines_removed") -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and their number in a column ``into``."""
    chosen = boilerplate(docs, least_sites).select("h1", "h2")
    if chosen.count() <= SEND_AT_MOST:
        return _cleaned(docs, into, _by_hash(docs.sparkSession, chosen))
    drops = _matching(_lines(docs).select("row", "row2", "place", "h1", "h2"), chosen).groupBy("row", "row2").agg(F.collect_set("place").alias("_places"))
    one, two, gone = (flat.free_name(docs, x) for x in ("_row", "_row2", "_places"))
    keyed = docs.withColumns(dict(zip((one, two), _row_key())))
    joined = keyed.join(drops.withColumnsRenamed({"row": one, "row2": two, "_places": gone}), [one, two], "left").drop(one, two)

    def by_place(batch: pa.RecordBatch) -> Iterator[tuple[list[str], set[int]]]:
        for text, places in zip(batch.column("text").to_pylist(), batch.column(gone).to_pylist()):
            yield (text or "").split("\n"), set(places or ())

    return _cleaned(joined, into, by_place).drop(gone)


def _by_hash(spark: SparkSession, chosen: DataFrame):
    """For every text of a batch its lines and the places of those whose hash is among the chosen ones."""
    rows = chosen.toArrow()
    pairs = np.stack([np.asarray(rows["h1"].cast(pa.int64())), np.asarray(rows["h2"].cast(pa.int64()))], axis=1) if rows.num_rows else np.zeros((0, 2), np.int64)
    seed = spark.range(1).select(F.xxhash64(F.lit(1))).first()[0] & (1 << 64) - 1  # hashing goes on from the number's hash
    shared = spark.sparkContext.broadcast(pairs)

    def run(batch: pa.RecordBatch) -> Iterator[tuple[list[str], set[int]]]:
        known = _known(shared.value)
        for text in batch.column("text").to_pylist():
            lines = (text or "").split("\n")
            found = set()
            for k, line in enumerate(lines):
                raw = line.encode()
                second = known.get(xxhash.xxh64_intdigest(raw, 42))
                if second and xxhash.xxh64_intdigest(raw, seed) in second:
                    found.add(k)
            yield lines, found

    return run


_held: list = [None, {}]


def _known(pairs: np.ndarray) -> dict[int, set[int]]:
    """First hash -> second hashes, built once per task process."""
    if _held[0] is not pairs:
        index: dict[int, set[int]] = {}
        for one, two in pairs.view(np.uint64).tolist():
            index.setdefault(one, set()).add(two)
        _held[:] = [pairs, index]
    return _held[1]


def _cleaned(docs: DataFrame, into: str, gone) -> DataFrame:
    """``docs`` without the lines at the places that ``gone`` tells for every text of a batch, and their number."""
    plain = [c for c in docs.columns if c != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.slices(batches):
            texts, many = batch.column("text").to_pylist(), []
            for k, (lines, places) in enumerate(gone(batch)):
                many.append(len(places))
                if places:
                    texts[k] = "\n".join(x for i, x in enumerate(lines) if i not in places)
            yield pa.RecordBatch.from_arrays([*(pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in plain), pa.array(many, pa.int64())], names=[*plain, into])

    return flat.map_batches(docs.select(*plain), run, flat.schema_of(docs, plain, f"{into} bigint"))


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, source, i, parts[i] AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)
), spread AS (
  SELECT line FROM lines WHERE regexp_matches(line, '\\S') GROUP BY line HAVING count(DISTINCT coalesce(source, chr(0))) >= {LEAST_SITES}
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n FROM lines WHERE line NOT IN (SELECT line FROM spread) GROUP BY doc_id
), total AS (
  SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id
)
SELECT d.doc_id, coalesce(t.n, 0) - coalesce(k.n, 0) AS n_lines_removed, CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(k.text, '')) END AS text_sha256
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN total t USING (doc_id)
"""
