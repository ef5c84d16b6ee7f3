"""Vector search: top-k, best chunk per path, batch nearest neighbours, hash search.

A search has one query, a batch a stated list; a batch of counted, bounded size is sent to the tasks in one scan of the
gallery, and a larger one is joined by blocks. Every ranking names a tie-breaking column.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwright.functions import vectors
from siftwright.operators import neighbours

#: Queries up to so many numbers (rows times dimensions) are sent to every task.
SENT_VALUES = 4_000_000
#: Similarities that a task holds at a time.
SCORES = 4_000_000


def with_similarity(candidates: DataFrame, query: list[float], vector: str = "embedding") -> DataFrame:
    """Candidates with their cosine similarity to one query vector."""
    wanted = F.array(*(F.lit(float(x)) for x in query))
    return candidates.withColumn("similarity", vectors.cosine(F.col(vector), wanted))


def top_k(scored: DataFrame, k: int, tie: str, score: str = "similarity") -> DataFrame:
    """The k best rows (ties by ``tie``) with their rank from 1."""
    best = scored.where(F.col(score).isNotNull()).orderBy(F.desc(score), tie).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), tie)).cast("bigint"))


def best_per_group(scored: DataFrame, group: str, tie: str, score: str = "similarity") -> DataFrame:
    """The best row of every group; a group-limited window, pruned before the shuffle."""
    ranked = scored.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie)))
    return ranked.where("_rn = 1").drop("_rn")


def flag_matches(scored: DataFrame, least: float, score: str = "similarity") -> DataFrame:
    """Mark rows at or above a threshold; none is dropped."""
    return scored.withColumn("is_match", F.col(score) >= F.lit(least))


def search(candidates: DataFrame, query: list[float], k: int, least: float, group: str, tie: str, paths: DataFrame | None = None) -> DataFrame:
    """Best chunk per path, top-k paths, match flag; ``paths`` restricts the candidates to its rows."""
    chosen = candidates if paths is None else candidates.join(paths.select(group).distinct(), group, "left_semi")
    return flag_matches(top_k(best_per_group(with_similarity(chosen, query), group, tie), k, tie), least)


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length == 0, 1, length)


def _best(queries: np.ndarray, ids: np.ndarray, found: np.ndarray, k: int, exclude_self: bool) -> pd.DataFrame:
    """The k best ids of every query from a matrix of similarities; ids are in order, and the first of equal ones count."""
    if exclude_self:
        found[queries[:, None] == ids[None, :]] = -np.inf
    k = min(k, len(ids))
    least = np.partition(found, len(ids) - k, axis=1)[:, len(ids) - k, None]
    # all above the k-th value, and of those equal to it the first ones that still have room
    above, equal = found > least, found == least
    chosen = above | equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True))
    query, at = np.nonzero(chosen)
    value = found[query, at]
    rows = pd.DataFrame({"query": queries[query], "target": ids[at], "similarity": value})
    return rows[np.isfinite(value)]


def batch_neighbours(queries: DataFrame, gallery: DataFrame, k: int, key: str, target: str, vector: str = "embedding", least: float | None = None, exclude_self: bool = False) -> DataFrame:
    """For every query its k nearest gallery rows: query, target, similarity, rank (ties by target).

    Up to ``SENT_VALUES`` numbers of queries are sent to every task and compared with its gallery rows in one scan; more
    queries are joined block by block (``neighbours.neighbour_join``). Queries without a hit give no row; see
    ``neighbours.with_hitless``.
    """
    size = queries.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d")).first()
    if size.n * max(size.d or 0, 1) <= SENT_VALUES:
        ranked = _against_sent(queries, gallery, k, key, target, vector, exclude_self)
    else:
        ranked = neighbours.neighbour_join(queries, gallery, k, key, target, vector, exclude_self=exclude_self)
    return ranked if least is None else ranked.where(F.col("similarity") >= least)


def _against_sent(queries: DataFrame, gallery: DataFrame, k: int, key: str, target: str, vector: str, exclude_self: bool) -> DataFrame:
    """The nearest rows of few queries: a task keeps k rows a query, and one shuffle of those takes the final k."""
    schema = f"query {queries.schema[key].dataType.simpleString()}, target {gallery.schema[target].dataType.simpleString()}, similarity double"
    rows = queries.where(F.col(vector).isNotNull()).select(key, vector).collect()  # at most SENT_VALUES numbers
    if not rows:
        return gallery.sparkSession.createDataFrame([], schema + ", rank bigint")
    shared = gallery.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows]), _unit(np.array([r[1] for r in rows], float))))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, wanted = shared.value
        for frame in frames:
            if not len(frame):
                continue
            ids = frame["target"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, units = ids[order], _unit(np.stack(frame["vector"].to_numpy()[order]).astype(float))
            step = max(1, SCORES // len(ids))
            for low in range(0, len(own), step):
                yield _best(own[low : low + step], ids, (wanted[low : low + step] @ units.T).round(12), k, exclude_self)

    out = gallery.select(F.col(target).alias("target"), F.col(vector).alias("vector")).where(F.col("vector").isNotNull()).mapInPandas(score, schema)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "target")).cast("bigint")).where(F.col("rank") <= k)


def matches_per_query(queries: DataFrame, hits: DataFrame, key: str, least: float) -> DataFrame:
    """Every query with its list of targets at or above a threshold, best first; queries without one get an empty list."""
    listed = hits.where(F.col("similarity") >= least).groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "target"))).alias("l"))
    joined = queries.select(F.col(key).alias("query")).join(listed, "query", "left")
    return joined.select("query", F.coalesce(F.transform("l", lambda x: x["target"]), F.array().cast("array<bigint>")).alias("targets"))


def zipped(queries: DataFrame, results: DataFrame, query_order: str, result_order: str) -> DataFrame:
    """Queries beside results by their places in two orders (``ordinal`` from 0), as far as the shorter side goes."""
    from siftwright.sources import files

    left, right = files.numbered(queries, F.col(query_order)), files.numbered(results, F.col(result_order))
    return left.join(right, "ordinal")


def hash_search(candidates: DataFrame, query_hash: str, k: int, tie: str, column: str = "pdq_hash") -> DataFrame:
    """Top-k by hash similarity; rows without a hash are skipped, and a query that is none finds nothing."""
    hashed = candidates.where(vectors.is_hash(F.col(column)))
    if not re.fullmatch("[0-9a-fA-F]{64}", query_hash):
        return hashed.where("false").withColumns({"similarity": F.lit(None).cast("double"), "rank": F.lit(None).cast("bigint")})
    score = F.round(1 - vectors.differing_bits(F.col(column), query_hash) / vectors.HASH_BITS, 4)
    best = hashed.withColumn("similarity", score).orderBy(F.desc("similarity"), tie).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), tie)).cast("bigint"))


def series_search(candidates: DataFrame, mode: str, query: list[float], query_hash: str, k: int, least: float, tie: str, exclude: Column | None = None, weights: tuple[float, float] = (0.6, 0.4)) -> DataFrame:
    """Image-to-image search: semantic, pdq or combined; scores have 4 places and are flagged after rounding."""
    from siftwright.operators import fusion

    pool = candidates if exclude is None else candidates.where(~exclude)
    semantic = with_similarity(pool, query).where(F.col("similarity").isNotNull()).select(tie, F.round("similarity", 4).alias("score"))
    hashed = pool.where(F.coalesce(F.col("pdq_hash"), F.lit("")) != "").select(tie, vectors.hash_similarity(F.col("pdq_hash"), query_hash).alias("score"))
    if mode == "semantic":
        scored = semantic.withColumnRenamed("score", "similarity")
    elif mode == "pdq":
        scored = hashed.withColumnRenamed("score", "similarity")
    elif mode == "combined":
        scored = fusion.fuse({"clip": (semantic, weights[0]), "pdq": (hashed, weights[1])}, tie).withColumnRenamed("score", "similarity")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return flag_matches(top_k(scored, k, tie), least)
