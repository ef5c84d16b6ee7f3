"""Operator 11: centroid clustering by plain Lloyd rounds on whole numbers.

Every round sends the centroids (``clusters`` times ``dimensions`` numbers, a bound known beforehand) to the tasks. A task
takes integer squared differences to one centroid after the other in NumPy; the lowest index wins ties. It gives one row of
sums per cluster and partition, and a groupBy merges them, so a frequent vector or a large cluster costs no task more than
its own rows. Only the merged sums, one row a cluster, come back to the driver.

Defined results: vectors that are null, have another number of components, or hold null or non-finite ones give no row; of
fewer vectors than clusters each starts one; rows that share an id are vectors of their own, and start clusters in the order
of their components; ids may be null and start clusters after all others; components beyond 2**27 count as 2**27; a sum of
distances beyond a long is null; empty tables give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.llm import flat, integers
from siftwright.session import materialise

DIMENSIONS = 64
SCALE = 256
CLUSTERS = 40
ROUNDS = 5


def whole_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(key, point) of the vectors that count, as whole numbers."""
    return rows.where(integers.finite(vector, dimensions)).select(F.col(key).alias("key"), integers.scaled(vector, scale).alias("point"))


def starting_points(points: DataFrame, clusters: int = CLUSTERS, seed: int = 2) -> np.ndarray:
    """The points with the smallest sha256 of ``<seed>:<key>``, in order of that hash."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    first = points.select(order.alias("order"), "point").orderBy(F.asc_nulls_last("order"), "point").limit(clusters)
    return np.array([r.point for r in first.collect()], np.int64)  # at most ``clusters`` rows


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of every point; the lowest number wins ties."""
    distances = np.stack([integers.squared_to(points, c) for c in centroids])
    cluster = distances.argmin(axis=0)
    return cluster, distances[cluster, np.arange(len(points))]


def _merged(points: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts) of the points nearest to every centroid."""
    k, dimensions = centroids.shape
    shared = points.sparkSession.sparkContext.broadcast(centroids)
    names = [f"s{i}" for i in range(dimensions)]

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64)
        for frame in frames:
            rows = integers.matrix(frame["point"], dimensions)
            for some in integers.blocks(rows):
                cluster, _ = nearest(rows[some], shared.value)
                counts += np.bincount(cluster, minlength=k)
                order = np.argsort(cluster, kind="stable")
                found, at = np.unique(cluster[order], return_index=True)
                sums[found] += np.add.reduceat(rows[some][order], at, axis=0)
        used = np.flatnonzero(counts)
        yield pd.DataFrame({"cluster": used.astype(np.int32), "n": counts[used]} | {name: sums[used, i] for i, name in enumerate(names)})

    schema = "cluster int, n long, " + ", ".join(f"{name} long" for name in names)
    parts = points.select("point").mapInPandas(add, schema)
    merged = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(name).alias(name) for name in names)).collect()
    sums, counts = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64)
    for r in merged:  # one row a cluster
        counts[r.cluster], sums[r.cluster] = r.n, [r[name] for name in names]
    return sums, counts


def fit(points: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 2) -> np.ndarray:
    """Centroids after so many rounds over all points; those without points stay where they are."""
    flat.bounded_batches(points.sparkSession, 5000)
    centroids = starting_points(points, clusters, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = integers.floor_means(*_merged(points, centroids), centroids)
    return centroids


def assign(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """key, cluster and squared distance of every point."""
    flat.bounded_batches(points.sparkSession, 5000)
    shared = points.sparkSession.sparkContext.broadcast(centroids)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = integers.matrix(frame["point"], shared.value.shape[1])
            found = [nearest(rows[some], shared.value) for some in integers.blocks(rows)]
            if found:
                yield pd.DataFrame({"key": frame["key"], "cluster": np.concatenate([c for c, _ in found]).astype(np.int32), "distance": np.concatenate([d for _, d in found])})

    # ids travel as text, which keeps them exact beside nulls
    text = points.select(F.col("key").cast("string").alias("key"), "point").mapInPandas(run, "key string, cluster int, distance long")
    return text.withColumn("key", F.col("key").cast(points.schema["key"].dataType))


def cluster(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 2) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that counts."""
    points = whole_vectors(rows, key, vector, dimensions, scale)
    centroids = fit(points, clusters, rounds, seed)
    if not len(centroids):
        kind = rows.schema[key].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"{key} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    assigned = materialise(assign(points, centroids))
    totals = {r.cluster: int(r.total) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # one row a cluster
    fits = lambda x: x if x < 1 << 63 else None
    whole = fits(sum(totals.values()))
    of_cluster = [(i, fits(totals[i]), whole, digest(c)) for i, c in enumerate(centroids) if i in totals]
    sent = rows.sparkSession.createDataFrame(of_cluster, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(sent), "cluster").select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def digest(numbers: np.ndarray) -> str:
    """sha256 of decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, numbers.ravel().tolist())).encode()).hexdigest()


def _oracle() -> str:
    floor = "CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END"
    nearest_ = lambda c: f"SELECT vec_id, p, k, d FROM (SELECT v.vec_id, v.p, c.k, list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(v.p, c.p)])::BIGINT AS d, row_number() OVER (PARTITION BY v.vec_id ORDER BY list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(v.p, c.p)]), c.k) AS rn FROM v, {c} c) WHERE rn = 1"
    parts = [
        "v AS MATERIALIZED (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS p FROM embeddings WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k, p FROM v ORDER BY sha256('2:' || vec_id) LIMIT 40)",
    ]
    for i in range(ROUNDS):
        parts.append(f"a{i} AS MATERIALIZED ({nearest_(f'c{i}')})")
        parts.append(f"m{i} AS (SELECT k, list({floor} ORDER BY i) AS p FROM (SELECT k, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT k, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM a{i}) GROUP BY k, i) GROUP BY k)")
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.p, c.p) AS p FROM c{i} c LEFT JOIN m{i} m USING (k))")
    parts.append(f"z AS MATERIALIZED ({nearest_(f'c{ROUNDS}')})")
    return f"WITH {', '.join(parts)} SELECT vec_id, z.k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY z.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.p, ',')) AS centroid_sha256 FROM z JOIN c{ROUNDS} c ON c.k = z.k"


ORACLE = _oracle()
