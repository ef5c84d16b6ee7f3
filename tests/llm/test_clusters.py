"""Operators 11 and 13 against plain Python, with odd, tied and empty inputs."""

import hashlib
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwright.llm import centroids, codebooks, integers

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, error string, key int, point int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA).repartition(3)


def some_vectors(n, dimensions, seed=3, step=0.25):
    """Vectors on a coarse grid, so that many distances tie."""
    rnd = random.Random(seed)
    return [[rnd.randrange(-3, 4) * step for _ in range(dimensions)] for _ in range(n)]


ODD = [None, [], [1.0], [float("nan")] + [0.0] * 3, [float("inf")] + [0.0] * 3, [None] + [0.0] * 3, [0.5] * 5]


def square(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def lloyd(points, start, rounds):
    """Plain rounds: centres and the last assignment."""
    centres = [list(c) for c in start]
    pick = lambda p: min(range(len(centres)), key=lambda k: (square(p, centres[k]), k))
    for _ in range(rounds):
        own = [pick(p) for p in points]
        for k in set(own):
            members = [p for p, o in zip(points, own) if o == k]
            centres[k] = [sum(x) // len(members) for x in zip(*members)]
    return centres, [pick(p) for p in points]


def test_lloyd_as_in_plain_python(spark):
    vectors = some_vectors(90, 4) + [[0.25] * 4] * 40
    rows = [(i, v, None) for i, v in enumerate(vectors)] + [(1000 + i, v, 1) for i, v in enumerate(ODD)]
    found = {r.vec_id: r for r in centroids.cluster(frame(spark, rows), dimensions=4, clusters=7, rounds=3).collect()}
    points = [[math.floor(256 * x) for x in v] for v in vectors]
    order = sorted(range(len(points)), key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())[:7]
    centres, own = lloyd(points, [points[i] for i in order], 3)
    assert set(found) == set(range(130))
    distances = [square(p, centres[o]) for p, o in zip(points, own)]
    for i, (p, o) in enumerate(zip(points, own)):
        r = found[i]
        assert (r.cluster, r.distance, r.inertia) == (o, distances[i], sum(distances))
        assert r.cluster_inertia == sum(d for d, k in zip(distances, own) if k == o)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[o])).encode()).hexdigest()


def test_lloyd_of_few_repeated_and_missing_ids(spark):
    rows = [(None, [1.0] * 4, 1), (5, [0.0] * 4, 1), (5, [-1.0] * 4, 2), (5, [0.0] * 4, 1), (None, None, None)]
    found = centroids.cluster(frame(spark, rows), dimensions=4, rounds=2).collect()
    assert sorted((r.vec_id or -1, r.distance, r.inertia) for r in found) == [(-1, 0, 0), (5, 0, 0), (5, 0, 0), (5, 0, 0)]
    assert len({r.cluster for r in found}) == 3  # the two equal ones share the lower of their clusters


def test_clusters_of_no_rows_and_of_vast_components(spark):
    for rows in ([], [(1, v, 0) for v in ODD]):
        assert centroids.cluster(frame(spark, rows), dimensions=4).collect() == []
        assert codebooks.describe(frame(spark, rows)).collect() == []
    vast = frame(spark, [(1, [3e38] * 64, 0), (2, [-3e38] * 64, 0), (3, [0.0] * 64, 1)])
    assert [r.distance for r in centroids.cluster(vast, clusters=1, rounds=0).collect()].count(0) == 1
    assert {r.error for r in codebooks.describe(vast).collect()} == {0}


@pytest.mark.parametrize("step", [0.25, 0.01])
def test_codebooks_as_in_plain_python(spark, step):
    vectors = some_vectors(150, 6, 5, step) + [[step] * 6] * 50
    rows = [(i, v, i % 3 or None) for i, v in enumerate(vectors)] + [(2000 + i, v, 1) for i, v in enumerate(ODD) if v is None or len(v) != 6]
    coded, books = codebooks.compress(frame(spark, rows), dimensions=6, parts=3, entries=16, rounds=4)
    found = {r.key: r for r in coded.collect()}
    points = [[math.floor(1024 * float(np.float32(x))) for x in v] for v in vectors]
    want = {i: ["", 0] for i in range(200)}
    for p in range(3):
        own_part = [x[2 * p : 2 * p + 2] for x in points]
        centres, own = lloyd(own_part, own_part[:16], 4)
        assert books[p].tolist() == centres
        for i, o in enumerate(own):
            want[i][0] += f"{o:02x}"
            want[i][1] += square(own_part[i], centres[o])
    assert {i: [r.code, r.error] for i, r in found.items()} == want


def test_pruned_rounds_measure_less_and_assign_alike():
    rnd = np.random.default_rng(1)
    points = np.concatenate([rnd.integers(-40, 40, (2000, 4)) + 400 * rnd.integers(-5, 6, (2000, 1)), np.zeros((500, 4), int)])
    books = points[:64].copy()
    own, upper, lower = codebooks.first_assignment(points, books)
    measured = []
    for _ in range(4):
        sums, counts = np.zeros_like(books), np.bincount(own, minlength=64)
        np.add.at(sums, own, points)
        after = integers.floor_means(sums, counts, books)
        moved = codebooks.root_up(((after - books) ** 2).sum(axis=1))
        own, upper, lower, n = codebooks.next_assignment(points, after, own, upper, lower, moved, codebooks._apart(after))
        books = after
        squares = codebooks.all_squared(points, books)
        assert (own == squares.argmin(axis=1)).all()
        assert (upper**2 >= squares[np.arange(len(points)), own]).all() and (lower**2 <= squares).all()
        measured.append(n)
    assert sum(measured) < 0.3 * 4 * points.shape[0] * 64


def test_roots_are_exact():
    x = np.array([0, 1, 2, 3, 4, 2**52 - 1, 2**60, 2**60 - 1, (2**30 + 1) ** 2, (2**30 + 1) ** 2 - 1])
    assert codebooks.root_down(x).tolist() == [math.isqrt(v) for v in x.tolist()]
    assert codebooks.root_up(x).tolist() == [math.isqrt(v - 1) + 1 if v else 0 for v in x.tolist()]


@pytest.mark.parametrize("send", [1000, 3])
def test_totals_of_groups_by_every_way(spark, send):
    rows = spark.range(400).select((F.when(F.col("id") < 300, 7).when(F.col("id") < 320, None).otherwise(F.col("id"))).alias("label"), F.col("id").alias("error"))
    got = integers.with_group_total(rows, "label", "error", "total", send).collect()
    sums = {7: sum(range(300)), None: sum(range(300, 320))}
    assert len(got) == 400 and all(r.total == sums.get(r.label, r.error) for r in got)


def test_only_the_last_table_of_bounds_stays(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(codebooks, "shared_folder", lambda _: str(tmp_path))
    coded, _ = codebooks.compress(frame(spark, [(i, v, 0) for i, v in enumerate(some_vectors(20, 4))]), dimensions=4, parts=2, entries=4, rounds=3)
    assert coded.count() == 20
    (folder,) = os.listdir(tmp_path)
    assert os.listdir(tmp_path / folder) == ["3"]
