"""The join of nearest neighbours against all pairs in NumPy."""

import numpy as np
import pytest

from siftwright.operators import neighbours, similarity

SCHEMA = "id string, embedding array<float>, collection int, rank int, cell string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA).repartition(3)


def clusters(n, dimensions=8, seed=2):
    """Rows around a few centres; a third of all rows are one vector."""
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(9, dimensions))
    out = centres[rnd.integers(0, 9, n)] + 0.05 * rnd.normal(size=(n, dimensions))
    out[: n // 3] = centres[0]
    return out.astype(np.float32)


ODD = [None, [], [0.0] * 8, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [1.0] * 5, [None] + [1.0] * 7]


def expected(queries, gallery, k, exclude_self):
    unit = lambda rows: np.stack([r[1] for r in rows]).astype(float) / np.linalg.norm(np.stack([r[1] for r in rows]).astype(float), axis=1, keepdims=True)
    found = (unit(queries) @ unit(gallery).T).round(12)
    out = set()
    for i, q in enumerate(queries):
        ranked = sorted((-found[i, j], g[0]) for j, g in enumerate(gallery) if q[2] == g[2] and q[2] is not None and not (exclude_self and q[0] == g[0]))
        out |= {(q[0], t, r + 1, round(-s, 9)) for r, (s, t) in enumerate(ranked[:k])}
    return out


@pytest.mark.parametrize("block_rows, exclude_self, many", [(16, True, 1), (60, False, 4), (1000, False, 1)])
def test_join_as_all_pairs(spark, monkeypatch, block_rows, exclude_self, many):
    monkeypatch.setattr(neighbours, "SLICE_BLOCKS", 3)
    rows = [(f"v{i:04}", v.tolist(), i % many) for i, v in enumerate(clusters(500))]
    odd = [(f"odd{i}", v, 0) for i, v in enumerate(ODD)] + [("none", [1.0] * 8, None)]
    side = frame(spark, rows + odd)
    got = neighbours.neighbour_join(side, side, 4, "id", "id", within="collection", exclude_self=exclude_self, block_rows=block_rows)
    assert {(r.query, r.target, r["rank"], round(r.similarity, 9)) for r in got.collect()} == expected(rows, rows, 4, exclude_self)


def test_most_pairs_of_blocks_are_pruned(spark):
    """Well parted clusters: each query block meets few gallery blocks."""
    rnd = np.random.default_rng(4)
    rows = [(f"{i:05}", (rnd.normal(size=8) * 0.002 + np.eye(8)[i % 8]).tolist(), 0) for i in range(1600)]
    side = frame(spark, rows)
    seen = []
    compared = neighbours._compared
    neighbours._compared = lambda q, g, pairs, *rest: seen.append((pairs.count(), q.count() * g.count())) or compared(q, g, pairs, *rest)
    try:
        got = neighbours.neighbour_join(side, side, 3, "id", "id", block_rows=25).count()
    finally:
        neighbours._compared = compared
    assert got == 4800 and sum(n for n, _ in seen) < 0.2 * max(every for _, every in seen)  # an eighth at best


def test_pairs_of_blocks_carry_no_vectors(spark, monkeypatch):
    """Every pair of blocks is compared, yet only places of blocks are shuffled."""
    rows = [(f"v{i:04}", v.tolist(), 0) for i, v in enumerate(np.random.default_rng(6).normal(size=(400, 8)).astype(np.float32))]
    side, seen, compared = frame(spark, rows), [], neighbours._compared
    monkeypatch.setattr(neighbours, "_compared", lambda q, g, pairs, *rest: seen.append((q, g)) or compared(q, g, pairs, *rest))
    got = neighbours.neighbour_join(side, side, 4, "id", "id", block_rows=20)
    assert {(r.query, r.target, r["rank"]) for r in got.collect()} == {r[:3] for r in expected(rows, rows, 4, False)}
    assert all("rows" not in blocks.columns and blocks.where("size > 0").count() > 10 for blocks in (*seen[0], *seen[1]))


def test_hitless_queries_and_empty_sides(spark):
    rows = [("a", [1.0, 0.0], 1), ("b", [0.0, 1.0], 1), ("c", [1.0, 0.0], 2)]
    queries, none = frame(spark, rows + [("d", None, 1)]), frame(spark, rows).where("false")
    hits = neighbours.neighbour_join(queries, frame(spark, rows[:2]), 1, "id", "id", within="collection")
    got = {(r.query, r.target, r.similarity, r.distance, r["rank"]) for r in neighbours.with_hitless(queries, hits, "id").collect()}
    assert got == {("a", "a", 1.0, 0.0, 1), ("b", "b", 1.0, 0.0, 1), ("c", None, 0.0, 1.0, None), ("d", None, 0.0, 1.0, None)}
    assert neighbours.neighbour_join(queries, none, 1, "id", "id").collect() == []
    assert neighbours.neighbour_join(none, queries, 1, "id", "id").collect() == []
    assert neighbours.with_hitless(queries, neighbours.neighbour_join(queries, none, 1, "id", "id"), "id").count() == 4


def test_sent_and_joined_batches_agree(spark, monkeypatch):
    rows = [(f"v{i:04}", v.tolist(), 0) for i, v in enumerate(clusters(200, seed=8))]
    side = frame(spark, rows)
    sent = similarity.batch_neighbours(side, side, 5, "id", "id", exclude_self=True).collect()
    monkeypatch.setattr(similarity, "SENT_VALUES", 10)
    joined = similarity.batch_neighbours(side, side, 5, "id", "id", exclude_self=True).collect()
    key = lambda rows: {(r.query, r.target, r["rank"], round(r.similarity, 9)) for r in rows}
    assert key(sent) == key(joined)
