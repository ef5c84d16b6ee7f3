"""Neighbour searches on what makes their steps go wrong or slow: ties, wide keys, few and many queries of a task."""

import numpy as np
import pytest

from siftwright.operators import neighbours, vector_index


def test_best_keeps_ties_by_the_smaller_id():
    rnd = np.random.default_rng(4)
    for kind in (np.int64, str, object):
        best, rows = neighbours.Best(7, 5), []
        for _ in range(30):
            q, ids, s = rnd.integers(0, 6, 20), rnd.permutation(10_000)[:20], rnd.integers(0, 9, 20) / 8
            ids = np.array([f"{i:05}" for i in ids]) if kind is str else ids.astype(kind)
            best.add(q, ids, s)
            rows += zip(q.tolist(), (-s).tolist(), ids.tolist())
        want = [row for k in range(7) for row in sorted(r for r in rows if r[0] == k)[:5]]
        q, ids, s = best.settled()
        assert [*zip(q.tolist(), (-s).tolist(), ids.tolist())] == want
        assert np.allclose(best.least[:6], s.reshape(6, 5)[:, -1]) and best.least[6] == -np.inf


def test_best_of_single_precision_scores():
    q, s = np.repeat(np.arange(3), 4), np.array([0.5, -0.25, 0.0, -1.0, 2.0, 2.0, 1.0, 3.0, -3.0, -2.0, -1.0, -4.0], np.float32)
    best = neighbours.Best(3, 2)
    best.add(q, np.arange(12), s)
    assert best.settled()[1].tolist() == [0, 2, 7, 4, 10, 9] and best.least.tolist() == [0.0, 2.0, -2.0]


@pytest.mark.parametrize("width", [1, 7, 8, 30])
def test_places_above_a_floor(width):
    values = np.random.default_rng(width).normal(size=(9, width)).astype(np.float32)
    floor = np.linspace(-1, 3, 9).astype(np.float32)
    got, want = neighbours.above(values, floor), np.nonzero(values >= floor[:, None])
    assert [x.tolist() for x in got] == [x.tolist() for x in want]


def test_a_table_with_itself_makes_its_blocks_once(spark, tmp_path, monkeypatch):
    stored = []
    monkeypatch.setattr(neighbours, "_stored", lambda blocks, side, old=neighbours._stored: stored.append(side) or old(blocks, side))
    x = np.random.default_rng(1).normal(size=(300, 8)).round(1)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, embedding array<double>")
    found = {(r.query, r["rank"]): r.target for r in neighbours.neighbour_join(rows, rows, 4, "id", "id", exclude_self=True, block_rows=32).collect()}
    units = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (units @ units.T).round(12)
    np.fill_diagonal(near, -2)
    want = np.lexsort((np.broadcast_to(np.arange(300), near.shape), -near))[:, :4]
    assert stored == ["g"] and found == {(i, r + 1): int(want[i, r]) for i in range(300) for r in range(4)}


def test_searches_rank_in_the_task_and_do_not_shuffle_vectors(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=(500, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, embedding array<double>")
    index = vector_index.build(rows, "id", f"{tmp_path}/i", parts=4)
    found = vector_index.search(index, rows, rows.where("id < 400"), 6, "id", "id", probes=len(index.centres), candidates=500, exclude_self=True)
    assert "Window" not in found._jdf.queryExecution().toString()
    got = {(r.query, r.target): (r.similarity, r["rank"]) for r in found.collect()}
    exact = {(r.query, r.target): (r.similarity, r["rank"]) for r in neighbours.neighbour_join(rows, rows, 6, "id", "id", exclude_self=True).collect() if r.target < 400}
    assert got == exact
