"""The approximate index against exact neighbours."""

import numpy as np
import pytest

from siftwright.operators import neighbours, vector_index

SCHEMA = "id string, embedding array<float>, list int, code string"


def test_recall_on_a_whole_table(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    exact = neighbours.neighbour_join(rows, rows, 10, "vec_id", "vec_id", exclude_self=True)
    index = vector_index.load(spark, vector_index.build(rows, "vec_id", f"{tmp_path}/i").folder)
    probes, candidates = vector_index.tune(index, rows, 10, "vec_id")
    found = vector_index.search(index, rows, rows, 10, "vec_id", "vec_id", probes=probes, candidates=candidates, exclude_self=True)
    measured = vector_index.recall(found, exact).first()
    assert measured.queries == 500 and measured.recall >= 0.95
    assert found.where("query = target OR rank > 10").count() == 0


def test_clusters_need_few_lists_and_hot_vectors_are_spread(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "CODE_ROWS", 50)
    monkeypatch.setattr(vector_index, "QUERY_ROWS", 30)
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(20, 16))
    x = centres[rnd.integers(0, 20, 900)] + 0.1 * rnd.normal(size=(900, 16))
    x[:300] = x[0]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0] * 3]
    rows = [(f"v{i:04}", v.tolist(), 1, "clash") for i, v in enumerate(x)] + [(f"odd{i}", v, 2, "clash") for i, v in enumerate(odd)]
    side = spark.createDataFrame(rows, SCHEMA).repartition(3)
    index = vector_index.build(side, "id", f"{tmp_path}/i", parts=4)
    probes, candidates = vector_index.tune(index, side, 5, "id")
    assert probes <= len(index.centres) // 2
    found = vector_index.search(index, side, side, 5, "id", "id", probes=probes, candidates=max(candidates, 400))
    exact = neighbours.neighbour_join(side, side, 5, "id", "id")
    assert vector_index.recall(found, exact).first().recall >= 0.95
    assert found.where("query LIKE 'odd%' OR target LIKE 'odd%'").count() == 0


def test_searches_give_a_query_its_candidates_alone(spark, tmp_path, monkeypatch):
    """A task merges the codes of all lists, so that what leaves it doesn't grow with the number of lists."""
    monkeypatch.setattr(vector_index, "CODE_ROWS", 50)
    x = np.random.default_rng(5).normal(size=(600, 8)).astype(np.float32)
    side = spark.createDataFrame([(f"v{i:04}", v.tolist(), 1, "") for i, v in enumerate(x)], SCHEMA).repartition(3)
    index = vector_index.build(side, "id", f"{tmp_path}/i", parts=4)
    found = vector_index.candidates_of(index, side, "id", probes=10, candidates=20)
    assert "Window" not in found._jdf.queryExecution().toString()
    assert {r["count"] for r in found.groupBy("query").count().collect()} == {20}


def test_galleries_that_cannot_be_indexed(spark, tmp_path):
    side = spark.createDataFrame([("a", [1.0, 0.0, 1.0], 1, "")], SCHEMA)
    with pytest.raises(ValueError):
        vector_index.build(side.where("false"), "id", f"{tmp_path}/a")
    with pytest.raises(ValueError):
        vector_index.build(side, "id", f"{tmp_path}/b", parts=2)
