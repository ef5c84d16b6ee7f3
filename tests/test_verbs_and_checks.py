"""Checks, collections, lookups, pixel values and verbs on small and odd rows."""

import datetime
import decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwright.functions import checks, predicates
from siftwright.operators import collections, detections, grouping, lineage, similarity
from siftwright.plans import registry, slots
from siftwright.sources import bitmaps, files


def test_json_of_any_type(spark):
    schema = "a struct<d:date,x:decimal(5,2),b:binary,l:array<map<int,timestamp_ntz>>,n:double,t:string,e:struct<z:int>>"
    at = datetime.datetime(2024, 1, 2, 3, 4, 5)
    rows = [((datetime.date(2024, 1, 2), decimal.Decimal("1.50"), b"xy", [{7: at}, None], 0.5, 'q"', None),), ((None,) * 7,), (None,)]
    df = spark.createDataFrame(rows, schema)
    found = [r.j for r in df.select(checks.json_text(F.col("a"), df.schema["a"].dataType).alias("j")).collect()]
    nulls = '{"d":null,"x":null,"b":null,"l":null,"n":null,"t":null,"e":null}'
    assert found == ['{"d":"2024-01-02","x":"1.50","b":"xy","l":[{"7":"2024-01-02 03:04:05"},null],"n":0.5,"t":"q\\"","e":null}', nulls, None]


def test_problems_of_rows(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (2, None), (None, "z")], "k int, s string")
    found = [list(r.p) for r in df.select(checks.problems(["k", "s"], {"s": ["a", "b"]}).alias("p")).collect()]
    assert found == [[], ["missing k"], ["missing s"], ["missing k", "invalid s: z"]]
    assert df.select(checks.problems([]).alias("p")).first().p == []
    texts = spark.createDataFrame([("a\0b\0",), (None,), ("",)], "s string")
    assert [r.s for r in texts.select(checks.sanitised(F.col("s"), 1).alias("s")).collect()] == ["a", None, ""]


def test_collections(spark):
    schema = "collection string, path string, embedding array<float>"
    stored = spark.createDataFrame([("a", "p", [1.0]), ("a", "q", [2.0]), ("b", "p", [3.0])], schema)
    new = spark.createDataFrame([("a", "p", [9.0]), ("a", "p", [8.0]), ("c", "x", [5.0]), ("a", "q", None)], schema)
    after = collections.upload(stored, new)
    assert sorted((r.collection, r.path, r.embedding[0]) for r in after.collect()) == [("a", "p", 9.0), ("a", "q", 2.0), ("b", "p", 3.0), ("c", "x", 5.0)]
    assert sorted(r.collection for r in collections.delete(after, ["a", "none"]).collect()) == ["b", "c"]
    assert collections.delete(after, []).count() == 4 and collections.upload(stored, new.limit(0)).count() == 3
    assert sorted(map(tuple, collections.summary(after).collect())) == [("a", 2, 1), ("b", 1, 1), ("c", 1, 1)]


def test_pixel_values(spark):
    pixels = [0.0, 0.25, 0.5, 0.75, 1.0, 0.1]
    df = spark.createDataFrame([(pixels,), ([],), (None,), ([0.5, 0.5],)], "e array<double>")
    plain = np.array(pixels)
    scaled = plain * 255
    wanted = {"base": plain, "raw": scaled, "Facenet": (scaled - scaled.mean()) / scaled.std(), "Facenet2018": scaled / 127.5 - 1, "ArcFace": (scaled - 127.5) / 128}
    wanted |= {k: scaled - np.tile(m, 2) for k, m in bitmaps.CHANNEL_MEANS.items()}
    for kind in bitmaps.NORMALISATIONS:
        first, empty, null, alike = (r.v for r in df.select(bitmaps.normalised(F.col("e"), kind).alias("v")).collect())
        assert np.allclose(first, wanted[kind]) and empty == [] and null is None
        assert (alike == [None, None]) == (kind == "Facenet")
    with pytest.raises(ValueError):
        bitmaps.normalised(F.col("e"), "none")


def test_detections_of_labels(spark):
    schema = "image int, box_id int, label string, score double, x1 double, y1 double, x2 double, y2 double, width int, height int"
    box = (0.0, 0.0, 0.5, 0.5, 100, 50)
    rows = [(1, 1, "a", 0.9, *box), (1, 2, "a", 0.8, *box), (1, 3, "b", 0.7, *box), (1, 4, "c", 0.1, *box), (2, 1, "a", 0.6, *box)]
    df = spark.createDataFrame(rows, schema)
    kept = lambda label: sorted((r.image, r.box_id) for r in detections.select_detections(df, 0.5, label=label).collect())
    assert kept("label") == [(1, 1), (1, 3), (2, 1)] and kept(None) == [(1, 1), (2, 1)]
    one = detections.select_detections(df, 0.5, label="label").where("image = 2").first()
    assert (one.x2, one.y2) == (50, 25) and detections.select_detections(df.limit(0), 0.5, label="label").count() == 0


def test_lookups(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z")], "k string, n int, v string")
    asked = spark.createDataFrame([("a",), ("a",), ("none",), (None,)], "k string")
    assert [tuple(r) for r in grouping.first_of(asked, rows, "k", "n").collect()] == [("a", 1, "y")]
    assert sorted(r.v for r in lineage.steps_by_id(rows, asked, "k").collect()) == ["x", "y"]
    responses = spark.createDataFrame([("s", "b", 0), ("s", "a", 1), ("s", "a", 0), ("t", "a", 5)], "step_job_id string, container string, ordinal int")
    assert sorted((r.step_job_id, r.place, r.container, r.ordinal) for r in lineage.response_order(responses).collect()) == [("s", 1, "a", 0), ("s", 2, "a", 1), ("s", 3, "b", 0), ("t", 1, "a", 5)]
    results = spark.createDataFrame([(10,), (30,), (20,)], "r int")
    assert sorted((r.n, r.r) for r in similarity.zipped(rows.select("n").distinct(), results, "n", "r").collect()) == [(1, 10), (2, 20)]
    assert predicates_of(spark) == {"paths": ["a"], "none": [], "all": ["a", "b", "c"], "hashed": ["a"], "plain": ["b"]}


def predicates_of(spark):
    cache = spark.createDataFrame([("a", "m", "1", "ff"), ("b", "m", "2", ""), ("c", "o", "3", None)], "path string, model_name string, content_sha256 string, pdq_hash string")
    wanted = {"paths": predicates.cached(paths=["a", "c"], model="m"), "none": predicates.cached(hashes=[]), "all": predicates.cached(), "hashed": predicates.cached(hashed=True), "plain": predicates.cached(hashed=False)}
    return {k: sorted(r.path for r in cache.where(v).collect()) for k, v in wanted.items()}


def test_orders_of_files(spark):
    scan = spark.createDataFrame([("/b.PNG", 5), ("/a.jpg", 5), ("/c.txt", 9), ("/d.webp", None)], "path string, length bigint")
    assert [(r.ordinal, r.path) for r in files.sorted_files(scan).orderBy("ordinal").collect()] == [(1, "/a.jpg"), (2, "/b.PNG"), (3, "/d.webp")]
    assert [r.path for r in files.largest_first(scan).orderBy("ordinal").collect()] == ["/c.txt", "/a.jpg", "/b.PNG", "/d.webp"]
    assert files.largest_first(scan.limit(0)).count() == 0


def test_verbs_of_models(spark):
    slot = slots.Slot("s", "summary string", lambda batch: {"summary": [x[:1] for x in batch["text"]]}, ("text",))
    rows = spark.createDataFrame([("n", "text")], "name string, text string")
    known = registry.default_registry({"text_summarization/summarize": slot})
    assert known.call("/summarize", rows).first().summary == "t" and known.call("docs/open", rows, {"name": "n"}).first().text == "text"
    assert known.call("docs/open", rows, {"name": "other"}).count() == 0
    with pytest.raises(ValueError):
        known.call("/transcribe", rows)
    with pytest.raises(ValueError):
        registry.default_registry({"nothing/known": slot})


def test_models_get_few_rows_at_a_time(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    count = slots.Slot("count", "n bigint", lambda batch: {"n": [len(batch["text"])] * len(batch["text"])}, ("text",))
    rows = spark.range(3000).coalesce(1).selectExpr("id", "repeat('x', 100) AS text")
    assert max(r.n for r in count.apply(rows).collect()) <= 500


def test_texts_are_cut_a_few_rows_at_a_time(spark):
    from siftwright.functions import texts

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert texts.chunk_table(spark.range(3).selectExpr("id AS path", "'a b' AS text")).count() == 3
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500
