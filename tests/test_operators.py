import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwright.operators import cache, detections, evaluate, fusion, graph, grouping, lineage, nested, similarity, state
from siftwright.plans import slots
from siftwright.sources import files


def scored(spark, rows):
    return spark.createDataFrame(rows, "path string, score double")


def fused(spark, parts, weights):
    out = fusion.fuse({k: (scored(spark, v), weights[k]) for k, v in parts.items()}, "path")
    return {r.path: r for r in out.collect()}


def test_fusion(spark):
    rows = fused(spark, {"x": [("a", 0.8)], "y": [("a", 0.6)]}, {"x": 0.5, "y": 0.5})
    assert (rows["a"].score, rows["a"].score_x, rows["a"].score_y) == (0.7, 0.8, 0.6)
    assert fused(spark, {"x": [("a", 1.0)], "y": [("a", 0.0)]}, {"x": 3, "y": 1})["a"].score == 0.75
    rows = fused(spark, {"x": [("a", 0.9)], "y": [("b", 0.1)]}, {"x": 0.6, "y": 0.4})
    assert rows["a"].score == 0.9 and rows["a"].score_y is None
    with pytest.raises(ValueError):
        fusion.fuse({"x": (scored(spark, [("a", 1.0)]), 0)}, "path")


def test_batch_neighbours_equal_numpy(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = (unit @ unit.T).round(12)
    for size in (4_000_000, 16):
        monkeypatch.setattr(similarity, "SENT_VALUES", size)
        rows = similarity.batch_neighbours(df.where("vec_id < 7"), df.repartition(5), 4, "vec_id", "vec_id", exclude_self=True).collect()
        for q in range(7):
            order = [i for i in np.lexsort((np.arange(120), -sims[q])) if i != q][:4]
            assert [r.target for r in sorted((r for r in rows if r.query == q), key=lambda r: r.rank)] == order
    assert similarity.batch_neighbours(df.where("false"), df, 4, "vec_id", "vec_id").count() == 0


def test_search_restricted_to_paths(spark):
    df = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("a", 1, [0.9, 0.1]), ("b", 0, [0.0, 1.0]), ("c", 0, [1.0, 0.0])], "path string, chunk int, embedding array<double>")
    rows = similarity.search(df, [1.0, 0.0], 5, 0.5, "path", "chunk", df.where("path != 'c'")).orderBy("rank").collect()
    assert [(r.path, r.chunk, r.is_match) for r in rows] == [("a", 0, True), ("b", 0, False)]


@pytest.mark.parametrize("mode", ["semantic", "pdq", "combined"])
def test_series_modes(spark, mode):
    df = spark.createDataFrame([("a", [1.0, 0.0], "0" * 64), ("b", [0.6, 0.8], ""), ("q", [1.0, 0.0], "f" * 64)], "path string, embedding array<double>, pdq_hash string")
    rows = similarity.series_search(df, mode, [1.0, 0.0], "0" * 64, 5, 0.7, "path", exclude=F.col("path") == "q").collect()
    assert [r.path for r in rows] == {"semantic": ["a", "b"], "pdq": ["a"], "combined": ["a", "b"]}[mode]
    with pytest.raises(ValueError):
        similarity.series_search(df, "other", [1.0], "", 1, 0.0, "path")


def brute_nms(boxes, threshold, inclusive):
    add, kept = float(inclusive), []
    for b in sorted(boxes, key=lambda b: (-b[6], b[1])):
        def overlap(k):
            w = max(0, min(b[4], k[4]) - max(b[2], k[2]) + add)
            h = max(0, min(b[5], k[5]) - max(b[3], k[3]) + add)
            area = lambda r: max(0, r[4] - r[2] + add) * max(0, r[5] - r[3] + add)
            union = area(b) + area(k) - w * h
            return w * h / union if union > 0 else 0

        if all(overlap(k) <= threshold for k in kept):
            kept.append(b)
    return {(b[0], b[1]) for b in kept}


@pytest.mark.parametrize("inclusive", [False, True])
def test_suppression_equals_brute_force(spark, inclusive):
    rng = np.random.default_rng(1)
    rows = []
    for image in range(12):
        for k in range(rng.integers(1, 25)):
            x, y, w, h = rng.integers(0, 40, 4)
            rows.append((image, k, float(x), float(y), float(x + w), float(y + h), float(rng.integers(0, 5)) / 4))
    df = spark.createDataFrame(rows, "image int, box_id int, x1 double, y1 double, x2 double, y2 double, score double")
    got = {(r.image, r.box_id) for r in detections.suppress(df, 0.4, inclusive=inclusive).collect()}
    assert got == set().union(*(brute_nms([r for r in rows if r[0] == i], 0.4, inclusive) for i in range(12)))
    assert detections.suppress(df, 0.4, most=1).count() == 12


def test_boxes(spark):
    df = spark.createDataFrame([([10, 10, 20, 40],), ([0, 0, 5, 5],)], "b array<int>")
    assert [r.s for r in df.select(detections.squared(F.col("b"), F.lit(30), F.lit(60)).alias("s")).collect()] == [[0, 10, 30, 40], [0, 0, 5, 5]]
    cells = spark.createDataFrame([("i", 0, 50.0, 50.0, 20.0, 20.0, 0.9, 1.0, 0.0, 0.0, 100, 100), ("i", 1, 51.0, 50.0, 20.0, 20.0, 0.8, 1.0, 0.0, 0.0, 100, 100), ("i", 2, 9.0, 9.0, 4.0, 4.0, 0.5, 1.0, 0.0, 0.0, 100, 100)], "image string, box_id int, cx double, cy double, w double, h double, score double, scale double, pad_w double, pad_h double, width int, height int")
    face = detections.grid_faces(cells).collect()
    assert [(f.box_id, f.x1, f.y1, f.x2, f.y2) for f in face] == [(0, 37.5, 37.5, 62.5, 62.5)]


def responses(spark, *bodies):
    return spark.createDataFrame([(str(k), "e", b if isinstance(b, str) or b is None else json.dumps(b)) for k, b in enumerate(bodies)], "step_job_id string, endpoint string, response string")


def flat_rows(spark, body):
    return [(r.container, r.ordinal, r.output_type, json.loads(r.payload)) for r in nested.flatten_responses(responses(spark, body)).orderBy("container", "ordinal").collect()]


def test_flatten_shapes(spark):
    text = lambda v: {"root": {"output_type": "text", "value": v}}
    assert flat_rows(spark, text("[1, 2, 3]")) == [("text.json[]", k, "json_item", k + 1) for k in range(3)]
    assert flat_rows(spark, text(json.dumps({"file_pairs": [{"a": 1}], "run_id": "r", "files": [], "other": []}))) == [("text.json.file_pairs", 0, "json_item", {"a": 1}), ("text.json.remainder", 0, "json_object", {"run_id": "r", "other": []})]
    assert flat_rows(spark, text("not valid json {")) == [("text.raw", 0, "text", {"value": "not valid json {"})]
    assert flat_rows(spark, text(" ")) == [("text.value", 0, "text", {"value": ""})]
    assert flat_rows(spark, text("7")) == [("text.json", 0, "json_primitive", {"value": 7})]
    assert flat_rows(spark, text(5)) == [("text.value", 0, "text", {"value": 5})]
    batch = {"output_type": "batchtext", "transcripts_dir": "/t", "texts": [{"value": "x"}, "y"]}
    assert flat_rows(spark, batch) == [("root", 0, "batchtext_meta", {"transcripts_dir": "/t"}), ("root.texts", 0, "text", {"value": "x"}), ("root.texts", 1, "text", {"value": "y"})]
    assert flat_rows(spark, {"output_type": "batchfile", "files": [{"path": "p"}, "q"]}) == [("root.files", 0, "file", {"path": "p"}), ("root.files", 1, "file", {"_item": "q"})]
    assert flat_rows(spark, {"output_type": "file", "path": "p"}) == [("root", 0, "file", {"output_type": "file", "path": "p"})]
    assert flat_rows(spark, "no json")[0][:3] == ("raw", 0, "unknown")


def test_output_paths(spark):
    bodies = [{"output_type": "batchfile", "files": [{"path": "/a/b/c.txt"}]}, {"output_type": "text", "value": "Mounted at /m/x/"}, {"output_type": "text", "value": '["/s/one.txt"]'}, {"output_type": "directory", "path": "/d"}, {"output_type": "text", "value": "hello"}, {"files": [{"path": "/z/y.png"}]}, None]
    rows = responses(spark, *bodies).select("step_job_id", nested.output_path(F.col("response")).alias("p")).orderBy("step_job_id").collect()
    assert [r.p for r in rows] == ["/a/b", "/m/x/files", "/s", "/d", None, "/z", None]


def test_hits_and_requests(spark):
    jobs = responses(spark, {"output_type": "batchfile", "files": [{"path": "a", "metadata": {"similarity": "0.91", "model": "m"}}, {"path": ""}, {"path": "c\\d"}]})
    rows = nested.ranked_hits(jobs).orderBy("rank").collect()
    assert [(r.path, r.rank, r.similarity, r.model) for r in rows] == [("a", 1, 0.91, "m"), ("c/d", 3, None, None)]
    request = json.dumps({"inputs": {"input_dir": {"path": "/in"}, "query": {"text": "cats"}}, "parameters": {"k": 5}})
    parts = nested.request_parts(spark.createDataFrame([("u", request)], "uid string, request string")).collect()
    assert {(r.part, r.name, r.value) for r in parts} == {("directory", "input_dir", "/in"), ("text", "query", "cats"), ("parameter", "k", "5")}


def test_completion_replaces_snapshots(spark):
    jobs = responses(spark, {"output_type": "batchfile", "files": [{"path": "/o/1", "metadata": {"input_path": "/i/1"}}]}, {"output_type": "text", "value": json.dumps({"file_pairs": [{"input_path": " /i/2 ", "output_path": "/o/./2"}, {"input_path": "", "output_path": "x"}]})}).withColumn("completed_at", F.lit("2024"))
    tables = {
        "steps": spark.createDataFrame([("0", "old", "2023")], "step_job_id string, endpoint string, completed_at string"),
        "rows": spark.createDataFrame([("0", "root.files", 0, "file", "{}"), ("0", "root.files", 1, "file", "{}"), ("9", "x", 0, "file", "{}")], "step_job_id string, container string, ordinal int, output_type string, payload string"),
        "links": spark.createDataFrame([], "step_job_id string, input_path string, output_path string, metadata map<string,string>, input_path_norm string, output_path_norm string"),
    }
    after = lineage.record_completion(tables, jobs)
    assert {(r.step_job_id, r.endpoint) for r in after["steps"].collect()} == {("0", "e"), ("1", "e")}
    assert sorted((r.step_job_id, r.container) for r in after["rows"].collect()) == [("0", "root.files"), ("1", "text.json.file_pairs"), ("1", "text.json.file_pairs"), ("9", "x")]
    links = {r.output_path_norm: (r.input_path, r.metadata["link_kind"]) for r in after["links"].collect()}
    assert links == {"/o/1": ("/i/1", "batchfile_metadata_pair"), "/o/2": ("/i/2", "file_pairs")}
    asked = spark.createDataFrame([("/o//1",), ("/o/./2",), ("/none",)], "output_path string")
    legacy = spark.createDataFrame([("/none", "/none", "/legacy")], "output_path string, output_path_norm string, input_path string")
    found = {r.output_path: (r.found, r.found_in) for r in lineage.input_of_output(asked, after["links"], legacy).collect()}
    assert found == {"/o//1": ("/i/1", 1), "/o/./2": ("/i/2", 1), "/none": ("/legacy", 3)}


def test_moves(spark):
    cached = spark.createDataFrame([("/old/a.txt", "h1", 1), ("/keep/b.txt", "h2", 2), ("/old/c.txt", "h3", 3)], "path string, sha256 string, v int")
    wanted = spark.createDataFrame([("/new/A.TXT", "h1"), ("/keep/b.txt", "h2"), ("/copy/b2.txt", "h2"), ("/new/x.txt", "h9"), ("/new/y.txt", "")], "path string, sha256 string")
    assert {(r.path, r.old_path) for r in cache.moves_by_name(wanted, cached).collect()} == {("/new/A.TXT", "/old/a.txt")}
    moves = cache.moves_by_content(wanted, cached)
    assert {(r.path, r.old_path, r.action) for r in moves.collect()} == {("/new/A.TXT", "/old/a.txt", "relocate"), ("/copy/b2.txt", "/keep/b.txt", "clone")}
    after = {r.path: r.v for r in cache.apply_moves(cached, moves).collect()}
    assert after == {"/new/A.TXT": 1, "/keep/b.txt": 2, "/copy/b2.txt": 2, "/old/c.txt": 3}
    assert cache.move_counts(wanted, cached).first().asDict() == {"new": 2, "relocated": 1, "cloned": 1}


def test_pipelines(spark):
    rows = [("a", None, 1), ("b", "a", 2), ("c", None, 5), ("d", None, 0)]
    out = {r.uid: (r.pipeline, r.member, r.group_start) for r in grouping.pipelines(spark.createDataFrame(rows, "uid string, root string, start int")).collect()}
    assert out == {"a": ("a", 1, 2), "b": ("a", 2, 2), "c": ("c", 1, 5), "d": ("d", 1, 0)}


def test_votes(spark):
    votes = spark.createDataFrame([("q", "m", "p1", 2.0), ("q", "m", "p2", 1.0), ("q", "n", "p1", 2.0)], "q string, m string, p string, w double")
    assert [(r.m, r.votes, r.voters) for r in fusion.weighted_votes(votes, "q", "m", "p", "w", 2.5).collect()] == [("m", 3.0, ["p1", "p2"])]
    items = spark.createDataFrame([("x", True, 1.0), ("x", False, 1.0), ("y", True, 2.0), ("y", False, 1.0)], "i string, v boolean, w double")
    assert {r.i: r.positive for r in fusion.majority_vote(items, "i", "v", "w").collect()} == {"x": False, "y": True}


def test_confusion_without_rows(spark):
    row = evaluate.confusion(spark.createDataFrame([], "t boolean, p boolean"), "t", "p").first()
    assert (row.tp, row.accuracy, row.f1) == (0, 0.0, 0.0)


def test_adjacent_status(spark):
    rows = [("c", 1, 1, "j", "Started"), ("c", 2, 2, "j", "Completed"), ("c", 3, 3, "k", "Running"), ("c", 4, 4, "j", "Completed"), ("d", 1, 5, "k", "Completed")]
    found = state.adjacent_status(spark.createDataFrame(rows, "conversation_id string, timestamp int, message_id int, job_id string, status string")).collect()
    assert [(r.message_id, r.next_id) for r in found] == [(1, 2)]


def test_state_changes(spark):
    jobs = spark.createDataFrame([("a", "Running", "x"), ("b", "Running", "y")], "uid string, status string, note string")
    changes = spark.createDataFrame([("a", 1, "Failed", None), ("a", 2, "Completed", None), ("a", 3, None, "z")], "uid string, seq int, status string, note string")
    assert {tuple(r) for r in state.apply_changes(jobs, changes, "uid").collect()} == {("a", "Completed", "z"), ("b", "Running", "y")}
    parents, children = state.delete_cascade(jobs, changes, jobs.where("uid = 'a'"), "uid")
    assert parents.count() == 1 and children.count() == 0
    added = state.append_unique(jobs, spark.createDataFrame([("b", "s", "n"), ("c", "s", "n"), ("c", "s", "n")], jobs.schema), "uid")
    assert added.count() == 3
    assert state.jobs_of_user(jobs.withColumns({"userId": F.lit("u"), "startTime": F.lit(1)}), None).count() == 0
    assert state.count_jobs(jobs.withColumn("userId", F.lit("u")), "u").first().n == 2


def test_saved_filters(spark):
    filters = spark.createDataFrame([("f1", "n", "input", '["a.txt", "/abs/b.txt"]')], "id string, name string, filter_type string, paths_json string")
    assert [r.path for r in state.filter_paths(filters, "f1", "/in/").orderBy("ordinal").collect()] == ["/in/a.txt", "/abs/b.txt"]


def test_graph(spark):
    jobs = spark.createDataFrame([("j", "b/search", '["a/scan"]', "Completed", "s", "e")], "uid string, endpoint string, endpointChain string, status string, startTime string, endTime string")
    inputs = spark.createDataFrame([("j", "/in")], "uid string, path string")
    hits = spark.createDataFrame([("j", "/o/x.png", 1, 0.91, "m")], "uid string, path string, rank long, similarity double, model string")
    nodes, edges = graph.nodes(jobs, inputs, hits), graph.edges(jobs, inputs, hits)
    kinds = [r.kind for r in edges.collect()]
    assert sorted(kinds) == ["instrument", "instrument", "object", "search_hit", "wasInformedBy"] and graph.invalid(nodes, edges).count() == 0
    doc = json.loads(graph.documents(nodes, edges).first().jsonld)
    hit = next(x for x in doc["@graph"] if x.get("kindOfRelationship") == "search_hit")
    assert (hit["similarity"], hit["model"], hit["rank"]) == (0.91, "m", 1)
    assert {x["@id"] for x in doc["@graph"] if x["@type"] == "AnalyticTool"} == {"kb:instrument-a_scan", "kb:instrument-b_search"}
    assert {r.path for r in graph.outer_directories(inputs, hits).collect()} == {"/o"}


def container(entries):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, body in entries.items():
            z.writestr(name, body)
    return b"<xml/>" + data.getvalue()


def test_sources(spark, tmp_path):
    from siftwright.sources import container as boxes
    from siftwright.sources import files, logends, sinks

    for name, body in {"a.txt": b"alpha\nbeta", "b.TXT": b"bad \xff bytes", "skip.bin": b"x", "nested/inner.txt": b"in", "pic.png": b"\x89PNGxx", "fake.jpg": b"no"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    (tmp_path / "box.ufdr").write_bytes(container({"files/one.txt": b"0123456789", "two.txt": b"x"}))
    scan = files.listing(spark, str(tmp_path), files.TEXT, content=True)
    assert sorted(r.name for r in scan.collect()) == ["a.txt", "b.TXT"]
    assert files.listing(spark, str(tmp_path), files.TEXT, recursive=True).count() == 3
    assert [r.name for r in files.listing(spark, str(tmp_path), (".txt",), case_sensitive=True).collect()] == ["a.txt"]
    assert files.listing(spark, str(tmp_path / "none")).count() == 0
    assert {r.path.rsplit("/", 1)[1]: r.text for r in files.texts(scan).collect()}["a.txt"] == "alpha\nbeta"
    chosen = spark.createDataFrame([(0, f"{tmp_path}/b.TXT"), (1, "/missing")], "ordinal int, path string")
    assert [r.path for r in files.corpus(scan, chosen).collect()] == [f"{tmp_path}/b.TXT"]
    assert files.corpus(scan, None).count() == 2 and files.corpus(scan, chosen.where("false")).count() == 0
    with pytest.raises(ValueError):
        files.corpus_size(files.corpus(scan, chosen.where("false")))
    with pytest.raises(ValueError):
        files.require_files(scan, (".mp3",))
    everything = files.listing(spark, str(tmp_path), content=True)
    assert [r.name for r in files.decoded_images(everything).collect()] == ["pic.png"]
    ends = [{r.line for r in end(spark, str(tmp_path), 1, (".txt",)).collect() if r.path.endswith("/a.txt")} for end in (logends.head, logends.tail)]
    assert ends == [{"alpha"}, {"beta"}]
    assert {r.path.rsplit("/", 1)[1]: r.mime for r in files.forensics(everything).collect()}["pic.png"] == "image/png"
    tree = boxes.read(spark, str(tmp_path))
    assert sorted(r.path for r in tree.collect()) == ["/", "/files", "/files/one.txt", "/metadata.xml", "/two.txt"]
    assert sorted(r.name for r in boxes.children(tree, "/").collect()) == ["files", "metadata.xml", "two.txt"]
    assert bytes(boxes.read_range(spark, str(tmp_path), "/files/one.txt", 3, 4).first().data) == b"3456"
    out = sinks.text_outputs(files.texts(scan), "/o", whole_name=False).collect()
    assert {r.output_path for r in out} == {"/o/a.txt", "/o/b.txt"}
    sinks.append(scan.select("name"), f"{tmp_path}/t")
    sinks.append(scan.select("name"), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 4
    sinks.discard(scan)


def test_gallery_upsert(spark):
    from siftwright.sources import sinks

    schema = "scope string, collection_name string, face_id string, image_path string, v int"
    old = spark.createDataFrame([("s", "c", "1", "a", 1), ("s", "c", "2", "b", 2)], schema)
    new = spark.createDataFrame([("s", "c", "2", "c", 3), ("s", "c", "3", "d", 4)], schema)
    assert sorted(r.v for r in sinks.next_gallery(old, new).collect()) == [1, 3, 4]


def test_registry_and_plans(spark):
    from siftwright.plans import registry

    r = registry.default_registry()
    df = spark.createDataFrame([("a", "Hello world"), ("b", "nothing")], "path string, text string")
    out = r.run([{"name": "texts/contain", "arguments": {"term": "HELLO"}}, {"name": "texts/chunk"}], df)
    assert [x.path for x in out.collect()] == ["a"]
    assert r.run([{"name": "texts/chunk"}], df, df.where("path = 'b'")).count() == 1
    for bad in ({"name": "none"}, {"name": "texts/chunk", "arguments": {"size": 0}}, {"name": "texts/chunk", "arguments": {"x": 1}}, {"name": "metadata/filter"}):
        with pytest.raises(ValueError):
            r.run([bad], df)
    assert [x.name for x in r.listing(spark).collect()][0] == "texts/chunk"
    assert registry.chained_arguments({"input_dir": "x"}, ["input_dir", "output_dir"], "/p") == {"input_dir": "/p", "output_dir": "/p"}
    assert registry.chained_arguments({"a": 1}, [], "/p") == {"a": 1} and registry.chained_arguments({"input_dataset": "x"}, [], "/p") == {"input_dataset": "/p"}


def test_streamed_embedding(spark, tmp_path):
    from siftwright.streaming import incremental

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one two three")
    run = lambda: incremental.embed_stream(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    run()
    (tmp_path / "in/b.txt").write_text("four five")
    run()
    rows = spark.read.parquet(str(tmp_path / "t")).collect()
    assert len(rows) == 2 and all(len(r.embedding) == 256 for r in rows)
    assert len(list(incremental.response_lines(spark.range(3)))) == 3


def test_model_slot_checks_its_columns(spark):
    rows = spark.createDataFrame([(1, "abc"), (2, "")], "id long, text string")
    slot = slots.Slot("m", "n int", lambda batch: {"n": [len(x) for x in batch["text"]]}, ("text",))
    assert sorted(map(tuple, slot.apply(rows).collect())) == [(1, "abc", 3), (2, "", 0)]
    for bad in (rows.drop("text"), rows.withColumn("n", F.lit(1))):
        with pytest.raises(ValueError):
            slot.apply(bad)
    with pytest.raises(Exception, match="gave"):
        slots.Slot("m", "n int", lambda batch: {"n": []}, ("text",)).apply(rows).collect()


def test_numbered_rows_over_many_partitions(spark):
    rows = spark.range(1000).select(F.concat(F.lit("p"), (F.col("id") % 3).cast("string")).alias("g"), (1000 - F.col("id")).alias("v")).repartition(7)
    got = files.numbered(rows, F.col("g"), F.col("v")).orderBy("ordinal").collect()
    assert [r.ordinal for r in got] == list(range(1000)) and [(r.g, r.v) for r in got] == sorted((r.g, r.v) for r in got)
    assert files.numbered(rows.where("false"), F.col("g")).count() == 0


def test_payload_bounds():
    deep = value = {}
    for _ in range(20):
        value["a"] = {}
        value = value["a"]
    text, depth = nested.cut_levels(deep), 0
    while isinstance(text, dict):
        text, depth = text["a"], depth + 1
    assert text == "<max_depth>" and depth == 15
    assert nested.cut_levels("x" * 16_001) == "x" * 16_000 + "...<trunc 16001 chars>"
    assert nested.cut_levels({"k" * 300: [1, None, 2.5, True]}) == {"k" * 200: [1, None, 2.5, True]}


def test_best_of_equal_similarities():
    found = np.array([[0.5, 0.9, 0.5, 0.5, 0.1], [0.2, 0.2, 0.2, 0.2, 0.2]])
    best = similarity._best(np.array([7, 8]), np.arange(5), found, 3, False)
    assert sorted(zip(best["query"], best["target"])) == [(7, 0), (7, 1), (7, 2), (8, 0), (8, 1), (8, 2)]
    assert sorted(similarity._best(np.array([1]), np.arange(5), found[:1].copy(), 9, True)["target"]) == [0, 2, 3, 4]


def test_shuffles_have_partitions_by_rows(spark):
    """A larger table gets more partitions to sort in, at the least those of the session; before, their number was fixed."""
    from siftwright.session import fine_shuffles

    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    try:
        for rows, parts in ((10, int(spark.conf.get("spark.sql.shuffle.partitions"))), (1_000_001, 21)):
            fine_shuffles(spark, rows)
            plan = spark.range(10).groupBy((F.col("id") % 3).alias("k")).count()._jdf.queryExecution().executedPlan().toString()
            assert f", {parts})" in plan.split("hashpartitioning(")[1].split("\n")[0]
    finally:
        spark.conf.unset(key)


def test_documents_of_jobs_are_made_in_one_shuffle(spark):
    """The same texts as from node and edge tables, with repeated paths, missing parts and rows of unknown jobs; the plan has
    one shuffle, where the tables took a dozen."""
    jobs = spark.createDataFrame([("a", "scan/x", '["scan/x","b c"]', "completed", "1", None), ("b", None, None, None, None, "2"), ("c", "q", "no json", "failed", "3", "4")], "uid string, endpoint string, endpointChain string, status string, startTime string, endTime string")
    inputs = spark.createDataFrame([("a", "/i"), ("a", "/i"), ("a", "/j"), ("b", None), ("z", "/k")], "uid string, path string")
    hits = spark.createDataFrame([("a", "/o/1.png", 1, 0.5, "m"), ("a", "/o/1.png", 2, 0.25, None), ("a", "/o/2.txt", None, None, "m"), ("c", None, 1, 0.1, "m"), ("y", "/o/3", 1, 0.1, "m")], "uid string, path string, rank long, similarity double, model string")
    got = graph.documents_of_jobs(jobs, inputs, hits)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = graph.documents(graph.nodes(jobs, inputs, hits), graph.edges(jobs, inputs, hits))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
