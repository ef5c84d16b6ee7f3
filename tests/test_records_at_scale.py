"""Queries over jobs' responses read and parse them few times, whatever the table's size."""

import json

from pyspark.sql import functions as F

import __spark_entry__ as entry
from siftwright.functions import scalars
from siftwright.operators import lineage, nested

SF = "/root/testdata/sf0.001"


def scans(df, name):
    return df._jdf.queryExecution().executedPlan().toString().count(f"/{name}.parquet]")


def test_links_of_jobs_read_lines_once(spark):
    assert scans(entry.queries()["links_of_jobs"](spark, SF), "lineitem") == 1


def test_completed_jobs_read_lines_few_times(spark):
    assert scans(entry.queries()["completed_jobs"](spark, SF), "lineitem") <= 6


def test_links_of_all_kinds_in_one_pass(spark):
    pair = lambda k, **more: {"input_path": f" /i/{k}", "output_path": f"/o/{k} "} | more
    text = lambda **lists: json.dumps({"root": {"output_type": "text", "value": json.dumps(lists)}})
    files = [{"path": "\\o\\1", "metadata": {"source_path": "/i/1", "n": 7}}, {"path": "", "metadata": {"input_path": "/i"}}, {"path": "/o/x"}, "q", None]
    bodies = [("a", "e", json.dumps({"output_type": "batchfile", "files": files})), ("b", "e", text(file_pair_rows=[pair(2), pair(3, metadata={"link_kind": "own"})], file_pairs=[pair(4)])), ("c", "x/summarize-images", text(file_pairs=[pair(5)], image_summary=True)), ("d", None, "[1]"), ("e", None, None), ("f", None, "{broken")]
    jobs = spark.createDataFrame(bodies, "step_job_id string, endpoint string, response string")
    told = lambda df: sorted((r.step_job_id, r.input_path, r.output_path, r.metadata["link_kind"]) for r in df.collect())
    want = [("a", "/i/1", "/o/1", "batchfile_metadata_pair"), ("b", "/i/2", "/o/2", "file_pair_rows"), ("b", "/i/3", "/o/3", "own"), ("b", "/i/4", "/o/4", "file_pairs")]
    assert told(lineage.links_of_responses(jobs)) == want
    assert told(lineage.links_of_batches(jobs)) + told(lineage.links_of_json(jobs, "file_pair_rows")) + told(lineage.links_of_json(jobs, "file_pairs")) == want


def test_roots(spark):
    texts = ['{"root": {"a": 1}}', ' \n{"root": "{}", "b": 2}', '{"root": [1]}', "[{}]", '"{}"', "7", "{", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.to_json(nested.root_of(F.col("t"))).alias("r")).orderBy("i").collect()
    assert [r.r for r in rows] == ['{"a":1}', '{"b":2,"root":"{}"}', '{"root":[1]}', None, None, None, None, None, None]


def test_ordinals_of_several_containers(spark):
    body = json.dumps({"output_type": "text", "value": json.dumps({"rows": [1, 2, 3], "hits": [4, 5], "n": 1})})
    jobs = spark.createDataFrame([("a", body)], "step_job_id string, response string")
    got = sorted((r.container.split(".")[-1], r.ordinal, r.payload) for r in nested.flatten_responses(jobs, cap=5).collect())
    assert got == [("hits", 0, "4"), ("hits", 1, "5"), ("rows", 0, "1"), ("rows", 1, "2"), ("rows", 2, "3")]


def test_normal_paths_stay(spark):
    paths = {"/a/b": "/a/b", "/a/.b/..c": "/a/.b/..c", "/a//b": "/a/b", "/a/": "/a", "/": "/", "/a/.": "/a", "/a/..": "/", "/../a": "/a", "/a\\b": "/a/b", "/a ": "/a", "a": "/a", "": "/", "/a/./b": "/a/b", "/a\n": "/a\n"}
    rows = spark.createDataFrame([(p,) for p in paths] + [(None,)], "p string").select("p", scalars.normalised_path(F.col("p")).alias("n")).collect()
    assert {r.p: r.n for r in rows} == paths | {None: None}


def test_streams_list_files_by_few_tasks(spark, tmp_path):
    from siftwright.streaming import incremental

    (tmp_path / "in").mkdir()
    for k in range(120):
        (tmp_path / f"in/{k}.txt").write_text(f"text {k}")
    stream = incremental.embed_stream(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c"))
    stream.awaitTermination()
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(str(stream.runId)) for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages if s) <= incremental.LISTING_TASKS
    assert spark.read.parquet(str(tmp_path / "t")).count() == 120
