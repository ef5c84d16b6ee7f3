"""Queries do their whole job: nothing is cut or left out where tables, lists or texts are long."""

import json

import __spark_entry__ as entry
from siftwright.functions import texts
from siftwright.operators import lineage

LONG = "word " * 400 + "\n\n" + "x" * 1000 + "\n" + "é ü\n" * 200


def test_every_item_of_a_long_list_is_linked(spark):
    n = 1203
    pairs = lambda kind: [{"input_path": f"/i/{k}", "output_path": f"/{kind}/{k}"} for k in range(n)]
    files = [{"path": f"/f/{k}", "metadata": {"input_path": f"/i/{k}"}} for k in range(n)]
    bodies = [("a", json.dumps({"output_type": "batchfile", "files": files})), ("b", json.dumps({"value": json.dumps({"file_pair_rows": pairs("r"), "file_pairs": pairs("p")})}))]
    jobs = spark.createDataFrame(bodies, "step_job_id string, response string").selectExpr("*", "'scan/files' AS endpoint")
    want = {(f"/i/{k}", f"/{kind}/{k}") for kind in "frp" for k in range(n)}
    told = lambda df: {(r.input_path, r.output_path) for r in df.collect()}
    assert told(lineage.links_of_responses(jobs)) == want
    assert told(lineage.links_of_batches(jobs)) | told(lineage.links_of_json(jobs, "file_pair_rows")) | told(lineage.links_of_json(jobs, "file_pairs")) == want


def test_documents_give_all_their_chunks(spark, tmp_path):
    docs = {1: LONG, 2: "short", 3: "", 4: None, 5: " \n"}
    spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.path, r.chunk_index, r.chunk_text) for r in entry.queries()["chunk_documents"](spark, str(tmp_path)).collect()}
    assert got == {(k, i, x) for k, t in docs.items() for i, x in (enumerate(texts.split_recursively(t or "")) if (t or "").strip() else [(None, None)])}


def test_streams_embed_whole_texts(spark, tmp_path):
    pages = [(k, f"u{k}", f"{k} {LONG}" if k % 2 else "<p>") for k in range(12)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.path, r.chunk_index, r.chunk_text): r.dimensions for r in entry.queries()["streamed_embeddings"](spark, str(tmp_path)).collect()}
    assert set(got) == {(f"page_{k}", i, x) for k, url, html in pages for i, x in enumerate(texts.split_recursively(f"{url}\nen région\n{html}"))}
    assert set(got.values()) == {256}
