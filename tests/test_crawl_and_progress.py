"""Crawls over pages and recorded progress of streams."""

import duckdb
import pytest
from pyspark.sql import functions as F

from siftwright.operators import crawl
from siftwright.plans import catalogue
from siftwright.streaming import progress

BASE = "http://h.example/a/b.html?x=1"


@pytest.mark.parametrize(
    "link, target",
    [("c.html", "http://h.example/a/c.html"), ("/c#top", "http://h.example/c"), ("https://o.example/", "https://o.example/"), ("//o.example/x", "http://o.example/x"), ("#top", None), ("", None), ("mailto:a@b.example", None), ("JavaScript:x()", None), ("http://h.example/a?b&c", "http://h.example/a?b&c")],
)
def test_links_are_resolved(spark, link, target):
    assert spark.range(1).select(crawl.resolved(F.lit(link), F.lit(BASE)).alias("t")).first().t == target


def page(name, *targets):
    return f"http://h.example/{name}", "".join(f'<p><a title="x" href="{t}">y</a>' for t in targets)


def test_crawl_gives_depths_and_parents(spark):
    rows = [page("a", "b", "c", "a", "missing"), page("b", "d", "c"), page("c", "/d#x", "http://h.example/a"), page("d", "e"), page("e"), page("alone", "a"), (None, "<a href='a'>"), ("http://h.example/n", None)]
    pages = spark.createDataFrame([(*r, 1) for r in [*rows, rows[0]]], "url string, html string, depth int").repartition(3)
    short = lambda x: x and x.rsplit("/", 1)[1]
    found = {(short(r.url), r.depth, short(r.parent)) for r in crawl.reachable(pages, ["http://h.example/a", "http://nowhere.example/"]).collect()}
    assert found == {("a", 0, None), ("b", 1, "a"), ("c", 1, "a"), ("d", 2, "b"), ("e", 3, "d")}
    assert crawl.reachable(pages, ["http://h.example/a"], most_steps=1).count() == 3
    assert crawl.reachable(pages, []).count() == 0 and crawl.reachable(pages.where("false"), ["x"]).count() == 0


def test_long_crawls_end_where_their_sql_does(spark, tmp_path):
    """Of 12,500 pages some are more than 24 steps away."""
    spark.range(12_500).select(F.col("id").alias("page_id"), F.lit("<p>x</p>").alias("html")).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    found = sorted((r.path, r.depth, r.parent) for r in catalogue.QUERIES["wiki_crawl"](spark, str(tmp_path)).collect() if r.parent)
    assert found == sorted(r for r in duck.execute(catalogue.ORACLES["wiki_crawl"]).fetchall() if r[2])
    assert max(r[1] for r in found) == 24


def test_progress_rows_add_up(spark, tmp_path):
    spark.range(1000).repartition(5).write.parquet(f"{tmp_path}/in")
    assert progress.read(spark, f"{tmp_path}/p").count() == 0
    with progress.recorded(spark, f"{tmp_path}/p"):
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
        stream.writeStream.queryName("numbers").format("noop").option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start().awaitTermination()
        bad = stream.select(F.raise_error(F.lit("broken")).alias("x")).writeStream.queryName("bad").format("noop").option("checkpointLocation", f"{tmp_path}/t").trigger(availableNow=True).start()
        with pytest.raises(Exception):
            bad.awaitTermination()
    rows = progress.read(spark, f"{tmp_path}/p")
    assert rows.where("name = 'numbers' AND state = 'running'").agg(F.sum("input_rows")).first()[0] == 1000
    ends = {r.name: (r.state, bool(r.error)) for r in rows.where("state <> 'running'").collect()}
    assert ends == {"numbers": ("done", False), "bad": ("failed", True)}
