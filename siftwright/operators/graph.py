"""Provenance graphs of jobs: node and edge tables, and one JSON-LD document per job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwright.functions import scalars

_NODE = ("uid", "id", "type", "body")


def _node(df: DataFrame, ident: Column, kind: str, **body: Column) -> DataFrame:
    """One node per job and id; its body becomes JSON once the id is unique."""
    told = F.struct(*(v.alias(k) for k, v in body.items()))
    return df.select("uid", ident.alias("id"), told.alias("b")).groupBy("uid", "id").agg(F.min("b").alias("b")).select("uid", "id", F.lit(kind).alias("type"), F.to_json("b").alias("body"))


def steps_of(jobs: DataFrame) -> DataFrame:
    """Ordered endpoints of every job: uid, step from 1, endpoint."""
    chain = scalars.pipeline_endpoints(F.from_json("endpointChain", "array<string>"), F.col("endpoint"))
    return jobs.select("uid", F.posexplode(chain).alias("step", "endpoint")).withColumn("step", (F.col("step") + 1).cast("bigint"))


def nodes(jobs: DataFrame, inputs: DataFrame, hits: DataFrame) -> DataFrame:
    """Nodes: uid, id, type, body (JSON). ``inputs`` are (uid, path), ``hits`` (uid, path, rank, similarity, model)."""
    steps = steps_of(jobs)
    action = lambda n: F.concat(F.lit("kb:action-"), F.col("uid"), F.lit("-"), n.cast("string"))
    status = jobs.select("uid", scalars.action_status(F.col("status")).alias("status"), "startTime", "endTime")
    last = steps.join(status, "uid")
    informed = F.when(F.col("step") > 1, action(F.col("step") - 1))
    raster = scalars.is_raster(F.col("path"))
    parts = [
        _node(steps, F.concat(F.lit("kb:instrument-"), scalars.endpoint_slug(F.col("endpoint"))), "AnalyticTool", name=F.col("endpoint")),
        _node(last, action(F.col("step")), "InvestigativeAction", name=F.col("endpoint"), status=F.col("status"), start=F.col("startTime"), end=F.col("endTime"), wasInformedBy=informed),
        _node(inputs, scalars.node_id(F.col("path"), "dir"), "Directory", path=F.col("path")),
        _node(hits, scalars.node_id(F.col("path"), "file"), "File", path=F.col("path"), isRaster=raster),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(jobs: DataFrame, inputs: DataFrame, hits: DataFrame) -> DataFrame:
    """Edges: uid, source, target, kind, rank, similarity, model."""
    steps = steps_of(jobs)
    first, last = "kb:action-", steps.groupBy("uid").agg(F.max("step").alias("last"))
    blank = {"rank": F.lit(None).cast("bigint"), "similarity": F.lit(None).cast("double"), "model": F.lit(None).cast("string")}
    action = lambda n: F.concat(F.lit(first), F.col("uid"), F.lit("-"), n.cast("string"))
    instrument = steps.select("uid", action(F.col("step")).alias("source"), F.concat(F.lit("kb:instrument-"), scalars.endpoint_slug(F.col("endpoint"))).alias("target"), F.lit("instrument").alias("kind"), *(v.alias(k) for k, v in blank.items()))
    informed = steps.where("step > 1").select("uid", action(F.col("step")).alias("source"), action(F.col("step") - 1).alias("target"), F.lit("wasInformedBy").alias("kind"), *(v.alias(k) for k, v in blank.items()))
    objects = inputs.select("uid", F.concat(F.lit(first), F.col("uid"), F.lit("-1")).alias("source"), scalars.node_id(F.col("path"), "dir").alias("target"), F.lit("object").alias("kind"), *(v.alias(k) for k, v in blank.items())).distinct()
    results = hits.join(last, "uid").select("uid", action(F.col("last")).alias("source"), scalars.node_id(F.col("path"), "file").alias("target"), F.lit("search_hit").alias("kind"), "rank", "similarity", "model")
    return instrument.unionByName(informed).unionByName(objects).unionByName(results)


def documents_of_jobs(jobs: DataFrame, inputs: DataFrame, hits: DataFrame) -> DataFrame:
    """The texts of ``documents(nodes(...), edges(...))`` for jobs with a ``uid`` of their own: uid, jsonld.

    A job's rows meet once, as they are, and its nodes and edges are made there, so that no node or edge is shuffled. The graph
    of a job is bounded by its inputs and its capped result rows.
    """
    told = {"job": F.struct("endpoint", "endpointChain", "status", "startTime", "endTime"), "input": F.struct("path"), "hit": F.struct("path", "rank", "similarity", "model")}
    rows = None
    for name, df in (("job", jobs), ("input", inputs), ("hit", hits)):
        part = df.select("uid", told[name].alias(name))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    by = rows.groupBy("uid").agg(*(F.collect_list(name).alias(f"{name}s") for name in told))
    # a job or an input has an item always, a hit where its path is known; said before the steps, which a filter would repeat
    by = by.where((F.size("jobs") > 0) | (F.size("inputs") > 0) | F.exists("hits", lambda x: x["path"].isNotNull()))
    chain = lambda j: scalars.pipeline_endpoints(F.from_json(j["endpointChain"], "array<string>"), j["endpoint"])
    steps = F.flatten(F.transform("jobs", lambda j: F.transform(chain(j), lambda x, i: F.struct((i + 1).cast("bigint").alias("step"), x.alias("endpoint"), scalars.action_status(j["status"]).alias("status"), j["startTime"].alias("start"), j["endTime"].alias("end")))))
    by = by.select("uid", steps.alias("steps"), F.array_max(F.transform(steps, lambda s: s["step"])).alias("last"), "inputs", "hits")
    action = lambda n: F.concat(F.lit("kb:action-"), F.col("uid"), F.lit("-"), n.cast("string"))
    tool = lambda s: F.concat(F.lit("kb:instrument-"), scalars.endpoint_slug(s["endpoint"]))
    informed = lambda s: F.when(s["step"] > 1, action(s["step"] - 1))
    file = lambda x: scalars.node_id(x["path"], "file")
    folder = lambda x: scalars.node_id(x["path"], "dir")
    items = [
        _node_items("steps", "AnalyticTool", tool, lambda s: F.struct(s["endpoint"].alias("name"))),
        _node_items("steps", "InvestigativeAction", lambda s: action(s["step"]), lambda s: F.struct(s["endpoint"].alias("name"), s["status"].alias("status"), s["start"].alias("start"), s["end"].alias("end"), informed(s).alias("wasInformedBy"))),
        _node_items("inputs", "Directory", folder, lambda x: F.struct(x["path"].alias("path"))),
        _node_items("hits", "File", file, lambda x: F.struct(x["path"].alias("path"), scalars.is_raster(x["path"]).alias("isRaster"))),
        F.transform("steps", lambda s: _edge_item(action(s["step"]), tool(s), "instrument")),
        F.transform(F.filter("steps", lambda s: s["step"] > 1), lambda s: _edge_item(action(s["step"]), informed(s), "wasInformedBy")),
        F.transform(F.array_distinct(F.transform("inputs", folder)), lambda x: _edge_item(action(F.lit(1)), x, "object")),
        F.transform(F.filter("hits", lambda x: F.col("last").isNotNull() & F.col("uid").isNotNull()), lambda x: _edge_item(action(F.col("last")), file(x), "search_hit", x)),
    ]
    listed = F.array_sort(F.filter(F.concat(*items), lambda x: x.isNotNull()))
    return by.select("uid", _jsonld(listed).alias("jsonld"))


def _node_items(rows: str, kind: str, ident, body) -> Column:
    """JSON items of a job's nodes of a kind, one an id: that of the smallest body."""
    told = F.array_sort(F.filter(F.transform(rows, lambda x: F.struct(ident(x).alias("id"), body(x).alias("b"))), lambda x: x["id"].isNotNull()))
    # the sorted nodes with the id before each one's
    pairs = F.transform(F.array(told), lambda t: F.transform(F.filter(F.transform(t, lambda x, i: F.struct(x.alias("x"), F.when(i > 0, F.get(t, i - 1)["id"]).alias("before"))), lambda p: p["before"].isNull() | (p["before"] != p["x"]["id"])), lambda p: p["x"]))
    return F.transform(F.flatten(pairs), lambda x: _node_item(x["id"], F.lit(kind), F.to_json(x["b"])))


def _node_item(ident: Column, kind: Column, body: Column) -> Column:
    return F.concat(F.lit('{"@id":"'), ident, F.lit('","@type":"'), kind, F.lit('",'), F.substr(body, F.lit(2)))


def _edge_item(source: Column, target: Column, kind: str, hit: Column | None = None) -> Column:
    rank, similarity, model = (F.lit(None).cast(t) if hit is None else hit[name].cast(t) for name, t in (("rank", "bigint"), ("similarity", "double"), ("model", "string")))
    digest = F.sha2(F.concat_ws("|", F.col("uid"), source, target, F.lit(kind), rank.cast("string")), 256)
    return F.to_json(F.struct(F.concat(F.lit("kb:relationship-"), F.substring(digest, 1, 16)).alias("@id"), F.lit("Relationship").alias("@type"), source.alias("source"), target.alias("target"), F.lit(kind).alias("kindOfRelationship"), rank.alias("rank"), similarity.alias("similarity"), model.alias("model")))


def _jsonld(items: Column) -> Column:
    return F.concat(F.lit('{"@context":{"kb":"http://example.org/kb/"},"@graph":['), F.array_join(items, ","), F.lit("]}"))


def documents(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """One JSON-LD text per job: uid, jsonld. The graph of a job is bounded by its inputs and its capped result rows."""
    n = node_table.select("uid", _node_item(F.col("id"), F.col("type"), F.col("body")).alias("item"))
    e = edge_table.select("uid", F.to_json(F.struct(F.concat(F.lit("kb:relationship-"), F.substring(F.sha2(F.concat_ws("|", "uid", "source", "target", "kind", F.col("rank").cast("string")), 256), 1, 16)).alias("@id"), F.lit("Relationship").alias("@type"), "source", "target", F.col("kind").alias("kindOfRelationship"), "rank", "similarity", "model")).alias("item"))
    listed = n.unionByName(e).groupBy("uid").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return listed.select("uid", _jsonld(F.col("items")).alias("jsonld"))


def invalid(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """Edges whose source or target is no node of their job: uid, source, target, kind."""
    end = lambda id, other, first: F.struct(F.col(id).alias("id"), F.col(other).alias("other"), F.lit(first).alias("first"))
    ends = edge_table.select("uid", "kind", F.inline(F.array(end("source", "target", True), end("target", "source", False))))
    missing = ends.join(node_table.select("uid", "id"), ["uid", "id"], "left_anti")
    source, target = F.when(F.col("first"), F.col("id")).otherwise(F.col("other")), F.when(F.col("first"), F.col("other")).otherwise(F.col("id"))
    return missing.select("uid", source.alias("source"), target.alias("target"), "kind").distinct()


def outer_directories(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Directories of outputs that are no inputs: uid, path."""
    made = outputs.select("uid", scalars.parent(F.col("path")).alias("path")).where(F.col("path") != "").distinct()
    return made.join(inputs.select("uid", "path"), ["uid", "path"], "left_anti")


def ranked(rows: DataFrame, group: str, score: str, tie: str) -> DataFrame:
    """Rank from 1 within a group."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie)).cast("bigint"))
