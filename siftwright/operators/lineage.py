"""Lineage tables: input -> output links, lookups by a cascade of keys, completion of a job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwright.functions import scalars
from siftwright.operators import grouping, nested

BATCH, ROWS, PAIRS = "batchfile_metadata_pair", "file_pair_rows", "file_pairs"


def links_of_responses(jobs: DataFrame, kinds: tuple[str, ...] = (BATCH, ROWS, PAIRS), key: str = "step_job_id") -> DataFrame:
    """Links of ``links_of_batches`` and of both lists of ``links_of_json``, for which a response is parsed once; every item of
    a list counts."""
    get = lambda x, name, kind="string": F.try_variant_get(x, f"$.{name}", kind)
    texts = (ROWS in kinds) or (PAIRS in kinds)
    roots = jobs.select(key, *(["endpoint"] if PAIRS in kinds else []), nested.root_of(F.col("response")).alias("_root"))
    payload = F.try_parse_json(get(F.col("_root"), "value")) if texts else F.lit(None).cast("variant")
    told = roots.select("*", payload.alias("_payload"))
    lists = {BATCH: lambda: nested.files_of_batch(F.col("_root")), ROWS: lambda: get(F.col("_payload"), ROWS, "array<variant>"), PAIRS: lambda: F.when(~_summarised(F.col("_payload"), F.col("endpoint")), get(F.col("_payload"), PAIRS, "array<variant>"))}
    listed = told.select(key, F.inline(F.array(*(F.struct(F.lit(kind).alias("_kind"), lists[kind]().alias("_list")) for kind in kinds))))
    items = listed.select(key, "_kind", F.explode("_list").alias("_x"))
    x, batch = F.col("_x"), F.col("_kind") == BATCH
    path, metadata = nested.item_of_batch(x)
    found = nested.worked_out(items, F.col(key).alias(key), F.col("_kind"), F.when(~batch, get(x, "input_path")).alias("_in"), F.when(batch, path).otherwise(get(x, "output_path")).alias("_out"), metadata.alias("m"))
    m, at = F.col("m"), lambda name: F.try_element_at(F.col("m"), F.lit(name))
    source = F.when(batch, F.coalesce(at("input_path"), at("source_path"))).otherwise(F.col("_in"))
    marked = F.when(at("link_kind").isNull(), F.map_concat(m, F.create_map(F.lit("link_kind"), F.col("_kind")))).otherwise(m)
    links = found.select(key, F.trim(source).alias("input_path"), F.trim("_out").alias("output_path"), marked.alias("metadata"))
    return links.where((F.col("input_path") != "") & (F.col("output_path") != ""))


def _summarised(payload: Column, endpoint: Column) -> Column:
    return F.coalesce(F.try_variant_get(payload, "$.image_summary", "boolean"), F.lit(False)) & F.contains(F.coalesce(endpoint, F.lit("")), F.lit("summarize-images"))


def links_of_batches(jobs: DataFrame, key: str = "step_job_id") -> DataFrame:
    """Links from batch files whose metadata names their input."""
    return links_of_responses(jobs, (BATCH,), key)


def links_of_json(jobs: DataFrame, field: str, key: str = "step_job_id") -> DataFrame:
    """Links from a list of pairs (``file_pairs`` or ``file_pair_rows``) in a JSON text response. Pairs of image summaries
    are left to ``summary_links``."""
    return links_of_responses(jobs, (field,), key)


def summary_links(outputs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Image-summary links: the recorded pair of an output, or else the image that its name implies."""
    known = pairs.select("output_path", F.col("input_path").alias("paired"))
    joined = outputs.select("output_path").join(known, "output_path", "left")
    return joined.select("output_path", F.coalesce("paired", scalars.source_image(F.col("output_path"))).alias("input_path"))


def upsert_links(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Links keyed by normalised output path; of new ones with the same key the last input path counts."""
    keyed = new.withColumns({"input_path_norm": scalars.normalised_path(F.col("input_path")), "output_path_norm": scalars.normalised_path(F.col("output_path"))})
    fresh = grouping.latest(keyed, ["output_path_norm"], ["input_path"])
    return grouping.upsert(stored, fresh.select(*stored.columns), ["output_path_norm"])


def lookup_cascade(requests: DataFrame, on: str, tables: list[tuple[DataFrame, str, str, Column | None]]) -> DataFrame:
    """First hit of several lookups: each a table, its key and value column, and an expression of the request to look up
    (the request key itself when None). Adds ``found`` and ``found_in`` (from 1)."""
    out = requests
    for k, (table, key, value, expression) in enumerate(tables):
        side = table.groupBy(F.col(key).alias(f"_k{k}")).agg(F.min(value).alias(f"_v{k}"))
        wanted = F.col(on) if expression is None else expression
        out = out.join(side, wanted == side[f"_k{k}"], "left").drop(f"_k{k}")
    values = [F.col(f"_v{k}") for k in range(len(tables))]
    place = reduce(lambda rest, k: F.when(values[k].isNotNull(), k + 1).otherwise(rest), reversed(range(len(tables))), F.lit(None).cast("int"))
    return out.select(*requests.columns, F.coalesce(*values).alias("found"), place.cast("bigint").alias("found_in"))


def input_of_output(requests: DataFrame, links: DataFrame, legacy: DataFrame) -> DataFrame:
    """Input path of every output path: by normalised, then raw path, in the links and then in a legacy table."""
    norm = scalars.normalised_path(F.col("output_path"))
    return lookup_cascade(requests, "output_path", [(links, "output_path_norm", "input_path", norm), (links, "output_path", "input_path", None), (legacy, "output_path_norm", "input_path", norm), (legacy, "output_path", "input_path", None)])


def steps_by_id(steps: DataFrame, wanted: DataFrame, key: str = "step_job_id") -> DataFrame:
    """The steps that are asked for, each once, however often it is asked for."""
    return steps.join(wanted.select(key), key, "left_semi")


def response_order(rows: DataFrame, key: str = "step_job_id") -> DataFrame:
    """Response rows with their place (from 1) in their step, by container and ordinal."""
    by = Window.partitionBy(key).orderBy("container", "ordinal")
    return rows.withColumn("place", F.row_number().over(by).cast("bigint"))


def record_completion(tables: dict[str, DataFrame], jobs: DataFrame) -> dict[str, DataFrame]:
    """Next versions of ``steps``, ``rows`` and ``links`` after jobs (step_job_id, endpoint, completed_at, response) ended."""
    steps = grouping.upsert(tables["steps"], jobs.select(*tables["steps"].columns), ["step_job_id"])
    rows = grouping.replace_snapshot(tables["rows"], nested.flatten_responses(jobs).select(*tables["rows"].columns), ["step_job_id"])
    links = upsert_links(tables["links"], links_of_responses(jobs))
    return {"steps": steps, "rows": rows, "links": links}
