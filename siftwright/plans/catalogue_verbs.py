"""Queries of verbs by name, collections, lookups, checks and pixel values."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.functions import checks, predicates
from siftwright.operators import collections, detections, grouping, lineage, similarity
from siftwright.plans import catalogue, registry, slots
from siftwright.plans.catalogue import query
from siftwright.plans.catalogue_files import _FILES, _page_files
from siftwright.plans.catalogue_records import suppressed_sql
from siftwright.session import table
from siftwright.sources import bitmaps, files

_WIDTH, _HEIGHT = 640, 480
#: Boxes of an order's lines, as fractions of a picture; lines of even and odd numbers have labels of their own.
_FRACTIONS = """SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, box_id) AS rn FROM (SELECT l_orderkey * 2 + l_linenumber % 2 AS image, l_linenumber AS box_id, max(l_discount) AS score,
l_linenumber / 32 AS x1, l_linenumber / 64 AS y1, l_linenumber / 32 + (max(l_quantity) % 8 + 1) / 16 AS x2, l_linenumber / 64 + (max(l_quantity) % 8 + 1) / 16 AS y2 FROM lineitem GROUP BY l_orderkey, l_linenumber) WHERE score > 0.02"""


@query(f"""SELECT b.image // 2 AS image, b.box_id, b.image % 2 AS label, floor(b.x1 * {_WIDTH})::INTEGER AS x1, floor(b.y1 * {_HEIGHT})::INTEGER AS y1, floor(b.x2 * {_WIDTH})::INTEGER AS x2, floor(b.y2 * {_HEIGHT})::INTEGER AS y2
FROM ({_FRACTIONS}) b JOIN ({suppressed_sql(0, 200, 1000, _FRACTIONS)}) k ON k.image = b.image AND k.box_id = b.box_id""")
def selected_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VX19: likely boxes of every label, suppressed label by label, in pixels."""
    n = F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_discount").alias("score"), ((F.max("l_quantity") % 8 + 1) / 16).alias("side"))
    boxes = lines.select(F.col("l_orderkey").alias("image"), n.alias("box_id"), (n % 2).cast("bigint").alias("label"), "score", (n / 32).alias("x1"), (n / 64).alias("y1"), (n / 32 + F.col("side")).alias("x2"), (n / 64 + F.col("side")).alias("y2"), F.lit(_WIDTH).alias("width"), F.lit(_HEIGHT).alias("height"))
    return detections.select_detections(boxes, 0.02, label="label").select("image", "box_id", "label", "x1", "y1", "x2", "y2")


@query(f"""WITH e AS (SELECT vec_id, embedding, sha256(vec_id::VARCHAR) AS h FROM embeddings), q AS (SELECT embedding, h FROM e WHERE vec_id = 0),
s AS (SELECT e.vec_id, round({catalogue._SIM}, 4) AS clip, round(1 - ({catalogue._HAM.replace("d.h", "e.h")}) / 256, 4) AS pdq FROM e, q),
f AS (SELECT vec_id AS path, round((0.6 * clip + 0.4 * pdq) / (0.6 + 0.4), 4) AS similarity FROM s)
SELECT path, similarity, row_number() OVER (ORDER BY similarity DESC, path) AS rank, similarity >= 0.3 AS is_match FROM f ORDER BY similarity DESC, path LIMIT 10""")
def registered_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UD7: image-to-image search by name, of vectors and hashes together."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("path"), "embedding", F.sha2(F.col("vec_id").cast("string"), 256).alias("pdq_hash"))
    arguments = {"query": catalogue._vector(spark, sf_dir), "query_hash": hashlib.sha256(b"0").hexdigest(), "k": 10, "least": 0.3}
    return registry.default_registry().call("image_series_similarity/search_series", rows, arguments).select("path", "similarity", "rank", "is_match")


@query("""WITH s AS (SELECT 'c' || label || '_yoArS' AS collection, vec_id, vec_id % 2 = 0 AS is_new FROM embeddings WHERE label <> 3 AND embedding IS NOT NULL)
SELECT collection, vec_id AS path, is_new FROM s WHERE collection <> 'c1_yoArS'""")
def registered_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UD8: uploads into collections and the deletion of one, by name. Vectors of even ids are uploaded again, changed; those
    of odd ids stay; images without a face have no row."""
    vectors = table(spark, sf_dir, "embeddings").where("label <> 3 AND embedding IS NOT NULL")
    rows = vectors.select(F.concat(F.lit("c"), F.col("label").cast("string")).alias("collection"), F.col("vec_id").alias("path"), "embedding")
    rows = collections.named(rows, "yolo", "ArcFace")
    changed = rows.where("path % 2 = 0").withColumn("embedding", F.transform("embedding", lambda x: x * 0 + 7))
    faceless = rows.withColumns({"path": -F.col("path") - 1, "embedding": F.lit(None).cast("array<float>")})
    sent = rows.withColumn("is_new", F.lit(False)).unionByName(changed.unionByName(faceless).withColumn("is_new", F.lit(True)))
    known = registry.default_registry()
    left = known.call("face-match/deletecollection", known.call("face-match/bulkupload", sent), {"name": "c1_yoArS"})
    return left.select("collection", "path", F.forall("embedding", lambda x: x == 7).alias("is_new"))


@query("SELECT doc_id, left(coalesce(text, ''), 80) AS summary, length(coalesce(text, ''))::BIGINT AS seconds FROM documents")
def registered_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UD11, UD12, PL7: models behind their verbs, one after another, with stand-ins that cut and count."""
    summarise = slots.Slot("summary", "summary string", lambda batch: {"summary": [(x or "")[:80] for x in batch["text"]]}, ("text",))
    transcribe = slots.Slot("transcript", "seconds bigint", lambda batch: {"seconds": [len(x or "") for x in batch["text"]]}, ("text",))
    known = registry.default_registry({"text_summarization/summarize": summarise, "audio/transcribe": transcribe})
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return known.run([{"name": "/summarize"}, {"name": "/transcribe"}], rows).select("doc_id", "summary", "seconds")


@query(f"WITH f AS ({_FILES}) SELECT row_number() OVER (ORDER BY name) AS ordinal, name FROM f WHERE kind >= 3")
def face_query_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC9: pictures of a folder in the order of their names, the folders below it left out."""
    scan = files.listing(spark, _page_files(spark, sf_dir, sounds=True))
    return files.sorted_files(scan).select(F.col("ordinal").cast("bigint").alias("ordinal"), F.regexp_extract("path", "[^/]*$", 0).alias("name"))


@query("SELECT doc_id, row_number() OVER (ORDER BY strlen(text) DESC, doc_id::VARCHAR) AS ordinal FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def largest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO14: long work first."""
    scan = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("length"))
    return files.largest_first(scan).select("doc_id", "ordinal")


@query("""WITH c AS (SELECT c_custkey, '/c/' || c_custkey AS path, c_mktsegment AS model, c_acctbal > 0 AS hashed FROM customer)
SELECT 'hashed' AS part, c_custkey FROM c WHERE hashed AND model = 'BUILDING' UNION ALL SELECT 'plain', c_custkey FROM c WHERE NOT hashed
UNION ALL SELECT 'paths', c_custkey FROM c WHERE path IN ('/c/1', '/c/5') UNION ALL SELECT 'hashes', c_custkey FROM c WHERE c_custkey IN (3, 8)""")
def cache_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FL23: rows of a cache by paths, model, content hashes and whether they have a perceptual hash."""
    key = F.col("c_custkey").cast("string")
    cache = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("/c/"), key).alias("path"), F.col("c_mktsegment").alias("model_name"), F.sha2(key, 256).alias("content_sha256"), F.when(F.col("c_acctbal") > 0, "ab").otherwise("").alias("pdq_hash"))
    wanted = {
        "hashed": predicates.cached(model="BUILDING", hashed=True),
        "plain": predicates.cached(hashed=False),
        "paths": predicates.cached(paths=["/c/1", "/c/5", "/none"]),
        "hashes": predicates.cached(hashes=[hashlib.sha256(x).hexdigest() for x in (b"3", b"8")]),
        "nothing": predicates.cached(paths=[]),
    }
    return reduce(DataFrame.unionByName, (cache.where(condition).select(F.lit(part).alias("part"), "c_custkey") for part, condition in wanted.items()))


@query("""WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n FROM customer), o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders)
SELECT c_custkey, o_orderkey FROM c JOIN o USING (n)""")
def zipped_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN12: queries beside their results by place."""
    queries, results = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select("o_orderkey")
    return similarity.zipped(queries, results, "c_custkey", "o_orderkey").select("c_custkey", "o_orderkey")


@query("""WITH r AS (SELECT l_orderkey AS id, l_linenumber AS n, min(l_returnflag) AS container FROM lineitem GROUP BY ALL)
SELECT 'rows' AS part, id, n, row_number() OVER (PARTITION BY id ORDER BY container, n) AS place FROM r
UNION ALL SELECT 'steps', o_orderkey, 0, 0 FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)""")
def response_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO9: response rows in their step's order, and the steps that are asked for."""
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.groupBy(F.col("l_orderkey").alias("step_job_id"), F.col("l_linenumber").alias("ordinal")).agg(F.min("l_returnflag").alias("container"))
    steps = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("step_job_id"))
    found = lineage.steps_by_id(steps, lines.where("l_quantity >= 49").select(F.col("l_orderkey").alias("step_job_id")))
    placed = lineage.response_order(rows).select(F.lit("rows").alias("part"), F.col("step_job_id").alias("id"), F.col("ordinal").alias("n"), "place")
    return placed.unionByName(found.select(F.lit("steps").alias("part"), F.col("step_job_id").alias("id"), F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("place")))


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) JOIN customer ON o_custkey = c_custkey WHERE rn = 1 AND c_acctbal > 0")
def first_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO11: the first row for every key that is asked for."""
    asked = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return grouping.first_of(asked, rows, "c_custkey", "o_orderkey")


@query("""SELECT o_orderkey, '{"key":' || o_orderkey || ',"at":"' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '","parts":[{"price":"' || o_totalprice::DECIMAL(12, 2) || '","note":null}],"by":{"' || o_custkey || '":"' || o_orderpriority || '"},"ok":' || (o_orderstatus = 'F') || '}' AS json FROM orders""")
def json_safe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN33: records of any types as JSON text: dates, decimals and bytes as text, keys as text, nulls kept."""
    price = F.struct(F.col("o_totalprice").cast("decimal(12,2)").alias("price"), F.lit(None).cast("date").alias("note"))
    record = F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("at"), F.array(price).alias("parts"), F.create_map("o_custkey", F.col("o_orderpriority").cast("binary")).alias("by"), (F.col("o_orderstatus") == "F").alias("ok"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", record.alias("record"))
    return rows.select("o_orderkey", checks.json_text(F.col("record"), rows.schema["record"].dataType).alias("json"))


@query("""SELECT c_custkey, left(c_name, 12) AS name, concat_ws('; ', CASE WHEN c_nationkey IS NULL THEN 'missing c_nationkey' END, CASE WHEN c_acctbal <= 0 THEN 'missing note' END,
CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'invalid c_mktsegment: ' || c_mktsegment END) AS problems FROM customer""")
def row_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN38: missing and invalid fields of rows, and texts made fit to be stored."""
    rows = table(spark, sf_dir, "customer").withColumn("note", F.when(F.col("c_acctbal") > 0, "note"))
    found = checks.problems(["c_nationkey", "note"], {"c_mktsegment": ["BUILDING", "MACHINERY"]})
    dirty = F.concat(F.substring("c_name", 1, 3), F.lit("\0"), F.substring("c_name", 4, 100))
    return rows.select("c_custkey", checks.sanitised(dirty, 12).alias("name"), F.array_join(found, "; ").alias("problems"))


def _pixels_sql() -> str:
    means = {k: f"(CASE ({{i}}) % 3 WHEN 0 THEN {r} WHEN 1 THEN {g} ELSE {b} END)" for k, (r, g, b) in bitmaps.CHANNEL_MEANS.items()}
    value = {"base": "{x}", "raw": "{x} * 255", "Facenet": "({x} - m) / nullif(s, 0)", "Facenet2018": "{x} * 255 / 127.5 - 1", "ArcFace": "({x} * 255 - 127.5) / 128"} | {k: "{x} * 255 - " + mean for k, mean in means.items()}
    each = lambda text: text.replace("{x}", "e[len(e)]").replace("{i}", "len(e) - 1")
    rows = " UNION ALL ".join(f"SELECT vec_id, '{kind}' AS kind, round({each(text)}, 6) AS last FROM d" for kind, text in value.items())
    return f"""WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
m AS (SELECT *, list_avg(e) AS m FROM p), d AS (SELECT *, sqrt(list_avg(list_transform(e, lambda x: (x - m) * (x - m)))) AS s FROM m) {rows}"""


@query(_pixels_sql())
def pixel_normalisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN37: pixel values as models want them; the pixels are the components of vectors."""
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = table(spark, sf_dir, "embeddings").where(finite & (F.size("embedding") > 0)).select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    last = lambda kind: F.struct(F.lit(kind).alias("kind"), F.round(F.element_at(bitmaps.normalised(F.col("e"), kind), -1), 6).alias("last"))
    return rows.select("vec_id", F.inline(F.array(*map(last, bitmaps.NORMALISATIONS))))
