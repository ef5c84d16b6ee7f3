"""Queries over records: jobs, filters, links, responses, paths and texts, caches, boxes and the registry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.functions import embedders, predicates, scalars, texts
from siftwright.operators import cache, detections, fusion, lineage, nested, similarity, state
from siftwright.plans import registry, slots
from siftwright.plans.catalogue import query
from siftwright.session import bounded_batches, table
from siftwright.sources import files


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# --- paths and texts

@query("""SELECT c_custkey, '/data/' || c_mktsegment || '/' || c_name AS normal, '/data/x/../' || c_mktsegment || '//./' || c_name || '/' AS raw, c_acctbal > 0 AS raster,
CASE WHEN c_acctbal > 0 THEN '/p/' || c_name || '.PNG' END AS source, '/data/' || c_mktsegment AS up, 'Instruct: Given a search query, retrieve relevant passages' || chr(10) || 'Query: ' || c_name AS qwen, 'query: ' || c_name AS plain FROM customer""")
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN4, FN16, FN21, FN43, VX13: normal forms, image suffixes, the image of a summary, parents, search queries."""
    c = table(spark, sf_dir, "customer")
    raw = F.concat(F.lit("/data/x/../"), "c_mktsegment", F.lit("//./"), "c_name", F.lit("/"))
    windows = F.concat(F.lit("\\\\?\\"), F.replace(raw, F.lit("/"), F.lit("\\")), F.lit(" "))
    picture = F.concat(F.lit("/p/"), "c_name", F.when(F.col("c_acctbal") > 0, ".PNG").otherwise(".docx"))
    normal = scalars.normalised_path(windows)
    return c.select("c_custkey", normal.alias("normal"), raw.alias("raw"), scalars.is_raster(picture).alias("raster"), scalars.source_image(F.concat(picture, F.lit(".txt"))).alias("source"), scalars.parent(normal).alias("up"), scalars.search_query(F.lit("Qwen3"), F.col("c_name")).alias("qwen"), scalars.search_query(F.lit("e5"), F.col("c_name")).alias("plain"))


@query("""SELECT o_orderkey, o_orderdate AS at, NULL::TIMESTAMP AS no_time, o_orderpriority AS answer, [o_custkey::INTEGER, 2] AS box, 'Results for: scan/' || o_orderstatus || ' → ' || o_orderpriority AS title, 'Results' AS no_title,
'clipseg-blackout-v1:' || CASE WHEN o_orderpriority < 'b' THEN o_orderpriority || ',b' ELSE 'b,' || o_orderpriority END AS tag, sha1(o_orderkey::VARCHAR || '-' || epoch(o_orderdate)::BIGINT) AS fingerprint FROM orders""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN13, FN19, FN20, FN28, FN30, FN32, VX26: times, boxes, answers after thinking, titles, chains, tags, fingerprints."""
    o = table(spark, sf_dir, "orders")
    chain = scalars.chain_list(F.to_json(F.array(F.concat(F.lit("scan/"), "o_orderstatus"), F.col("o_orderpriority"))))
    box = scalars.integer_box(F.concat(F.lit("["), F.col("o_custkey").cast("string"), F.lit(".0, 2, 0, 7]")))
    return o.select(
        "o_orderkey",
        scalars.iso_time(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).cast("timestamp_ntz").alias("at"),
        scalars.iso_time(F.col("o_orderpriority")).cast("timestamp_ntz").alias("no_time"),
        scalars.after_think(F.concat(F.lit("<think>a</think> "), "o_orderpriority", F.lit(" "))).alias("answer"),
        F.slice(box, 1, 2).alias("box"),
        scalars.results_title(chain, F.col("o_orderpriority")).alias("title"),
        scalars.results_title(scalars.chain_list(F.lit("no list")), F.lit(" ")).alias("no_title"),
        scalars.protocol_tag(F.array(F.lit("b"), F.col("o_orderpriority"))).alias("tag"),
        scalars.file_fingerprint(F.col("o_orderkey"), F.col("o_orderdate")).alias("fingerprint"),
    )


@query("""SELECT o_orderkey, '# Audit Trail' || chr(10) || chr(10) || '**Generated:** ' || o_orderkey || chr(10) || chr(10) || '## Job Information' || chr(10) || chr(10) || '- **Job ID:** `JOB_' || o_custkey || '`' || chr(10) || '- **Status:** ' || o_orderstatus AS text FROM orders""")
def audit_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN42: an audit trail's heading."""
    uid = F.concat(F.lit("JOB_"), F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", state.audit_markdown(F.col("o_orderkey"), uid, F.col("o_orderstatus")).alias("text"))


@query("""SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)) || chr(10) || 'tail & more' AS text, true AS none FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '^[A-Za-z]')""")
def wiki_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC28, FN39: text of a page's container with divisions inside; pages without one have none."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike("^[A-Za-z]"))
    body = F.replace(F.replace(F.rtrim(F.regexp_replace("text", r"[\s\x{85}\x{A0}\x1c-\x1f]+$", "")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    inner = F.concat(F.lit('<p>menu</p><div class="wiki markdown-body"><div>'), body, F.lit("</div>\n<b>tail</b> &amp; <div><span>more</span></div><script>var x = '<div>';</script></div><div>footer</div>"))
    read = texts.contained_text()
    return docs.select("doc_id", read(inner).alias("text"), read(F.lit("<div>plain</div>")).isNull().alias("none"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey IS NULL OR c_nationkey = 3")
def owner_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FL24: rows of a user, and those of nobody."""
    return table(spark, sf_dir, "customer").where(predicates.visible_to(F.col("c_nationkey").cast("string"), "3")).select("c_custkey", "c_name")


@query("""SELECT DISTINCT trim(line) AS pattern FROM (SELECT unnest(string_split('  ' || p_type || chr(10) || chr(10) || ' ' || p_brand || ' ', chr(10))) AS line FROM part) WHERE trim(line) <> ''""")
def pattern_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FL16, FL18, AG3: patterns of inline files, once each."""
    lines = table(spark, sf_dir, "part").select(F.explode(F.split(F.concat(F.lit("  "), "p_type", F.lit("\n\n "), "p_brand", F.lit(" ")), "\n")).alias("value"))
    return predicates.pattern_lines(lines).distinct()


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn = 1")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG3, SE3: the first row of every key."""
    return predicates.ordered_distinct(table(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type")


# --- jobs, cases, filters

_EVENT_JOBS = "SELECT event_id::VARCHAR AS uid, user_id::VARCHAR AS userId, ts, event_type AS endpoint FROM events"


def _event_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    return table(spark, sf_dir, "events").select(text("event_id").alias("uid"), text("user_id").alias("userId"), F.col("ts").alias("startTime"), F.col("event_type").alias("endpoint"))


@query(f"WITH j AS ({_EVENT_JOBS}), u AS (SELECT min(userId) AS u FROM j) SELECT 'jobs' AS part, uid, 0::BIGINT AS n FROM j, u WHERE userId = u UNION ALL SELECT 'count', NULL, count(*) FROM j, u WHERE userId = u UNION ALL SELECT 'nobody', NULL, 0")
def jobs_of_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO3, AG1: a user's jobs and their number; none without a user."""
    jobs = _event_jobs(spark, sf_dir)
    user = jobs.agg(F.min("userId")).first()[0]
    none = F.lit(None).cast("string")
    listed = state.jobs_of_user(jobs, user).select(F.lit("jobs").alias("part"), "uid", F.lit(0).cast("bigint").alias("n"))
    counts = [state.count_jobs(jobs, u).select(F.lit(name).alias("part"), none.alias("uid"), "n") for name, u in (("count", user), ("nobody", None))]
    return _union([listed, *counts, state.jobs_of_user(jobs, None).select(F.lit("jobs").alias("part"), "uid", F.lit(0).cast("bigint").alias("n"))])


@query("SELECT conv_id AS conversation_id, max(turn) AS updated_at FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system') GROUP BY 1")
def conversations_of_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO5, FL24: conversations that a user sees, latest first; here those with a system turn belong to the user."""
    owner = F.when(F.bool_or(F.col("role") == "system"), "me").otherwise("other")
    chats = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("conversation_id")).agg(F.max("turn").alias("updated_at"), owner.alias("userId"))
    return state.conversations_of_user(chats, "me").select("conversation_id", "updated_at")


@query("SELECT conv_id, turn, job_id FROM (SELECT *, lead(status) OVER w AS next_status, lead(job_id) OVER w AS next_job FROM (SELECT conv_id, turn, turn // 2 AS job_id, CASE role WHEN 'user' THEN 'started' WHEN 'assistant' THEN 'completed' ELSE 'failed' END AS status FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE status = 'started' AND next_status = 'completed' AND job_id = next_job")
def adjacent_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN7: a started job whose next message says that it is completed."""
    status = F.when(F.col("role") == "user", "started").when(F.col("role") == "assistant", "COMPLETED").otherwise("failed")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("timestamp"), F.col("turn").alias("message_id"), F.expr("turn div 2").alias("job_id"), status.alias("status"))
    return state.adjacent_status(rows).select(F.col("conversation_id").alias("conv_id"), F.col("message_id").alias("turn"), "job_id")


@query("SELECT s_suppkey AS case_id, s_name AS name, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS place, s_nationkey = 4 AS mine FROM supplier")
def cases_and_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO7, SO8: cases newest first; the filters of one owner."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("case_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("created"), F.col("s_nationkey").cast("string").alias("owner_id"))
    place = files.numbered(rows.select("case_id", "created"), F.desc("created"), F.col("case_id")).select("case_id", (F.col("ordinal") + 1).alias("place"))
    mine = state.newest_first(rows, "created", "case_id", "4").select("case_id", F.lit(True).alias("mine"))
    return rows.join(place, "case_id").join(mine, "case_id", "left").select("case_id", "name", "place", F.coalesce("mine", F.lit(False)).alias("mine"))


@query("SELECT 'f' || n_nationkey AS id, (i - 1)::INTEGER AS ordinal, CASE i WHEN 1 THEN '/abs/' || n_name ELSE '/in/' || n_name END AS path FROM nation, range(1, 3) r(i) WHERE n_nationkey = 7 UNION ALL SELECT 'jobs', count(*)::INTEGER, max(n_name) FROM orders JOIN nation ON n_nationkey = 7 WHERE o_orderstatus = 'F'")
def saved_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC26, JN13, DM12: paths of a saved filter, relative ones below the input folder; jobs with their filter."""
    filters = table(spark, sf_dir, "nation").select(F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.lit("input").alias("filter_type"), F.to_json(F.array(F.concat(F.lit("/abs/"), "n_name"), F.col("n_name"))).alias("paths_json"))
    listed = state.filter_paths(filters, "f7", "/in/").select(F.lit("f7").alias("id"), "ordinal", "path")
    jobs = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "f7").alias("filterId"))
    attached = state.filters_of_jobs(jobs, filters).where("filter_name IS NOT NULL").agg(F.lit("jobs").alias("id"), F.count("*").cast("int").alias("ordinal"), F.max("filter_name").alias("path"))
    return listed.unionByName(attached)


@query("""SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN CASE WHEN c_nationkey > 12 THEN 'composite' ELSE 'in' END WHEN c_acctbal > 0 THEN 'out' WHEN c_mktsegment = 'BUILDING' THEN 'composite' END AS outcome,
CASE WHEN c_acctbal > 5000 THEN 'in' WHEN c_acctbal > 0 THEN 'out' END AS unsaved FROM customer""")
def prompt_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DM10, DM11: which saved filter a tool call ends up with, or whether one is made of its paths and patterns."""
    rich, some = F.col("c_acctbal") > 5000, F.col("c_acctbal") > 0
    calls = table(spark, sf_dir, "customer").select("c_custkey", F.when(rich, "in").alias("input_filter"), F.when(rich & (F.col("c_nationkey") > 12), "out").when(rich, "in").when(some, "out").alias("output_filter"), F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("/a"))).alias("paths"), F.array().cast("array<string>").alias("patterns"))
    saved, unsaved = state.resolved_filters(calls), state.resolved_filters(calls, save=False)
    return saved.select("c_custkey", F.when(F.col("composite"), "composite").otherwise(F.col("filter_id")).alias("outcome")).join(unsaved.select("c_custkey", F.col("filter_id").alias("unsaved")), "c_custkey")


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'p' || o_custkey WHEN 'O' THEN 'm' || o_custkey ELSE 'i' || o_custkey END AS filter_id FROM orders""")
def filter_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN35: the saved filter that a request names: parameters first, then its file filter."""
    who, kind = F.col("o_custkey").cast("string"), F.col("o_orderstatus")
    parameters = F.when(kind == "F", F.to_json(F.struct(F.concat(F.lit("p"), who).alias("filter_id")))).when(kind == "O", F.to_json(F.struct(F.lit("").alias("filterId"), F.struct(F.concat(F.lit("m"), who).alias("filterId")).alias("_meta"))))
    inputs = F.to_json(F.struct(F.struct(F.concat(F.lit("i"), who).alias("filter_id")).alias("file_filter")))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.filter_id(inputs, parameters).alias("filter_id"))


@query("SELECT event_id::VARCHAR AS uid, event_type AS endpoint, user_id::VARCHAR AS modelUid, NULL::VARCHAR AS caseNotes, CASE WHEN event_id = 5 THEN repeat('k > 1,', 700)[:4000] END AS pipelineMetadataFilterCriteria FROM events")
def job_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FL28, DM13: flat fields of jobs, one of them with its metadata criteria set."""
    jobs = state.job_fields(_event_jobs(spark, sf_dir).withColumnRenamed("userId", "modelUid"))
    changed = state.with_criteria(state.with_criteria(jobs, " 5 ", "k > 1," * 700), " ", "lost")
    return changed.select("uid", "endpoint", "modelUid", "caseNotes", "pipelineMetadataFilterCriteria")


@query("SELECT 'E' AS kind, c_mktsegment AS collection, 1::BIGINT AS n FROM customer WHERE c_acctbal > 0 GROUP BY ALL UNION ALL SELECT 'S', c_mktsegment, count(*) FROM customer WHERE NOT c_acctbal > 0 GROUP BY ALL")
def collection_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG16: collections of single models, and of ensembles without repeats."""
    names = table(spark, sf_dir, "customer").select(scalars.collection_name(F.col("c_mktsegment"), F.lit("retina"), F.lit("arc"), F.col("c_acctbal") > 0).alias("name"))
    return _union([state.collections_of(names, x == "E").groupBy("collection").agg(F.count("*").alias("n")).withColumn("kind", F.lit(x)) for x in "ES"])


@query("SELECT event_type AS tool, count(*) AS calls, count(*) FILTER (WHERE value > 10) AS completed FROM events GROUP BY 1")
def call_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PL8: tool calls with their results or errors, and how many completed."""
    events = table(spark, sf_dir, "events")
    results = events.where("value IS NOT NULL").select(F.col("event_id").alias("call_id"), F.when(F.col("value") > 10, F.col("props")).alias("result"), F.when(F.col("value") <= 10, "too small").alias("error"))
    done = state.call_results(events.select(F.col("event_id").alias("call_id"), F.col("event_type").alias("tool")), results)
    return done.groupBy("tool").agg(F.count("*").alias("calls"), F.count_if("completed").alias("completed"))


@query("""SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN 'closed' ELSE c_mktsegment END AS status, CASE WHEN c_acctbal < -500 THEN 'note' || c_custkey END AS note, 'JOB_' || upper(left(sha256(c_custkey::VARCHAR), 6)) AS uid FROM customer WHERE c_nationkey <> 3
UNION ALL SELECT s_suppkey + 1000000, 'new', NULL, 'JOB_' || upper(left(sha256((s_suppkey + 1000000)::VARCHAR), 6)) FROM supplier WHERE s_nationkey <> 3""")
def state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DM6-DM9: latest non-null changes, unique additions, deletion with what hangs below, ids of new jobs."""
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("status"), F.lit(None).cast("string").alias("note"))
    note = F.when(F.col("c_acctbal") < -500, F.concat(F.lit("note"), F.col("c_custkey").cast("string")))
    poor, none = c.where("c_acctbal < 0"), F.lit(None).cast("string")
    changes = poor.select(F.col("c_custkey").alias("k"), F.lit(1).alias("seq"), F.lit("open").alias("status"), note.alias("note")).unionByName(poor.select(F.col("c_custkey").alias("k"), F.lit(2).alias("seq"), F.lit("closed").alias("status"), none.alias("note")))
    changed = state.apply_changes(rows, changes, "k")
    new = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000000).alias("k"), F.lit("new").alias("status"), none.alias("note"))
    added = state.append_unique(changed, new.unionByName(new).unionByName(changed), "k")
    owner = c.select(F.col("c_custkey").alias("k"), "c_nationkey").unionByName(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000000).alias("k"), F.col("s_nationkey").alias("c_nationkey")))
    kept, _ = state.delete_cascade(added, owner, owner.where("c_nationkey = 3"), "k")
    return state.new_job_ids(kept, F.col("k"))


# --- responses and lineage

@query("""SELECT l_orderkey AS step_job_id, l_linenumber AS n, left('/in/' || l_partkey, 60) AS input_path, '/out/' || l_orderkey || '/' || l_linenumber || '-' || l_partkey AS output_path, CASE l_returnflag WHEN 'R' THEN 'file_pair_rows' WHEN 'A' THEN 'own' ELSE 'batchfile_metadata_pair' END AS kind FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem)""")
def links_of_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NX7-NX9: links of job responses: from batch files' metadata and from pairs in JSON texts."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    one, two = F.concat(F.lit("/in/"), F.col("l_partkey").cast("string")), F.concat_ws("", F.lit("/out/"), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"), F.lit("-"), F.col("l_partkey").cast("string"))
    met = items.repartition("l_orderkey").distinct()  # a job's lines meet once, as numbers
    jobs = met.groupBy("l_orderkey", "l_returnflag").agg(F.sort_array(F.collect_list(F.struct(two.alias("two"), one.alias("one")))).alias("lines"))
    text = lambda pair, name: F.to_json(F.struct(F.lit("text").alias("output_type"), F.to_json(F.struct(F.transform("lines", pair).alias(name))).alias("value")))
    plain = lambda x: F.struct(x["one"].alias("input_path"), F.concat(x["two"], F.lit(" ")).alias("output_path"))
    owned = lambda x: F.struct(x["one"].alias("input_path"), x["two"].alias("output_path"), F.struct(F.lit("own").alias("link_kind")).alias("metadata"))
    batch = F.to_json(F.struct(F.lit("batchfile").alias("output_type"), F.transform("lines", lambda x: F.struct(x["two"].alias("path"), F.struct(x["one"].alias("input_path")).alias("metadata"))).alias("files")))
    response = F.when(F.col("l_returnflag") == "R", text(plain, "file_pair_rows")).when(F.col("l_returnflag") == "A", text(owned, "file_pairs")).otherwise(batch)
    key = F.concat_ws("|", F.col("l_orderkey").cast("string"), "l_returnflag").alias("step_job_id")
    links = lineage.links_of_responses(jobs.select(key, F.lit("scan/files").alias("endpoint"), response.alias("response")))
    found = links.select("step_job_id", "input_path", "output_path", F.element_at("metadata", "link_kind").alias("kind"))
    return found.select(F.split("step_job_id", r"\|")[0].cast("bigint").alias("step_job_id"), F.regexp_extract("output_path", r"/(\d+)-", 1).cast("int").alias("n"), "input_path", "output_path", "kind")


@query("""SELECT p_partkey, CASE WHEN p_size < 10 THEN '/in/' || p_partkey WHEN p_size < 30 THEN '/legacy/' || p_partkey END AS found, CASE WHEN p_size < 10 THEN 1 WHEN p_size < 30 THEN 3 END AS found_in FROM part""")
def inputs_of_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN6-JN8, NX7: input of every output, by normalised paths of the links, then of an older table; upserted first."""
    part = table(spark, sf_dir, "part")
    output = F.concat(F.lit("/out/./"), F.col("p_partkey").cast("string"))
    pair = lambda where, folder: part.where(where).select(F.concat(F.lit(folder), F.col("p_partkey").cast("string")).alias("input_path"), output.alias("output_path"))
    norm = lambda df: df.withColumns({"input_path_norm": scalars.normalised_path(F.col("input_path")), "output_path_norm": scalars.normalised_path(F.col("output_path"))})
    links = lineage.upsert_links(norm(pair("p_size < 10", "/before/")), pair("p_size < 10", "/in/"))
    requests = part.select("p_partkey", F.concat(F.lit("/out//"), F.col("p_partkey").cast("string")).alias("output_path"))
    return lineage.input_of_output(requests, links, norm(pair("p_size < 30", "/legacy/"))).select("p_partkey", "found", F.col("found_in").cast("int").alias("found_in"))


@query("""SELECT p_partkey, CASE WHEN p_size < 25 THEN '/known/' || p_partkey ELSE '/img/' || p_partkey || '.JPG' END AS input_path FROM part""")
def summary_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NX10, FN21: the image of a summary: the recorded pair, else what its name tells."""
    output = F.concat(F.lit("/img/"), F.col("p_partkey").cast("string"), F.lit(".JPG.txt")).alias("output_path")
    part = table(spark, sf_dir, "part")
    pairs = part.where("p_size < 25").select(output, F.concat(F.lit("/known/"), F.col("p_partkey").cast("string")).alias("input_path"))
    return lineage.summary_links(part.select(output), pairs).select(F.regexp_extract("output_path", r"(\d+)", 1).cast("bigint").alias("p_partkey"), "input_path")


@query("SELECT 'steps' AS part, count(*) AS n FROM orders UNION ALL SELECT 'rows', count(*) FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'flat', count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' UNION ALL SELECT 'links', count(DISTINCT '/out/' || l_orderkey || '/' || l_linenumber || l_partkey) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'")
def completed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NX5, NX6, NX11: steps, rows and links after jobs ended; their old rows are replaced."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("step_job_id"), F.col("o_orderstatus").alias("status"))
    blank = F.lit(None).cast("string")
    tables = {
        "steps": orders.select("step_job_id", F.lit("old").alias("endpoint")),
        "rows": orders.select("step_job_id", F.lit("old").alias("container"), F.lit(0).alias("ordinal"), blank.alias("output_type"), blank.alias("payload")),
        "links": orders.limit(0).select("step_job_id", blank.alias("input_path"), blank.alias("output_path"), blank.alias("input_path_norm"), blank.alias("output_path_norm")),
    }
    ended = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(ended, "l_orderkey", "left_semi")
    key = F.col("l_orderkey").cast("string")
    output = F.concat(F.lit("/out/"), key, F.lit("/"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))
    file = F.struct(output.alias("path"), F.struct(F.concat(F.lit("/in/"), F.col("l_partkey").cast("string")).alias("input_path")).alias("metadata"))
    met = lines.repartition("l_orderkey").groupBy("l_orderkey").agg(F.collect_list(file).alias("files"))  # a job's lines meet once, as numbers
    jobs = met.select(key.alias("step_job_id"), F.to_json(F.struct(F.lit("batchfile").alias("output_type"), "files")).alias("response"), F.lit("new").alias("endpoint"))
    after = lineage.record_completion(tables, jobs)
    count = lambda name, df: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    old = F.col("container") == "old"
    of_jobs = after["rows"].groupBy("step_job_id").agg(F.count_if(old).alias("old"), F.count_if(~old).alias("flat"))  # both counts in one pass
    empty_jobs = orders.where("status = 'F'").select("step_job_id").join(jobs.select("step_job_id"), "step_job_id", "left_anti").distinct()
    told = of_jobs.join(empty_jobs.withColumn("empty", F.lit(True)), "step_job_id", "left").agg(F.coalesce(F.sum(F.when(F.col("empty").isNull(), F.col("old"))), F.lit(0)).alias("rows"), F.coalesce(F.sum("flat"), F.lit(0)).alias("flat"))
    counted = told.select(F.inline(F.array(*(F.struct(F.lit(name).alias("part"), F.col(name).alias("n")) for name in ("rows", "flat")))))
    return _union([count("steps", after["steps"]), counted, count("links", after["links"])])


_KINDS = [("1-URGENT", """'{"output_type":"batchtext","transcripts_dir":"/t/' || o_orderkey || '","texts":["a"]}'""", "'/t/' || o_orderkey", "batchtext", "1"), ("2-HIGH", """'{"root":{"output_type":"file","path":"/f/' || o_orderkey || '/x.png"}}'""", "'/f/' || o_orderkey", "file", "1"), ("3-MEDIUM", """'{"files":[{"path":"/b/' || o_orderkey || '/y.png"},{"path":"/z"}]}'""", "'/b/' || o_orderkey", "batchfile", "2"), ("5-LOW", """'{"value":"mounted at /m/' || o_orderkey || '/"}'""", "'/m/' || o_orderkey || '/files'", "text", "1")]
_REST = ("""'{"output_type":"directory","path":"/d/' || o_orderkey || '"}'""", "'/d/' || o_orderkey", "directory", "1")


def _by_kind(k: int) -> str:
    return "CASE o_orderpriority " + " ".join(f"WHEN '{x[0]}' THEN {x[k] if k in (1, 2) else repr(x[k]) if k == 3 else x[k]}" for x in _KINDS) + f" ELSE {_REST[k - 1] if k in (1, 2) else repr(_REST[k - 1]) if k == 3 else _REST[k - 1]} END"


@query(f"SELECT o_orderkey AS step_job_id, {_by_kind(2)} AS output_path, {_by_kind(3)} AS output_type, ({_by_kind(4)})::BIGINT AS items FROM orders")
def output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NX13, PL5, AG17: where a response of each kind wrote to, and its compact summary."""
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("step_job_id"), F.expr(_by_kind(1)).alias("response"))
    summary = nested.response_summary(jobs).select("step_job_id", "output_type", "items")
    return jobs.select("step_job_id", nested.output_path(F.col("response")).alias("output_path")).join(summary, "step_job_id")


@query("""SELECT o_orderkey::VARCHAR AS uid, 'directory' AS part, 'input_dir' AS name, '/d/' || o_custkey AS value FROM orders UNION ALL SELECT o_orderkey::VARCHAR, 'text', 'prompt', o_orderpriority FROM orders UNION ALL SELECT o_orderkey::VARCHAR, 'parameter', 'k', o_custkey::VARCHAR FROM orders
UNION ALL SELECT o_orderkey::VARCHAR, 'payload', 'input_dir', CASE o_orderstatus WHEN 'F' THEN '/own' ELSE '/d/' || o_custkey END FROM orders""")
def request_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN34, NX18: inputs and parameters of requests; the input folder put into summaries that name none."""
    uid, folder = F.col("o_orderkey").cast("string").alias("uid"), F.concat(F.lit("/d/"), F.col("o_custkey").cast("string"))
    orders = table(spark, sf_dir, "orders")
    inputs = F.struct(F.struct(folder.alias("path")).alias("input_dir"), F.struct(F.col("o_orderpriority").alias("text")).alias("prompt"))
    requests = orders.select(uid, F.to_json(F.struct(inputs.alias("inputs"), F.struct(F.col("o_custkey").alias("k")).alias("parameters"))).alias("request"))
    payload = F.when(F.col("o_orderstatus") == "F", '{"input_dir":"/own","n":1}').otherwise('{"n":1}')
    merged = nested.with_input_dir(orders.select(uid, payload.alias("payload")), requests)
    told = merged.select("uid", F.lit("payload").alias("part"), F.lit("input_dir").alias("name"), F.get_json_object("payload", "$.input_dir").alias("value"))
    return nested.request_parts(requests).unionByName(told)


@query("""SELECT doc_id, CASE WHEN length(text) > 16000 THEN left(text, 16000) || '...<trunc ' || length(text) || ' chars>' ELSE text END AS text, least(11 + doc_id % 7, 15) AS depth,
least(390 + doc_id % 20, 400) + CASE WHEN doc_id % 20 > 10 THEN 1 ELSE 0 END AS keys, CASE WHEN doc_id % 20 > 10 THEN doc_id % 20 - 10 END AS more, CASE WHEN doc_id % 100 = 1 THEN 5001 END::BIGINT AS items, CASE WHEN doc_id % 100 = 1 THEN '<truncated ' || (1 + doc_id % 3) || ' list items>' END AS mark FROM documents WHERE text IS NOT NULL""")
def payload_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN22, SO12: payloads of every document cut in depth, text, list and key bounds."""
    bounded_batches(spark)
    n, cut = F.col("doc_id"), nested.cut_payloads()
    steps = (11 + n % 7).cast("int")
    deep = F.concat(F.repeat(F.lit('{"a":'), steps), F.lit("1"), F.repeat(F.lit("}"), steps))
    wide = F.to_json(F.map_from_entries(F.transform(F.sequence(F.lit(1), (390 + n % 20).cast("int")), lambda i: F.struct(i.cast("string").alias("k"), i.alias("v")))))
    listed = F.when(n % 100 == 1, F.to_json(F.sequence(F.lit(1), (5001 + n % 3).cast("int"))))
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    done = docs.select("doc_id", cut(F.to_json(F.struct("text"))).alias("t"), cut(deep).alias("d"), cut(wide).alias("w"), cut(listed).alias("l"))
    items = F.from_json("l", "array<string>")
    return done.select("doc_id", F.from_json("t", "text string")["text"].alias("text"), (F.length("d") - F.length(F.replace("d", F.lit("{"), F.lit("")))).cast("bigint").alias("depth"), F.size(F.json_object_keys("w")).cast("bigint").alias("keys"), F.get_json_object("w", "$._truncated_key_count").cast("bigint").alias("more"), F.when(items.isNotNull(), F.size(items)).cast("bigint").alias("items"), F.element_at(items, -1).alias("mark"))


@query("""SELECT p_partkey, '/img/' || p_partkey || '.png' AS path, p_name || ' by ' || p_brand AS description FROM part WHERE p_size < 40""")
def batch_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN14, FN20: descriptions of images from batch answers of a model, joined by basename."""
    part = table(spark, sf_dir, "part")
    name = F.concat(F.col("p_partkey").cast("string"), F.lit(".png"))
    files = part.select("p_partkey", F.concat(F.lit("/img/"), name).alias("path"))
    said = F.concat("p_name", F.lit(" by "), "p_brand")
    entry = F.when(F.col("p_size") < 20, F.to_json(F.array(F.struct(name.alias("file"), said.alias("description"))))).otherwise(F.to_json(F.array(F.struct(F.concat(F.lit("/x/"), name).alias("filename"), said.alias("text")))))
    answer = F.when(F.col("p_size") < 30, F.concat(F.lit("<think>[]</think>\n```json\n"), entry, F.lit("\n```"))).when(F.col("p_size") < 40, entry).otherwise("no list")
    return texts.batch_descriptions(part.select(answer.alias("answer")), files)


# --- caches, searches, boxes

@query("SELECT 'paths' AS kind, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT 'model', doc_id FROM documents WHERE NOT (lang = 'de' AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))")
def cache_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DM4, DM5: a cache without the rows of some paths, or of some paths and models."""
    cached = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("?")).alias("model"))
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.lit("de").alias("model"))
    return cache.without(cached, gone, ["doc_id"]).select(F.lit("paths").alias("kind"), "doc_id").unionByName(cache.without(cached, gone, ["doc_id", "model"]).select(F.lit("model").alias("kind"), "doc_id"))


@query("SELECT doc_id, length(text)::BIGINT AS chars FROM documents UNION ALL SELECT doc_id + 1000000, length(text) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def embedded_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DM1, ST4: what a cache lacks is computed and added; here the missing rows' ids are raised."""
    docs = table(spark, sf_dir, "documents")
    known = docs.select("doc_id", F.length("text").cast("bigint").alias("chars"))
    lacking = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_anti").select((F.col("doc_id") + 1000000).alias("doc_id"), "text")
    requested = docs.select("doc_id", "text").unionByName(lacking)
    return cache.embed_missing(requested, known, ["doc_id"], lambda df: df.select("doc_id", F.length("text").cast("bigint").alias("chars")))


@query("WITH s AS (SELECT s_suppkey, round(s_acctbal / 1000, 1) AS score, row_number() OVER (ORDER BY round(s_acctbal / 1000, 1) DESC, s_suppkey) AS rank FROM supplier) SELECT s_suppkey, score, rank FROM s WHERE rank <= 20")
def ranked_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO1, SO2, SO10: the best rows by score, ties by a key."""
    return similarity.top_k(table(spark, sf_dir, "supplier").select("s_suppkey", F.round(F.col("s_acctbal") / 1000, 1).alias("score")), 20, "s_suppkey", "score")


@query("""WITH a AS (SELECT p_partkey, p_size / 50 AS s FROM part WHERE p_size > 10), b AS (SELECT p_partkey, (51 - p_size) / 50 AS s FROM part WHERE p_size < 40)
SELECT p_partkey, round((coalesce(0.75 * a.s, 0) + coalesce(0.25 * b.s, 0)) / (CASE WHEN a.s IS NULL THEN 0 ELSE 0.75 END + CASE WHEN b.s IS NULL THEN 0 ELSE 0.25 END), 3) AS score FROM a FULL JOIN b USING (p_partkey)""")
def scorer_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VX9, VX7, JN9: any scorers (key, score) fused by their weights, over those that a key has."""
    part = table(spark, sf_dir, "part")
    scorers = {"size": (part.where("p_size > 10").select("p_partkey", (F.col("p_size") / 50).alias("score")), 3.0), "smallness": (part.where("p_size < 40").select("p_partkey", ((51 - F.col("p_size")) / 50).alias("score")), 1.0)}
    return fusion.fuse(scorers, "p_partkey").select("p_partkey", F.round("score", 3).alias("score"))


@query("SELECT l_orderkey, l_linenumber, x1 - (greatest(w, h) - w) // 2 AS a, y1 - (greatest(w, h) - h) // 2 AS b, greatest(0, x1 - (greatest(w, h) - w) // 2) AS c FROM (SELECT *, l_linenumber AS x1, l_linenumber * 2 AS y1, l_quantity::INTEGER AS w, (l_suppkey % 40 + 1)::INTEGER AS h FROM lineitem)")
def squared_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VX22: boxes grown to squares, clipped to the image where its size is known."""
    x, y = F.col("l_linenumber"), F.col("l_linenumber") * 2
    box = F.array(x, y, x + F.round("l_quantity").cast("int"), y + (F.col("l_suppkey") % 40 + 1).cast("int"))
    free, cut = detections.squared(box), detections.squared(box, F.lit(500), F.lit(500))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", free[0].alias("a"), free[1].alias("b"), cut[0].alias("c"))


#: Greedy suppression of the boxes of an order, step by step in the order of their scores.
_BOXES = "SELECT l_orderkey AS image, l_linenumber AS box_id, l_discount AS score, {x} AS x1, {y} AS y1, {x} + l_quantity AS x2, {y} + l_quantity AS y2, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber) AS rn FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity, max(l_discount) AS l_discount FROM lineitem GROUP BY ALL)".format(x="l_linenumber * 3.0", y="l_linenumber * 2.0")


def suppressed_sql(add: int, pool: int, most: int, boxes: str = _BOXES) -> str:
    side = lambda c: f"greatest(0, least(k.{c}2, b.{c}2) - greatest(k.{c}1, b.{c}1) + {add})"
    area = lambda t: f"({t}.x2 - {t}.x1 + {add}) * ({t}.y2 - {t}.y1 + {add})"
    over = f"{side('x')} * {side('y')} / ({area('k')} + {area('b')} - {side('x')} * {side('y')}) > 0.5"
    return f"""WITH RECURSIVE b AS ({boxes}), s AS (SELECT image, 1 AS rn, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'box_id': box_id}}] AS kept FROM b WHERE rn = 1
UNION ALL SELECT s.image, b.rn::INTEGER, CASE WHEN (SELECT bool_or({over}) FROM (SELECT unnest(s.kept, recursive := true)) k) THEN s.kept ELSE list_append(s.kept, {{'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2, 'box_id': b.box_id}}) END FROM s JOIN b ON b.image = s.image AND b.rn = s.rn + 1 AND b.rn <= {pool})
SELECT image, unnest(list_transform((kept)[:{most}], lambda x: x.box_id)) AS box_id FROM s WHERE rn = (SELECT max(t.rn) FROM s t WHERE t.image = s.image)"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber").cast("double")
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), F.max("l_discount").alias("score"))
    return items.select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("box_id"), (n * 3).alias("x1"), (n * 2).alias("y1"), (n * 3 + F.col("l_quantity")).alias("x2"), (n * 2 + F.col("l_quantity")).alias("y2"), "score")


@query(suppressed_sql(0, 200, 1000))
def suppressed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VX17, VX18: greedy suppression per image."""
    return detections.suppress(_boxes(spark, sf_dir), 0.5).select("image", "box_id")


@query(suppressed_sql(1, 4, 2))
def suppressed_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VX20: suppression that counts pixels, few candidates before and fewer after."""
    return detections.suppress(_boxes(spark, sf_dir), 0.5, candidates=4, inclusive=True, most=2).select("image", "box_id")


@query("SELECT image, list(box_id ORDER BY box_id) AS boxes, count(*) AS n FROM (" + _BOXES + ") GROUP BY 1")
def boxes_per_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG15: detections of an image as one list."""
    listed = detections.per_image(_boxes(spark, sf_dir))
    return listed.select("image", F.transform("detections", lambda d: d["box_id"]).alias("boxes"), F.size("detections").cast("bigint").alias("n"))


@query("""WITH m AS (SELECT p_brand AS image, (p_size % 7)::INTEGER AS x, (p_partkey % 5)::INTEGER AS y FROM part WHERE p_size > 25), g AS (SELECT DISTINCT image, x + dx::INTEGER AS x, y + dy::INTEGER AS y FROM m, range(-1, 2) a(dx), range(-1, 2) b(dy))
SELECT p_partkey, CASE WHEN g.image IS NULL THEN p_size ELSE 0 END AS value FROM part LEFT JOIN g ON g.image = p_brand AND g.x = p_size AND g.y = p_partkey % 5""")
def masked_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VX24: a mask of all labels' pixels above a threshold, grown, and the pixels below it blackened."""
    part = table(spark, sf_dir, "part")
    row = (F.col("p_partkey") % 5).cast("int")
    logits = part.select(F.col("p_brand").alias("image"), F.col("p_type").alias("label"), (F.col("p_size") % 7).alias("x"), row.alias("y"), F.when(F.col("p_size") > 25, 3.0).otherwise(-3.0).alias("logit"))
    pixels = part.select("p_partkey", F.col("p_brand").alias("image"), F.col("p_size").alias("x"), row.alias("y"), F.col("p_size").alias("value"))
    return detections.blackened(pixels, detections.mask_pixels(logits, 0.4, 1), "value").select("p_partkey", "value")


@query("""WITH c AS (SELECT l_orderkey AS image, l_linenumber AS n, max(l_discount) * 10 AS score FROM lineitem GROUP BY 1, 2), f AS (SELECT * FROM c WHERE score > 0.7),
b AS (SELECT *, row_number() OVER (PARTITION BY image, n % 3 ORDER BY score DESC, n) AS rn FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, n) - 1 AS i FROM b WHERE rn = 1)
SELECT image, i::INTEGER AS face_idx, [greatest(0, 80 * (n % 3) + 2)::INTEGER, 2, 80 * (n % 3) + 62, 62] AS box, round(score, 6) AS score, CASE n % 3 WHEN 0 THEN 'left' ELSE 'right' END AS side FROM k
UNION ALL SELECT image, NULL, NULL, NULL, NULL FROM (SELECT DISTINCT l_orderkey AS image FROM lineitem) WHERE image NOT IN (SELECT image FROM f)""")
def faces_of_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UD9, UD14, VX21: none, one or many faces an image from a detector's cells by a table function, with an attribute that
    the call asks for; images are orders, their cells the lines."""
    n = F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg((F.max("l_discount") * 10).alias("score"))
    cell = F.struct("l_linenumber", (40.0 * (n % 3) + 20).alias("cx"), F.lit(16.0).alias("cy"), F.lit(24.0).alias("w"), F.lit(24.0).alias("h"), "score")
    images = lines.groupBy(F.col("l_orderkey").alias("image")).agg(F.array_sort(F.collect_list(cell)).alias("cells"))  # the lines of an order
    frame = F.struct(F.lit(0.5).alias("scale"), F.lit(4.0).alias("pad_w"), F.lit(0.0).alias("pad_h"), F.lit(300).alias("width"), F.lit(200).alias("height"))
    table_ = slots.face_table({"side": ("string", lambda box, frame: "left" if box[0] + box[2] < 100 else "right")})
    found = slots.faces_of(images.withColumn("frame", frame), table_, "side", keep_empty=True)
    return found.select("image", "face_idx", "box", F.round("score", 6).alias("score"), "side")


# --- registry, plans, slots

@query("SELECT p_partkey, p_name AS text FROM part WHERE contains(lower(p_name), 'red') AND p_size >= 10")
def registered_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UD1-UD4, UD18, PL1, PL3, PL4, PL7, FL30: operators by name, checked, and plans of several steps."""
    known = registry.default_registry()
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("path"), F.col("p_name").alias("text"), F.create_map(F.lit("Size"), F.col("p_size").cast("string")).alias("metadata"))
    plan = [{"name": "metadata/filter", "arguments": {"criteria": "size >= 10"}}, {"name": "texts/contain", "arguments": {"term": "RED"}}]
    return known.run(plan, rows, keep_paths=rows.select("path")).select("p_partkey", "text")


@query("SELECT name, place, count(*) AS calls FROM (VALUES ('Cut texts', 1), ('Search texts', 2), ('Filter by metadata', 3), ('Flag matches', 4), ('Search chunks', 5), ('Search images', 6), ('Search image series', 7), ('Find faces', 8), ('Upload faces', 9), ('Delete a collection', 10)) t(name, place) JOIN events ON event_id % 10 + 1 = place GROUP BY 1, 2")
def registry_menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UD4, SO15: operators in menu order, those of hidden groups left out, with how often each was called."""
    listed = [(r.title, k + 1) for k, r in enumerate(registry.default_registry().listing(spark).collect())]
    menu = spark.createDataFrame(listed, "name string, place int")
    calls = table(spark, sf_dir, "events").groupBy((F.col("event_id") % 10 + 1).cast("int").alias("place")).agg(F.count("*").alias("calls"))
    return menu.join(calls, "place").select("name", "place", "calls")


@query("""WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0), s AS (SELECT e.label, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS sim FROM embeddings e, q), b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS rn FROM s), r AS (SELECT *, row_number() OVER (ORDER BY sim DESC, vec_id) AS rank FROM b WHERE rn = 1)
SELECT vec_id, rank, sim >= 0.2 AS is_match FROM r WHERE rank <= 5""")
def registered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UD6, PL7: image search by name with a query vector."""
    vectors = table(spark, sf_dir, "embeddings")
    wanted = list(vectors.where("vec_id = 0").first().embedding)
    rows = vectors.select(F.col("label").alias("path"), "vec_id", F.col("vec_id").alias("chunk_index"), "embedding")
    return registry.default_registry().call("/images", rows, {"query": wanted, "k": 5, "least": 0.2}).select("vec_id", "rank", "is_match")


@query("SELECT n_name AS path, n_name AS name FROM nation UNION ALL SELECT 'head', n_name FROM nation WHERE n_nationkey < 5")
def registered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UD17, SC23, SC24: the file verbs by name."""
    known = registry.default_registry()
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("path"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("n"), F.col("n_name").alias("line"))
    return known.call("fs/ls", rows).select("path", "name").unionByName(known.call("fs/head", rows, {"n": 5}).select(F.lit("head").alias("path"), F.col("line").alias("name")))


@query("SELECT p_partkey, length(p_name)::BIGINT AS length, CASE WHEN length(p_name) > 10 THEN 'long' ELSE 'short' END AS prediction FROM part")
def model_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UD9-UD15: a model slot: any function over batches of rows, its columns checked, with a stand-in for a model."""
    stand_in = slots.Slot("length", "length bigint, prediction string", lambda batch: {"length": [len(x) for x in batch["text"]], "prediction": ["long" if len(x) > 10 else "short" for x in batch["text"]]}, ("text",))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("text"))
    return stand_in.apply(rows).select("p_partkey", "length", "prediction")


@query("SELECT p_partkey, CASE WHEN p_size < 5 THEN 7 ELSE least(200, 10 * p_size - 100) END AS size, CASE WHEN p_size < 5 THEN 1 ELSE least(32, p_size) END AS workers FROM part")
def batch_clamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN36: batch sizes and workers of requests within their bounds; a request without one takes the setting, or 1."""
    asked = lambda value: F.when(F.col("p_size") >= 5, value)
    return table(spark, sf_dir, "part").select("p_partkey", registry.clamped_values(asked(10 * F.col("p_size") - 100), 200, 7).alias("size"), registry.clamped_values(asked(F.col("p_size")), 32).alias("workers"))


@query("SELECT n_name AS text, 0 AS chunk_index, true AS unit FROM nation")
def embedded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UD15, FN1: chunks of texts with unit vectors."""
    docs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("path"), F.col("n_name").alias("text"))
    rows = texts.chunk_table(docs).withColumn("v", embedders.embedder()("chunk_text"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return rows.select(F.col("chunk_text").alias("text"), F.col("chunk_index").cast("int").alias("chunk_index"), (F.abs(length - 1) < 1e-5).alias("unit"))
