"""Job, conversation, case, filter and audit queries, and their state changes as versioned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwright.functions import predicates, scalars


def jobs_of_user(jobs: DataFrame, user: str | None) -> DataFrame:
    """A user's jobs, newest first; none without a user."""
    return jobs.where(F.lit(user is not None) & (F.col("userId") == F.lit(user))).orderBy(F.desc("startTime"), "uid")


def count_jobs(jobs: DataFrame, user: str | None) -> DataFrame:
    """One row ``n``; 0 without a user."""
    return jobs.where(F.lit(bool(user)) & (F.col("userId") == F.lit(user))).agg(F.count("*").alias("n"))


def jobs_of_pipeline(jobs: DataFrame, user: str, root: str) -> DataFrame:
    """Jobs of a pipeline root and the root itself, oldest first."""
    return jobs.where((F.col("userId") == user) & ((F.col("root") == root) | (F.col("uid") == root))).orderBy("startTime", "uid")


def conversations_of_user(conversations: DataFrame, user: str | None) -> DataFrame:
    """Conversations by latest update; all of them without a user."""
    return conversations.where(predicates.visible_to(F.col("userId"), user) if user is not None else F.lit(True)).orderBy(F.desc("updated_at"), "conversation_id")


def message_counts(messages: DataFrame) -> DataFrame:
    """Messages per conversation, derived instead of kept as a counter."""
    return messages.groupBy("conversation_id").agg(F.count("*").alias("message_count"))


def tool_call_history(messages: DataFrame, conversations: DataFrame, user: str | None = None, endpoint: str | None = None, kind: str = "tool_call") -> DataFrame:
    """Messages of a type with their conversation, newest first."""
    chosen = messages.where(F.col("message_type") == kind)
    chosen = chosen if endpoint is None else chosen.where(F.col("tool_call_endpoint") == endpoint)
    owned = conversations if user is None else conversations.where(F.col("userId") == user)
    return chosen.join(owned.select("conversation_id", "title"), "conversation_id").orderBy(F.desc("timestamp"), "message_id")


def adjacent_status(messages: DataFrame) -> DataFrame:
    """Messages of a started job directly followed, in their conversation, by one of the same job completed."""
    w = Window.partitionBy("conversation_id").orderBy("timestamp", "message_id")
    with_next = messages.withColumns({"next_id": F.lead("message_id").over(w), "next_job": F.lead("job_id").over(w), "next_status": F.lead("status").over(w)})
    return with_next.where(F.lower("status").isin("running", "started") & (F.lower("next_status") == "completed") & (F.col("job_id") == F.col("next_job")))


def apply_changes(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with the latest non-null value of every changed column. ``changes`` has the key, ``seq`` and some columns."""
    changed = [c for c in changes.columns if c not in (key, "seq")]
    last = changes.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}") for c in changed))
    joined = rows.join(last, key, "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in changed else F.col(c) for c in rows.columns))


def delete_cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children without the deleted parents."""
    return parents.join(gone.select(key), key, "left_anti"), children.join(gone.select(key), key, "left_anti")


def append_unique(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Stored rows and the new ones whose unique key is free; of new ones with the same key the first row stays."""
    fresh = new.join(stored.select(key), key, "left_anti").dropDuplicates([key])
    return stored.unionByName(fresh.select(*stored.columns))


def new_job_ids(rows: DataFrame, key: Column) -> DataFrame:
    """Rows with a ``uid`` of ``JOB_`` and six hex digits of the key's digest."""
    return rows.withColumn("uid", F.concat(F.lit("JOB_"), F.upper(F.substring(F.sha2(key.cast("string"), 256), 1, 6))))


def filter_paths(filters: DataFrame, filter_id: str, input_dir: str) -> DataFrame:
    """Paths of a saved filter in order: ordinal, path; relative ones below ``input_dir``."""
    listed = filters.where(F.col("id") == filter_id).select(F.posexplode(F.from_json("paths_json", "array<string>")).alias("ordinal", "path"))
    absolute = F.when(F.startswith("path", F.lit("/")), F.col("path")).otherwise(F.concat(F.lit(input_dir.rstrip("/") + "/"), F.col("path")))
    return listed.select("ordinal", absolute.alias("path"))


def filters_of_jobs(jobs: DataFrame, filters: DataFrame) -> DataFrame:
    """Jobs with the saved filter attached to them, if any."""
    return jobs.join(filters.select(F.col("id").alias("filterId"), F.col("name").alias("filter_name"), "filter_type"), "filterId", "left")


def audit_trail(jobs: DataFrame, messages: DataFrame, logs: DataFrame) -> DataFrame:
    """Per job: its messages of the same endpoint (a job without one has none) and its log lines from its start on."""
    called = messages.where(F.col("tool_call_endpoint").isNotNull()).groupBy(F.col("tool_call_endpoint").alias("endpoint")).agg(F.count("message_id").alias("messages"))
    logged = jobs.select("uid", "startTime").join(logs.select(F.col("job_id").alias("uid"), "timestamp"), "uid").where(F.col("timestamp").isNull() | (F.col("timestamp") >= F.col("startTime"))).groupBy("uid").agg(F.count("*").alias("log_lines"))
    out = jobs.join(called, "endpoint", "left").join(logged, "uid", "left")
    return out.select("uid", "endpoint", F.coalesce("messages", F.lit(0)).alias("messages"), F.coalesce("log_lines", F.lit(0)).alias("log_lines"))


def audit_markdown(generated: Column, uid: Column, status: Column) -> Column:
    """An audit trail's heading and job lines."""
    return F.concat_ws("\n", F.lit("# Audit Trail"), F.lit(""), F.concat(F.lit("**Generated:** "), generated.cast("string")), F.lit(""), F.lit("## Job Information"), F.lit(""), F.concat(F.lit("- **Job ID:** `"), uid, F.lit("`")), F.concat(F.lit("- **Status:** "), status))


def log_table(lines: DataFrame, job: str | None = None, start: str | None = None) -> DataFrame:
    """Parsed log lines, unparsable ones dropped: timestamp, level, job_id, message."""
    rows = lines.select(scalars.log_record(F.col("value")).alias("r")).where(F.col("r").isNotNull()).select("r.*")
    rows = rows if job is None else rows.where(F.col("job_id") == job)
    return rows if start is None else rows.where(F.col("timestamp").isNull() | (F.col("timestamp") >= F.lit(start).cast("timestamp")))


def newest_first(rows: DataFrame, created: str, tie: str, owner: str | None = None, column: str = "owner_id") -> DataFrame:
    """Cases or saved filters, newest first; those of one owner where one is named."""
    return (rows.where(F.col(column) == owner) if owner else rows).orderBy(F.desc(created), tie)


#: Fields of a job that others read, in order.
JOB_FIELDS = ("uid", "modelUid", "taskUid", "endpoint", "endpointChain", "pipelineRootJobId", "pipelineMetadataFilterCriteria", "startTime", "endTime", "status", "statusText", "request", "response", "taskSchema", "caseNotes")


def job_fields(jobs: DataFrame) -> DataFrame:
    """The flat fields of jobs; columns that a table of an older form lacks are null."""
    return jobs.select(*(F.col(c) if c in jobs.columns else F.lit(None).cast("string").alias(c) for c in JOB_FIELDS))


def with_criteria(jobs: DataFrame, uid: str, criteria: str, most: int = 4000) -> DataFrame:
    """Jobs with the metadata criteria of one of them set, cut to ``most`` characters; a blank uid changes nothing."""
    return jobs.withColumn("pipelineMetadataFilterCriteria", F.when((F.col("uid") == uid.strip()) & F.lit(uid.strip() != ""), criteria[:most]).otherwise(F.col("pipelineMetadataFilterCriteria")))


def resolved_filters(calls: DataFrame, save: bool = True) -> DataFrame:
    """What filter each tool call (input_filter, output_filter, paths, patterns) ends up with: ``filter_id``, or
    ``composite``: whether one is to be made of its paths and patterns.

    One saved filter counts as it is, as do two equal ones; two different ones make a composite, or leave the input's where
    nothing is saved; without any, given paths or patterns make one.
    """
    one, two = F.col("input_filter"), F.col("output_filter")
    given = (F.size(F.coalesce("paths", F.array().cast("array<string>"))) > 0) | (F.size(F.coalesce("patterns", F.array().cast("array<string>"))) > 0)
    differ = one.isNotNull() & two.isNotNull() & (one != two)
    made = F.lit(save) & (differ | (F.coalesce(one, two).isNull() & given))
    return calls.withColumns({"composite": made, "filter_id": F.when(~made, F.coalesce(one, two))})


def collections_of(names: DataFrame, ensemble: bool, column: str = "name") -> DataFrame:
    """Base names of full collection names ``base_xxS`` or ``base_xxE``: those of ensembles without repeats."""
    chosen = names.where(F.endswith(column, F.lit("E" if ensemble else "S"))).select(F.regexp_replace(column, "_[^_]*$", "").alias("collection"))
    return chosen.distinct() if ensemble else chosen


def call_results(calls: DataFrame, results: DataFrame, key: str = "call_id") -> DataFrame:
    """Tool calls with their result or error, and whether they completed."""
    joined = calls.join(results.select(key, "result", "error"), key, "left")
    return joined.withColumn("completed", F.col("result").isNotNull())
