"""Scalar functions over paths, names, statuses and texts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status words, suffixes, levels and the form of log lines.
SUCCESS = ("completed", "success", "succeeded")
FAIL = ("failed", "error")
ONGOING = ("running", "pending", "queued")
RASTER = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".tif", ".tiff")
LOG_LEVELS = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}
LOG_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) \| (\w+)\s*\| (.*?) \| (\S+) \| (.+)"


def truncate(text: Column, most: int) -> Column:
    """Trimmed text, cut to ``most`` characters and ``...`` when longer."""
    t = F.trim(text)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)


def preview(text: Column, over: int = 280, keep: int = 277) -> Column:
    """Text cut to ``keep`` characters and an ellipsis when it has more than ``over``."""
    return F.when(F.length(text) > over, F.concat(F.substring(text, 1, keep), F.lit("…"))).otherwise(text)


def title(text: Column, most: int = 50) -> Column:
    """The first characters of a message as a title."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def basename(path: Column) -> Column:
    """The part after the last slash or backslash."""
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def basename_key(path: Column) -> Column:
    """Case-folded basename."""
    return F.lower(basename(path))


def parent(path: Column) -> Column:
    """The directory of a path."""
    return F.regexp_replace(F.regexp_replace(path, r"/+$", ""), r"/[^/]*$", "")


def extension(path: Column) -> Column:
    """The lower-cased suffix with its dot, empty without one; a leading dot is no suffix."""
    return F.lower(F.regexp_extract(basename(path), r"(?<=.)\.[^.]+$", 0))


def host_path(path: Column) -> Column:
    """Trimmed path without the extended-length prefix."""
    return F.regexp_replace(F.trim(path), r"^\\\\\?\\", "")


def normalised_path(path: Column) -> Column:
    """Slashes for backslashes, no doubled or trailing slash, ``.`` and resolvable ``..`` steps taken out."""
    parts = F.filter(F.split(F.replace(host_path(path), F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    done = F.startswith(path, F.lit("/")) & ~path.rlike(r"\\|/\.{0,2}(?:/|\z)| \z")  # most paths are; steps cost much more
    return F.when(done, path).otherwise(F.concat(F.lit("/"), F.array_join(walked, "/")))


def segment(text: Column) -> Column:
    """A file-name segment: letters, digits, ``-_.``; the rest becomes ``_``, nothing becomes ``unknown``."""
    s = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\-_.]", "_")
    return F.when(s == "", "unknown").otherwise(s)


def user_scope(user: Column) -> Column:
    """``u_`` and 16 hex digits of the id's SHA-256."""
    return F.concat(F.lit("u_"), F.substring(F.sha2(user.cast("string"), 256), 1, 16))


def demo_scope(path: Column) -> Column:
    """The demo folder of a path, null without one."""
    found = F.regexp_extract(path, r"(?i)[/\\]Documents[/\\](demo[0-9]+)([/\\]|$)", 1)
    return F.when(found != "", F.lower(found))


def collection_name(base: Column, detector: Column, model: Column, ensemble: Column) -> Column:
    """``{base}_{de}{mo}{S|E}``."""
    return F.concat(base, F.lit("_"), F.substring(detector, 1, 2), F.substring(model, 1, 2), F.when(ensemble, "E").otherwise("S"))


def node_id(path: Column, prefix: str) -> Column:
    """Deterministic graph node id."""
    return F.concat(F.lit(f"kb:{prefix}-"), F.substring(F.sha2(path, 256), 1, 16))


def endpoint_slug(endpoint: Column) -> Column:
    """Slashes and spaces to underscores, 120 characters at most."""
    e = F.when(F.coalesce(endpoint, F.lit("")) == "", "unknown").otherwise(endpoint)
    return F.substring(F.translate(e, "/ ", "__"), 1, 120)


def action_status(status: Column) -> Column:
    """Success, Fail, Ongoing or Unknown."""
    s = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    return F.when(s.isin(*SUCCESS), "Success").when(s.isin(*FAIL), "Fail").when(s.isin(*ONGOING), "Ongoing").otherwise("Unknown")


def job_status(status: Column) -> Column:
    """One of the four job statuses; unknown values count as running."""
    s = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    return F.when(s == "completed", "Completed").when(s == "failed", "Failed").when(s == "canceled", "Canceled").otherwise("Running")


def iso_time(text: Column) -> Column:
    """Timestamp of an ISO string, null where it is none."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def is_raster(path: Column) -> Column:
    """Whether a path has the suffix of a raster image."""
    return extension(path).isin(*RASTER)


def ground_truth_name(name: Column) -> Column:
    """The identity in ``name_12.jpg``, null for other names."""
    found = F.regexp_extract(name, r"^(.+?)_\d+\.jpg", 1)
    return F.when(found != "", found)


def is_correct_match(names: Column, truth: Column, n: int) -> Column:
    """Whether the first ``n`` names hold the truth."""
    return F.array_contains(F.slice(names, 1, n), truth)


def after_think(text: Column) -> Column:
    """Trimmed text after the first closing think tag, or all of it."""
    at = F.locate("</think>", text)
    return F.trim(F.when(at > 0, F.substr(text, at + 8)).otherwise(text))


def source_image(summary_path: Column) -> Column:
    """The image that a ``<image>.txt`` summary belongs to, null for other names."""
    name = F.regexp_replace(summary_path, r"\.txt$", "")
    return F.when(summary_path.endswith(".txt") & is_raster(name), name)


def integer_box(text: Column) -> Column:
    """Four non-negative integers of a printed box, else null."""
    box = F.from_json(text, "array<double>")
    return F.when((F.size(box) == 4) & F.forall(box, lambda x: x.isNotNull() & (x >= 0)), F.transform(box, lambda x: x.cast("int")))


def chain_list(text: Column) -> Column:
    """An endpoint chain from its JSON text, null where that is no list."""
    return F.from_json(text, "array<string>")


def results_title(chain: Column, endpoint: Column) -> Column:
    """``Results for: a → b``, in order and without repeats."""
    steps = F.array_distinct(F.filter(F.concat(F.coalesce(chain, F.array().cast("array<string>")), F.array(endpoint)), lambda x: x.isNotNull() & (F.trim(x) != "")))
    return F.when(F.size(steps) > 0, F.concat(F.lit("Results for: "), F.array_join(steps, " → "))).otherwise("Results")


def pipeline_endpoints(chain: Column, endpoint: Column) -> Column:
    """Ordered distinct endpoints of a chain and its last step; ``unknown`` for none."""
    steps = F.array_distinct(F.filter(F.transform(F.concat(F.coalesce(chain, F.array().cast("array<string>")), F.array(endpoint)), F.trim), lambda x: x.isNotNull() & (x != "")))
    return F.when(F.size(steps) > 0, steps).otherwise(F.array(F.lit("unknown")))


def protocol_tag(labels: Column) -> Column:
    """Privacy protocol of a set of labels."""
    return F.concat(F.lit("clipseg-blackout-v1:"), F.array_join(F.array_sort(labels), ","))


def progress_label(percent: Column) -> Column:
    """What a progress bar says."""
    return F.when(percent.isNull(), "Running").when(percent >= 100, "Done").otherwise(F.concat(F.format_number(percent, 0), F.lit("%")))


def percent_done(done: Column, total: Column) -> Column:
    """min(95, floor(100 * done / total)); 0 without a total."""
    return F.when(total > 0, F.least(F.lit(95), F.floor(100 * done / total))).otherwise(0).cast("bigint")


def log_record(line: Column) -> Column:
    """struct<timestamp, level, job_id, message> of a log line; null where it has no such form."""
    part = lambda i: F.regexp_extract(line, LOG_LINE, i)
    job = F.regexp_extract(part(3), r"job_id=([^\s|]+)", 1)
    record = F.struct(F.try_to_timestamp(part(1), F.lit("yyyy-MM-dd HH:mm:ss")).alias("timestamp"), part(2).alias("level"), F.when(job != "", job).alias("job_id"), part(5).alias("message"))
    return F.when(line.rlike(LOG_LINE), record)


def log_level(name: Column) -> Column:
    """Number of a level name; unknown names count as INFO."""
    levels = F.create_map(*(F.lit(x) for kv in LOG_LEVELS.items() for x in kv))
    return F.coalesce(F.try_element_at(levels, F.upper(F.trim(name))), F.lit(LOG_LEVELS["INFO"]))


def search_query(model: Column, query: Column) -> Column:
    """Query text in the form that the embedding model expects."""
    wrapped = F.concat(F.lit("Instruct: Given a search query, retrieve relevant passages\nQuery: "), query)
    return F.when(F.contains(F.lower(model), F.lit("qwen")), wrapped).otherwise(F.concat(F.lit("query: "), query))


def probability_band(p: Column) -> Column:
    """Four bands of a probability of being real."""
    return F.when(p < 0.4, "likely fake").when(p < 0.6, "uncertain").when(p < 0.8, "weakly real").otherwise("likely real")


def sigmoid(x: Column) -> Column:
    """Logistic function."""
    return 1 / (1 + F.exp(-x))


def softmax_band(real: Column, fake: Column) -> Column:
    """struct<prediction, confidence> from two logits."""
    p = F.greatest(sigmoid(real - fake), sigmoid(fake - real))
    side = F.when(real > fake, "real").otherwise("fake")
    label = F.when(p > 0.8, F.concat(F.lit("likely "), side)).when(p > 0.6, F.concat(F.lit("weakly "), side)).otherwise("uncertain")
    return F.struct(label.alias("prediction"), p.alias("confidence"))


def file_fingerprint(length: Column, modified: Column) -> Column:
    """Cheap fingerprint of a file from its size and modification time (Spark's file source has no creation time)."""
    return F.sha1(F.concat_ws("-", length.cast("string"), F.unix_timestamp(modified).cast("string")))


def filter_id(request: Column, parameters: Column) -> Column:
    """The saved filter that a job's parameters (``filterId``, ``filter_id``, ``_meta.filterId``) or else its ``file_filter``
    input name; both are JSON texts."""
    p, i = F.try_parse_json(parameters), F.try_parse_json(request)
    named = [F.try_variant_get(v, path, "string") for v, path in ((p, "$.filterId"), (p, "$.filter_id"), (p, "$._meta.filterId"), (i, "$.file_filter.filter_id"))]
    return F.coalesce(*(F.when(x != "", x) for x in named))
