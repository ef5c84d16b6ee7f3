"""Sinks: appended tables, upserts, CSV and text exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwright.functions import scalars
from siftwright.operators import grouping
from siftwright.sources import filewriter


def append(rows: DataFrame, path: str) -> None:
    """Add rows to a Parquet table; new columns are merged when it is read with mergeSchema."""
    rows.write.mode("append").parquet(path)


def discard(rows: DataFrame) -> None:
    """Compute rows and keep nothing."""
    rows.write.format("noop").mode("overwrite").save()


def replace_all(rows: DataFrame, path: str) -> None:
    """Overwrite a cache table."""
    rows.write.mode("overwrite").parquet(path)


def csv(rows: DataFrame, path: str) -> None:
    """CSV files with a header."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def next_gallery(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Face gallery after an upload: rows keyed by (scope, collection_name, face_id), the upload's last row wins."""
    key = ["scope", "collection_name", "face_id"]
    ranked = new.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("image_path"))))
    return grouping.upsert(stored, ranked.where("_rn = 1").select(*stored.columns), key)


def text_outputs(rows: DataFrame, folder: str, whole_name: bool = True, below: Column | None = None) -> DataFrame:
    """input_path, output_path and text of per-file results: ``<name>.txt`` or ``<stem>.txt`` in a folder, or in the one that
    ``below`` names in it: tasks that write to the same folder wait for one another."""
    name = scalars.basename(F.col("path"))
    stem = name if whole_name else F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")
    return rows.select(F.col("path").alias("input_path"), F.concat(F.lit(folder.rstrip("/") + "/"), *([] if below is None else [below, F.lit("/")]), stem, F.lit(".txt")).alias("output_path"), "text")


def jsonld(documents: DataFrame, path: str) -> None:
    """JSON-LD documents of jobs as lines of few files, a job a line."""
    documents.select(F.col("jsonld").alias("value")).write.mode("overwrite").text(path)


def jsonld_files(documents: DataFrame, folder: str) -> None:
    """One JSON-LD file a job, named by the job."""
    place = F.concat(F.lit(folder.rstrip("/") + "/"), F.regexp_replace("uid", "[/\\\\]", "_"), F.lit(".jsonld"))
    filewriter.write_files(documents.select(place.alias("output_path"), F.col("jsonld").cast("binary").alias("content")), folder)


def fallback_folder(input_dir: str, writable: bool, scratch: str) -> str:
    """Output folder: below the input when it can be written to, else a folder of the scratch space named by its hash."""
    import hashlib

    return f"{input_dir.rstrip('/')}/transcripts" if writable else f"{scratch.rstrip('/')}/{hashlib.sha256(input_dir.encode()).hexdigest()[:16]}"


def told_apart(outputs: DataFrame) -> DataFrame:
    """(input_path, output_path, text) with an output path of its own for every text.

    Of the inputs that would share a file the one with the smallest path keeps it; the others get 16 digits of the SHA-256 of
    their path and text before the suffix. Equal texts of the same input share their file; a null text is empty.
    """
    rows = outputs.select("input_path", "output_path", F.coalesce("text", F.lit("")).alias("text")).withColumn("_id", F.sha2(F.concat_ws("\n", "input_path", "text"), 256))
    first = rows.groupBy("output_path").agg(F.min(F.struct(F.coalesce("input_path", F.lit("")), "_id")).alias("_first"))
    own = F.struct(F.coalesce("input_path", F.lit("")), "_id") == F.col("_first")
    place = F.when(own, F.col("output_path")).otherwise(F.concat(F.regexp_replace("output_path", r"\.txt$", ""), F.lit("."), F.left("_id", F.lit(16)), F.lit(".txt")))
    return rows.join(first, "output_path").select("input_path", place.alias("output_path"), "text")


def write_texts(outputs: DataFrame, folder: str) -> None:
    """Write every text of (input_path, output_path, text) to a file of its own below a folder, replacing files of that name."""
    rows = filewriter.dealt(told_apart(outputs), outputs.count())
    filewriter.write_files(rows.select("output_path", F.col("text").cast("binary").alias("content")), folder)
