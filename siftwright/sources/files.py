"""File sources: listings, corpora, bounded text, samples.

Folders are listed by tasks, level by level, so that the driver holds no file's name; contents are read by tasks that the
listing is dealt to by numbers and bytes. Stores are those of ``pyarrow.fs``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwright.functions import scalars
from siftwright.session import materialise
from siftwright.sources.filewriter import store_of

# Suffixes of the kinds of files, and how images begin.
TEXT = (".txt", ".text", ".md", ".log")
IMAGES = (".jpg", ".jpeg", ".png", ".bmp", ".gif", ".tiff")
SERIES_IMAGES = (*IMAGES, ".webp")
FACES = (".jpg", ".jpeg", ".png", ".bmp", ".webp")
PICTURES = (".jpg", ".jpeg", ".png")
AUDIO = (".mp3", ".wav", ".flac", ".aac", ".ogg", ".m4a")
TEXT_CHARS = 50 * 1024 * 1024
#: Rows of a batch of a listing; tasks that list the folders of a level; files and bytes that one task reads, and bytes of a
#: batch.
LISTED_ROWS = 4096
LISTING_TASKS = 64
TASK_FILES = 4000
TASK_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
_MAGIC = {"jpeg": "ffd8ff", "png": "89504e47"}


def listing(spark: SparkSession, folder: str, suffixes: tuple[str, ...] | None = None, recursive: bool = False, case_sensitive: bool = False, content: bool = False, hidden: bool = False) -> DataFrame:
    """Files of a folder: path, name, length, modified, and content on request. Without ``recursive`` only the top level;
    suffixes compare case-folded unless told otherwise. Names that begin with ``.`` or ``_`` are left out, as by Spark's readers, but with ``hidden``.
    A missing folder gives no rows. The folder is listed when rows are asked for; with content or below the top, at once."""
    if not _exists(spark, folder):
        return spark.createDataFrame([], "path string, name string, length bigint, modified timestamp" + (", content binary" if content else ""))
    found = _entries(spark.createDataFrame([(folder,)], "folder string").coalesce(1), hidden)
    if recursive:
        levels = [materialise(found)]
        while n := (below := levels[-1].where("is_dir").select(F.col("path").alias("folder"))).count():
            levels.append(materialise(_entries(below.repartition(min(n, LISTING_TASKS)), hidden)))
        found = levels[0]
        for level in levels[1:]:
            found = found.unionByName(level)
    out = found.where("NOT is_dir").select("path", "name", "length", F.timestamp_micros("modified").alias("modified"))
    if suffixes is not None:
        suffix = F.regexp_extract("name", r"\.[^.]+$", 0)
        out = out.where((suffix if case_sensitive else F.lower(suffix)).isin(*suffixes))
    return _with_content(out) if content else out


def _hidden(name: str) -> bool:
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _listed(folder: str, hidden: bool = False) -> Iterator[tuple[str, str, int | None, int, bool]]:
    """(path, name, length, modified in microseconds, is it a folder) of what lies in a folder, one after another where the
    store allows it."""
    store, place = store_of(folder)
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(place) as entries:
            for e in entries:
                if hidden or not _hidden(e.name):
                    about, is_dir = e.stat(), e.is_dir()
                    yield f"{place.rstrip('/')}/{e.name}", e.name, None if is_dir else about.st_size, about.st_mtime_ns // 1000, is_dir
        return
    scheme = folder[: len(folder) - len(place)] if folder.endswith(place) else ""
    for info in store.get_file_info(fs.FileSelector(place)):
        if hidden or not _hidden(info.base_name):
            yield scheme + info.path, info.base_name, info.size, (info.mtime_ns or 0) // 1000, info.type == fs.FileType.Directory


def _entries(folders: DataFrame, hidden: bool = False) -> DataFrame:
    """path, name, length, modified (microseconds) and is_dir of what lies in folders (folder); a task lists a folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["path", "name", "length", "modified", "is_dir"])
        held = []
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                for row in _listed(folder, hidden):
                    held.append(row)
                    if len(held) >= LISTED_ROWS:
                        yield batch_of(held)
                        held = []
        if held:
            yield batch_of(held)

    return folders.mapInArrow(run, "path string, name string, length bigint, modified bigint, is_dir boolean")


def dealt(found: DataFrame, sized: bool = True, task_files: int | None = None) -> DataFrame:
    """A listing dealt to tasks by the number of files and, where they will be read whole, by their bytes."""
    found = materialise(found)
    size = found.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    return found.repartition(max(1, -(-size.n // (task_files or TASK_FILES)), -(-size.bytes // TASK_BYTES) if sized else 1))


def _with_content(found: DataFrame) -> DataFrame:
    """A listing with the files' content, in tasks of bounded numbers and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, size = 0, [], 0
            for i, path in enumerate(batch.column("path").to_pylist()):
                store, place = store_of(path)
                with store.open_input_file(place) as file:
                    held.append(file.read())
                size += len(held[-1])
                if size >= BATCH_BYTES or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*batch.slice(first, len(held)).columns, pa.array(held, pa.binary())], names=[*batch.schema.names, "content"])
                    first, held, size = i + 1, [], 0

    return dealt(found).mapInArrow(run, "path string, name string, length bigint, modified timestamp, content binary")


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def require_files(files: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """The listing itself, or ValueError where it holds no file with one of the suffixes."""
    if not files.where(scalars.extension(F.col("path")).isin(*suffixes)).take(1):
        raise ValueError(f"no file with a suffix of {', '.join(suffixes)}")
    return files


def corpus(scan: DataFrame, chosen: DataFrame | None) -> DataFrame:
    """Files of a scan, or those of a filter (ordinal, path) that exist, in the filter's order: ordinal, path.

    Without a filter the scan counts, by path; a filter without rows gives no rows and never falls back to the scan.
    """
    if chosen is None:
        return numbered(scan.select("path"), F.col("path")).withColumn("ordinal", F.col("ordinal") + 1)
    return chosen.join(scan.select("path"), "path", "left_semi").select("ordinal", "path")


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with their place from 0 in an order of all of them (``ordinal``): sorted by ranges, numbered within each
    range after the rows of the ranges before it."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(placed.withColumn("_part", F.shiftright("_at", 33)))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n")).collect()  # one row a partition
    before, total = [], 0
    for r in sorted(sizes, key=lambda r: r["_part"]):
        before.append((r["_part"], total))
        total += r["_n"]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "_part bigint, _before bigint"))
    ordinal = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(offsets, "_part").withColumn("ordinal", ordinal).select(*rows.columns, "ordinal")


def corpus_size(files: DataFrame) -> int:
    """Number of files; ValueError for a filter that leaves none."""
    n = files.count()
    if not n:
        raise ValueError("the filter names no existing file")
    return n


def ordered_images(scan: DataFrame, chosen: DataFrame | None, suffixes: tuple[str, ...] = SERIES_IMAGES) -> DataFrame:
    """Images in processing order: a filter's files, first mention only, or all by case-folded name."""
    images = scan.where(scalars.extension(F.col("path")).isin(*suffixes))
    if chosen is None:
        return numbered(images.select(F.lower("name").alias("_n"), "path"), F.col("_n"), F.col("path")).select((F.col("ordinal") + 1).alias("ordinal"), "path")
    first = chosen.groupBy("path").agg(F.min("ordinal").alias("ordinal"))
    return first.join(images.select("path"), "path", "left_semi").select("ordinal", "path")


def sorted_files(scan: DataFrame, suffixes: tuple[str, ...] = FACES) -> DataFrame:
    """Files with one of the suffixes in the order of their paths: ordinal from 1, path."""
    chosen = scan.where(scalars.extension(F.col("path")).isin(*suffixes)).select("path")
    return numbered(chosen, F.col("path")).select((F.col("ordinal") + 1).alias("ordinal"), "path")


def largest_first(scan: DataFrame) -> DataFrame:
    """Files with their place (from 1) by falling size, ties by path: long work begins first."""
    return numbered(scan, F.col("length").desc(), F.col("path")).withColumn("ordinal", F.col("ordinal") + 1)


def inside(files: DataFrame, folder: str, suffixes: tuple[str, ...]) -> DataFrame:
    """Files below a folder, with one of the suffixes."""
    return files.where(F.startswith("path", F.lit(folder.rstrip("/") + "/")) & scalars.extension(F.col("path")).isin(*suffixes))


def decoded_images(files: DataFrame) -> DataFrame:
    """Files whose content begins like a JPEG or PNG image."""
    head = F.lower(F.hex(F.substring("content", 1, 4)))
    return files.where(F.startswith(head, F.lit(_MAGIC["jpeg"])) | (head == _MAGIC["png"]))


def texts(files: DataFrame, most: int = TEXT_CHARS) -> DataFrame:
    """path and text of files with content: UTF-8, at most ``most`` characters; undecodable bytes are dropped."""
    whole = F.col("content").cast("string")
    dropped = F.replace(F.make_valid_utf8(whole), F.lit("\ufffd"), F.lit(""))
    text = F.when(F.is_valid_utf8(whole), whole).otherwise(dropped)
    return files.select("path", F.coalesce(F.substring(text, 1, most), F.lit("")).alias("text"))


def labelled_images(scan: DataFrame) -> DataFrame:
    """Images with ``is_real``: 1 where the path holds ``R_``."""
    return scan.where(scalars.extension(F.col("path")).isin(*PICTURES)).withColumn("is_real", F.contains("path", F.lit("R_")).cast("int"))


def labelled_sample(scan: DataFrame, source: str, most: int) -> DataFrame:
    """At most ``most`` files of every source by path, renamed with the source as prefix: source, path, new_name."""
    ranked = scan.withColumn("_rn", F.row_number().over(Window.partitionBy(source).orderBy("path"))).where(F.col("_rn") <= most)
    return ranked.select(F.col(source).alias("source"), "path", F.concat(F.col(source), F.lit("_"), "name").alias("new_name"))


def evaluation_files(metadata: DataFrame, most: int) -> DataFrame:
    """Test-split files that aren't webp, prefixed R_ or F_ by their ground truth, the first ``most`` by name."""
    chosen = metadata.where((F.col("split") == "Test") & (scalars.extension(F.col("filename")) != ".webp"))
    prefix = F.when(F.lower("ground_truth") == "real", "R_").otherwise("F_")
    return chosen.select("filename", F.concat(prefix, "filename").alias("new_name")).orderBy("filename").limit(most)


def browse(entries: DataFrame, suffixes: tuple[str, ...] | None = None) -> DataFrame:
    """Directory entries (name, is_dir): directories first, then by case-folded name; files filtered by suffix."""
    shown = entries if suffixes is None else entries.where(F.col("is_dir") | scalars.extension(F.col("name")).isin(*suffixes))
    return numbered(shown, ~F.col("is_dir"), F.lower("name"), F.col("name")).withColumn("ordinal", F.col("ordinal") + 1)


def forensics(files: DataFrame) -> DataFrame:
    """path, size, modified, mime and SHA-256 of files with content."""
    # Media types by suffix.
    types = {".txt": "text/plain", ".md": "text/markdown", ".log": "text/plain", ".json": "application/json", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".pdf": "application/pdf", ".mp3": "audio/mpeg", ".wav": "audio/x-wav", ".mp4": "video/mp4"}
    table = F.create_map(*(F.lit(x) for kv in types.items() for x in kv))
    return files.select("path", F.col("length").alias("size"), "modified", F.try_element_at(table, scalars.extension(F.col("path"))).alias("mime"), F.sha2("content", 256).alias("sha256"))


def prompts(spark: SparkSession, attributes: dict[str, list[str]], n: int, seed: int = 42) -> DataFrame:
    """n rows of one random value of every attribute, repeatable by seed: id and the attributes."""
    pick = lambda k, name, values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(F.lit(seed), F.lit(name), "id"), F.lit(len(values))) + 1).cast("int")).alias(name)
    return spark.range(n).select("id", *(pick(k, name, values) for k, (name, values) in enumerate(attributes.items())))
