"""A data source that writes one file per row, from the tasks that hold the rows.

``rows.write.format("one_file_a_row").mode("append").option("path", folder).save()`` takes columns ``output_path`` and
``content`` (binary). A task writes each file under a temporary name beside its place and moves it there, so a reader never
sees half a file, and a task that is repeated puts the same bytes there again. Files that exist under that name are replaced,
others stay. Only counts return to the driver; when a job fails, temporary files of its tasks are deleted.

Stores are those of ``pyarrow.fs`` (local and shared folders, HDFS, S3, GCS).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "one_file_a_row"
#: Folders that a task remembers, and files that it writes where rows are dealt to tasks by their number.
KNOWN_FOLDERS = 1000
TASK_FILES = 4000


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote."""

    files: int
    size: int


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path)


def put(path: str, content: bytes, mark: str, known: dict[str, tuple[fs.FileSystem, str]] | None = None) -> None:
    """Write a file under a temporary name and move it to its place. ``known`` keeps the folders that a task has made."""
    known, (above, _, name) = {} if known is None else known, path.rpartition("/")
    if above not in known:
        if len(known) >= KNOWN_FOLDERS:
            known.clear()
        store, place = store_of(path)
        known[above] = store, place.rpartition("/")[0]
        store.create_dir(known[above][1], recursive=True)
    store, folder = known[above]
    place = f"{folder}/{name}"
    staged = f"{folder}/.{mark}.{uuid.uuid4().hex}"
    with store.open_output_stream(staged) as out:
        out.write(content)
    try:
        store.move(staged, place)
    except OSError:  # stores that don't replace on a move
        if store.get_file_info(place).type != fs.FileType.File:
            store.delete_file(staged)
            raise
        store.delete_file(place)
        store.move(staged, place)


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, schema: StructType) -> None:
        if missing := {"output_path", "content"} - set(schema.names):
            raise ValueError(f"rows lack {sorted(missing)}")
        self.folder, self.mark = folder, f"staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, size, known = 0, 0, {}
        for batch in iterator:
            for path, content in zip(batch.column("output_path"), batch.column("content")):
                data = content.as_py() or b""
                put(path.as_py(), data, self.mark, known)
                files, size = files + 1, size + len(data)
        return Written(files, size)

    def commit(self, messages: list[Written | None]) -> None:
        """Every file is in its place already; a task without a message has failed and was repeated."""
        if any(m is None for m in messages):
            raise RuntimeError("a task did not report its files")

    def abort(self, messages: list[Written | None]) -> None:
        """Delete what tasks of this job left under temporary names."""
        store, place = store_of(self.folder)
        for info in store.get_file_info(fs.FileSelector(place, allow_not_found=True, recursive=True)):
            if info.base_name.startswith(f".{self.mark}."):
                store.delete_file(info.path)


class OneFileARow(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("files are replaced one by one: use mode('append')")
        return _Writer(self.options["path"], schema)


def dealt(rows: DataFrame, files: int) -> DataFrame:
    """Rows of (output_path, ...), of which there are ``files``, dealt to tasks by their number: after a join Spark deals them
    by bytes, so that millions of short texts would be written by a few tasks."""
    return rows.repartition(max(1, -(-files // TASK_FILES)), "output_path")


def write_files(rows: DataFrame, folder: str) -> None:
    """Write ``content`` of every row of (output_path, content) to its file below a folder."""
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(OneFileARow)
    rows.select("output_path", "content").write.format(NAME).mode("append").option("path", folder).save()
