"""Progress of streams as a table: a listener writes a row for every batch that any stream of the session ends."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

from siftwright.sources import filewriter

SCHEMA = "run string, name string, batch bigint, at timestamp, input_rows bigint, rows_per_second double, milliseconds bigint, state string, error string"


class ProgressTable(StreamingQueryListener):
    """Writes JSON rows, one file each, below a folder: of batches, and of each run's end."""

    def __init__(self, folder: str) -> None:
        self.folder, self.names = folder.rstrip("/"), {}

    def _put(self, run: str, place: str, **row: object) -> None:
        filewriter.put(f"{self.folder}/{run}_{place}.json", json.dumps({"run": run, "name": self.names.get(run)} | row).encode(), "staged")

    def onQueryStarted(self, event) -> None:
        self.names[str(event.runId)] = event.name

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.names[str(p.runId)] = p.name
        self._put(str(p.runId), f"{p.batchId:012}", batch=p.batchId, at=p.timestamp, input_rows=p.numInputRows, rows_per_second=p.processedRowsPerSecond, milliseconds=p.batchDuration, state="running")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._put(str(event.runId), "end", state="failed" if event.exception else "done", error=event.exception)


@contextmanager
def recorded(spark: SparkSession, folder: str) -> Iterator[ProgressTable]:
    """Record streams that run meanwhile; all events of finished batches are written when it ends."""
    listener = ProgressTable(folder)
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        spark.streams.removeListener(listener)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The recorded rows; empty where nothing was recorded."""
    from siftwright.sources import files

    if not files._exists(spark, folder):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).json(folder)
