"""Incremental embedding as Structured Streaming: new files since the last run are embedded and appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from siftwright.functions import embedders, texts
from siftwright.operators import cache

LISTING_TASKS = 64


def new_texts(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (path, text), one row per new file."""
    return spark.readStream.format("text").option("wholetext", "true").load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def embed_stream(spark: SparkSession, folder: str, table: str, checkpoint: str, size: int = 300, overlap: int = 60) -> StreamingQuery:
    """Embed the chunks of new files into a Parquet table; paths that it holds are skipped, so a replayed batch adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        try:
            stored = spark.read.parquet(table).select("path")
        except Exception as error:  # the table begins with the first batch
            if "PATH_NOT_FOUND" not in str(error):
                raise
            stored = None
        fresh = batch if stored is None else cache.missing(batch, stored, ["path"])  # before texts are cut
        texts.chunk_table(fresh, size, overlap).withColumn("embedding", embedders.embedder()("chunk_text")).write.mode("append").parquet(table)

    # a batch asks for the state of each of its files: in this session by so many tasks, not by one a file
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(LISTING_TASKS))
    return new_texts(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def json_lines(rows: DataFrame) -> DataFrame:
    """Rows as JSON lines (``value``), made by the tasks that hold them."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def response_lines(rows: DataFrame):
    """Rows as JSON lines, one at a time and without gathering them: what a line-streaming response sends."""
    return (r.value for r in json_lines(rows).toLocalIterator())


def append_lines(spark: SparkSession, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """Append the lines of new files to a Parquet table, each file once, however often the stream runs."""
    lines = spark.readStream.format("text").load(folder).withColumnRenamed("value", "line")
    return lines.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
