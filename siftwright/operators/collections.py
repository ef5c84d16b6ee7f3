"""Named collections of vectors: uploads, deletion, and what they hold.

A collection is a set of rows (collection, path, embedding); an upload changes only the collections that it names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.functions import scalars
from siftwright.operators import grouping

KEY = ["collection", "path"]


def named(rows: DataFrame, detector: str, model: str, ensemble: bool = False) -> DataFrame:
    """``rows`` with the full name of their collection."""
    full = scalars.collection_name(F.col("collection"), F.lit(detector), F.lit(model), F.lit(ensemble))
    return rows.withColumn("collection", full)


def upload(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The collections after an upload: a path that is there already gets its new vector, others are added. Rows without a
    vector, as of images without a face, are left out; of several rows of a path the largest vector counts."""
    known = new.where(F.col("embedding").isNotNull())
    once = known.groupBy(*KEY).agg(F.max("embedding").alias("embedding"))
    return grouping.upsert(stored.select(*KEY, "embedding"), once, KEY)


def delete(stored: DataFrame, names: list[str]) -> DataFrame:
    """The collections without the named ones; names that aren't there change nothing."""
    return stored.where(~F.col("collection").isin(*names)) if names else stored


def summary(stored: DataFrame) -> DataFrame:
    """collection, number of paths and of components of a vector, by collection."""
    return stored.groupBy("collection").agg(F.count("*").alias("paths"), F.max(F.size("embedding")).alias("dimensions"))
