"""Embedding caches as versioned tables: what is missing, what moved, what can be copied by content.

Tables are immutable: an update is a new version built by joins. Guards that a sequential program would take from rows
already changed are restated on the set of all rows, with the smallest path winning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.functions import scalars
from siftwright.session import materialise
from siftwright.sources import files

#: Tables of one row a group up to this many rows go to every task.
SEND_AT_MOST = 200_000


def missing(requested: DataFrame, cached: DataFrame, key: list[str]) -> DataFrame:
    """Requested keys without a cached row."""
    return requested.join(cached.select(*key).distinct(), key, "left_anti")


def present(requested: DataFrame, cached: DataFrame, key: list[str]) -> DataFrame:
    """Requested keys with a cached row."""
    return requested.join(cached.select(*key).distinct(), key, "left_semi")


def without(cached: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """The cache without the rows of some keys."""
    return cached.join(gone.select(*key).distinct(), key, "left_anti")


def moves_by_name(requested: DataFrame, cached: DataFrame) -> DataFrame:
    """old_path -> path for requested paths that aren't cached but have a cached file of the same case-folded name.

    A cached path that is requested itself never moves; of several candidates on either side the smallest path is taken,
    and every old path moves once.
    """
    new = missing(requested.select("path").distinct(), cached, ["path"]).withColumn("name", scalars.basename_key(F.col("path")))
    old = cached.select("path").distinct().join(requested.select("path").distinct(), "path", "left_anti").select(F.col("path").alias("old_path"), scalars.basename_key(F.col("path")).alias("name"))
    return _matched(new, old, "name")


def moves_by_content(requested: DataFrame, cached: DataFrame) -> DataFrame:
    """old_path -> path, with action ``relocate`` or ``clone``, for new paths with a cached file of the same SHA-256.

    The first new path of a hash takes over a cached row whose path isn't requested any more; otherwise the row is copied.
    """
    new = missing(requested.select("path", "sha256").where(F.coalesce("sha256", F.lit("")) != "").distinct(), cached, ["path"])
    still = requested.select(F.col("path").alias("old_path")).distinct().withColumn("kept", F.lit(True))
    old = cached.where(F.coalesce("sha256", F.lit("")) != "").select(F.col("path").alias("old_path"), "sha256").distinct().join(still, "old_path", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    # the n-th new path relocates the n-th free row; further ones copy the first row: each new row has one partner
    per = old.groupBy("sha256").agg(F.count_if(~F.col("kept")).alias("free"), F.min(F.struct("kept", "old_path"))["old_path"].alias("first"))
    per = materialise(per.join(new.select("sha256").distinct(), "sha256", "left_semi"))
    send = per.count() <= SEND_AT_MOST
    sent = F.broadcast(per) if send else per
    wanted = _placed(new.join(sent, "sha256"), "sha256", "path")
    free = _placed(old.where("NOT kept").join(sent.select("sha256"), "sha256", "left_semi"), "sha256", "old_path")
    moved = wanted.where("place <= free").select("sha256", "place", "path").join(free.select("sha256", "place", "old_path"), ["sha256", "place"])
    copied = wanted.where("place > free").select("path", F.col("first").alias("old_path"))
    return moved.select("path", "old_path", F.lit("relocate").alias("action")).unionByName(copied.select("path", "old_path", F.lit("clone").alias("action")))


def _placed(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with their place from 1 within their group: sorted over all tasks by group and order, so that a frequent
    group is dealt over many. Where each group begins is sent to every task while the groups are few; more of them are
    joined by key, where a frequent group is split as it meets one row only."""
    numbered = files.numbered(rows, F.col(group), *(F.col(c) for c in order))
    first = numbered.groupBy(group).agg(F.min("ordinal").alias("_first"))
    first = materialise(first)
    first = F.broadcast(first) if first.count() <= SEND_AT_MOST else first
    return numbered.join(first, group).withColumn("place", F.col("ordinal") - F.col("_first") + 1).drop("ordinal", "_first")


def _matched(new: DataFrame, old: DataFrame, on: str) -> DataFrame:
    return _placed(new, on, "path").join(_placed(old, on, "old_path"), [on, "place"]).select("path", "old_path")


def apply_moves(cached: DataFrame, moves: DataFrame) -> DataFrame:
    """The next version of a cache: relocated rows under their new path, copies added, everything else as it was.

    ``moves`` without an ``action`` column are all relocations. All other columns are carried over.
    """
    m = moves if "action" in moves.columns else moves.withColumn("action", F.lit("relocate"))
    moved = cached.withColumnRenamed("path", "old_path").join(m.select("path", "old_path"), "old_path").select(*cached.columns)
    gone = m.where(F.col("action") == "relocate").select(F.col("old_path").alias("path"))
    return without(cached, gone, ["path"]).unionByName(moved)


def move_counts(requested: DataFrame, cached: DataFrame) -> DataFrame:
    """One row: paths to compute anew, relocated and cloned, as ``moves_by_content`` would move them.

    Of each hash's new paths as many are relocated as there are cached rows whose path isn't requested; the rest are cloned.
    Counts per hash tell that, so no row is placed or paired.
    """
    new = missing(requested.select("path", "sha256").distinct(), cached, ["path"])
    kept = requested.select(F.col("path").alias("old_path"), F.lit(True).alias("kept")).distinct()
    old = cached.where(F.coalesce("sha256", F.lit("")) != "").select(F.col("path").alias("old_path"), "sha256").distinct().join(kept, "old_path", "left")
    per = old.groupBy("sha256").agg(F.count_if(F.col("kept").isNull()).alias("free"))
    want = new.groupBy(F.when(F.col("sha256") != "", F.col("sha256")).alias("sha256")).agg(F.count("*").alias("want")).join(per, "sha256", "left")
    relocated = F.least("want", F.coalesce("free", F.lit(0)))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("bigint")
    return want.agg(total(F.when(F.col("free").isNull(), F.col("want"))).alias("new"), total(relocated).alias("relocated"), total(F.when(F.col("free").isNotNull(), F.col("want") - relocated)).alias("cloned"))


def embed_missing(requested: DataFrame, cached: DataFrame, key: list[str], embed) -> DataFrame:
    """The cache with rows for the requested keys that it lacks; ``embed`` maps a DataFrame of them to cache rows."""
    return cached.unionByName(embed(missing(requested, cached, key)).select(*cached.columns))
