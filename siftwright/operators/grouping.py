"""Grouping operators: content-hash groups, pipelines of jobs, adjacent pairs, latest versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_groups(files: DataFrame, hash_column: str, key: str) -> DataFrame:
    """Per non-empty hash: its representative (smallest key) and number of members."""
    return files.where(F.coalesce(F.col(hash_column), F.lit("")) != "").groupBy(hash_column).agg(F.min(key).alias("representative"), F.count("*").alias("members"))


def clone_to_members(unique: DataFrame, files: DataFrame, hash_column: str) -> DataFrame:
    """Spread what was computed once per hash over all files of the hash."""
    return files.join(unique, hash_column)


def pipelines(jobs: DataFrame, uid: str = "uid", root: str = "root", start: str = "start") -> DataFrame:
    """Jobs with their pipeline: jobs of a root form a group, the root job itself joins it, others stand alone.

    Adds ``pipeline``, ``group_start`` (latest start of the group, for newest-first order) and ``member`` (from 1, by start).
    """
    roots = jobs.where(F.col(root).isNotNull()).select(F.col(root).alias("_root")).distinct()
    joined = jobs.join(roots, jobs[uid] == roots["_root"], "left").withColumn("pipeline", F.coalesce(F.col(root), "_root", F.col(uid))).drop("_root")
    w = Window.partitionBy("pipeline")
    return joined.withColumn("group_start", F.max(start).over(w)).withColumn("member", F.row_number().over(w.orderBy(start, uid)).cast("bigint"))


def adjacent_pairs(rows: DataFrame, group: str, order: str, first: Column, second: Column) -> DataFrame:
    """Rows for which ``first`` holds and whose follower in the group fulfils ``second`` (over the columns of ``next``)."""
    follower = F.lead(F.struct(*(c for c in rows.columns if c != group))).over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("next", follower).where(first & F.coalesce(second, F.lit(False)))


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The latest version of every key: upsert by union and latest-wins."""
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order))))
    return ranked.where("_rn = 1").drop("_rn")


def upsert(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows replaced by new ones of the same key, and the other new ones."""
    return stored.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def replace_snapshot(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """All stored rows of a key go when new rows of that key exist; no new rows, no change."""
    return upsert(stored, new, key)


def set_equal(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row ``equal``: whether two key sets are the same and not empty."""
    both = a.select(key).distinct().withColumn("in_a", F.lit(1)).join(b.select(key).distinct().withColumn("in_b", F.lit(1)), key, "full_outer")
    return both.agg(F.coalesce(F.bool_and(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()), F.lit(False)).alias("equal"))


def union_if_absent(corpus: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """The corpus and those extra rows whose key it lacks."""
    return corpus.unionByName(extra.join(corpus.select(key), key, "left_anti").select(*corpus.columns))


def limited(rows: DataFrame, group: list[str], order: str, most: int) -> DataFrame:
    """The first ``most`` rows of every group (a documented cap of response flattening)."""
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(order)))
    return ranked.where(F.col("_rn") <= most).drop("_rn")


def first_of(requests: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row by an order for every request's key, one per distinct request; requests that find nothing have none."""
    others = [c for c in rows.columns if c != key]
    found = rows.join(requests.select(key), key, "left_semi").groupBy(key).agg(F.min_by(F.struct(*others), order).alias("_first"))
    return found.select(key, "_first.*")


def menu_order(models: DataFrame, ranks: DataFrame, uid: str = "uid") -> DataFrame:
    """Plugins by menu rank, unknown ones last, then by uid."""
    return models.join(ranks, uid, "left").orderBy(F.coalesce("rank", F.lit(10000)), uid)
