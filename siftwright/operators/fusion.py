"""Score fusion and weighted votes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fuse(scores: dict[str, tuple[DataFrame, float]], key: str) -> DataFrame:
    """Weighted mean of scorers (key, score), over the scorers that a key has; sub-scores kept as ``score_<name>``."""
    total = sum(w for _, w in scores.values())
    if total <= 0:
        raise ValueError("the weights of the scorers sum to zero")
    parts = [df.select(key, "score", F.lit(name).alias("scorer"), F.lit(w / total).alias("weight")) for name, (df, w) in scores.items()]
    fused = reduce(DataFrame.unionByName, parts).groupBy(key).agg(
        F.round(F.try_divide(F.sum(F.col("weight") * F.col("score")), F.sum("weight")), 4).alias("score"),
        *(F.max(F.when(F.col("scorer") == name, F.col("score"))).alias(f"score_{name}") for name in scores),
    )
    return fused.where(F.col("score").isNotNull())


def weighted_votes(votes: DataFrame, query: str, match: str, voter: str, weight: str, least: float) -> DataFrame:
    """Sum of voter weights per (query, match) with the sorted voters, where it reaches ``least``."""
    return votes.groupBy(query, match).agg(F.sum(weight).alias("votes"), F.array_sort(F.collect_set(voter)).alias("voters")).where(F.col("votes") >= least)


def run_statistics(votes: DataFrame, query: str, match: str, voter: str) -> DataFrame:
    """Per voter and overall (null): distinct matches and queries with one."""
    return votes.groupBy(query, match, voter).agg(F.lit(1).alias("one")).cube(voter).agg(F.count(match).alias("total_matches"), F.countDistinct(F.when(F.col(match).isNotNull(), F.col(query))).alias("queries_with_matches"))


def majority_vote(votes: DataFrame, item: str, vote: str, weight: str) -> DataFrame:
    """Positive where the weights of positive votes exceed half of the weights present."""
    return votes.groupBy(item).agg((F.sum(F.col(vote).cast("double") * F.col(weight)) > F.sum(weight) / 2).alias("positive"))
