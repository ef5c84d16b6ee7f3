"""Retrieval evaluation: confusion counts and rates, per threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(rows: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """tp, fp, tn, fn and accuracy, precision, recall, f1, tpr, fpr; 0 on empty denominators."""
    t, p = F.col(truth), F.col(predicted)
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")
    base = rows.groupBy(*(by or [])).agg(count(t & p).alias("tp"), count(~t & p).alias("fp"), count(~t & ~p).alias("tn"), count(t & ~p).alias("fn"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return base.withColumns({"accuracy": rate(tp + tn, tp + fp + tn + fn), "precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "f1": rate(2 * tp, 2 * tp + fp + fn), "tpr": rate(tp, tp + fn), "fpr": rate(fp, fp + tn)})


def threshold_sweep(queries: DataFrame, hits: DataFrame, low: float = 0.40, high: float = 0.78, step: float = 0.02) -> DataFrame:
    """Confusion per threshold: a query (query, truth) is positive when it has a hit at or above the threshold.

    The best hit of each query decides, so a threshold is a comparison, not a regrouping of the hits.
    """
    best = hits.groupBy("query").agg(F.max("similarity").alias("best"))
    many = round((high - low) / step) + 1
    grid = F.transform(F.sequence(F.lit(0), F.lit(many - 1)), lambda i: F.round(F.lit(low) + i * step, 2))
    rows = queries.join(best, "query", "left").withColumn("threshold", F.explode(grid)).withColumn("predicted", F.coalesce(F.col("best") >= F.col("threshold"), F.lit(False)))
    return confusion(rows, "truth", "predicted", ["threshold"])


def top_n_accuracy(queries: DataFrame, hits: DataFrame, n: int) -> DataFrame:
    """One row ``accuracy``: the share of queries (query, name) with their name among the n best hits (query, name, rank)."""
    right = hits.where(F.col("rank") <= n).select("query", F.col("name").alias("hit")).distinct()
    joined = queries.join(right, (queries["query"] == right["query"]) & (queries["name"] == right["hit"]), "left").select(queries["query"], "hit")
    return joined.groupBy("query").agg(F.max(F.col("hit").isNotNull().cast("int")).alias("ok")).agg(F.round(F.coalesce(F.avg("ok"), F.lit(0.0)), 6).alias("accuracy"))


def in_gallery(queries: DataFrame, gallery: DataFrame, identity: str) -> DataFrame:
    """Queries with ``truth``: whether the gallery holds their identity."""
    known = gallery.select(identity).distinct().withColumn("_known", F.lit(True))
    return queries.join(known, identity, "left").withColumn("truth", F.coalesce("_known", F.lit(False))).drop("_known")
