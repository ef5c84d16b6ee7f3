"""Vectors as whole numbers, shared by the operators that cluster them exactly.

Sums and squared differences of whole numbers don't depend on the order in which tasks add them, so every run and every
partitioning gives the same centroids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole-number components stay within this on either side, so that squared distances fit into a long.
MOST = 1 << 27
#: Rows whose differences a task holds at a time.
BLOCK = 1024


def finite(vector: str, dimensions: int) -> Column:
    """True for a vector of so many components, none of them null or non-finite."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) == dimensions) & F.forall(F.col(vector).cast("array<double>"), good), F.lit(False))


def scaled(vector: str, factor: int) -> Column:
    """floor(factor * component) of every component, as doubles that hold whole numbers within ``MOST``."""
    whole = lambda x: F.floor(F.greatest(F.least(x * F.lit(float(factor)), F.lit(float(MOST))), F.lit(-float(MOST))))
    return F.transform(F.col(vector).cast("array<double>"), whole)


def matrix(column: pd.Series, dimensions: int) -> np.ndarray:
    """Rows of whole numbers from a column of arrays."""
    return np.concatenate([*column, np.zeros(0)]).astype(np.int64).reshape(-1, dimensions)


def squared_to(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of all points to one centre, in whole numbers."""
    off = points - centre
    return np.einsum("ij,ij->i", off, off)


def blocks(points: np.ndarray) -> Iterator[slice]:
    """Slices of bounded rows."""
    for low in range(0, len(points), BLOCK):
        yield slice(low, min(low + BLOCK, len(points)))


def floor_means(sums: np.ndarray, counts: np.ndarray, before: np.ndarray) -> np.ndarray:
    """floor(sum / count) by components; centres without points stay as they were."""
    used = counts > 0
    out = before.copy()
    out[used] = sums[used] // counts[used, None]
    return out


def with_group_total(rows: DataFrame, group: str, value: str, into: str, send_at_most: int) -> DataFrame:
    """``rows`` with the sum of ``value`` over rows of an equal ``group`` (nulls together); null where it exceeds a long.

    Totals are aggregated before anything is shuffled by key. Up to ``send_at_most`` of them are sent to every task; of
    more, those of groups that hold at least that share of all rows are sent (there can't be more than ``send_at_most``)
    and the others, none of which is frequent, are joined by key.
    """
    totals = rows.groupBy(F.col(group).alias("_group")).agg(F.sum(F.col(value).cast("decimal(38,0)")).try_cast("bigint").alias(into), F.count("*").alias("_rows"))
    joined = lambda some, sums, send: some.join(F.broadcast(sums) if send else sums, F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group", "_rows", "_often")
    sizes = totals.agg(F.count("*").alias("n"), F.sum("_rows").alias("rows")).first()
    if sizes.n <= send_at_most:
        return joined(rows, totals, True)
    often = totals.where(F.col("_rows") * send_at_most >= sizes.rows)
    marked = rows.join(F.broadcast(often.select(F.col("_group"), F.lit(True).alias("_often"))), F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group")
    return joined(marked.where("_often"), often, True).unionByName(joined(marked.where("_often IS NULL"), totals, False))
