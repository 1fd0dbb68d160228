"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, keep


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    ends = links.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m")), F.struct(F.col("v").alias("u"), F.col("m")))))
    return ends.select(F.col("col.u").alias("u"), F.col("col.m").alias("v")).where("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """links: (a, b) longs. One row (node, root) for each node that is not the smallest of its component; root is that one.

    A hub costs rows, not a group in memory: its smallest neighbour is an aggregate, and the join that
    spreads it is one Spark splits where it is skewed. Each round is a written table.
    """
    first = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    now, before = keep(first, "links"), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
        after = keep(_small_star(_large_star(now)), "links")
        forget(now)
        now = after


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row of a symmetric boolean matrix that isn't the first of its component, and that first one."""
    n = len(linked)
    label = np.arange(n)
    reach = np.where(linked, np.arange(n)[None, :], n)
    while True:
        lower = np.minimum(label, np.where(reach < n, label[np.minimum(reach, n - 1)], n).min(axis=1))
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]
