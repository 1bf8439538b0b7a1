"""Connected components over edges of any number, by alternating star contractions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadwright.llm.common import shared_folder


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, component): the smallest node that each node of an edge reaches.

    edges: two columns of long; direction, repeated rows and loops do not matter. Every round joins each node with the
    smallest of its neighbours (a pre-aggregated minimum, so that a hub's edges can be split over tasks) and is
    checkpointed. The rounds end when the edges are stars around the smallest nodes. No edges: no rows.
    """
    shared_folder(edges.sparkSession)
    a, b = (F.col(c) for c in edges.columns[:2])
    now = edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct().checkpoint()
    seen = None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = moved.union(least).distinct().checkpoint()
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v")).distinct())


def smallest_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places reaches over pairs (i, j), inside one task."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
