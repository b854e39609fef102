"""Connected components of an undirected graph kept in DataFrames (alternating large-star and small-star steps); those of a
graph that a count shows to be small are found on the driver, as a round over few rows costs as many tasks as over many."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Distinct edges (of 16 bytes) that the driver takes at most.
LOCAL = 1 << 18


def _neighbours(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Joins each node's neighbours (the larger ones, or the rest with the node itself) to the smallest of all."""
    low = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    kept = pairs.where("v > u") if larger else pairs
    linked = kept.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not larger:
        linked = linked.union(low.select("u", F.col("m").alias("v")))
    return linked.where("u <> v").distinct()


def lowest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of these edges and the smallest id reachable from each: roots are hung below smaller ones that an edge leads to,
    and trees flattened, until no edge leads from one tree to another."""
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    root, (a, b) = np.arange(len(ids)), at.reshape(2, -1)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return ids, ids[root]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in ``edges`` (u, v: long).

    Up to LOCAL distinct edges are collected. With more, every round is checkpointed; it ends when a round changes nothing,
    after O(log^2 n) rounds. Null ends and loops are ignored. A hub's neighbours are never gathered: they are joined to its
    minimum, so skewed joins can be split.
    """
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    if e.count() <= LOCAL:
        t = e.toArrow()
        ids, low = lowest(t.column("u").to_numpy(), t.column("v").to_numpy())
        return e.sparkSession.createDataFrame(pa.table({"id": ids, "component": low}), "id long, component long")
    seen = None
    while True:
        big = _star(_neighbours(e), True)  # v > m
        e = cut(_star(big.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False))
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    low = e.groupBy("v").agg(F.lit(1)).select(F.col("v").alias("id"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(low)
