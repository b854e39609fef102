"""Similarity graphs, label propagation, clusters of labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a part in :func:`cosine_edges`.
PER_BLOCK = 1024


def cosine_edges(vectors: DataFrame, id_: str, vector: str, least: float = 0.7, blocks: int | None = None) -> DataFrame:
    """src < dst with cosine similarity over ``least``, as weight. Exact over all pairs of vectors of one length; null, empty
    and zero vectors have no edge.

    Rows are dealt to ``blocks`` parts (by default as many as leave some ``PER_BLOCK`` rows each, after a count), and every
    two parts, and each with itself, meet in one cell, as a product of matrices of normalised vectors. A cell is bounded
    whatever the number of vectors is, and each pair is compared once.
    """
    v = vectors.select(F.col(id_).alias("id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v")).where((F.size("v") > 0) & F.col("id").isNotNull())
    blocks = blocks or max(1, -(-v.count() // PER_BLOCK))
    v = v.withColumn("p", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    rows = v.select("id", "v", F.col("p").alias("x"), F.explode(F.sequence("p", F.lit(blocks - 1))).alias("y"), F.lit(0).alias("side"))
    rows = rows.union(v.select("id", "v", F.explode(F.sequence(F.lit(0), "p")).alias("x"), F.col("p").alias("y"), F.lit(1).alias("side")))

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        same, out = pdf.x.iloc[0] == pdf.y.iloc[0], [[], [], []]
        for _, part in pdf.groupby(pdf.v.map(len)):
            m = np.stack(part.v.to_list())
            norm = np.sqrt((m * m).sum(axis=1))
            good = norm > 0
            m, ids, side = m[good] / norm[good, None], part.id.to_numpy()[good], part.side.to_numpy()[good]
            a, b, left, right = m[side == 0], m[side == 1], ids[side == 0], ids[side == 1]
            for low in range(0, len(a), 512):
                w = a[low : low + 512] @ b.T
                i, j = np.nonzero(w > least)
                w, i = w[i, j], left[low + i]
                j = right[j]
                keep = i < j if same else np.ones(len(i), bool)
                for o, c in zip(out, (np.minimum(i, j), np.maximum(i, j), w), strict=True):
                    o.append(c[keep])
        return pd.DataFrame({n: np.concatenate(o) if o else [] for n, o in zip(("src", "dst", "weight"), out, strict=True)})

    kind = v.schema["id"].dataType.simpleString()
    return rows.groupBy("x", "y").applyInPandas(cell, f"src {kind}, dst {kind}, weight double")


def lpa_step(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One synchronous round: each node that is a ``dst`` takes the label with the largest vote of its ``src`` nodes (the
    smallest label among equals); others keep theirs. ``labels``: node, label; a src without one votes for itself.

    Votes are compared to 6 digits, so that the order of a sum does not decide between equal ones."""
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    votes = edges.join(labels, F.col("src") == F.col("node"), "left").groupBy("dst", F.coalesce("label", "src").alias("cid")).agg(F.round(F.sum(weight), 6).alias("vote"))
    won = votes.groupBy("dst").agg(F.max_by("cid", F.struct("vote", -F.col("cid"))).alias("won"))
    return labels.join(won, F.col("node") == F.col("dst"), "full").select(F.coalesce("node", "dst").alias("node"), F.coalesce("won", "label").alias("label"))


def label_propagation(edges: DataFrame, max_iter: int = 5) -> DataFrame:
    """node, label after at most ``max_iter`` rounds and a last vote, or when nothing changes. Nodes that are never a dst are
    left out.

    Rounds are checkpointed (set ``spark.checkpoint.dir``), so the plan does not grow and lost executors cost one round.
    """
    edges = edges.checkpoint()
    labels = edges.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node")).checkpoint()
    for _ in range(max_iter):
        new = lpa_step(edges, labels).checkpoint()
        old = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        changed = new.join(old, F.col("node") == F.col("_n"), "left").where(~F.col("label").eqNullSafe(F.col("_l"))).limit(1).count()
        labels = new
        if not changed:
            break
    else:
        labels = lpa_step(edges, labels)
    return labels.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_semi")


def clusters(labels: DataFrame, least: int = 2) -> DataFrame:
    """label, count, members (sorted) of the labels with at least ``least`` nodes."""
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_list("node")).alias("members")).where(F.col("count") >= least)


def cluster(edges: DataFrame, least_weight: float = 0, weighted: bool = True, max_iter: int = 15, least: int = 2) -> DataFrame:
    e = edges.where(F.col("weight") >= least_weight) if "weight" in edges.columns else edges
    return clusters(label_propagation(e if weighted else e.drop("weight"), max_iter), least)


def cluster_members(labels: DataFrame, least: int = 2) -> DataFrame:
    """label, node, count: the same clusters with a row for each member, so a giant one is no single row."""
    n = labels.groupBy(F.col("label").alias("_label")).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= least)
    return labels.join(n, F.col("label") == F.col("_label")).select("label", "node", "count")


def labelled_vertices(vertices: DataFrame, labels: DataFrame, id_: str = "id") -> DataFrame:
    """All vertices with their label; null for those that no edge reaches."""
    return vertices.join(labels.select(F.col("node").alias("_node"), "label"), F.col(id_) == F.col("_node"), "left").drop("_node")


def save_clusters(vertices: DataFrame, edges: DataFrame, path: str, id_: str = "id", overwrite: bool = False, **options) -> DataFrame:
    """Clusters of a graph as Parquet under ``path``, of the vertices given; returns their statistics."""
    e = edges.join(vertices.select(F.col(id_).alias("src")), "src", "left_semi").join(vertices.select(F.col(id_).alias("dst")), "dst", "left_semi")
    cluster(e.select(*edges.columns), **options).write.mode("overwrite" if overwrite else "error").parquet(path)
    return cluster_stats(edges.sparkSession.read.parquet(path))


def cluster_stats(found: DataFrame) -> DataFrame:
    """One row: nodes and clusters in all; least, largest, mean, deviation and quartiles of the clusters' sizes."""
    quartiles = [F.percentile("count", F.lit(q)).alias(n) for q, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    return found.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("nodes"), F.count(F.lit(1)).alias("clusters"), F.min("count").alias("smallest"), F.max("count").alias("largest"), F.avg("count").alias("mean"), F.stddev("count").alias("deviation"), *quartiles)
