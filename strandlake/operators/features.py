"""Sparse feature vectors of gene clusters, their centroids and nearest centroids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vec import l2_normalize


def domain_features(hits: DataFrame, members: DataFrame) -> DataFrame:
    """bgc_id, key, value 255 for each domain (hmm_acc) found in a cluster's coding sequences."""
    d = hits.join(members, "cds_id").select("bgc_id", F.col("hmm_acc").alias("key")).distinct()
    return d.withColumn("value", F.lit(255.0))


def ranked_features(hits: DataFrame, query: list[str], family: str, member: str, top_k: int = 3) -> DataFrame:
    """The best ``top_k`` members of each family a query hits, weighing 255 down in equal whole steps."""
    w = Window.partitionBy(*query, family).orderBy(F.col("bitscore").desc(), F.col(member))
    rank = F.row_number().over(w)
    d = hits.withColumn("_r", rank).where(F.col("_r") <= top_k)
    value = F.lit(255) - F.floor(F.lit(255.0) / top_k * (F.col("_r") - 1))
    return d.withColumn("value", value.cast("double")).drop("_r")


def vectors(*parts: DataFrame) -> DataFrame:
    """bgc_id, features: the largest value of each key over all parts (bgc_id, key, value)."""
    long = parts[0].select("bgc_id", "key", "value")
    for p in parts[1:]:
        long = long.unionByName(p.select("bgc_id", "key", "value"))
    best = long.groupBy("bgc_id", "key").agg(F.max("value").alias("value"))
    return best.groupBy("bgc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("features"))


def cutoff_hits(hits: DataFrame, cutoffs: DataFrame | None = None, bitscore: float | None = None) -> DataFrame:
    """Hits at or above a fixed score, or above their profile's (hmm_acc, cutoff)."""
    if bitscore is not None:
        return hits.where(F.col("bitscore") >= bitscore)
    c = cutoffs.select(F.col("hmm_acc").alias("_acc"), F.col("cutoff").alias("_cut"))
    return hits.join(c, F.col("hmm_acc") == F.col("_acc")).where(F.col("bitscore") >= F.col("_cut")).drop("_acc", "_cut")


def hit_sequences(hits: DataFrame, cds: DataFrame) -> DataFrame:
    """The hits (cds_id, cds_from, cds_to from 1, both included) with ``aa``, the amino acids of their span, to be scanned again."""
    c = cds.select(F.col("idx").alias("_idx"), "aa_sequence")
    span = F.substring("aa_sequence", F.col("cds_from").cast("int"), (F.col("cds_to") - F.col("cds_from") + 1).cast("int"))
    return hits.join(c, F.col("cds_id") == F.col("_idx")).select(*hits.columns, span.alias("aa"))


def embed(vectors: DataFrame, dims: int = 2, id_: str = "bgc_id") -> DataFrame:
    """id, embedding: the first ``dims`` principal components of array<double> vectors ``v`` of one length (a linear embedding)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    d = vectors.select(F.col(id_), array_to_vector(F.col("v")).alias("v"))
    return PCA(k=dims, inputCol="v", outputCol="e").fit(d).transform(d).select(id_, vector_to_array("e").alias("embedding"))


#: Points whose distances to all sub-clusters are taken as one product of matrices, and sub-clusters made dense for it at once.
BLOCK, SLAB = 256, 1024


def _birch(keys: np.ndarray, values: np.ndarray, first: np.ndarray, threshold: float) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(points, keys, sums) of the sub-clusters of sparse points, given as runs of distinct key numbers in ascending order.

    A block of points meets the sub-clusters of before the block in products of matrices; those that the block itself opens or
    changes are kept beside them, restricted to the block's keys, and are compared with each point anew. Distances that differ
    by rounding alone are ties: the oldest sub-cluster is taken.
    """
    n, norm, square = np.zeros(0), np.zeros(0), np.zeros(0)  # of each sub-cluster: points, |sum|^2, sum of |point|^2
    own: list[tuple[np.ndarray, np.ndarray]] = []  # its keys and sums
    for low in range(0, len(first) - 1, BLOCK):
        many = min(BLOCK, len(first) - 1 - low)
        part, old = slice(first[low], first[low + many]), len(own)
        used, column = np.unique(keys[part], return_inverse=True)
        bounds = first[low : low + many + 1] - first[low]
        points = np.zeros((many, len(used)))
        points[np.repeat(np.arange(many), np.diff(bounds)), column] = values[part]
        dots = np.empty((many, old))
        for a in range(0, old, SLAB):
            some = own[a : a + SLAB]
            k, v = np.concatenate([k for k, _ in some]), np.concatenate([v for _, v in some])
            row = np.repeat(np.arange(len(some)), [len(k) for k, _ in some])
            at = np.minimum(np.searchsorted(used, k), max(0, len(used) - 1))
            met = used[at] == k if len(used) else np.zeros(len(k), bool)
            slab = np.zeros((len(some), len(used)))
            slab[row[met], at[met]] = v[met]
            dots[:, a : a + SLAB] = points @ slab.T
        size = np.array([values[part][a:b] @ values[part][a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
        far = norm / (n * n) - 2 * dots / n
        far[np.isnan(far)] = np.inf
        n, norm, square = (np.concatenate((x, np.zeros(many))) for x in (n, norm, square))
        # sub-clusters that this block opened or changed: their numbers, and their sums of the block's keys
        number, place, sums, count = np.zeros(many, np.int64), {}, np.zeros((many, len(used))), 0
        for i in range(many):
            mine = slice(bounds[i], bounds[i + 1])
            k, v, col = keys[part][mine], values[part][mine], column[mine]
            d, who = far[i], number[:count]
            least = d.min(initial=np.inf)
            near = norm[who] / n[who] ** 2 - 2 * (sums[:count, col] @ v) / n[who]
            near[np.isnan(near)] = np.inf
            least = min(least, near.min(initial=np.inf))
            # rounding is in proportion to the squares that were subtracted
            least += 1e-12 * (size[i] + abs(least) if np.isfinite(least) else 0.0)
            c = np.flatnonzero(d <= least)[:1].tolist() + who[near <= least].tolist()
            c = min(c) if np.isfinite(least) and c else None
            if c is not None:
                ck, cv = own[c]
                if np.array_equal(ck, k):
                    mk, mv = ck, cv + v
                else:
                    mk, where = np.unique(np.concatenate((ck, k)), return_inverse=True)
                    mv = np.bincount(where, np.concatenate((cv, v)), len(mk))
                m, whole = n[c] + 1, mv @ mv
                if not np.sqrt(max(0.0, (square[c] + size[i]) / m - whole / (m * m))) <= threshold:
                    c = None
            if c is None:
                c, m, mk, mv, whole, gain = len(own), 1, k, v, size[i], size[i]
                own.append((k, v))
            else:
                own[c], gain = (mk, mv), square[c] + size[i]
            n[c], norm[c], square[c] = m, whole, gain
            if c not in place:
                place[c], number[count], count = count, c, count + 1
                if c < old:
                    far[:, c] = np.inf
                at = np.minimum(np.searchsorted(used, mk), len(used) - 1) if len(used) else np.zeros(0, np.int64)
                met = used[at] == mk if len(used) else np.zeros(0, bool)
                sums[place[c], at[met]] = mv[met]
            else:
                sums[place[c], col] += v
        n, norm, square = n[: len(own)], norm[: len(own)], square[: len(own)]
    return [(int(c), k, v) for c, (k, v) in zip(n, own, strict=True)]


def flat_birch(points: list[dict[str, float]], threshold: float) -> list[tuple[int, dict[str, float]]]:
    """Clustering features in one pass: a point joins the nearest sub-cluster if the merged radius stays within the
    threshold, otherwise it opens one. Returns (points, centroid) for each."""
    names = sorted({k for p in points for k in p})
    number = {k: i for i, k in enumerate(names)}
    rows = [sorted((number[k], v) for k, v in p.items()) for p in points]
    keys, values = np.array([k for r in rows for k, _ in r], np.int64), np.array([v for r in rows for _, v in r], float)
    made = _birch(keys, values, np.cumsum([0, *map(len, rows)]), threshold)
    return [(c, {names[k]: v / c for k, v in zip(ks.tolist(), vs.tolist(), strict=True) if v > 0}) for c, ks, vs in made]


def centroids(vecs: DataFrame, threshold: float = 0.4, parts: int = 8, id_: str = "bgc_id") -> DataFrame:
    """gcf_id, features: sub-cluster centroids of the L2-normalised vectors. Each of ``parts`` hash parts is clustered by
    itself in the order of ids (of their features, for rows that share an id), so the result depends on ``parts`` alone, not
    on how Spark deals the rows. Every point meets every sub-cluster of its part, so the time grows with their product."""
    d = vecs.select(F.col(id_).cast("long").alias("id"), l2_normalize(F.col("features")).alias("features")).where(F.size("features") > 0)
    d = d.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(max(1, parts))).cast("int"))
    schema = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("features", pa.list_(pa.struct([("key", pa.string()), ("value", pa.float64())])))])

    def run(table: pa.Table) -> pa.Table:
        number: dict[str, int] = {}
        key, value, length = [], [], []
        for chunk in table.column("features").chunks:
            offsets = chunk.offsets.to_numpy()
            names = chunk.keys.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
            items = chunk.items.slice(offsets[0], offsets[-1] - offsets[0])
            here = np.array([number.setdefault(k, len(number)) for k in names.dictionary.to_pylist()], np.int64)
            there = items.is_valid().to_numpy(zero_copy_only=False)
            key.append(here[names.indices.to_numpy()][there])
            value.append(items.drop_null().to_numpy())
            length.append(np.diff(np.concatenate(([0], np.cumsum(there)))[offsets - offsets[0]]))
        key, value, length = np.concatenate(key), np.concatenate(value), np.concatenate(length)
        names = np.array(list(number), object)
        by_name = np.argsort(names, kind="stable")
        rank = np.empty(len(names), np.int64)
        rank[by_name] = np.arange(len(names))
        id_ = table.column("id")
        order = pc.array_sort_indices(id_).to_numpy().astype(np.int64)
        sorted_, first = id_.take(order), np.cumsum(np.concatenate(([0], length)))
        same = pc.equal(sorted_.slice(1).fill_null(0), sorted_.slice(0, len(order) - 1).fill_null(0)).to_numpy() & (sorted_.slice(1).is_null().to_numpy() == sorted_.slice(0, len(order) - 1).is_null().to_numpy())
        starts = np.flatnonzero(np.concatenate(([True], ~same)))
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(order)).tolist(), strict=True):
            if b - a > 1:
                order[a:b] = sorted(order[a:b], key=lambda i: sorted(zip(rank[key[first[i] : first[i + 1]]].tolist(), value[first[i] : first[i + 1]].tolist(), strict=True)))
        # the points in order, the keys of each by name
        place = np.empty(len(length), np.int64)
        place[order] = np.arange(len(length))
        sort = np.lexsort((rank[key], np.repeat(place, length)))
        made = _birch(rank[key][sort], value[sort].astype(float), np.concatenate(([0], np.cumsum(length[order]))), threshold)
        names, columns = pa.array(names[by_name], pa.string()), ([], [], [0])
        for c, k, v in made:
            columns[0].append(k[v > 0])
            columns[1].append(v[v > 0] / c)
            columns[2].append(columns[2][-1] + len(columns[0][-1]))
        entries = pa.StructArray.from_arrays([names.take(pa.array(np.concatenate(columns[0]))), pa.array(np.concatenate(columns[1]))], ["key", "value"])
        features = pa.ListArray.from_arrays(pa.array(columns[2], pa.int32()), entries)
        part = np.full(len(made), table.column("part")[0].as_py(), np.int32)
        return pa.Table.from_arrays([pa.array(part), pa.array(np.arange(len(made))), features], schema=schema)

    made = d.groupBy("part").applyInArrow(run, "part int, n long, features array<struct<key:string,value:double>>")
    return made.select((F.col("part").cast("long") * F.lit(1 << 32).cast("long") + F.col("n")).alias("gcf_id"), F.map_from_entries("features").alias("features"))


def nearest(vecs: DataFrame, centres: DataFrame, id_: str = "bgc_id", centre_id: str = "gcf_id") -> DataFrame:
    """id, nearest centre, Euclidean distance of the normalised vectors (ties: the smallest centre id).

    |a - b|^2 = |a|^2 + |b|^2 - 2 a.b: the products come from an equi-join on shared features, summed by pair; the centre of
    least norm stands for those that share none (exact for vectors without negative values, and for dense ones).
    """
    def long(df: DataFrame, i: str, name: str) -> DataFrame:
        return df.select(F.col(i).alias(name), F.explode("features").alias("key", name + "_v"))

    v = vecs.select(F.col(id_), l2_normalize(F.col("features")).alias("features"))
    square = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    nv, nc = v.select(F.col(id_).alias("a"), square(F.col("features")).alias("na")), centres.select(F.col(centre_id).alias("b"), square(F.col("features")).alias("nb"))
    dots = long(v, id_, "a").join(long(centres, centre_id, "b"), "key").groupBy("a", "b").agg(F.sum(F.col("a_v") * F.col("b_v")).alias("ab"))
    near = dots.join(nv, "a").join(nc, "b").select("a", "b", F.sqrt(F.greatest(F.lit(0.0), F.col("na") + F.col("nb") - 2 * F.col("ab"))).alias("dist"))
    least = nc.agg(F.min_by("b", F.struct("nb", "b")).alias("b"), F.min("nb").alias("nb"))
    alone = nv.join(F.broadcast(least)).select("a", "b", F.sqrt(F.col("na") + F.col("nb")).alias("dist")).join(near.select("a", "b"), ["a", "b"], "left_anti")
    best = near.unionByName(alone).withColumn("dist", F.round("dist", 9)).groupBy("a").agg(F.min(F.struct("dist", "b")).alias("m"))
    return best.select(F.col("a").alias(id_), F.col("m.b").alias(centre_id), F.col("m.dist").alias("dist"))
