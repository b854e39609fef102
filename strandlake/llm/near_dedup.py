"""Operator 6: near-duplicates by b-bit MinHash.

1. One pass over the texts: distinct shingles, their number, a 128-bit hash of the set, ``bands x rows`` minima. Of every
   minimum the low ``b`` bits are kept and packed (the signature); each band's minima give one band key.
2. Documents of equal sets form a class, which its smallest doc_id stands for; only representatives go on.
3. Representatives that share a band key are candidates. Each is first held against its bucket's smallest id: distinct
   pairs, a collision-corrected estimate by counting equal b-bit lanes, then the exact Jaccard of the full sets.
4. In buckets whose members are not all connected by then, the members of different components are held against each
   other, block by block (a hot bucket becomes many small blocks): first by estimate; where a pair of a block passes,
   by exact intersection. A block returns a spanning forest of its links, never its pairs.
5. Connected components over the links of 3 and 4.

With the default 30 bands of 5 rows a pair of similarity 0.85 shares no band with probability 2e-8, and is turned down by
its estimate (0.85 - 0.14) with about 1e-6; both fall steeply above 0.85.
The pipeline's stage links from 0.8 on: a pair at 0.8 shares no band with probability 7e-6.

Nulls and blank texts have no shingles and are linked with nothing; fewer words than ``k`` give one shingle. A null
doc_id is never linked. Rows that share a doc_id are the same document id: what links one links the other. Extra columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, fresh, stash
from .components import components
from .textops import U64, mix, over_texts, shingles, span_hashes, spans, tidy


@dataclass(frozen=True)
class NearDedup:
    """percent: links need 100 * intersection >= percent * union; margin: what the estimate may lack; block: members of
    a bucket that are compared with as many others in one task."""

    percent: int = 85
    k: int = 5
    bands: int = 30
    rows: int = 5
    bits: int = 4
    margin: float = 0.14
    block: int = 1024

    @property
    def size(self) -> int:
        return self.bands * self.rows

    @property
    def words(self) -> int:
        """64-bit words of a packed signature."""
        return -(-self.size * self.bits // 64)


#: Of the pipeline; its margin is wider, as an estimate spreads more at 0.8.
STAGE = NearDedup(percent=80, margin=0.18)


def _multipliers(n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, n, dtype=np.uint64) * U64(2) + U64(1)


def text_shingles(data, offsets, k):
    starts, ends, first = spans(data, offsets)
    return shingles(span_hashes(data, starts, ends, lower=True), first, k)


def signatures(docs: DataFrame, p: NearDedup) -> DataFrame:
    """doc_id, n (shingles), key1, key2 (set hash), sig (packed low bits), bands (keys); one row for each row of ``docs``."""
    mult = _multipliers(p.size)
    lanes = 8 // p.bits

    def block(batch, i, data, offsets):
        h, first = text_shingles(data, offsets, p.k)
        m = len(offsets) - 1
        n, key1, key2 = np.zeros(m, np.int64), np.zeros(m, U64), np.zeros(m, U64)
        for d in range(m):
            if first[d + 1] > first[d]:
                own = np.sort(h[first[d] : first[d + 1]])
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
                n[d], key1[d], key2[d] = len(own), mix(own).sum(dtype=U64), mix(own ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)
        full = np.flatnonzero(n)
        sig, keys = [None] * m, [None] * m
        if len(full):
            at = first[full]
            minima = np.empty((len(full), p.size), U64)
            x = np.empty_like(h)
            for j in range(p.size):
                np.multiply(h, mult[j], out=x)
                minima[:, j] = np.minimum.reduceat(x, at)
            low = (mix(minima) & U64((1 << p.bits) - 1)).astype(np.uint8)
            low = np.pad(low, ((0, 0), (0, p.words * 8 * lanes - p.size)))
            packed = np.zeros((len(full), low.shape[1] // lanes), np.uint8)
            for q in range(lanes):
                packed |= low[:, q::lanes] << np.uint8(q * p.bits)
            band = np.repeat(np.arange(1, p.bands + 1, dtype=U64)[None, :], len(full), 0)
            for r in range(p.rows):
                band = mix(band * U64(0xD6E8FEB86659FD93) + minima[:, r :: p.rows])
            for a, d in enumerate(full):
                sig[d], keys[d] = packed[a].tobytes(), band[a].view(np.int64)
        ids = batch.column(0).slice(i, m)
        return pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(key1.view(np.int64)), pa.array(key2.view(np.int64)), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n", "key1", "key2", "sig", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(over_texts(block, "text"), "doc_id long, n long, key1 long, key2 long, sig binary, bands array<long>")


def shingle_sets(docs: DataFrame, p: NearDedup) -> DataFrame:
    """id, set: the sorted distinct shingles as little-endian 64-bit values."""

    def block(batch, i, data, offsets):
        h, first = text_shingles(data, offsets, p.k)
        m = len(offsets) - 1
        sets = [np.unique(h[first[d] : first[d + 1]]).tobytes() for d in range(m)]
        return pa.RecordBatch.from_arrays([batch.column(0).slice(i, m), pa.array(sets, pa.binary())], ["id", "set"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(over_texts(block, "text"), "id long, set binary")


def matrix(sigs) -> np.ndarray:
    """Packed signatures, a row of 64-bit words each."""
    return np.frombuffer(b"".join(sigs), U64).reshape(len(sigs), -1)


def estimate(a: np.ndarray, b: np.ndarray, p: NearDedup) -> np.ndarray:
    """Similarity of packed signatures by counting bits: a lane differs if any bit of it does, which is folded into its lowest
    bit; a lane of different minima is equal by chance with 2^-b, which is corrected. Padding is equal and so never counts."""
    x = a ^ b
    folded = x.copy()
    for k in range(1, p.bits):
        folded |= x >> U64(k)
    lowest = U64(sum(1 << i for i in range(0, 64, p.bits)))
    different = np.bitwise_count(folded & lowest).sum(axis=-1, dtype=np.int64)
    chance = 2.0**-p.bits
    return ((p.size - different) / p.size - chance) / (1 - chance)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _star_links(stars: DataFrame, sets: DataFrame, p: NearDedup) -> DataFrame:
    """Of the pairs (u, v) those whose full sets are similar enough."""

    @tidy
    def check(batches):
        for pdf in batches:
            ok = [linked(np.frombuffer(a, U64), np.frombuffer(b, U64), p.percent) for a, b in zip(pdf.a, pdf.b, strict=True)]
            yield pdf.loc[np.array(ok, bool), ["u", "v"]] if len(pdf) else pdf[["u", "v"]]

    left = sets.select(F.col("id").alias("u"), F.col("set").alias("a"))
    right = sets.select(F.col("id").alias("v"), F.col("set").alias("b"))
    return stars.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInPandas(check, "u long, v long")


def _passing(sig: np.ndarray, comp: np.ndarray, near: np.ndarray, p: NearDedup) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of a block in different components, not both of the same side of a block pair, whose estimate passes."""
    out_i, out_j = [], []
    for i in range(len(sig) - 1):
        j = np.flatnonzero((comp[i + 1 :] != comp[i]) & ((near[i + 1 :] != near[i]) | (near[i] == 2))) + i + 1
        if len(j):
            j = j[estimate(sig[j], sig[i], p) >= p.percent / 100 - p.margin]
            out_i.append(np.full(len(j), i))
            out_j.append(j)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, int), np.zeros(0, int))


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections: a product of 0/1 matrices over the values that occur more than once."""
    value, where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.cumsum(count > 1) - 1
    keep = count > 1
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    hit = keep[where]
    owner, col = owner[hit], common[where[hit]]
    out = np.zeros((len(sets), len(sets)), np.float64)
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    for low in range(0, int(keep.sum()), 8192):
        a, b = np.searchsorted(col, (low, low + 8192))
        part = np.zeros((len(sets), min(8192, int(keep.sum()) - low)), np.float32)
        part[owner[a:b], col[a:b] - low] = 1
        out += part @ part.T
    return np.rint(out).astype(np.int64)


def _rest_links(rest: DataFrame, sigs: DataFrame, sets: DataFrame, p: NearDedup) -> DataFrame:
    """Links between different components within buckets; ``rest``: key, id, comp of the buckets that hold several."""
    counts = rest.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(p.block)).cast("int").alias("parts"))
    rows = rest.join(counts, "key").withColumn("i", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    # part i meets part j once, in the cell (min, max); its own cell is (i, i)
    rows = rows.select("key", "id", "comp", "i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"))
    rows = rows.select("key", "id", "comp", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), F.when(F.col("i") == F.col("j"), 2).when(F.col("i") < F.col("j"), 0).otherwise(1).cast("int").alias("near"))
    rows = rows.join(sigs.select("id", "sig"), "id")

    def alive(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = _passing(matrix(list(pdf.sig)), pdf.comp.to_numpy(), pdf.near.to_numpy(), p)
        return pdf.iloc[np.unique(np.concatenate((i, j)))][["key", "x", "y", "id", "comp", "near", "sig"]]

    some = cut(rows.groupBy("key", "x", "y").applyInPandas(alive, "key long, x int, y int, id long, comp long, near int, sig binary"))

    def confirm(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = _passing(matrix(list(pdf.sig)), pdf.comp.to_numpy(), pdf.near.to_numpy(), p)
        own = [np.frombuffer(s, U64) for s in pdf.set]
        both = intersections(own)[i, j] if len(i) > 4 else np.array([len(np.intersect1d(own[a], own[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
        size = np.array([len(s) for s in own], np.int64)
        ok = 100 * both >= p.percent * (size[i] + size[j] - both)
        ids, root, out = pdf.id.to_numpy(), {}, []

        def find(c):
            while root.setdefault(c, c) != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        comp = pdf.comp.to_numpy()
        for a, b in zip(i[ok], j[ok], strict=True):
            ra, rb = find(comp[a]), find(comp[b])
            if ra != rb:
                root[ra] = rb
                out.append((ids[a], ids[b]))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return some.join(sets, "id").groupBy("key", "x", "y").applyInPandas(confirm, "u long, v long")


def near_duplicates(docs: DataFrame, params: NearDedup | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept; one row for each row of ``docs``."""
    p = params or NearDedup()
    rows = stash(signatures(docs, p))
    full = rows.where("n > 0 and doc_id is not null")
    reps = cut(full.groupBy("key1", "key2", "n").agg(F.min_by(F.struct("doc_id", "sig", "bands"), "doc_id").alias("r")).select("key1", "key2", F.col("r.doc_id").alias("id"), "r.sig", "r.bands"))
    keys = reps.select("id", F.explode("bands").alias("key"))
    lows = keys.groupBy("key").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("members")).where("members > 1").select("key", "low")
    shared = cut(keys.join(lows, "key"))
    sigs = reps.select("id", "sig")
    chosen = shared.select("id").distinct()
    sets = stash(shingle_sets(docs.join(chosen, docs["doc_id"] == chosen["id"], "left_semi"), p).dropDuplicates())

    @tidy
    def likely(batches):
        for pdf in batches:
            if len(pdf):
                pdf = pdf[estimate(matrix(list(pdf.a)), matrix(list(pdf.b)), p) >= p.percent / 100 - p.margin]
            yield pdf[["u", "v"]]

    stars = shared.where("id <> low").select(F.col("id").alias("u"), F.col("low").alias("v")).distinct()
    stars = stars.join(sigs.select(F.col("id").alias("u"), F.col("sig").alias("a")), "u").join(sigs.select(F.col("id").alias("v"), F.col("sig").alias("b")), "v").select("u", "v", "a", "b")
    first = cut(_star_links(cut(stars.mapInPandas(likely, "u long, v long")), sets, p))
    comp = cut(components(first))
    placed = shared.join(comp.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    several = placed.groupBy("key").agg((F.min("comp") != F.max("comp")).alias("several")).where("several").select("key")
    rest = cut(placed.join(several, "key"))
    second = _rest_links(rest, sigs, sets, p)
    comp = cut(components(first.union(second)))
    found = reps.select("key1", "key2", "id").join(comp.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").select("key1", "key2", F.coalesce("component", "id").alias("component"))
    out = rows.select("doc_id", "n", "key1", "key2").join(found, ["key1", "key2"], "left")
    cid = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), cid.alias("component_id"), F.coalesce(cid == F.col("doc_id"), F.lit(True)).alias("kept"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity 0.8 or more) stays: the one of smallest doc_id."""
    (key,) = fresh(docs, "_key")
    gone = near_duplicates(docs, STAGE).where("not kept").select(F.col("doc_id").alias(key))
    return docs.join(gone, F.col("doc_id") == F.col(key), "left_anti")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS sh
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM pairs JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
ends AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
r AS (SELECT doc_id AS root, doc_id AS node FROM n UNION SELECT r.root, ends.v FROM r JOIN ends ON ends.u = r.node),
c AS (SELECT node AS doc_id, min(root) AS component_id FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id, coalesce(c.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
