import random
import re

import numpy as np
import pytest

from strandlake.llm import components as components_module
from strandlake.llm import near_dedup as N
from strandlake.llm.bloom import bloom
from strandlake.llm.components import components

from .data import nasty, nothing


def shingles(t):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.findall(r"[^\x20\x09-\x0d]+", t or "")]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs, percent=85):
    sets = [(d, shingles(t)) for d, t in docs]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, u in sets[:i]:
            if s and u and 100 * len(s & u) >= percent * len(s | u):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in sets}


def check(rows, docs):
    want = brute(docs)
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id), r.doc_id


@pytest.mark.parametrize("block", [1024, 3])
def test_against_all_pairs(spark, block):
    """Chains of copies edited again and again, whose ends are not alike, copies of all kinds, and short texts."""
    rng = random.Random(block)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    docs, i = [], 0
    for _ in range(12):
        w = [word() for _ in range(rng.choice([3, 6, 40, 150]))]
        for _ in range(rng.randint(1, 12)):
            docs.append((i, " ".join(w) if rng.random() < 0.7 else "\n".join(w).upper()))
            i += 1
            w = list(w)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                w[rng.randrange(len(w))] = word()
    docs += [(i, None), (i + 1, ""), (i + 2, " \n"), (i + 3, "a"), (i + 4, "A"), (i + 5, "a b c d"), (i + 6, "a b c d e")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    check(N.near_duplicates(frame, N.NearDedup(block=block)).collect(), docs)


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(N.op6_near_dedup(spark, sf).collect(), docs)


def test_nasty(spark, sf):
    docs = nasty(spark)
    rows = N.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    got = {r.doc_id: r.component_id for r in rows}
    assert got[5] == got[6] == got[7] == 5 and got[None] is None and got[1] == 1
    assert N.near_duplicates(nothing(spark)).count() == 0
    out = N.stage(spark, docs, sf)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {1, 2, 3, 4, 5, 8, 9, None}


def test_estimates_and_intersections():
    rng = np.random.default_rng(1)
    p = N.NearDedup(bands=200)
    for both in (0, 300, 850):
        minima = rng.integers(0, 1 << 62, (2, p.size))
        same = rng.random(p.size) < both / 1000
        minima[1, same] = minima[0, same]
        low = np.pad(minima % 16, ((0, 0), (0, p.words * 16 - p.size))).astype(np.uint8)
        a, b = (low[:, ::2] | low[:, 1::2] << 4).astype(np.uint8).view(np.uint64)
        equal = (low[0, : p.size] == low[1, : p.size]).mean()
        assert N.estimate(a, b, p) == pytest.approx((equal - 1 / 16) / (15 / 16)) == pytest.approx(both / 1000, abs=0.06)
    sets = [np.unique(rng.integers(0, 500, rng.integers(1, 300))).astype(np.uint64) for _ in range(20)]
    got, apart = N.intersections(sets), ~np.eye(20, dtype=bool)
    assert (got == np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets]))[apart].all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_small_graphs_take_few_jobs(spark, monkeypatch):
    """Components of few edges, and a small Bloom filter, cost a few jobs whatever the partitions; more edges go by rounds."""
    rng = random.Random(5)
    edges = spark.createDataFrame([(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(500 - i, 499 - i) for i in range(30)] + [(None, 3), (4, None)], "u long, v long").repartition(8).cache()
    given = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in given}

    def jobs(name, work):
        spark.sparkContext.setJobGroup(name, name)
        out = work()
        spark.sparkContext._jsc.clearJobGroup()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    found = lambda: {r.id: r.component for r in components(edges).collect()}
    try:
        for k, v in given.items():
            spark.conf.set(k, v)
        small, n = jobs("small graph", found)
        assert n <= 10
        monkeypatch.setattr(components_module, "LOCAL", 50)
        assert found() == small and len(small) > 90
        filter_, n = jobs("filter", lambda: bloom(spark.range(30_000).select("id")))
        assert n <= 10 and filter_.may_have(np.arange(30_000, dtype=np.uint64)).all()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        edges.unpersist()


def test_stage_links_from_four_fifths(spark, sf):
    """196 shingles each: four words changed leave 176 of 216 (0.81), five 171 of 221 (0.77)."""
    w = [f"w{i}" for i in range(200)]
    other = lambda n: " ".join(f"x{i}" if i % 30 == 20 and i < 30 * n else x for i, x in enumerate(w))
    docs = spark.createDataFrame([(1, " ".join(w)), (2, other(4))], "doc_id long, text string")
    assert [r.doc_id for r in N.stage(spark, docs, sf).collect()] == [1]
    docs = spark.createDataFrame([(1, " ".join(w)), (2, other(5))], "doc_id long, text string")
    assert sorted(r.doc_id for r in N.stage(spark, docs, sf).collect()) == [1, 2]
