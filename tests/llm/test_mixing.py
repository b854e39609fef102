import math
import re
from collections import Counter, defaultdict

import pytest

from strandlake.llm import mixing

from .data import nasty, nothing

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def water(sizes):
    """Targets by resharing until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight, open_, left, out = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, set(order), 1.5 * sum(sizes.values()), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def check(docs, rows):
    size = lambda t: len(WORD.findall(t or ""))
    sizes = Counter()
    for d in docs:
        sizes[d.source] += size(d.text)
    target, got = water(sizes), Counter()
    assert Counter((d.doc_id, d.source, size(d.text)) for d in docs) == Counter((r.doc_id, r.source, r.size) for r in rows)
    for r in rows:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 2 * r.size
        got[r.source] += r.taken
    for s in sizes:
        assert abs(got[s] - target[s]) <= 1, s
    epochs = {s: int(target[s] // sizes[s]) if sizes[s] else 0 for s in sizes}
    part = defaultdict(int)
    for r in rows:  # complete epochs first, and one document at most is cut
        assert r.taken >= epochs[r.source] * r.size
        part[r.source] += 0 < r.taken - epochs[r.source] * r.size < r.size
    assert max(part.values(), default=0) <= 1


@pytest.mark.parametrize("per_bin", [1, 3, 20000])
def test_against_brute_force(spark, sf, per_bin):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    hot = docs.selectExpr("doc_id", "text", "case when doc_id % 3 = 0 then 'hot' when doc_id % 50 = 1 then null else source end as source")
    rows = mixing.taken(hot, mixing.Mix(per_bin=per_bin)).collect()
    check(hot.collect(), rows)
    other = mixing.taken(hot.repartition(7), mixing.Mix(per_bin=per_bin, small=3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, other))  # reruns agree, whatever the partitions and joins


def test_nasty(spark):
    docs = nasty(spark)
    check(docs.collect(), mixing.taken(docs).collect())
    assert mixing.taken(nothing(spark)).count() == 0
    assert mixing.taken(docs.where("text is null")).collect()[0].taken == 0


def test_weight_decides_the_order(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'a b c' as text", "'s' as source", "id % 2 = 0 as good")
    mix = mixing.Mix(share=0.2)
    rows = mixing.taken(docs, mix, weight=docs.good.cast("int") + 1.0).collect()
    good = sum(r.taken > 0 for r in rows if r.doc_id % 2 == 0)
    bad = sum(r.taken > 0 for r in rows if r.doc_id % 2)
    assert good + bad == pytest.approx(800, abs=1) and good > 1.6 * bad


def test_stage_repeats_and_cuts(spark, sf):
    docs = nasty(spark)
    out = mixing.stage(spark, docs, sf)
    assert out.columns == docs.columns
    want, got = Counter(), Counter()
    for r in mixing.taken(docs).collect():
        want[r.doc_id] += r.taken
    for r in out.collect():
        got[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert +want == got or sum((want - got).values()) <= 1  # equal rows share evenly, rounded down
