import math
import re
from collections import Counter

import numpy as np
import pytest

from strandlake.llm import lm_scoring as L

from .data import nasty, nothing


def words(t):
    return [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x20\x09-\x0d]+", t or "")]


def literal(docs, target, lam=0.7):
    """Scores by plain loops; ``target``: the numbers of the documents that make it."""

    def counts(texts):
        pair, one = Counter(), Counter()
        for t in texts:
            r = words(t)
            pair.update(zip(["", *r], r))
            one.update(r)
            one[""] += bool(r)  # starts
        return pair, one

    everything, aimed = counts(t for _, t in docs), counts(t for d, t in docs if d in target)
    size = 1 + len(set(everything[1]) - {""})
    out = []
    for d, t in docs:
        r, loss = words(t), []
        own = counts([t])
        for (pair, one), counted in ((aimed, d in target), (everything, True)):
            p = lambda k: pair[k] - counted * own[0][k]  # noqa: B023, E731
            c = lambda k: one[k] - counted * own[1][k]  # noqa: B023, E731
            total, x = sum(one.values()) - one[""] - counted * len(r), 0.0
            for a, b in zip(["", *r], r):
                base = (c(b) + 1) / (total + size)
                x -= math.log(lam * p((a, b)) / c(a) + (1 - lam) * base if c(a) else base)
            loss.append(x / len(r) if r else None)
        out.append((d, len(r), *loss))
    return out


def same(got, docs, target):
    got = {r.doc_id: r for r in got}
    for d, n, x, y in literal(docs, target):
        r = got.pop(d)
        assert r.n_tokens == n
        if n:
            assert r.target_loss == pytest.approx(x, rel=1e-9) and r.background_loss == pytest.approx(y, rel=1e-9)
            assert r.score == pytest.approx(x - y, abs=1e-9)
        else:
            assert r.target_loss is None and r.score is None
    assert not got


@pytest.mark.parametrize("size", [2000, 1 << 20])
def test_against_loops(spark, sf, size):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(150).collect()] + [(-1, None), (-2, " ")]
    target = {d for d, _ in docs if d % 3 == 0}
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    p = L.Bigrams(group_bytes=size, range_bytes=size * 2)
    same(L.score(frame, frame.where("doc_id % 3 = 0").select("doc_id"), p).collect(), docs, target)


def test_every_word_is_a_symbol(spark):
    """10000 words that occur four times each, more than any fixed vocabulary would keep beside the frequent ones."""
    docs = [(i, " ".join(f"w{(i * 50 + k) % 10000}" for k in range(100))) for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    same(L.score(frame, frame.where("doc_id % 5 = 0").select("doc_id"), L.Bigrams(group_bytes=30_000)).collect(), docs, {d for d, _ in docs if d % 5 == 0})


def test_target_like_texts_score_lower(spark):
    rows = [(i, ("alpha beta gamma delta " if i % 4 == 0 else "delta beta alpha omega ") * 6) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for target in (docs.where("doc_id % 4 = 0").select("text"), docs.where("doc_id % 4 = 0").select("doc_id")):
        out = L.score(docs, target).collect()
        assert max(r.score for r in out if r.doc_id % 4 == 0) < min(r.score for r in out if r.doc_id % 4)


def test_one_id_with_most_of_the_text(spark):
    """A doc_id (in the target) and null with thousands of rows each are dealt to many groups, and each row is scored."""
    docs = [(7 if i % 3 else None, f"a hot text {i} of many like it") for i in range(3000)] + [(1, "another text"), (2, "a hot text")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    out = L.score(frame, spark.createDataFrame([(7,), (2,)], "doc_id long"), L.Bigrams(group_bytes=4000)).collect()
    assert Counter(r.doc_id for r in out) == Counter(d for d, _ in docs)
    total = sum(len(t.split()) for d, t in docs)
    (r,) = [r for r in out if r.doc_id == 1]  # its words occur nowhere else but "text"
    heads = {"": len(docs) - 1, "another": 0}
    base = [1 / (total - 2 + 1 + len({w for _, t in docs for w in t.split()})), (sum(t.split().count("text") for _, t in docs)) / (total - 2 + 1 + len({w for _, t in docs for w in t.split()}))]
    assert heads[""] and r.background_loss == pytest.approx(-(math.log(0.3 * base[0]) + math.log(base[1])) / 2)


def test_nasty(spark):
    docs = nasty(spark)
    assert L.score(docs, docs.select("text")).count() == docs.count()
    assert L.score(docs, docs.select("doc_id")).count() == docs.count()
    assert L.score(docs, nothing(spark).select("text")).where("score is null").count() == 3
    assert L.score(nothing(spark), docs.select("text")).count() == 0


def test_own_background(spark):
    """Texts outside the background are scored by its counts alone; their unseen words have the add-one loss."""
    docs, rest = [(1, "a b new"), (2, None)], ["a b", "a c", "b a"]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    texts = spark.createDataFrame([(t,) for t in rest], "text string")
    (r,) = L.score(frame, texts, background=texts).where("doc_id = 1").collect()
    seen = [0.7 * 2 / 3 + 0.3 * 4 / 10, 0.7 * 1 / 3 + 0.3 * 3 / 10, 0.7 * 0 + 0.3 * 1 / 10]
    assert r.background_loss == pytest.approx(-sum(map(math.log, seen)) / 3) and r.score == 0


def test_packed_numbers():
    rng = np.random.default_rng(1)
    for top in (1, 255, 256, 1 << 40, (1 << 63) - 1):
        x = rng.integers(0, top, 100, dtype=np.uint64)
        assert (L.widen(L.narrow(x)) == x).all()
    assert len(L.widen(L.narrow(np.zeros(0, np.uint64)))) == 0
