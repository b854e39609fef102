import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import public_tokenizers
from strandlake.llm import packing
from tokenizers import Tokenizer

from .data import nasty, nothing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, docs, window):
    """Every id in exactly one piece, sequences without gaps, at most a window, full or of a power of two."""
    whole, own, sequences = Tokenizer.from_file(PATH), defaultdict(list), defaultdict(list)
    for r in rows:
        own[r.doc_id, r.row].append(r)
        sequences[r.sequence_id].append(r)
    texts = defaultdict(list)
    for d in docs:
        texts[d.doc_id].append(d.text or "")
    assert Counter(d for d, _ in own) == {d: len(t) for d, t in texts.items()}
    left = {d: [np.array([*whole.encode(x, add_special_tokens=False).ids, 1], "<u4") for x in t] for d, t in texts.items()}
    for (doc, _), pieces in own.items():
        ids = next(x for x in left[doc] if all(r.ids_crc32 == zlib.crc32(x[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(x) for r in pieces))
        left[doc] = [x for x in left[doc] if x is not ids]
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == window or at < window and at & (at - 1) == 0


@pytest.mark.parametrize("window", [64, 2048])
def test_nasty(spark, window):
    docs = nasty(spark)
    rows = packing.packed(docs, PATH, packing.Packing(window=window)).collect()
    check(rows, docs.collect(), window)
    assert packing.packed(nothing(spark), PATH).count() == 0


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = packing.op10_retrieval_packing(spark, sf).collect()
    check(rows, docs, 2048)
    again = packing.op10_retrieval_packing(spark, sf).collect()
    assert sorted(rows) == sorted(again)


def corpus(docs, vocabulary):
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=vocabulary)
    return packing.Corpus(len(docs), np.mean([len(d) for d in docs]), df)


def test_neighbours_are_the_best_by_bm25():
    """With the statistics of all documents, from an index over some of them."""
    rng = np.random.default_rng(5)
    every = [rng.integers(0, 60, rng.integers(1, 40)) for _ in range(160)]
    docs = every[:80]
    first = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    p = packing.Packing(terms=1000, neighbours=5)
    index = packing.Bm25(np.concatenate(docs), first, p, corpus(every, 60))
    mean, df = np.mean([len(d) for d in every]), np.bincount(np.concatenate([np.unique(d) for d in every]), minlength=60)
    used = np.zeros(80, bool)
    used[[3, 0]] = True

    def score(q, d):
        out = 0.0
        for t in np.unique(docs[q]):
            tf = (docs[d] == t).sum()
            out += np.log1p((160 - df[t] + 0.5) / (df[t] + 0.5)) * tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * len(docs[d]) / mean))
        return out

    for q in (0, 10, 41):
        best = sorted((d for d in range(80) if not used[d] and score(q, d) > 0), key=lambda d: (-round(score(q, d), 4), d))[:5]
        assert index.neighbours(q, used) == best


def literal(ids, first, same, p, c):
    """Greedy windows by plain loops over all pairs, as the sequence of documents."""
    docs = [ids[a:b] for a, b in zip(first, first[1:])]
    weight = lambda d, t: c.idf[t] * (tf := (docs[d] == t).sum()) * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * len(docs[d]) / c.mean))
    used, order, offset, queue, held = set(), [], 0, [], set()
    while len(used) < len(docs):
        free = [d for d in range(len(docs)) if d not in used]
        queue = [d for d in queue if d in free and same[d] not in held]
        doc = queue[0] if queue else next((d for d in free if same[d] not in held), free[0])
        used.add(doc)
        held.add(same[doc])
        order.append(doc)
        whole, offset = divmod(offset + len(docs[doc]) + 1, p.window)
        if whole:
            queue, held = [], {same[doc]} if offset else set()
        if offset:
            queue = [d for d in queue if d not in used and same[d] not in held]
            if not queue:
                near = {d: sum(weight(d, t) for t in np.unique(docs[doc])) for d in range(len(docs)) if d not in used}
                queue = sorted((d for d in near if near[d] > 0), key=lambda d: (-round(near[d], 4), d))[: p.neighbours]
    return order


def test_windows_against_loops():
    rng = np.random.default_rng(8)
    docs = [rng.integers(0, 50, rng.integers(0, 30)) for _ in range(60)]
    docs += docs[:20]
    first, ids, same = np.concatenate(([0], np.cumsum([len(d) for d in docs]))), np.concatenate(docs), [d.tobytes() for d in docs]
    p, c = packing.Packing(window=64, terms=1000, neighbours=6), corpus(docs, 50)
    assert list(dict.fromkeys(x[0] for x in packing.arrange(ids, first, same, p, c))) == literal(ids, first, same, p, c)


def test_copies_are_kept_apart(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) between 200 and 2000").select("doc_id", "text").dropDuplicates(["text"])
    twice = docs.union(docs).repartition(3)
    windows = defaultdict(list)
    for r in packing.packed(twice, PATH).collect():
        windows[r.sequence_id].append((r.doc_id, r.row))
    together = sum(len(set(w)) - len({d for d, _ in w}) for w in windows.values())
    assert together <= 0.05 * docs.count()


def test_shards_hold_like_documents_and_none_overflows(spark):
    """A third of all rows are one text, a third near copies of another; shards stay small, and near copies meet."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    near = [word() for _ in range(60)]
    texts = ["the same words in each of many rows " * 4] * 400
    texts += [" ".join(near[:i % 50] + [word()] + near[i % 50 + 1:]) for i in range(400)] + [" ".join(word() for _ in range(60)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    p = packing.Packing(shard_tokens=10_000)
    rows = packing.encoded(docs, PATH, 2).cache()
    c = packing.corpus_of(rows, 50_000)
    assert c.documents == 1200
    got = packing.dealt(rows, c, 2, p).selectExpr("doc_id", "shard", "length(ids) / 2 + 1 as n").collect()
    assert sorted(r.doc_id for r in got) == list(range(1200))
    load = Counter()
    for r in got:
        load[r.shard] += r.n
    assert max(load.values()) <= 4 * p.shard_tokens and len(load) > 5
    check(packing.packed(docs, PATH, p).collect(), docs.collect(), 2048)


def test_index_memory():
    """The index of a shard is made in 24 bytes an id at most, and scores as the formula does."""
    rng = np.random.default_rng(3)
    ids, first = (rng.zipf(1.3, 1 << 19) % 5000).astype("<u2"), np.arange(0, (1 << 19) + 1, 1 << 9)
    df = np.bincount(np.unique(np.repeat(np.arange(1 << 10), 1 << 9) * 5000 + ids) % 5000, minlength=5000)
    p, corpus = packing.Packing(), packing.Corpus(1 << 10, 512.0, df)
    tracemalloc.start()
    index = packing.Bm25(ids, first, p, corpus)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * len(ids)
    for doc in (0, 1023):
        tf = Counter(ids[first[doc] : first[doc + 1]].tolist())
        a, b = index.by_doc[doc : doc + 2]
        assert index.term[a:b].tolist() == sorted(tf)
        expected = [np.log1p((1024 - df[t] + 0.5) / (df[t] + 0.5)) * n * (p.k1 + 1) / (n + p.k1 * (1 - p.b + p.b * 512 / 512.0)) for t, n in sorted(tf.items())]
        assert np.allclose(index.weight[a:b], expected, rtol=1e-6)
