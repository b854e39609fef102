import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import line_dedup as L
from strandlake.llm.textops import span_hashes

from .data import nasty, nothing


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(s, n, letters="abé ☃"):
    s = list(s)
    for _ in range(n):
        k, what = random.randrange(len(s) + 1), random.random()
        if what < 0.4 and k < len(s):
            s[k] = random.choice(letters)
        elif what < 0.7:
            s.insert(k, random.choice(letters))
        elif k < len(s):
            del s[k]
    return "".join(s)


@pytest.mark.parametrize("t", [0, 1, 2, 3])
def test_banded_distance(t):
    random.seed(t)
    for _ in range(3000):
        a = "".join(random.choice("ab") for _ in range(random.randint(0, 12)))
        b = edited(a, random.randint(0, 4), "ab") if random.random() < 0.7 else "".join(random.choice("ab") for _ in range(random.randint(0, 12)))
        assert L.within_edits(a, b, t) == (distance(a, b) <= t), (a, b, t)


def brute(texts, p):
    """Texts after dedup and links of each line, by comparing all lines."""
    lines = sorted({x for _, t in texts for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)})
    links, root = defaultdict(set), {x: x for x in lines}
    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            most = min(p.threshold, min(len(a), len(b)) // p.per_edit)
            if abs(len(a) - len(b)) <= most and distance(a, b) <= most:
                links[a].add(b)
                links[b].add(a)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, bs in links.items():
        for b in bs:
            root[find(a)] = find(b)
    docs = defaultdict(set)
    for d, t in texts:
        for x in (t or "").split("\n"):
            if x in root:
                docs[find(x)].add(d)
    out = {}
    for d, t in texts:
        if t is None:
            out[d] = (None, 0)
            continue
        seen, kept = set(), []
        for x in t.split("\n"):
            if x in root:
                c = find(x)
                if c in seen or len(docs[c]) >= p.min_docs and d != min(docs[c]):
                    continue
                seen.add(c)
            kept.append(x)
        out[d] = ("\n".join(kept), sum(len(links[x]) for x in t.split("\n") if x in root))
    return out


@pytest.mark.parametrize("t,cell", [(1, 512), (2, 3), (3, 512)])
def test_against_all_pairs(spark, t, cell):
    random.seed(t)
    base = ["".join(random.choice("abcdé fg") for _ in range(random.randint(5, 40))) for _ in range(14)]
    pool = base + [edited(random.choice(base), random.randint(1, t + 1)) for _ in range(150)] + ["", " ", "ab", "abc", "ab"]
    texts = [(i, "\n".join(random.choice(pool) for _ in range(random.randint(0, 9)))) for i in range(60)] + [(60, None), (61, "")]
    p = L.LineDedup(threshold=t, per_edit=7, min_docs=5, cell=cell)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.text, r.n_links) for r in L.dedup(docs, p).collect()}
    assert got == brute(texts, p)


def test_nasty(spark, sf):
    docs = nasty(spark)
    rows = L.dedup(docs).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in rows))) == sorted(map(str, ((r.doc_id, r.text) for r in docs.collect())))
    assert L.stage(spark, docs, sf).columns == docs.columns
    assert L.dedup(nothing(spark)).count() == 0


def test_letter_maps_bound_edits():
    random.seed(9)
    for _ in range(300):
        a = "".join(random.choice("abcdefé ☃") for _ in range(60))
        b = edited(a, 2)
        data = np.frombuffer((a + "\n" + b).encode(), np.uint8)
        lines = L.Lines(data, np.array([0, len(data)]))
        if len(lines.hash) == 2:
            x, y = lines.maps(np.array([0, 1])).view(np.uint64)
            assert np.bitwise_count(x ^ y).sum() <= 8


def test_long_lines_stay_once(spark):
    """A passage of 60 words in two documents, once with an edit, stays in the first; a short line in both stays and is counted."""
    passage = " ".join(f"word{i}" for i in range(60))
    texts = [(1, f"one\n{passage}\nshort line"), (2, f"two\n{passage}\nshort line"), (3, f"three\n{passage}!"), (4, "four")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_dropped, r.n_shared) for r in L.dedup(docs).collect()}
    assert got == {1: (texts[0][1], 0, 2), 2: ("two\nshort line", 1, 2), 3: ("three", 1, 1), 4: ("four", 0, 0)}


def test_clashing_columns(spark, sf):
    texts = [(1, "one line that is long enough to be linked\nshort", 5, "a", 1.5, "x"), (2, "one line that is long enough to be linkec", 6, "b", 2.5, "y")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, dk int, _id string, n_lines double, _drop string")
    out = L.dedup(docs)
    assert out.columns == [*docs.columns, "_n_lines", "n_dropped", "n_linked", "n_links", "n_shared"]
    assert sorted(out.select(*docs.columns).collect()) == sorted(docs.collect()) and [r.n_links for r in out.collect()] == [1, 1]
    assert sorted(L.stage(spark, docs, sf).collect()) == sorted(docs.collect())


def test_long_texts_come_in_parts(spark, monkeypatch):
    """Texts of many blocks, and a line longer than a block, have the same lines as in one piece."""
    import pyarrow as pa

    random.seed(4)
    text = "\n".join("x" * random.choice([0, 1, 30, 700]) + str(i) for i in range(200))
    whole = [(i, n + m, x) for i, n, data, off in L.line_blocks(pa.array(["a\nb", text, "c"])) for lines in [L.Lines(data, off)] for m, x in zip(lines.number.tolist(), lines.hash.tolist())]
    monkeypatch.setattr(L, "BLOCK", 256)
    found = []
    for i, n, data, off in L.line_blocks(pa.array(["a\nb", text, "c"])):
        lines = L.Lines(data, off)
        found += zip((n + lines.number).tolist(), lines.hash.tolist())
    assert found == [(n, x) for _, n, x in whole]


def test_texts_are_not_dealt_out_for_their_lines(spark):
    """Lines come from one scan: equal rows are told by their lines, not by a shuffle of texts; they count once."""
    long, alike = "a line that is long enough to be linked", "a line that is long enough to be linkeD"
    texts = [(1, f"{long}\nx\n{alike}\nx")] * 3 + [(1, "x"), (2, f"y\n{alike}"), (None, "x\n \t\n\x0ex"), (None, "x\n \t\n\x0ex"), (3, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    marked = docs.withColumn("m", F.xxhash64(F.coalesce("text", F.lit(""))))
    assert "Exchange" not in L.occurrences(spark.createDataFrame(marked.collect(), marked.schema), "m")._jdf.queryExecution().toString()
    got = {(r.doc_id, r.text, r.n_lines, r.n_dropped, r.n_linked, r.n_links, r.n_shared) for r in L.dedup(docs).collect()}
    assert got == {(1, f"{long}\nx", 4, 2, 2, 2, 4), (1, "x", 1, 0, 0, 0, 1), (2, f"y\n{alike}", 2, 0, 1, 1, 1), (None, "x\n \t\n\x0ex", 2, 0, 0, 0, 1), (3, None, 0, 0, 0, 0, 0)}
    assert L.dedup(docs).count() == len(texts)


def test_hashes_of_spans():
    """Equal bytes have equal hashes wherever they lie; different ones of any length, and strings of strong structure, do not."""
    random.seed(6)
    strings = [bytes(random.choice(b"aB\0\xc3") for _ in range(random.randint(0, 40))) for _ in range(2000)]
    strings += [bytes(97 + bin(i).count("1") % 2 ^ flip for i in range(n)) for n in (1024, 4096) for flip in (0, 1)] + [b"a" * n for n in range(64)]
    data = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum([len(x) for x in strings])
    for lower in (False, True):
        h = span_hashes(data, ends - [len(x) for x in strings], ends, lower)
        found = {}
        for x, y in zip(strings, h.tolist()):
            assert found.setdefault(x.lower() if lower else x, y) == y
        assert len(set(found.values())) == len(found)
