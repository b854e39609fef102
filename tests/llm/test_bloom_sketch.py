import hashlib
import re

import pytest
from pyspark.sql import functions as F

from strandlake.llm import bloom_sketch as S

from .data import nasty, nothing


def parts(t):
    return {p for p in re.split(r"\n|(?<=[.!?])[\x20\x09-\x0d]+", t or "") if p.strip(" \t\n\x0b\x0c\r")}


def alike(a, b):
    a, b = parts(a), parts(b)
    return 1.0 if not a and not b else 1 - len(a ^ b) / (len(a) + len(b))


def check(rows, docs):
    order = sorted(docs, key=lambda r: r.doc_id, reverse=True)
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs)
    prints = {}
    for i, r in enumerate(order):
        text, after = r.text or "", order[(i + 1) % len(order)].text or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        g = got[r.doc_id]
        assert g.n_chars == len(text) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert g.near_edited == pytest.approx(alike(text, edited), abs=1e-9) and g.near_next == pytest.approx(alike(text, after), abs=1e-9)
        assert g.n_changed == len(parts(text) ^ parts(edited))
        for t, f in ((text, g.fingerprint), (edited, g.edited_fingerprint)):
            assert prints.setdefault(t, f) == f
    assert len(set(prints.values())) >= len({frozenset(parts(t)) for t in prints})


def test_against_sets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(S.fingerprints(docs, 5).collect(), docs.collect())


def test_peeling_recovers_the_difference(spark):
    rows = [(i, [f"p{i}.{j}" for j in range(n)], [f"p{i}.{j}" for j in range(m, n + m)]) for i, (n, m) in enumerate([(0, 0), (1, 0), (1, 1), (5, 2), (40, 3), (300, 299), (2000, 0), (2000, 900), *((800, k) for k in range(700, 740))])]
    d = spark.createDataFrame(rows, "id int, a array<string>, b array<string>")
    d = d.select("id", *(S.digests(F.array_join(c, "\n")).alias(c) for c in "ab"))
    d = d.withColumns({f"f{c}": S.sketch(F.col(c)) for c in "ab"})
    d = d.withColumns({"got": S.difference(*map(F.col, ("a", "b", "fa", "fb"))), "want": F.concat(F.array_except("a", "b"), F.array_except("b", "a"))})
    for r in d.select("id", "got", "want").collect():
        assert sorted(r.got) == sorted(r.want), r.id
    full = {r.id: r[1] for r in d.select("id", S.peel(S.sketch(F.col("a")))).collect()}
    assert full[0] == [] and len(full[3]) == 5 and full[6] is None  # the smallest sketch gives up and says so


def test_nasty(spark):
    docs = nasty(spark)
    rows = S.fingerprints(docs, 3).collect()
    assert len(rows) == docs.count() and all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in rows)
    assert S.fingerprints(nothing(spark), 3).count() == 0
    one = docs.where("doc_id = 5")
    check(S.fingerprints(one, 2).collect(), one.collect())
    plain = docs.where("doc_id < 9")
    check(S.fingerprints(plain, 2).collect(), plain.collect())
