import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from strandlake.llm import quality_rules as Q

from .data import nasty, nothing

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def literal(text):
    t = text or ""
    w = WORD.findall(t)
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    again = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)


def test_counts(spark):
    random.seed(1)
    texts = ["".join(random.choice("ab #é\n\t|") for _ in range(random.randint(0, 120))) for _ in range(300)]
    texts += [None, "", " a  b ", "x y z x y z x y z", "a b c d " * 5000, "\x0b\x0c\r", "one two", "one two three"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in Q.with_stats(docs, ["doc_id"]).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == literal(texts[r.doc_id]), texts[r.doc_id]


def tail(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if k < n else 1.0


def test_binomial_tail(spark):
    cases = [(0, 0), (0, 1), (1, 1), (0, 300), (3, 300), (15, 300), (300, 300), (40, 2000)]
    df = spark.createDataFrame(cases, "k long, n long").select("k", "n", Q.binomial_tail(F.col("k"), F.col("n"), 0.05).alias("p"))
    for r in df.collect():
        assert r.p == pytest.approx(tail(r.k, r.n, 0.05), rel=1e-9)
    big = spark.createDataFrame([(4900, 100000)], "k long, n long").select(Q.binomial_tail(F.col("k"), F.col("n"), 0.05)).first()[0]
    assert 0 < big < 1


def corpus(spark, n, junk, seed=0):
    rng = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        bad = rng.random() < junk
        words = ["".join(rng.choice("abcdefg") for _ in range(5)) + ("###" if bad else "") for _ in range(80)]
        rows.append((i, " ".join(words), "ab"[i % 2]))
        if i % 3:
            marks.append((i, int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, quality int")


def test_certified_cutoffs_reject_junk_and_spare_the_good(spark):
    docs, marks = corpus(spark, 4000, 0.2)
    out = Q.judge(docs, marks).collect()
    truth = {r.doc_id: "#" in r.text for r in docs.collect()}
    assert all(r.kept != truth[r.doc_id] for r in out)
    small, few = corpus(spark, 90, 0.2)  # too few labels to certify anything: nothing is rejected beyond the base rules
    assert all(r.kept == (not r.base_failed) for r in Q.judge(small, few).collect())


def test_holm_controls_false_rejection(spark):
    """Pure noise: good documents' scores are spread, so a cutoff that is certified must spare 95 % of them."""
    rng = random.Random(3)
    rules = Q.Rules(grid={"x": tuple(i / 20 for i in range(1, 20))}, cost=0.0)
    rows = [("s", rng.random() < 0.9, rng.random()) for _ in range(5000)]
    t = Q.tested(spark.createDataFrame(rows, "stratum string, good boolean, x double"), "stratum", rules).collect()
    n = sum(g for _, g, _ in rows)
    by = sorted(t, key=lambda r: (r.p_value, -r.cutoff))
    ok = True
    for i, r in enumerate(by):
        assert (r.n_good, r.k_good) == (n, sum(g and x >= r.cutoff for _, g, x in rows))
        ok = ok and r.p_value <= 0.05 / (len(by) - i)
        assert r.certified == ok
        assert not r.certified or r.cutoff >= 0.95


def test_nasty_and_stage(spark, sf):
    docs = nasty(spark)
    marks = spark.createDataFrame([(9, 1), (None, 0), (5, None), (5, 1), (5, 0)], "doc_id long, quality int")
    out = Q.judge(docs, marks)
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in docs.collect())
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in out.collect())
    assert Q.judge(nothing(spark), marks).count() == 0 and Q.judge(docs, marks.limit(0)).count() == docs.count()
    good = docs.unionByName(docs.where("doc_id = 8").withColumn("text", F.lit(" ".join(f"w{i}" for i in range(60)))).withColumn("doc_id", F.lit(77).cast("long")))
    kept = Q.stage(spark, good, sf)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {77}


def test_oracle(spark, sf):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    res = con.execute(Q.ORACLE)
    columns = [d[0] for d in res.description]
    df = Q.op4_quality_rules(spark, sf)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(r) for r in df.select(*columns).collect()) == sorted(res.fetchall())
