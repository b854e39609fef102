"""Every stage of the pipeline against a brute-force version of it, on what its predecessor kept."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from strandlake.llm.common import documents

from . import test_near_dedup, test_packing
from .data import DOCS, nasty
from .test_line_dedup import distance
from .test_mixing import water
from .test_quality_rules import literal, tail

WORD = re.compile(r"[^\x20\x09-\x0d]+")
GRID = {
    "symbol_share": (0.02, 0.03, 0.05, 0.07, 0.1, 0.15, 0.2, 0.3),
    "dup_line_share": (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8),
    "repeat_share": (0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4),
    "word_length": (6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0),
}


def fixture():
    """Good, junk and short documents, near and exact copies, shared and edited lines, nulls; labels of most."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(4, 6)))
    text = lambda n=60: " ".join(word() for _ in range(n))
    docs, labels = [], []

    def add(t, lang="en", quality=None):
        docs.append((len(docs) * 3 + 1, t, lang, ("a", "b", None, "é")[rng.choice([0, 0, 0, 1, 2, 3])], len(t or ""), f"k{len(docs)}"))
        if quality is not None:
            labels.append((docs[-1][0], quality, 0))

    for _ in range(560):
        add(text(), quality=1)
    for _ in range(40):
        add(" ".join(w + "##" for w in text().split()), quality=0)
    passage, notice = text(20), "all rights are reserved by us"
    for i in range(12):
        add(f"{text(70)}\n{passage if i % 2 else passage[:-1]}\n{notice}\n{text(5)}", lang=("en", "de", None)[i % 3])
    for i in range(15):
        w = text(200).split()
        add(" ".join(w))
        for k in range(rng.randint(1, 3)):
            w[7 + 23 * k] = word()
            add("  ".join(w).upper() if k else " ".join(w))
    for t in (None, "", " \n", "one two", "a b c " * 40, text(9000)):
        add(t, lang="fr")
    return docs, labels


def quality_rules(docs, labels):
    rows, marks = {}, {d: q >= 1 for d, q, _ in labels}
    for d in docs:
        n, chars, symbols, dup, repeat = literal(d.text)
        lines = sum(bool(WORD.search(x)) for x in (d.text or "").split("\n"))
        share = lambda a, b: a / b if b else 0.0
        rows[d.doc_id] = (d.lang, n < 50 or 100 * repeat > 50 * n, dict(zip(GRID, (share(symbols, chars), share(dup, lines), share(repeat, n), share(chars, n)), strict=True)))
    cells = []
    for lang in {lang for lang, _, _ in rows.values()}:
        held = [(s, marks[d]) for d, (own, failed, s) in rows.items() if own == lang and not failed and d in marks]
        good, bad = [s for s, g in held if g], [s for s, g in held if not g]
        for rule, cuts in GRID.items():
            for c in cuts if held else ():
                k, kb = sum(s[rule] >= c for s in good), sum(s[rule] >= c for s in bad)
                gain = round(kb / max(1, len(bad)) - 10 * k / max(1, len(good)), 9)
                cells.append((tail(k, len(good), 0.05 / 4), lang is not None, lang or "", rule, -c, gain))
    best = {}
    for i, (p, _, lang, rule, c, gain) in enumerate(sorted(cells)):
        if p > 0.05 / (len(cells) - i):
            break
        if gain > 0:
            best[lang, rule] = max(best.get((lang, rule), (0, 0)), (gain, -c))
    assert best  # the fixture certifies a cutoff
    return {d for d, (lang, failed, s) in rows.items() if not failed and not any(s[r] >= best.get((lang or "", r), (0, math.inf))[1] for r in GRID)}


def line_dedup(docs):
    lines = sorted({x for d in docs for x in (d.text or "").split("\n") if WORD.search(x)})
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    letters = sorted(set("".join(lines)))
    counts = np.array([[x.count(c) for c in letters] for x in lines])
    for i, a in enumerate(lines):
        for j in np.flatnonzero(np.abs(counts[i + 1 :] - counts[i]).sum(axis=1) <= 4) + i + 1:
            b = lines[j]
            most = min(2, min(len(a), len(b)) // 12)
            if abs(len(a) - len(b)) <= most and distance(a, b) <= most:
                root[find(a)] = find(b)
    where, longest = defaultdict(set), Counter()
    for d in docs:
        for x in (d.text or "").split("\n"):
            if x in root:
                where[find(x)].add(d.doc_id)
                longest[find(x)] = max(longest[find(x)], len(x))
    out = {}
    for d in docs:
        seen, kept = set(), []
        for x in (d.text or "").split("\n"):
            if x in root:
                c = find(x)
                if c in seen or (len(where[c]) >= 8 or longest[c] >= 64) and d.doc_id != min(where[c]):
                    continue
                seen.add(c)
            kept.append(x)
        out[d.doc_id] = None if d.text is None else "\n".join(kept)
    return out


def mixing(docs):
    sizes, own = Counter(), defaultdict(list)
    for d in docs:
        t = d.text or ""
        h = xxhash.xxh64_intdigest(t.encode(), xxhash.xxh64_intdigest(d.doc_id.to_bytes(8, "little"), 42))
        other = sum(c in "#*$%&|<>=+_~^{}[]0123456789" for c in t)
        key = (((h >> 11) + 0.5) / (1 << 53)) ** (1 / (2 - (other / len(t) if t else 1)))
        words = WORD.findall(t)
        sizes[d.source] += len(words)
        own[d.source].append((-key, d.doc_id, t, words))
    target, out = water(sizes), []
    for source, rows in own.items():
        epochs = int(target[source] // sizes[source]) if sizes[source] else 0
        room = math.floor(target[source] - epochs * sizes[source] + 0.5)
        for _, doc, t, words in sorted(rows):
            part = min(room, len(words))
            room -= part
            taken = epochs * len(words) + part
            out += [(doc, t)] * (taken // max(1, len(words)))
            if words and taken % len(words):
                out.append((doc, " ".join(words[: taken % len(words)])))
    return Counter(out)


def test_stages_against_brute_force(spark, tmp_path, monkeypatch):
    docs, labels = fixture()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, _key string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = {}

    def kept(name, stage):
        def run(spark, docs, sf_dir):
            seen[name] = docs.collect()
            return stage(spark, docs, sf_dir)

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [kept(*s) for s in corpus_pipeline.STAGES])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert list(seen) == ["quality_rules", "line_dedup", "near_dedup", "mixing", "packing"]
    given, passed, lines, one, mixed = seen.values()
    assert len(given) == len(docs) and all(rows[0].__fields__ == given[0].__fields__ for rows in seen.values())

    pick = lambda rows: sorted(tuple(r)[:2] for r in rows)
    ids = quality_rules(given, labels)
    assert pick(passed) == pick([d for d in given if d.doc_id in ids]) and 0 < len(passed) < len(given) - 40
    text = line_dedup(passed)
    assert {d.doc_id: d.text for d in lines} == text and any(text[d.doc_id] != d.text for d in passed)
    assert all(d.n_chars == len(d.text) for d in lines if text[d.doc_id] is not None)
    first = test_near_dedup.brute([(d.doc_id, d.text) for d in lines], 80)
    assert pick(one) == pick([d for d in lines if first[d.doc_id][1] == d.doc_id]) and len(one) < len(lines)
    assert Counter((d.doc_id, d.text) for d in mixed) == mixing(one)
    test_packing.check(packed, mixed, 2048)


CLASH = "_key string, _part int, _n int, _size long, _mine string, _mark int, _id long, _dk int, _drop int, _cls string, dk int, n_lines int, h long, row long, shard int, cls string, component string, kept int, n_words int, stratum string"


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_clashing_columns_and_empty_tables(spark, sf, name, stage):
    """Columns that have the helpers' names come out as they went in; an empty table gives an empty result."""
    hard = nasty(spark)
    extra = [x.split() for x in CLASH.split(", ")]
    values = [F.lit("7").cast(kind).alias(c) for c, kind in extra]
    wide = hard.select("*", *values).unionByName(hard.where("doc_id = 8").withColumn("text", F.lit(" ".join(f"w{i}" for i in range(60)))).select("*", *values))
    out, plain = stage(spark, wide, sf), stage(spark, wide.select(*hard.columns), sf)
    if name != "packing":
        assert out.dtypes == wide.dtypes
        assert sorted(map(str, out.select(*hard.columns).collect())) == sorted(map(str, plain.collect()))
        assert all(r[c] == ("7" if kind == "string" else 7) for r in out.collect() for c, kind in extra)
    else:
        key = lambda r: (str(r.doc_id), r.doc_tokens, r.start, r.ids_crc32)
        assert len(out.collect()) >= 13 and out.dtypes == plain.dtypes and sum(r.length for r in out.collect()) == sum(r.length for r in plain.collect())
        assert {key(r)[:2] for r in out.collect()} == {key(r)[:2] for r in plain.collect()}
    empty = stage(spark, spark.createDataFrame([], DOCS), sf)
    assert empty.count() == 0 and (name == "packing" or empty.columns == [c.split()[0] for c in DOCS.split(", ")])


def test_stages(spark, sf):
    docs = documents(spark, sf)
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mixing", "packing"]
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
    rows = out.collect()
    assert 0 < len({r.doc_id for r in rows}) <= before
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
