import random

from strandlake.llm import license_scan as L

from .data import nasty, nothing


def literal(text, p):
    """The scan by plain loops."""
    import re

    parts = [L.normal(s) for s in re.split(L.ENDS, text or "")]
    known, found = p.known(), []
    for at, s in enumerate(x for x in parts if x):
        if s in known:
            found.append((at, known[s]))
    out, i = [], 0
    while i < len(found):
        for name, ids in p.ordered():
            part = found[i : i + len(ids)]
            if [x[1] for x in part] == ids and part[-1][0] - part[0][0] < p.span:
                break
        else:
            name, part = f"sentence:{found[i][1]}", found[i : i + 1]
        out.append((name, part[0][0], part[-1][0]))
        i += len(part)
    return out


def test_against_loops(spark):
    random.seed(2)
    sentences = [s for all_ in L.SENTENCES.values() for s in all_]
    texts = [None, "", "No licence here."]
    for _ in range(150):
        parts = [random.choice(sentences) if random.random() < 0.7 else "Something else, entirely" for _ in range(random.randint(1, 40))]
        texts.append("".join(p.upper() + random.choice([". ", ".\n", "; ", "\n", "!  "]) for p in parts))
    for _, ids in L.RULES:
        texts.append("x. " + ".\n filler words.\n".join(L.SENTENCES[i][0] for i in ids) + ".")
    p = L.Scan()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.license, r.first, r.last) for r in L.scan(docs).collect())
    assert got == sorted((i, *m) for i, t in enumerate(texts) for m in literal(t, p))
    assert {r[1] for r in got} >= {name for name, _ in L.RULES}


def test_every_known_sentence_has_a_hint():
    import re

    assert all(re.search(L.HINT, s) for all_ in L.SENTENCES.values() for s in all_ if "CC " not in s or "icensed" in s)


def test_nasty(spark):
    assert L.scan(nasty(spark)).count() == 0 and L.scan(nothing(spark)).count() == 0
    twice = spark.createDataFrame([(1, "MIT License"), (1, "MIT License"), (None, "All rights reserved.")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.license, r.first, r.last) for r in L.scan(twice).collect())
    assert got == [("1", "MIT", 0, 0)] * 2 + [("None", "LicenseRef-proprietary", 0, 0)]


def test_wrapped_licences(spark):
    """MIT, BSD and GPL texts wrapped at 72 columns, as they are and in comments."""
    import textwrap

    def text(rule, mark, number=False):
        ids = [i for name, i in L.RULES if name == rule][0]
        out = ["Copyright (c) 2020 Someone."]
        for k, i in enumerate(ids):
            s = L.SENTENCES[i][0] if i != "gpl_hope" else "; ".join(L.SENTENCES[i])
            s = f"{k}. {s}" if number and k else s
            out += [*textwrap.wrap(s if s.endswith(":") or i == "mit_name" else s + ".", 72), ""]
        return "\n".join(f"{mark}{x}".rstrip() for x in out)

    rules, marks = ["MIT", "BSD-3-Clause", "BSD-2-Clause", "GPL-3.0-or-later"], ["", " * ", "# ", "// "]
    rows = [(i, text(rule, mark, "BSD" in rule)) for i, (rule, mark) in enumerate((r, m) for r in rules for m in marks)]
    got = {}
    for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.last > r.first))
    for i, _ in rows:
        assert got[i][0] == (rules[i // 4], True) and [x for x, _ in got[i][1:]] in ([], ["sentence:gpl_hope"]), (i, got[i])


def test_joining_needs_whole_sentences(spark):
    texts = ["The MIT. License", "The MIT\n\nLicense (MIT)", "not the MIT\nLicense", "MIT\nLicense plates"]
    assert L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count() == 0


def test_texts_wrapped_and_commented(spark):
    """Rules of several sentences and of one, each wrapped at 70 columns, plain and behind comment marks."""
    import textwrap

    texts, want = [], []
    for name, ids in L.RULES:
        if "spdx" in ids[0] or len({n for n, other in L.RULES if other[0] == ids[0] and len(other) > len(ids)}):
            continue
        whole = ""
        for i in ids:
            sentence = L.SENTENCES[i][0].rstrip(":.")
            whole += sentence + ("; " if i.endswith(("_free", "_terms")) and len(ids) > 2 and i not in ("unlicense_free",) else ". ")
        for mark in ("", "# ", " * ", "// "):
            texts.append("Some words before.\n" + "\n".join(mark + x for x in textwrap.wrap(whole, 70)) + "\nThe end")
            want.append(name)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in L.scan(docs).collect():
        got.setdefault(r.doc_id, []).append(r.license)
    assert len(set(want)) >= 20
    assert [(i, got.get(i)) for i in range(len(want)) if got.get(i) != [want[i]]] == []
    spdx = spark.createDataFrame([(i, f"x = 1  # before\n// SPDX-License-Identifier: {x}\nint y;") for i, x in enumerate(L.SPDX)], "doc_id long, text string")
    assert {r.doc_id: r.license for r in L.scan(spdx).collect()} == dict(enumerate(L.SPDX))
