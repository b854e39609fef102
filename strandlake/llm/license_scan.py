"""Operator 5: licence scan by sentence rules (native).

Known sentences that are wrapped over lines, with comment marks or without, are first joined to one line each: the words of
one, with other than letters and digits and one line feed at most between two of them. A joined sentence counts as one.

A text is split into sentences at line feeds, semicolons and sentence ends; each is normalised (ASCII lower case, every run
of other than letters and digits one space) and looked up among known licence sentences; the identifiers found, in the
order of the text and with unknown sentences left out, are matched against ordered rules, longer rules first, a
sentence counting for one rule only. ``span`` bounds how many sentences a rule may reach over, so that far-apart
sentences make no licence. What matches no rule is reported by its own sentence identifier as ``sentence:<id>``.

All of it happens within a row, without a shuffle; documents that hold none of the words that every known sentence holds one
of are settled by one search.

Nulls and blank texts have no match. Repeated rows are scanned each by itself; a sentence that occurs again can match
again. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, documents

# Known licence sentences, quoted from the licences themselves, and the identifiers of this scan.
SENTENCES = {
    "mit_name": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "The MIT License (MIT)", "MIT License"],
    "mit_grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    "mit_notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "as_is": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'],
    "apache_name": ["Licensed under the Apache License, Version 2.0", "Apache License, Version 2.0"],
    "apache_header": ['Licensed under the Apache License, Version 2.0 (the "License")'],
    "apache_may_not": ["you may not use this file except in compliance with the License"],
    "apache_obtain": ["You may obtain a copy of the License at"],
    "gpl3_name": ["This work is licensed under the GNU General Public License, version 3", "GNU General Public License, version 3"],
    "gpl2_name": ["This work is licensed under the GNU General Public License, version 2", "GNU General Public License, version 2"],
    "gpl_free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl_hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY", "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "cc_by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc_by_nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc_by_sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "bsd_grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd_source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd_binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd_endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "reserved": ["All rights reserved"],
    "isc_grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "bsd0_grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "disclaims": ['THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS'],
    "program_free": ["This program is free software"],
    "library_free": ["This library is free software"],
    "gpl_terms": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "lgpl_terms": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "v2_later": ["either version 2 of the License, or (at your option) any later version"],
    "v21_later": ["either version 2.1 of the License, or (at your option) any later version"],
    "v3_later": ["either version 3 of the License, or (at your option) any later version"],
    "lgpl3_free": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "agpl_free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "mpl_form": ["This Source Code Form is subject to the terms of the Mozilla Public License, v"],
    "epl_terms": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "boost_name": ["Distributed under the Boost Software License, Version 1.0", "Boost Software License - Version 1.0 - August 17th, 2003"],
    "unlicense_free": ["This is free and unencumbered software released into the public domain"],
    "unlicense_anyone": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"],
    "zlib_as_is": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib_event": ["In no event will the authors be held liable for any damages arising from the use of this software"],
    "zlib_grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "ofl_font": ["This Font Software is licensed under the SIL Open Font License, Version 1.1"],
    "eupl_name": ["Licensed under the EUPL", "Licensed under the European Union Public Licence"],
}
# Licence identifiers that files name in a line of their own.
SPDX = "MIT MIT-0 Apache-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later MPL-2.0 EPL-2.0 BSL-1.0 ISC 0BSD BSD-2-Clause BSD-3-Clause Unlicense Zlib CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 OFL-1.1 EUPL-1.2 Artistic-2.0 PostgreSQL WTFPL".split()
SENTENCES |= {f"spdx:{x}": [f"SPDX-License-Identifier: {x}"] for x in SPDX}

#: (licence, identifiers in order)
RULES = [
    ("MIT", ["mit_name", "mit_grant", "mit_notice", "as_is"]),
    ("MIT", ["mit_grant", "mit_notice", "as_is"]),
    ("MIT", ["mit_grant", "mit_notice"]),
    ("MIT", ["mit_name"]),
    ("Apache-2.0", ["apache_header", "apache_may_not", "apache_obtain"]),
    ("Apache-2.0", ["apache_header"]),
    ("Apache-2.0", ["apache_name"]),
    ("GPL-3.0-or-later", ["gpl_free", "gpl_hope"]),
    ("GPL-3.0-or-later", ["gpl_free"]),
    ("GPL-3.0-only", ["gpl3_name"]),
    ("GPL-2.0-only", ["gpl2_name"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("CC-BY-4.0", ["cc_by"]),
    ("CC-BY-NC-4.0", ["cc_by_nc"]),
    ("CC-BY-SA-4.0", ["cc_by_sa"]),
    ("CC0-1.0", ["cc0"]),
    ("LicenseRef-proprietary", ["reserved"]),
    ("ISC", ["isc_grant", "disclaims"]),
    ("ISC", ["isc_grant"]),
    ("0BSD", ["bsd0_grant", "disclaims"]),
    ("0BSD", ["bsd0_grant"]),
    ("GPL-2.0-or-later", ["program_free", "gpl_terms", "v2_later", "gpl_hope"]),
    ("GPL-2.0-or-later", ["program_free", "gpl_terms", "v2_later"]),
    ("GPL-3.0-or-later", ["program_free", "gpl_terms", "v3_later"]),
    ("LGPL-2.1-or-later", ["library_free", "lgpl_terms", "v21_later"]),
    ("LGPL-3.0-or-later", ["library_free", "lgpl_terms", "v3_later"]),
    ("LGPL-3.0-or-later", ["lgpl3_free"]),
    ("AGPL-3.0-or-later", ["agpl_free", "gpl_hope"]),
    ("AGPL-3.0-or-later", ["agpl_free"]),
    ("MPL-2.0", ["mpl_form"]),
    ("EPL-2.0", ["epl_terms"]),
    ("BSL-1.0", ["boost_name"]),
    ("Unlicense", ["unlicense_free", "unlicense_anyone"]),
    ("Unlicense", ["unlicense_free"]),
    ("Zlib", ["zlib_as_is", "zlib_event", "zlib_grant"]),
    ("OFL-1.1", ["ofl_font"]),
    ("EUPL-1.2", ["eupl_name"]),
] + [(x, [f"spdx:{x}"]) for x in SPDX]

#: Each known sentence holds one of these; a document with none needs no scan.
HINT = "(?i)licen[cs]e|copyright|software|permission|redistribut|reserved|warrant"
ENDS = r"\n|;|(?<=[.!?])[\x20\x09-\x0D]+"


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.translate(str.maketrans(UPPER, LOWER))).strip()


@dataclass(frozen=True)
class Scan:
    sentences: dict[str, list[str]] = field(default_factory=lambda: SENTENCES)
    rules: list[tuple[str, list[str]]] = field(default_factory=lambda: RULES)
    span: int = 24

    def known(self) -> dict[str, str]:
        return {normal(s): k for k, all_ in self.sentences.items() for s in all_}

    def ordered(self) -> list[tuple[str, list[str]]]:
        return sorted(self.rules, key=lambda r: -len(r[1]))


# Within a sentence: other than letters and digits, and no sentence's end.
INNER = r"(?:(?![.!?][\x20\x09-\x0D])[^A-Za-z0-9\n;])"


def wrapped(known: dict[str, str]) -> str:
    """A pattern of the known sentences (normalised) as whole sentences of a text, over one line or several."""
    gap = rf"(?:{INNER}++(?:\n{INNER}*+)?+|\n{INNER}*+)"
    one = "|".join(gap.join(s.split(" ")) for s in sorted(known, key=len, reverse=True))
    return rf"(?:^|(?<=[\n;])|(?<=[.!?][\x20\x09-\x0D])){INNER}*+(?i:{one})(?={INNER}*+(?:[\n;]|[.!?][\x20\x09-\x0D]|\z))"


def joined(text: Column, known: dict[str, str]) -> Column:
    """The text with its known sentences on one line each, normalised."""
    pattern = wrapped(known)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    plain = F.transform(found, lambda s: F.btrim(F.regexp_replace(F.translate(s, UPPER, LOWER), "[^a-z0-9]+", " ")))
    parts = F.zip_with(F.split(text, pattern, -1), plain, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
    return F.when(F.size(found) > 0, F.array_join(parts, "")).otherwise(text)


def identifiers(text: Column, known: dict[str, str]) -> Column:
    """array<struct<at int, id string>>: the known sentences of a text in order, ``at`` counting all its sentences."""
    table = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    normalised = F.transform(F.split(joined(text, known), ENDS), lambda s: F.btrim(F.regexp_replace(F.translate(s, UPPER, LOWER), "[^a-z0-9]+", " ")))
    filled = F.filter(normalised, lambda s: s != "")
    return F.filter(F.transform(filled, lambda s, i: F.struct(i.alias("at"), table[s].alias("id"))), lambda x: x["id"].isNotNull())


def matches(found: Column, p: Scan) -> Column:
    """array<struct<license, first, last>> from the identifiers of a text; each taken by one match."""

    # a match of a rule at position i: the identifiers from i on are the rule's, within the span
    def hits(rule_: list[str], i: Column) -> Column:
        ok = F.lit(True)
        for k, want in enumerate(rule_):
            ok = ok & (F.get(found, i + k)["id"] == F.lit(want))
        if len(rule_) > 1:
            ok = ok & (F.get(found, i + (len(rule_) - 1))["at"] - F.get(found, i)["at"] < p.span)
        return F.coalesce(ok, F.lit(False))

    # walking from the left, the first rule (longest first) that fits takes its identifiers
    choice = None
    for name, ids in reversed(p.ordered()):
        this = lambda i, name=name, ids=ids: F.struct(F.lit(name).alias("license"), F.lit(len(ids)).alias("n"))
        if choice is None:
            choice = lambda i, ids=ids, this=this: F.when(hits(ids, i), this(i)).otherwise(F.struct(F.concat(F.lit("sentence:"), F.get(found, i)["id"]).alias("license"), F.lit(1).alias("n")))
        else:
            choice = lambda i, ids=ids, this=this, after=choice: F.when(hits(ids, i), this(i)).otherwise(after(i))
    item = "array<struct<license:string,first:int,last:int>>"

    def step(state: Column, i: Column) -> Column:
        def take(c: Column) -> Column:
            row = F.struct(c["license"].alias("license"), F.get(found, i)["at"].alias("first"), F.get(found, i + c["n"] - 1)["at"].alias("last"))
            return F.struct((i + c["n"]).alias("next"), F.concat(state["out"], F.array(row)).cast(item).alias("out"))

        return F.when(i < state["next"], state).otherwise(F.get(F.transform(F.array(choice(i)), take), F.lit(0)))

    start = F.struct(F.lit(0).alias("next"), F.array().cast(item).alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda s: s["out"])


def scan(docs: DataFrame, params: Scan | None = None) -> DataFrame:
    """doc_id, license, first, last (numbers of the text's sentences), one row for each match."""
    p = params or Scan()
    d = docs.select("doc_id", "text").where(F.col("text").rlike(HINT)) if params is None else docs.select("doc_id", "text").where(F.col("text").isNotNull())
    d = d.select("doc_id", identifiers(F.col("text"), p.known()).alias("_found")).where(F.size("_found") > 0)
    return d.select("doc_id", F.explode(matches(F.col("_found"), p)).alias("m")).select("doc_id", "m.license", F.col("m.first").cast("long").alias("first"), F.col("m.last").cast("long").alias("last"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _oracle() -> str:
    """The same scan in SQL; it knows the rules that its tables can match: every subsequence is tried at every place."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({q(k)}, {q(v)})" for k, v in Scan().known().items())
    rules = ", ".join(f"({i}, {q(name)}, {len(ids)}, {q('|'.join(ids) + '|')})" for i, (name, ids) in enumerate(Scan().ordered()))
    return rf"""
WITH RECURSIVE known(s, id) AS (VALUES {known}),
rules(r, license, n, ids) AS (VALUES {rules}),
sent AS (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) - 1 AS pos FROM (
  SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(coalesce(text, ''), '([.!?])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), '\n|;'),
    lambda x: trim(regexp_replace(translate(x, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS p FROM documents)),
f AS (SELECT doc_id, pos, id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM sent JOIN known USING (s)),
seq AS (SELECT doc_id, list(id ORDER BY i) AS ids, list(pos ORDER BY i) AS ats FROM f GROUP BY doc_id),
fits AS (SELECT doc_id, ats, i, license, n FROM (SELECT doc_id, ids AS own, ats, unnest(range(1, len(ids) + 1)) AS i FROM seq), rules
  WHERE starts_with(array_to_string(own[i:i + n - 1], '|') || '|', rules.ids) AND len(own[i:i + n - 1]) = n AND (n = 1 OR ats[i + n - 1] - ats[i] < 24)
  QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY r) = 1),
pick AS (SELECT doc_id, i, coalesce(fits.license, 'sentence:' || f.id) AS license, coalesce(n, 1) AS n FROM f LEFT JOIN fits USING (doc_id, i)),
walk AS (SELECT doc_id, i, license, n FROM pick WHERE i = 1
  UNION ALL SELECT p.doc_id, p.i, p.license, p.n FROM walk w JOIN pick p ON p.doc_id = w.doc_id AND p.i = w.i + w.n)
SELECT w.doc_id, w.license, a.pos::BIGINT AS first, b.pos::BIGINT AS last FROM walk w
JOIN f a ON a.doc_id = w.doc_id AND a.i = w.i JOIN f b ON b.doc_id = w.doc_id AND b.i = w.i + w.n - 1
"""


ORACLE = _oracle()
