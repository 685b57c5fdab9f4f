"""Operator 7, licence scans: normalised text against licence templates by Dice coefficient over word bigrams.

In Spark expressions only.  Units are the lines of a text, the text as a whole and runs of its words; a unit's bigram set is
compared with a template's only where the sizes allow the threshold: 2|A and B| / (|A| + |B|) >= t needs |A| between
t/(2-t) |B| and (2-t)/t |B|.  Templates are notices and whole licence texts, given as a table of (licence, text).

Runs of words may begin and end anywhere, so wrapped and embedded licences are found.  Taking in a neighbouring bigram of the
template never lowers a run's Dice value, so only runs that begin and end with a maximal stretch of the template's bigrams are
compared; the space between first and last stretch is at most (2-t)/t times the template's bigrams.  Of overlapping runs for
a template the best counts (of equal ones the earlier, then the shorter).  Only texts that hold t/(2-t) of a template's
bigrams are searched for it.

Words: maximal runs of digits, a-z and characters beyond ASCII in the lower-cased text.

Defined cases: a null or empty text has no match (licence null, dice 0); a run's unit is the line it begins in; of equal Dice
values the smaller licence name, then the whole text (unit 0), then the earlier line is reported; repeated rows give repeated
results; an empty table gives an empty result; other columns are ignored; a very long text is handled whole by one task.
"""

from __future__ import annotations

import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Public licence notices and the opening parts of texts; SQL states the result for these.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Complete licence texts.
TEXTS: list[tuple[str, str]] = [(p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]
#: A Dice value from which a unit counts as the licence's.
THRESHOLD = 0.8
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _BETWEEN), lambda w: w != "")


def _pairs(words: Column) -> Column:
    """Bigrams of an array of words, in order."""
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(pairs, lambda p: p.isNotNull())


def _bigrams(words: Column) -> Column:
    """Distinct bigrams of an array of words."""
    return F.array_distinct(_pairs(words))


def _runs(licence: str, grams: list[str], length: int, threshold: float) -> tuple[str, str]:
    """SQL of (whether the bigrams ``hits`` allow the template, its best runs in ``seq``: licence, dice, unit)."""
    known = "({})".format(", ".join(f"'{g}'" for g in grams))
    need, span = math.ceil(len(grams) * threshold / (2 - threshold) - 1e-9), math.ceil(length * (2 - threshold) / threshold)
    at = "filter(transform(pos, (p, i) -> struct(p AS p, i AS i)), x -> {})"
    found = f"""filter(transform(flatten(transform(r.s, (a, i) -> transform(
          filter(transform(slice(r.e, i + 1, {span // 2 + 2}), (e, j) -> struct(e.p AS p, e.i AS i, get(r.s, i + j).p AS begin)),
                 e -> e.begin - get(r.e, i).p <= {span} AND e.i - a.i + 1 >= {need}),
          e -> struct(a.p AS a, e.p AS b)))),
        w -> get(transform(array(array_distinct(slice(seq, w.a + 1, w.b - w.a + 1))),
          u -> struct(-(size(filter(u, g -> g IN {known})) * 2.0D / (size(u) + {len(grams)})) AS d, w.a AS a, w.b AS b)), 0)),
      m -> -m.d >= {threshold}D)"""
    best = f"""aggregate(array_sort({found}), CAST(array() AS array<struct<d: double, a: int, b: int>>),
      (kept, w) -> if(exists(kept, k -> k.a <= w.b AND w.a <= k.b), kept, concat(kept, array(w))))"""
    unit = "aggregate(lines, struct(0 AS n, 1 AS k), (s, l) -> struct(s.n + size(l) AS n, s.k + if(s.n + size(l) <= w.a, 1, 0) AS k), s -> s.k)"
    return f"size(filter(hits, g -> g IN {known})) >= {need}", f"""get(transform(array(filter(transform(seq, (g, i) -> if(g IN {known}, i, -1)), i -> i >= 0)), pos ->
      get(transform(array(struct({at.format("x.i = 0 OR get(pos, x.i - 1) < x.p - 1")} AS s, {at.format("x.i = size(pos) - 1 OR get(pos, x.i + 1) > x.p + 1")} AS e)), r ->
        transform({best}, w -> struct(-w.d AS dice, '{licence.replace("'", "''")}' AS license, {unit} AS unit))), 0)), 0)"""


def license_matches(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, license, dice, unit (0: whole text, k: k-th line or a run that begins there),
    n_matches, licenses."""
    rows = []
    for name, text in [*TEMPLATES, *TEXTS] if templates is None else templates:
        w = [x for x in re.split(_BETWEEN, text.lower()) if x]
        if grams := list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))):
            rows.append((name, grams, len(w) - 1))
    narrow, wide = threshold / (2 - threshold), (2 - threshold) / threshold
    listed = lambda g: "array({})".format(", ".join(f"'{x}'" for x in g))
    known = F.array(*(F.struct(F.lit(n).alias("license"), F.expr(listed(g)).alias("grams"), F.lit(len(g)).alias("size")) for n, g, _ in rows))
    least = max(1, int(min(len(g) for _, g, _ in rows) * narrow))
    lines = F.transform(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n"), _words)
    split = docs.select("doc_id", lines.alias("lines")).select("doc_id", "lines", _pairs(F.flatten("lines")).alias("seq"))
    # a set of bigrams has one fewer than the words at most
    sized = F.filter(F.transform("lines", lambda w, i: F.struct((i + 1).cast("int").alias("unit"), w.alias("words"))), lambda u: F.size(u["words"]) > least)
    whole = F.filter(F.array(F.struct(F.lit(0).alias("unit"), F.array_distinct("seq").alias("grams"))), lambda u: F.size(u["grams"]) >= least)
    units = F.concat(whole, F.transform(sized, lambda u: F.struct(u["unit"].alias("unit"), _bigrams(u["words"]).alias("grams"))))
    every = ", ".join(f"'{g}'" for g in dict.fromkeys(x for _, g, _ in rows for x in g))
    with_grams = split.select("doc_id", "lines", "seq", units.alias("units"), F.expr(f"array_distinct(filter(seq, g -> g IN ({every})))").alias("hits"))

    def against(u: Column) -> Column:
        n = F.size(u["grams"])
        near = F.filter(known, lambda t: (n >= t["size"] * F.lit(narrow)) & (n <= t["size"] * F.lit(wide)))
        return F.transform(near, lambda t: F.struct(
            (F.size(F.array_intersect(u["grams"], t["grams"])) * F.lit(2.0) / (n + t["size"])).alias("dice"), t["license"].alias("license"), u["unit"].alias("unit")))

    none = "CAST(array() AS array<struct<dice: double, license: string, unit: int>>)"
    runs = [F.expr(f"if({fits}, {best}, {none})") for fits, best in (_runs(n, g, k, threshold) for n, g, k in rows)]
    same = F.filter(F.flatten(F.transform("units", against)), lambda m: m["dice"] >= threshold)
    found = with_grams.select("doc_id", F.concat(same, *runs).alias("found"))
    best = F.get(F.array_sort("found", lambda a, b: (
        F.when(a["dice"] != b["dice"], F.when(a["dice"] > b["dice"], -1).otherwise(1))
        .when(a["license"] != b["license"], F.when(a["license"] < b["license"], -1).otherwise(1))
        .otherwise(a["unit"] - b["unit"]))), F.lit(0))
    return found.select(
        "doc_id", best["license"].alias("license"), F.coalesce(best["dice"], F.lit(0.0)).alias("dice"), best["unit"].alias("unit"),
        F.size(F.array_distinct(F.transform("found", lambda m: m["unit"]))).cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda m: m["license"]))), ",").alias("licenses"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(read(spark, sf_dir, "documents"))


def _sql() -> str:
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES)
    grams = lambda w: f"list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
    words = lambda t: f"list_filter(string_split_regex(lower({t}), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    return f"""
WITH raw(license, text) AS (VALUES {values}),
tw AS (SELECT license, {words("text")} AS w FROM raw), t AS (SELECT license, {grams("w")} AS g FROM tw),
u AS (SELECT doc_id, 0 AS unit, {words("text")} AS w FROM documents UNION ALL
      SELECT doc_id, i::INT AS unit, {words("lines[i]")} AS w FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents) x, unnest(range(1, len(lines) + 1)) AS r(i)),
s AS (SELECT doc_id, unit, {grams("w")} AS g FROM u WHERE len(w) > 1),
m AS (SELECT doc_id, unit, license, len(list_intersect(s.g, t.g)) * 2.0::DOUBLE / (len(s.g) + len(t.g)) AS dice FROM s JOIN t
      ON len(s.g) BETWEEN len(t.g) * {THRESHOLD / (2 - THRESHOLD)} AND len(t.g) * {(2 - THRESHOLD) / THRESHOLD}),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, license, unit) AS place FROM m WHERE dice >= {THRESHOLD}),
a AS (SELECT doc_id, count(DISTINCT unit) AS n_matches, array_to_string(list_sort(list_distinct(list(license))), ',') AS licenses FROM k GROUP BY doc_id)
SELECT d.doc_id, k.license, coalesce(k.dice, 0)::DOUBLE AS dice, k.unit, coalesce(a.n_matches, 0) AS n_matches, coalesce(a.licenses, '') AS licenses
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id AND k.place = 1 LEFT JOIN a ON a.doc_id = d.doc_id
"""


SQL = _sql()
