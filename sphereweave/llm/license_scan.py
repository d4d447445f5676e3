"""License scans (native).

Text is normalised (A-Z lowered, words `[a-z0-9.]`, dots at a word's end dropped) and compared with licence
templates by the Dice coefficient over sets of word bigrams. Compared are, of each text,

* its units: the whole text, its paragraphs and its lines, and
* windows, for notices that stand among other words: from every place where a bigram of a template begins, as many
  words as that template has (fewer at the text's end), with that template alone.

Size bounds prune first: a Dice of t needs a set size between t/(2-t) and (2-t)/t times the template's, and at least
one bigram of any template, and one of the words that no match can do without; all are exact, so nothing that reaches t is lost.

The template list is a parameter; templates are literals of the plan, at most GROUP of them in one expression, and a longer list
takes several expressions over the same texts: no join, no shuffle of texts, one pass.

Edge cases: null or empty text matches nothing; a unit of one word has the set of that one
word; a template without words matches nothing; repeated rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, table

GROUP = 100

_AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
          "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
          "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_BSD_TERMS = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
              "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
              "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.")
_BSD_NAME = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.")
_BSD_AS_IS = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
              "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
              "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON "
              "ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_GNU = ("is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version.")

#: Public notices of common licences, and the full texts of the short ones (id, text).
TEMPLATES = [
    ("AGPL-3.0", "This program " + _GNU.format("Affero General Public License", "3")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
     'http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
     'CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", _BSD_TERMS + " " + _BSD_AS_IS),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", _BSD_TERMS + " " + _BSD_NAME + " " + _BSD_AS_IS),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program " + _GNU.format("General Public License", "3")),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This library " + _GNU.format("Lesser General Public License", "3")),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, '
     "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]


def _py_words(text: str) -> list[str]:
    return [x for x in (re.sub(r"\.+$", "", y) for y in re.split(r"[^a-z0-9.]+", text.lower())) if x]


def _py_bigrams(text: str) -> list[str]:
    w = _py_words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])} or set(w))


def anchors(sets: list[tuple[str, list[str]]], t: float) -> list[str]:
    """Words of which a unit that reaches t holds one at least: it shares t/(2-t) of a template's
    bigrams, so once the bigrams without a chosen word are fewer than that, one chosen word is there. Chosen are words that cover most in all
    templates together, long ones first, as short ones stand in every text."""
    left = [({g: set(g.split(" ")) for g in b}, len(b) * t / (2 - t) - 1e-9) for _, b in sets]
    out: set[str] = set()
    for least in (7, 5, 1):
        while left := [(g, need) for g, need in left if len(g) >= need]:
            gain: dict[str, float] = {}
            for g, need in left:
                for ws in g.values():
                    for w in ws:
                        if len(w) >= least:
                            gain[w] = gain.get(w, 0) + 1 / (len(g) - need + 1)
            if not gain:
                break
            word = max(gain, key=lambda w: (gain[w], w))
            out.add(word)
            left = [({k: ws for k, ws in g.items() if word not in ws}, need) for g, need in left]
    return sorted(out)


def _words(unit: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(ascii_lower(unit), r"\.+(?=[^a-z0-9.]|$)", ""), "[^a-z0-9.]+"), "")


def _grams(w: Column) -> Column:
    two = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))
    return F.array_distinct(F.when(F.size(w) > 1, two).otherwise(w))


def license_matches(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """Per row of docs: doc_id and matches, array of (id, dice, unit) of every unit and
    template with Dice >= threshold, sorted and distinct; a window's unit is its normalised words."""
    known = [(i, len(_py_words(t)), b) for i, t in templates if (b := _py_bigrams(t))]
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = [_matches(text, known[a: a + GROUP], float(threshold)) for a in range(0, len(known), GROUP)]
    if not parts:
        parts = [F.array().cast("array<struct<id:string,dice:double,unit:string>>")]
    return docs.select("doc_id", F.array_sort(F.array_distinct(F.concat(*parts) if len(parts) > 1 else parts[0])).alias("matches"))


def _matches(text: Column, known: list[tuple[str, int, list[str]]], t: float) -> Column:
    low = min(len(b) for *_, b in known) * t / (2 - t)
    high = max(len(b) for *_, b in known) * (2 - t) / t
    all_grams = sorted({x for *_, b in known for x in b})
    some = F.array(*map(F.lit, all_grams))
    chosen = anchors([(i, b) for i, _, b in known], t)

    def has_anchor(u):
        low_ = F.lower(u)  # changes more than A-Z, which can only let more through
        out = F.lit(False)
        for w in chosen:
            out = out | F.contains(low_, F.lit(w))
        return out

    units = F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, r"\n[ \t\r]*\n"), F.array(text)))
    # a set of k bigrams needs k separators at least; cheap length tests come before any splitting
    units = F.filter(units, lambda u: (F.length(u) >= int(2 * low)) & has_anchor(u))
    sized = F.filter(F.transform(units, lambda u: F.struct(u.alias("u"), _words(u).alias("w"))), lambda s: F.size(s["w"]) >= low)
    sized = F.transform(sized, lambda s: F.struct(s["u"].alias("u"), _grams(s["w"]).alias("b")))
    sized = F.filter(sized, lambda s: (F.size(s["b"]) >= low) & (F.size(s["b"]) <= high) & F.arrays_overlap(s["b"], some))
    table_ = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(n).alias("n"), F.array(*map(F.lit, b)).alias("b")) for i, n, b in known])

    def against(s):
        n = F.size(s["b"])
        fit = F.filter(table_, lambda k: (n >= F.size(k["b"]) * (t / (2 - t))) & (n <= F.size(k["b"]) * ((2 - t) / t)))
        return F.transform(fit, lambda k: F.struct(
            k["id"].alias("id"),
            (F.lit(2.0) * F.size(F.array_intersect(s["b"], k["b"])) / (n + F.size(k["b"]))).alias("dice"),
            s["u"].alias("unit")))

    def windows(w):
        """Words from each place where a template's bigram begins (w: all words, once)."""
        gram = lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i))
        at = F.filter(F.sequence(F.lit(1), F.size(w) - 1), lambda i: gram(i).isin(all_grams))
        spots = F.transform(at, lambda i: F.struct(i.alias("i"), gram(i).alias("g")))

        def of(s):
            own = F.filter(table_, lambda k: F.array_contains(k["b"], s["g"]))
            cut_ = F.transform(own, lambda k: F.struct(k["id"].alias("id"), k["b"].alias("k"), F.slice(w, s["i"], k["n"]).alias("w")))
            cut_ = F.filter(cut_, lambda c: F.arrays_overlap(c["w"], F.array(*map(F.lit, chosen))))
            return F.transform(cut_, lambda c: _window(c, _grams(c["w"])))

        return F.flatten(F.transform(spots, of))

    def _window(c, grams):
        return F.struct(c["id"].alias("id"), (F.lit(2.0) * F.size(F.array_intersect(grams, c["k"])) / (F.size(grams) + F.size(c["k"]))).alias("dice"),
                        F.array_join(c["w"], " ").alias("unit"))

    # array(x) and flatten(transform()) hold the words once, however often a window looks at them
    found = F.flatten(F.transform(F.filter(F.array(_words(text)), lambda w: F.size(w) > 1), windows))
    every = F.filter(F.concat(F.flatten(F.transform(sized, against)), found), lambda m: m["dice"] >= t)
    return F.when(has_anchor(text), every).otherwise(F.array().cast("array<struct<id:string,dice:double,unit:string>>"))


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    m = license_matches(table(spark, sf_dir, "documents"))
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda x: x["id"])))
    best = F.aggregate("matches", F.lit(0.0), lambda a, x: F.greatest(a, x["dice"]))
    return m.select("doc_id", F.size("matches").cast("long").alias("n_matches"),
                    F.array_join(ids, ",").alias("licenses"), F.round(best, 9).alias("best_dice"))


def oracle() -> str:
    """op6_license_scan in SQL: every unit's and window's bigrams against the templates', without any pruning."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = [f"({k}, {quoted(i)}, {n}, {len(b)}, {quoted(g)})" for k, (i, n, b) in enumerate((i, len(_py_words(t)), _py_bigrams(t)) for i, t in TEMPLATES) for g in b]
    words = lambda c: f"""list_filter(list_transform(regexp_extract_all(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9.]+'),
  lambda x: regexp_replace(x, '\\.+$', '')), lambda x: x <> '')"""  # noqa: E731
    return rf"""
with known(k, id, words, size, gram) as (values {", ".join(rows)}),
d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
u as (select row_number() over () as uid, r, unit from (select distinct r, unit from (
  select r, unnest(string_split(t, chr(10)) || regexp_split_to_array(t, '\n[ \t\r]*\n') || [t]) as unit from d))),
w as (select uid, r, unit, {words("unit")} as w from u),
b as (select uid, r, unit, case when len(w) > 1 then list_distinct(list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))) else w end as b from w where len(w) > 0),
g as (select uid, r, unit, len(b) as n, unnest(b) as gram from b),
m as (select r, unit, id, cast(2 * count(*) as double) / (n + size) as dice from g join known using (gram) group by uid, r, unit, n, k, id, size),
dw as (select r, {words("t")} as w from d),
p as (select r, w, unnest(range(1, len(w))) as i from dw),
s as (select r, i, k, id, words, size, list_slice(w, i, i + words - 1) as w from p join known on gram = concat(w[i], ' ', w[i + 1])),
sg as (select distinct r, i, k, id, size, array_to_string(w, ' ') as unit, unnest(list_transform(range(1, len(w)), lambda j: concat(w[j], ' ', w[j + 1]))) as gram from s),
sn as (select r, i, k, id, size, unit, count(*) as n, count(*) filter ((k, gram) in (select (k, gram) from known)) as hits from sg group by all),
f0 as (select r, id, unit, dice from m union select r, id, unit, cast(2 * hits as double) / (n + size) from sn),
f as (select r, count(*) as n, string_agg(distinct id, ',' order by id) as ids, max(dice) as best from (select distinct * from f0 where dice >= cast(0.8 as double)) group by r)
select doc_id, cast(coalesce(n, 0) as bigint) as n_matches, coalesce(ids, '') as licenses, round(coalesce(best, 0), 9) as best_dice
from d left join f using (r)
"""
