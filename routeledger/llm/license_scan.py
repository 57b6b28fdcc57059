"""Licence notices in texts: Dice coefficient over word bigrams against templates, in DataFrame expressions.

Units of a text are its lines, and its paragraphs of several lines.  Units and
templates are lower-cased, reduced to letter and digit words and compared as sets of
adjacent word pairs: dice = 2 * common / (unit + template).  Two bounds prune before any
pair is made:

* dice >= t needs sizes within t / (2 - t) of each other, so a unit meets only
  templates of about its size;
* dice >= t needs t / (2 - t) of the template's pairs, so out of any larger rest of
  them one must occur: the ``anchors`` are the rarest words of such a rest, and a
  text without any of these words is done after one regular expression.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Public licence texts by SPDX identifier, as notices, as paragraphs and (in comments without blank lines) whole.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MIT", "Released under the MIT License"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS'
_MIT = ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        _AS_IS + " OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_ISC = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.')
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.')
_APACHE = ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
           "http://www.apache.org/licenses/LICENSE-2.0",
           'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.')
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
_UNLICENSE = ("This is free and unencumbered software released into the public domain.",
              "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
              "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.")


def _gnu(name: str, title: str, version: str, date: str) -> list[tuple[str, str]]:
    """The title of a GNU licence's text, and the header of files under it."""
    what = "library" if version == "2.1" else "program"
    full = f"GNU {title}General Public License"
    header = (f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {full} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
              f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {full} for more details.",
              f"You should have received a copy of the {full} along with this {what}. If not, see <https://www.gnu.org/licenses/>.")
    return [(name, f"{full} Version {version}, {date}"), (name, header[0]), (name, " ".join(header))]


TEMPLATES = [
    *NOTICES,
    *(("MIT", t) for t in (*_MIT, " ".join(_MIT))),
    *(("ISC", t) for t in (*_ISC, " ".join(_ISC))),
    ("BSD-2-Clause", " ".join((*_BSD[:3], _BSD[4]))), ("BSD-3-Clause", _BSD[3]), ("BSD-3-Clause", " ".join(_BSD)),
    *(("Apache-2.0", t) for t in ("Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", _APACHE[0], _APACHE[2], " ".join(_APACHE))),
    *_gnu("GPL-2.0", "", "2", "June 1991"), *_gnu("GPL-3.0", "", "3", "29 June 2007"), *_gnu("AGPL-3.0", "Affero ", "3", "19 November 2007"),
    *_gnu("LGPL-2.1", "Lesser ", "2.1", "February 1999"), *_gnu("LGPL-3.0", "Lesser ", "3", "29 June 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"), ("MPL-2.0", _MPL),
    *(("Unlicense", t) for t in _UNLICENSE[1:]),
]
#: dice >= THRESHOLD[0] / THRESHOLD[1].
THRESHOLD = (4, 5)


#: Short words that are as rare as words longer by so many letters.
_RARE = {"cc": 9, "cc0": 9, "gnu": 9, "mpl": 9, "apache": 9, "bsd": 9, "mozilla": 9}


def _words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def _pairs(text: str) -> set[str]:
    w = _words(text)
    return {f"{a} {b}" for a, b in itertools.pairwise(w)}


def anchors(templates: list[tuple[str, str]], threshold: tuple[int, int]) -> list[str]:
    """Words of which every text at the threshold holds one: of each template, words (the longest
    and those chosen before first) that stand in more of its pairs than may be missing."""
    num, den = threshold
    out: set[str] = set()
    for _, t in sorted(templates, key=lambda x: (len(x[1]), x)):
        pairs = {p: p.split() for p in _pairs(t)}
        may_miss = len(pairs) - -(-len(pairs) * num // (2 * den - num))
        left = [p for p in pairs.values() if not out & set(p)]
        for w in sorted(set(_words(t)) - out, key=lambda w: (not w.isalpha(), -len(w) - _RARE.get(w, 0), w)):
            if len(pairs) - len(left) > may_miss:
                break
            out.add(w)
            left = [p for p in left if w not in p]
    return sorted(out)


def _template_frame(spark: SparkSession, templates) -> DataFrame:
    """(licence, pairs, n): a handful of rows."""
    rows = [(name, sorted(_pairs(t)), len(_pairs(t))) for name, t in templates]
    return spark.createDataFrame(rows, "licence string, pairs array<string>, n int")


def licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One row per document row: doc_id, licences (names by order, comma-joined), n_units, best_licence, best_dice.

    n_units counts units at the threshold (a unit counts for its best template; ties go to
    the first name), best_* are of the best unit (ties: first name).  Without a match:
    empty names, 0 units and a null best_dice.  Null and empty texts match nothing.
    Repeated rows are judged one by one; an empty table gives no rows.
    """
    templates, (num, den) = templates or TEMPLATES, threshold
    spark = docs.sparkSession
    hint = r"(?<![a-z0-9])(?:" + "|".join(anchors(templates, threshold)) + r")(?![a-z0-9])"
    text = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    # Only texts with an anchor are cut up; what follows stays within the document's row, so no row number is needed.
    low, high = min(len(_pairs(t)) for _, t in templates), max(len(_pairs(t)) for _, t in templates)
    paragraphs = F.filter(F.split("t", r"\n[\t\x0B\f\r ]*\n"), lambda p: F.instr(p, "\n") > 0)
    units = F.concat(F.split("t", "\n"), paragraphs)
    units = F.filter(units, lambda u: u.rlike(hint))
    words = F.transform(units, lambda u: F.filter(F.split(u, "[^a-z0-9]+"), lambda w: w != ""))
    fits = F.filter(words, lambda w: (F.size(w) - 1) * (2 * den - num) >= low * num)
    sets = F.transform(fits, lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1)))))
    sets = F.filter(sets, lambda s: F.size(s) * num <= (2 * den - num) * high)
    frame = _template_frame(spark, templates)
    all_templates = frame.agg(F.sort_array(F.collect_list(F.struct("licence", "n", "pairs"))).alias("templates"))
    rows = base.select("doc_id", F.when(F.col("t").rlike(hint), sets).otherwise(F.array().cast("array<array<string>>")).alias("sets"))
    rows = rows.crossJoin(F.broadcast(all_templates))  # one row: the templates

    def best(s):
        near = F.filter("templates", lambda t: (t.n * num <= F.size(s) * (2 * den - num)) & (F.size(s) * num <= t.n * (2 * den - num)))
        told = F.transform(near, lambda t: F.struct((-2 * F.size(F.array_intersect(s, t.pairs)) / (F.size(s) + t.n)).alias("d"), t.licence.alias("licence")))
        return F.array_min(F.filter(told, lambda x: -x.d * den >= num))

    found = F.filter(F.transform("sets", best), lambda x: x.isNotNull())
    rows = rows.select("doc_id", found.alias("found"))
    top = F.array_min("found")
    return rows.select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x.licence))), ",").alias("licences"),
                       F.size("found").cast("long").alias("n_units"), top.licence.alias("best_licence"), (-top.d).alias("best_dice"))


def oracle_sql(templates: list[tuple[str, str]] | None = None, threshold: tuple[int, int] = THRESHOLD) -> str:
    """DuckDB SQL of ``licenses``: every unit against every template, nothing pruned."""
    num, den = threshold
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in templates or TEMPLATES)
    pairs = ("list_distinct(list_transform(generate_series(1, len({w}) - 1), lambda i: {w}[i] || ' ' || {w}[i + 1]))")
    words = "list_filter(regexp_split_to_array(lower({t}), '[^a-z0-9]+'), lambda w: w <> '')"
    return f"""
with templates as (select licence, {pairs.format(w='ws')} as ps from (select licence, {words.format(t='t')} as ws from (values {values}) v(licence, t))),
units as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as u from documents
  union all
  select doc_id, u from (select doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\\n[\\t\\x0B\\f\\r ]*\\n')) as u from documents) where contains(u, chr(10))),
sets as (select doc_id, row_number() over () as unit, {pairs.format(w='ws')} as ps from (select doc_id, {words.format(t='u')} as ws from units) where len(ws) > 1),
scored as (select doc_id, unit, licence, 2.0::double * len(list_intersect(s.ps, t.ps)) / (len(s.ps) + len(t.ps)) as dice from sets s, templates t),
best as (select doc_id, unit, licence, dice from (select *, row_number() over (partition by unit order by dice desc, licence) as r from scored where dice * {den} >= {num}) where r = 1),
told as (select doc_id, string_agg(distinct licence, ',' order by licence) as licences, count(*) as n_units, max(dice) as best_dice from best group by doc_id),
tops as (select doc_id, min(licence) as best_licence from best join told using (doc_id) where best.dice = told.best_dice group by doc_id)
select d.doc_id, coalesce(licences, '') as licences, cast(coalesce(n_units, 0) as bigint) as n_units, best_licence, best_dice
from documents d left join told using (doc_id) left join tops using (doc_id)
"""
