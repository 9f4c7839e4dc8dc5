"""Licence scans: normalised text against licence templates by Dice's coefficient over word bigrams.

Units are a text's lines and, if it has several, the whole text; where these are no licence and it is asked for, also
windows of words, over the borders of lines or inside a line. A unit of A distinct bigrams and a template of T can
reach a coefficient t only if A lies between T t / (2 - t) and T (2 - t) / t: templates outside these bounds are not
compared. Before that, texts and lines without any of a few words are passed over: the words are chosen so that a
unit without all of them can't reach t with any template. Only DataFrame functions run, and nothing is shuffled.

Windows start and end where a run of template bigrams does: any other window can be made better, or no worse, by moving
its ends there. They hold as many bigrams as the template's bounds allow, repeats counted as often as the template
repeats. A window with a line that is a licence itself counts only for another template with more in common, such as a
header whose first line is a notice; a text that is a licence as a whole has none. Of windows of one template that
overlap the one of the greatest coefficient counts, of those of several templates the one that has most in common.
Only texts that hold enough of a template's bigrams come this far.

Defined cases: null and empty texts and units of fewer than two words have no bigrams and no result; ties between
templates go to the greatest id; repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Published licence notices, as they are commonly quoted.
TEMPLATES: dict[str, str] = {
    "agpl-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "bsd-2-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "bsd-notice": "Released under the BSD License.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-4.0-short": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-sa-4.0-short": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "lgpl-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "mit-notice": "Released under the MIT License.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "public-domain-notice": "This work has been released into the public domain.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


# Words that most English texts hold; as conditions they would pass over nothing.
COMMON = frozenset("about also any been conditions copy each form from have into other part provided source such that their there these they this under version were when whether which will with without work would".split())


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template, sorted. Words are runs of a-z and 0-9 of the text in lower case."""
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def anchors(templates: dict[str, list[str]], least: float) -> list[str]:
    """Words of which any unit that reaches ``least`` with any template has one.

    A unit needs T t / (2 - t) of a template's T bigrams at least. For each template, words are added, common words last,
    those of most templates and then the longest first, until the bigrams without an added word are fewer than that.
    """
    said = Counter(w for grams in templates.values() for w in {w for g in grams for w in g.split()})
    chosen: list[str] = []
    for grams in sorted(templates.values(), key=len):
        need = len(grams) * least / (2 - least)
        left = lambda: [g for g in grams if not set(g.split()) & set(chosen)]  # noqa: B023, E731
        while len(free := left()) >= need:
            words = {w for g in free for w in g.split()}
            chosen.append(max(words, key=lambda w: (len(w) > 3 and w not in COMMON, said[w], len(w), w)))
    return sorted(set(chosen))


def _windows(texts: DataFrame, library, any_gram, least: float) -> DataFrame:
    """Licences in windows of the words of ``texts`` (doc_id, lowered), as ``scan_licences`` gives them; line is that of the first word."""
    low, high = least / (2 - least), (2 - least) / least
    once = lambda x: F.explode(F.array(x))
    split = lambda x: F.filter(F.split(F.regexp_replace(x, "[^a-z0-9]+", " "), " "), lambda w: w != "")

    def pairs(words):
        return F.when(F.size(words) > 1, F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))

    def dice(common, own, other):
        return F.lit(2.0) * common / (own + other)

    def reaches(own, templates):
        return F.exists(templates, lambda t: dice(F.size(F.array_intersect(t["grams"], own)), F.size(own), t["size"]) >= least)

    # texts that hold enough of some template, wherever it stands
    own = texts.select("doc_id", "lowered", once(split(F.col("lowered"))).alias("words")).select("doc_id", "lowered", once(F.array_distinct(pairs(F.col("words")))).alias("own"))
    own = own.select("*", once(F.array_intersect(any_gram, F.col("own"))).alias("held")).filter(F.size("held") > 0)
    own = own.select("*", once(F.filter(library, lambda t: F.size(F.array_intersect(t["grams"], F.col("held"))) >= t["size"] * low)).alias("near")).filter(F.size("near") > 0)
    own = own.filter(~reaches(F.col("own"), F.col("near")))
    # words with their lines, and the lines that are a licence themselves
    own = own.select("doc_id", "near", once(F.transform(F.split("lowered", "\n"), split)).alias("parts"))

    def best(x, i):
        grams = F.array_distinct(pairs(x))
        scored = F.transform(F.col("near"), lambda t: F.struct(dice(F.size(F.array_intersect(t["grams"], grams)), F.size(grams), t["size"]).alias("dice"), t["id"].alias("licence"), F.size(F.array_intersect(t["grams"], grams)).alias("common")))
        return F.struct((i + 1).alias("line"), F.array_max(scored).alias("best"))

    own = own.select("doc_id", "near", "parts", once(F.filter(F.transform("parts", best), lambda h: h["best"]["dice"] >= least)).alias("hits"))
    placed = F.flatten(F.transform("parts", lambda x, i: F.transform(x, lambda w: F.struct(w.alias("w"), (i + 1).alias("line")))))
    own = own.select("doc_id", "near", "hits", once(placed).alias("placed"))
    own = own.select("doc_id", "near", "hits", F.col("placed.line").alias("lines"), once(pairs(F.col("placed.w"))).alias("grams")).filter(F.size("grams") > 0)
    # for each template its places, then the ends of their runs with the number of places up to there, then windows
    at = F.transform("near", lambda t: F.struct(t.alias("t"), F.filter(F.transform("grams", lambda g, i: F.when(F.array_contains(t["grams"], g), i + 1)), lambda i: i.isNotNull()).alias("at")))
    own = own.select("doc_id", "hits", "lines", "grams", once(F.filter(at, lambda x: F.size(x["at"]) >= x["t"]["size"] * low)).alias("near"))

    def ends(at, step):
        return F.filter(F.transform(at, lambda p, i: F.struct(p.alias("at"), i.alias("rank"), F.coalesce(F.get(at, i + step) != p + step, F.lit(True)).alias("end"))), lambda x: x["end"])

    own = own.select("doc_id", "hits", "lines", "grams", once(F.transform("near", lambda x: F.struct(x["t"].alias("t"), ends(x["at"], -1).alias("first"), ends(x["at"], 1).alias("last")))).alias("near"))

    def between(x):
        fits = lambda a, b: (b["at"] - a["at"] + 1 <= x["t"]["length"] * high) & (b["rank"] - a["rank"] + 1 >= x["t"]["size"] * low)
        spans = F.flatten(F.transform(x["first"], lambda a: F.transform(F.filter(x["last"], lambda b: fits(a, b)), lambda b: F.struct(a["at"].alias("lo"), b["at"].alias("hi")))))
        return F.struct(x["t"].alias("t"), spans.alias("spans"))

    own = own.select("doc_id", "hits", "lines", "grams", once(F.filter(F.transform("near", between), lambda x: F.size(x["spans"]) > 0)).alias("near")).filter(F.size("near") > 0)

    def measured(x):
        def one(p):
            part = F.slice(F.col("grams"), p["lo"], p["hi"] - p["lo"] + 1)
            return F.struct(p["lo"].alias("lo"), p["hi"].alias("hi"), F.size(F.array_intersect(x["t"]["grams"], part)).alias("common"), F.size(F.array_distinct(part)).alias("unit_size"), x["t"]["id"].alias("licence"), x["t"]["size"].alias("template_size"))

        return F.transform(x["spans"], one)

    own = own.select("doc_id", "hits", "lines", once(F.transform("near", measured)).alias("found"))
    with_dice = F.transform("found", lambda a: F.transform(a, lambda p: F.struct(dice(p["common"], p["unit_size"], p["template_size"]).alias("dice"), *(p[k].alias(k) for k in ("common", "licence", "lo", "hi", "unit_size", "template_size")))))

    def new(p):
        inside = lambda h: (F.get("lines", p["lo"] - 1) <= h["line"]) & (h["line"] <= F.get("lines", p["hi"]))
        known = F.exists("hits", lambda h: inside(h) & ((h["best"]["licence"] == p["licence"]) | (h["best"]["common"] >= p["common"])))
        return (p["dice"] >= least) & ~known

    own = own.select("doc_id", "lines", once(F.transform(with_dice, lambda a: F.filter(a, new))).alias("found"))

    def apart(spans):
        """Spans in the given order that overlap none before."""
        return F.aggregate(F.slice(spans, 2, F.greatest(F.size(spans) - 1, F.lit(0))), F.slice(spans, 1, 1), lambda kept, p: F.when(F.exists(kept, lambda k: (k["lo"] <= p["hi"]) & (p["lo"] <= k["hi"])), kept).otherwise(F.concat(kept, F.array(p))))

    own = own.select("doc_id", "lines", once(F.flatten(F.transform("found", lambda a: apart(F.reverse(F.array_sort(a)))))).alias("found"))
    names = ("common", "dice", "licence", "lo", "hi", "unit_size", "template_size")
    order = F.reverse(F.array_sort(F.transform("found", lambda p: F.struct(*(p[k].alias(k) for k in names)))))
    own = own.select("doc_id", "lines", once(order).alias("found")).select("doc_id", "lines", F.explode(apart(F.col("found"))).alias("p"))
    return own.select("doc_id", F.get("lines", F.col("p.lo") - 1).alias("line"), "p.licence", "p.common", "p.unit_size", "p.template_size", "p.dice")


def scan_licences(docs: DataFrame, *, least: float = 0.8, windows: bool = False, templates: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Units that are a licence: doc_id, line (0 for the whole text, else from 1), licence, common, unit_size,
    template_size, dice. The best template of each unit with a coefficient of ``least`` or more; with
    ``windows`` also windows, by the line of their first word."""
    grams = {k: bigrams(t) for k, t in (templates or TEMPLATES).items()}
    grams = {k: g for k, g in grams.items() if g}
    low, high = least / (2 - least), (2 - least) / least
    words = anchors(grams, least)
    length = {k: len(re.sub("[^a-z0-9]+", " ", t.lower()).split()) - 1 for k, t in (templates or TEMPLATES).items()}
    data = json.dumps([{"id": k, "size": len(g), "length": length[k], "grams": g} for k, g in sorted(grams.items())])
    library = F.from_json(F.lit(data), "array<struct<id: string, size: int, length: int, grams: array<string>>>")
    any_gram = F.from_json(F.lit(json.dumps(sorted({x for g in grams.values() for x in g}))), "array<string>")

    def may(column):
        found = F.lit(False)
        for word in words:
            found = found | F.contains(column, F.lit(word))
        return found

    lines = F.split("lowered", "\n")
    whole = F.when(F.size(lines) > 1, F.array(F.struct(F.lit(0).alias("line"), F.col("lowered").alias("unit")))).otherwise(F.array().cast("array<struct<line: int, unit: string>>"))
    each = F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), x.alias("unit")))
    # explode of one value: what it holds is computed once, not again in each place that uses it
    once = lambda x: F.explode(F.array(x))
    texts = docs.select(F.col(doc_id).alias("doc_id"), once(F.lower(F.col(text))).alias("lowered")).filter(may(F.col("lowered")))
    units = texts.select("doc_id", F.explode(F.filter(F.concat(whole, each), lambda u: may(u["unit"]))).alias("u"))
    split = F.split(F.trim(F.regexp_replace(F.col("u.unit"), "[^a-z0-9]+", " ")), " ")
    units = units.select("doc_id", F.col("u.line").alias("line"), once(split).alias("words")).filter(F.size("words") > 1)
    pairs = F.zip_with(F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words") - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    units = units.select("doc_id", "line", once(F.array_distinct(pairs)).alias("own"))
    units = units.withColumn("unit_size", F.size("own"))
    near = F.filter(library, lambda t: (F.col("unit_size") >= t["size"] * low) & (F.col("unit_size") <= t["size"] * high))

    def against(t):
        common = F.size(F.array_intersect(t["grams"], F.col("own")))
        return F.struct((F.lit(2.0) * common / (t["size"] + F.col("unit_size"))).alias("dice"), t["id"].alias("licence"), common.alias("common"), t["size"].alias("template_size"))

    best = units.select("doc_id", "line", "unit_size", once(F.array_max(F.transform(near, against))).alias("best")).filter(F.col("best.dice") >= least)
    best = best.select("doc_id", "line", F.col("best.licence").alias("licence"), F.col("best.common").alias("common"), "unit_size", F.col("best.template_size").alias("template_size"), F.col("best.dice").alias("dice"))
    return best.unionByName(_windows(texts, library, any_gram, least)) if windows else best


def oracle(least: float = 0.8) -> str:
    """The lines and whole texts of ``documents`` in DuckDB's SQL, without any pruning; it has no windows."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(k)}, [{', '.join(map(quoted, bigrams(t)))}])" for k, t in sorted(TEMPLATES.items()))
    return f"""
    with t(licence, grams) as (values {rows}),
    s as (select doc_id, lower(text) as text, string_split(lower(text), chr(10)) as lines from documents),
    u as (select doc_id, 0 as line, text as unit from s where len(lines) > 1
        union all select doc_id, unnest(generate_series(1, len(lines)))::int, unnest(lines) from s),
    w as (select doc_id, line, string_split(trim(regexp_replace(unit, '[^a-z0-9]+', ' ', 'g')), ' ') as words from u),
    g as (select doc_id, line, list_distinct(list_transform(generate_series(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1])) as own from w where len(words) > 1),
    c as (select doc_id, line, licence, len(list_intersect(grams, own)) as common, len(own) as unit_size, len(grams) as template_size from g, t),
    d as (select *, 2.0::double * common / (template_size + unit_size) as dice, row_number() over (partition by doc_id, line
        order by 2.0::double * common / (template_size + unit_size) desc, licence desc) as k from c)
    select doc_id, line::int as line, licence, common::int as common, unit_size::int as unit_size, template_size::int as template_size, dice
    from d where k = 1 and dice >= {least}
    """
