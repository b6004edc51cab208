"""License scans: texts against licence templates, by Dice coefficient over word bigrams.

Normalised text is A-Z in lower case and words of a-z and 0-9; what stands between is a space. Units are the
lines of a text, the whole text if it has more than one line, and windows: as many consecutive words of the
whole text as a template has, whatever lines, comment signs or sentences they are in. A window lies where an
anchor of the template places it. Anchors are its longest bigrams, one more of them than a window of its size
can lack at the threshold, so a window that lacks no more than that is found by one of them at least.

A unit's set of bigrams A is compared with a template's set B by 2 |A & B| / (|A| + |B|). At a threshold t
that needs |B| between |A| t / (2 - t) and |A| (2 - t) / t; templates outside these bounds are not looked at.
Most lines are too long or too short for every template, which their words tell before any bigram is made;
most texts hold no anchor, and so no window.

The templates are a parameter that travels as one constant, and all work is on one row: no shuffle, no
join, and neither a hot source nor copies matter. Null texts are empty and have no licence. Units with
fewer than two words have no bigrams. A very long text is looked at as a whole: its bigrams once, and a
window for each anchor in it. Ties go to the smaller licence name, then to the first line, then window.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dueline.llm.shared import lower_ascii, text_or_empty

# How licences are stated, and the usual wording of short licences and notices.
TEMPLATES: dict[str, list[str]] = {
    "agpl-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the GNU AGPL v3.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ],
    "bsd-3-clause": ["Released under the BSD 3-Clause License.", "Licensed under the 3-clause BSD License."],
    "bsd-2-clause": ["Released under the BSD 2-Clause License.", "Licensed under the 2-clause BSD License."],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc0-1.0": ["Released under CC0 1.0.", "This work is dedicated to the public domain under CC0 1.0."],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU GPL v2."],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU GPL v3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details.",
    ],
    "isc": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
        "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
        "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION "
        "WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
        "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
        "THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ],
    "mpl-2.0": [
        "Released under the Mozilla Public License 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
}

THRESHOLD = 0.85


def template_rows(templates: dict[str, list[str]], threshold: float) -> list[dict]:
    """name, bigrams, the sizes of units that can reach the threshold, words, and anchors with their places."""
    rows = []
    for name in sorted(templates):
        for text in templates[name]:
            words = [w for w in re.split("[^a-z0-9]+", text.lower()) if w]
            grams = sorted({f"{a} {b}" for a, b in zip(words, words[1:])})
            n = len(grams)
            if n:
                low, high = math.ceil(n * threshold / (2 - threshold)), math.floor(n * (2 - threshold) / threshold)
                anchors = sorted(grams, key=lambda g: (-len(g), g))[: math.floor((1 - threshold) * n) + 1]
                places = [{"gram": f"{a} {b}", "place": i} for i, (a, b) in enumerate(zip(words, words[1:])) if f"{a} {b}" in anchors]
                rows.append({"name": name, "n": n, "low": low, "high": high, "grams": grams, "width": len(words) - 1, "anchors": places})
    return rows


def bigrams(text: Column, least: int, most: int) -> Column:
    """The set of bigrams of a normalised text; none if it must have fewer than ``least`` or more than ``most``."""

    def pairs(words: Column) -> Column:
        # n words have at most n - 1 bigrams, and at least one fewer than they have distinct words.
        possible = (F.size(words) > least) & (F.size(F.array_distinct(words)) - 1 <= most)
        both = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
        found = F.array_distinct(F.slice(both, 1, F.greatest(F.size(words) - 1, F.lit(0))))
        return F.when(possible, found).otherwise(F.array().cast("array<string>"))

    words = F.filter(F.split(text, "[^a-z0-9]+"), lambda w: w != "")
    return F.flatten(F.transform(F.array(words), pairs))  # so that the words are computed once


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, list[str]] = TEMPLATES,
    threshold: float = THRESHOLD,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: doc_id, license (the best match, or null), dice, unit (its line from 1, or 0 for
    the whole text), licenses (all names found, sorted, by commas), n_units (units that matched)."""
    rows = template_rows(templates, threshold)
    least, most = min((r["low"] for r in rows), default=1), max((r["high"] for r in rows), default=0)
    kind = "array<struct<name string, n int, low int, high int, grams array<string>, width int, anchors array<struct<gram string, place int>>>>"
    table = F.from_json(F.lit(json.dumps(rows)), kind)
    text = lower_ascii(text_or_empty(F.col(text_column)))
    lines = F.split(F.col("text"), "\n")
    units = F.when(F.size(lines) > 1, F.concat(F.array("text"), lines)).otherwise(lines)
    sets = F.transform(units, lambda u: bigrams(u, least, most))

    def dice(grams: Column, t: Column) -> Column:
        return 2.0 * F.size(F.array_intersect(grams, t["grams"])) / (F.size(grams) + t["n"])

    def compared(grams: Column, place: Column) -> Column:
        fitting = F.filter(table, lambda t: F.size(grams).between(t["low"], t["high"]))
        found = F.transform(fitting, lambda t: F.struct(dice(grams, t).alias("dice"), t["name"].alias("name"), place.alias("unit")))
        return F.filter(found, lambda m: m["dice"] >= threshold)

    of_lines = F.flatten(F.transform("sets", lambda s, i: compared(s, i + F.when(F.size("sets") > 1, 0).otherwise(1))))
    matches = F.concat(of_lines, windows(F.col("text"), table, rows, threshold, dice))
    best = F.array_max(F.transform("matches", lambda m: m["dice"]))
    # Lines are numbered from 0 up, windows from -1 down.
    places = F.transform(F.filter("matches", lambda m: m["dice"] == F.col("dice")), lambda m: F.struct(m["name"], m["unit"] < 0, F.abs(m["unit"]), m["unit"].alias("unit")))
    first = F.array_min(places)
    return (
        docs.select(F.col(id_column).alias("doc_id"), text.alias("text"))
        .select("doc_id", "text", sets.alias("sets"))
        .select("doc_id", matches.alias("matches"))
        .select("doc_id", "matches", best.alias("dice"))
        .select(
            "doc_id",
            first["name"].alias("license"),
            "dice",
            first["unit"].alias("unit"),
            F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["name"]))), ",").alias("licenses"),
            F.size(F.array_distinct(F.transform("matches", lambda m: m["unit"]))).alias("n_units"),
        )
    )


def windows(text: Column, table: Column, rows: list[dict], threshold: float, dice) -> Column:
    """Matches of windows: dice, name, and as unit minus the number of the window's first word, from 1."""
    every = sorted({a["gram"] for r in rows for a in r["anchors"]})
    anchors = F.from_json(F.lit(json.dumps(every)), "array<string>")
    none = F.array().cast("array<struct<dice double, name string, unit int>>")

    def of_grams(grams: Column) -> Column:
        return F.flatten(F.transform(F.array(F.array_intersect(grams, anchors)), lambda hits: F.when(F.size(hits) > 0, placed(grams, hits)).otherwise(none)))

    def placed(grams: Column, hits: Column) -> Column:
        # Only the bigrams that are anchors, with their places, are looked at for each template.
        at = F.filter(F.transform(grams, lambda g, i: F.struct(g.alias("gram"), i.alias("at"))), lambda g: F.array_contains(hits, g["gram"]))
        near = lambda t: F.filter(t["anchors"], lambda a: F.array_contains(hits, a["gram"]))

        def starts(t: Column, at: Column) -> Column:
            each = F.transform(near(t), lambda a: F.transform(F.filter(at, lambda g: g["gram"] == a["gram"]), lambda g: F.greatest(g["at"] - a["place"], F.lit(0))))
            return F.array_distinct(F.flatten(each))

        def window(t: Column, start: Column) -> Column:
            own = F.transform(F.array(F.array_distinct(F.slice(grams, start + 1, t["width"]))), lambda w: F.when(F.size(w).between(t["low"], t["high"]), dice(w, t)))[0]
            return F.struct(own.alias("dice"), t["name"].alias("name"), (-1 - start).alias("unit"))

        hit = F.filter(table, lambda t: F.arrays_overlap(hits, F.transform(t["anchors"], lambda a: a["gram"])))
        found = F.flatten(F.transform(F.array(at), lambda at: F.flatten(F.transform(hit, lambda t: F.transform(starts(t, at), lambda s: window(t, s))))))
        return F.filter(found, lambda m: m["dice"] >= threshold)

    def of_words(words: Column) -> Column:
        both = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
        return F.slice(both, 1, F.greatest(F.size(words) - 1, F.lit(0)))

    # Arrays of one element, so that what is in them is computed once.
    words = F.filter(F.split(text, "[^a-z0-9]+"), lambda w: w != "")
    grams = F.transform(F.array(words), of_words)
    return F.flatten(F.transform(grams, of_grams))


def scan_sql(templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same in SQL over a view ``documents``."""
    rows = template_rows(templates, threshold)
    values = ", ".join(
        f"({k}, '{t['name']}', {t['n']}, {t['low']}, {t['high']}, {t['width']}, [{', '.join(repr(g) for g in t['grams'])}])" for k, t in enumerate(rows)
    )
    anchors = ", ".join(f"({k}, '{a['gram']}', {a['place']})" for k, t in enumerate(rows) for a in t["anchors"])
    return f"""
with t(k, name, n, low, high, width, grams) as (values {values}),
a(k, gram, place) as (values {anchors}),
d as (select row_number() over () r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') x from documents),
l as (select r, string_split(x, chr(10)) lines, x from d),
u as (select r, 0 unit, x from l where len(lines) > 1
      union all select r, unnest(range(1, len(lines) + 1)) unit, unnest(lines) x from l),
w as (select r, unit, list_filter(regexp_split_to_array(x, '[^a-z0-9]+'), lambda s: s <> '') words from u),
g as (select r, unit, list_distinct([words[i] || ' ' || words[i + 1] for i in range(1, len(words))]) grams from w where len(words) > 1),
m as (select r, unit, name, 2.0::double * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + n) dice
      from g join t on len(g.grams) between low and high),
ww as (select r, list_filter(regexp_split_to_array(x, '[^a-z0-9]+'), lambda s: s <> '') words from d),
wg as (select r, [words[i] || ' ' || words[i + 1] for i in range(1, len(words))] grams from ww where len(words) > 1),
p as (select r, unnest(range(0, len(grams))) pos, unnest(grams) gram from wg),
s as (select distinct r, k, greatest(pos - place, 0) first from p join a using (gram)),
v as (select s.r, first, name, n, t.grams, low, high, list_distinct(wg.grams[first + 1 : first + width]) own from s join t using (k) join wg using (r)),
mw as (select r, -1 - first unit, name, 2.0::double * len(list_intersect(own, grams)) / (len(own) + n) dice from v where len(own) between low and high),
k as (select * from (select * from m union all select * from mw) where dice >= {threshold}),
b as (select r, max(dice) dice, count(distinct unit) n_units, string_agg(distinct name, ',' order by name) licenses from k group by r),
f as (select r, min({{'name': name, 'w': unit < 0, 'place': abs(unit), 'unit': unit}}) best from k join b using (r) where k.dice = b.dice group by r)
select doc_id, best.name license, dice, cast(best.unit as integer) unit, coalesce(licenses, '') licenses, cast(coalesce(n_units, 0) as integer) n_units
from d left join b using (r) left join f using (r)
"""
