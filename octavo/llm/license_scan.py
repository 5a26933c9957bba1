"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

Only DataFrame functions are used.  Inverse document frequencies of the templates' terms are counted over
all files; a term of no template weighs like one that no file has.  What is compared are a file's lines, its
paragraphs (lines between lines without letters or digits, so that comment marks don't matter), its blocks (lines
between blank lines, such as a whole comment), and, of a file named like a licence file, the whole text; so a notice
wrapped over lines is met as it stands in the templates, which hold the common licences' notices, titles and texts.
A unit can only come near a template if it has one of its telling terms (what the others, the commonest, can add up to
is below the limit, by Cauchy-Schwarz), so all other files and units leave before anything is weighed.  Distinct units are weighed
once: terms by units times terms by templates, summed in the engine.

A file named like a licence file speaks for its directory; a file without a licence of its own takes that of the
nearest directory above it, found by joining the distinct directories' ancestors with the directories that have one.
The weights are as many as the templates have terms, whatever the tables hold.

Defined cases: a null or empty text has no licence of its own but inherits; a null path has no directory;
repeated rows get the same result; a certain licence goes before a family of licences, and that before a bare
reservation of rights; then the nearest template, then the first by name; of several licence files
in a directory the same order, then the first by path; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import keep

#: Least cosine.
LIMIT = 0.75
#: Names of licence files, in lower case, without what follows a dot.
FILE_NAMES = ("license", "licence", "copying", "unlicense", "notice")
#: Names that are less than a certain licence: a family of licences, a bare reservation of rights.
FAMILIES, RESERVED = ("BSD",), ("Proprietary",)

# The wording of common licences.
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_REST = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_INTRO = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""
_APACHE_END = """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GNU_END = """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {} for more details.

You should have received a copy of the {} along with this program. If not, see <https://www.gnu.org/licenses/>."""
_UNLICENSE = "This is free and unencumbered software released into the public domain."
_UNLICENSE_REST = "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"""


def _gnu(name: str, version: str, later: bool) -> str:
    choice = f"either version {version} of the License, or (at your option) any later version." if later else f"version {version}."
    return f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, {choice}"


_GPL, _LGPL, _AGPL = "GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License"
TEMPLATES = (
    ("Artistic", 'The "Artistic License"'),
    ("Artistic-2.0", "The Artistic License 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", f"{_APACHE}\n\n{_APACHE_END}"),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD", _BSD_INTRO),
    ("BSD-2-Clause", f"{_BSD_INTRO}\n{_BSD_TWO}"),
    ("BSD-2-Clause", f"{_BSD_INTRO}\n{_BSD_TWO}\n{_BSD_END}"),
    ("BSD-3-Clause", _BSD_THIRD),
    ("BSD-3-Clause", f"{_BSD_INTRO}\n{_BSD_TWO}\n{_BSD_THIRD}"),
    ("BSD-3-Clause", f"{_BSD_INTRO}\n{_BSD_TWO}\n{_BSD_THIRD}\n{_BSD_END}"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("BSL-1.0", _BOOST),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _gnu(_GPL, "2", True)),
    ("GPL-2.0", _gnu(_GPL, "2", False)),
    ("GPL-2.0", f"{_gnu(_GPL, '2', True)}\n\n{_GNU_END.format(_GPL, _GPL)}"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _gnu(_GPL, "3", True)),
    ("GPL-3.0", f"{_gnu(_GPL, '3', True)}\n\n{_GNU_END.format(_GPL, _GPL)}"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", _gnu(_AGPL, "3", True)),
    ("AGPL-3.0", f"{_gnu(_AGPL, '3', True)}\n\n{_GNU_END.format(_AGPL, _AGPL)}"),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", _gnu(_LGPL, "2.1", True)),
    ("LGPL-2.1", f"{_gnu(_LGPL, '2.1', True)}\n\n{_GNU_END.format(_LGPL, _LGPL)}"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", _gnu(_LGPL, "3", True)),
    ("LGPL-3.0", f"{_gnu(_LGPL, '3', True)}\n\n{_GNU_END.format(_LGPL, _LGPL)}"),
    ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002"),
    ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("ISC", "ISC License"),
    ("ISC", _ISC),
    ("ISC", f"{_ISC}\n\n{_ISC_END}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "MIT License"),
    ("MIT", _MIT_GRANT),
    ("MIT", f"{_MIT_GRANT}\n\n{_MIT_REST}"),
    ("MPL-1.1", "Mozilla Public License Version 1.1"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", f"{_UNLICENSE}\n\n{_UNLICENSE_REST}"),
    ("Zlib", _ZLIB),
    ("Proprietary", "All rights reserved."),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit("[a-z0-9]+"), F.lit(0))


def _terms(text: str) -> list[str]:
    out, word = [], ""
    for c in text.translate(str.maketrans(_UPPER, _LOWER)) + " ":
        if c in _LOWER or c in "0123456789":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def rank(name: str) -> int:
    return 2 if name in RESERVED else 1 if name in FAMILIES else 0


class Weights:
    """Terms' weights from the counts of files that have them."""

    def __init__(self, templates: tuple[tuple[str, str], ...], files: int, having: dict[str, int], limit: float):
        self.idf = {w: math.log((1 + files) / (1 + having.get(w, 0))) + 1 for _, t in templates for w in _terms(t)}
        self.other = math.log(1 + files) + 1
        self.rows = []
        heavy: set[str] = set()
        for name, text in templates:
            count: dict[str, int] = {}
            for w in _terms(text):
                count[w] = count.get(w, 0) + 1
            norm = math.sqrt(sum((n * self.idf[w]) ** 2 for w, n in sorted(count.items())))
            self.rows.append((name, {w: n * self.idf[w] / norm for w, n in count.items()}))
            # terms that together stay below the limit can't bring a unit near: the commonest are left to them first
            left = (limit * norm) ** 2 * (1 - 1e-9)
            for w in sorted(count, key=lambda w: (self.idf[w], w)):
                mass = (count[w] * self.idf[w]) ** 2
                if mass < left:
                    left -= mass
                else:
                    heavy.add(w)
        self.heavy = sorted(heavy)

    def _table(self, spark, rows: list[dict], schema: str) -> DataFrame:
        """A small table made of one literal."""
        return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))

    def scores(self, units: DataFrame, limit: float) -> DataFrame:
        """Of ``units(u, found)``, distinct in ``u``: ``u`` and ``near``, struct of rank, negative cosine and name of the first template in the limit."""
        spark = units.sparkSession
        idf = self._table(spark, [{"w": w, "idf": x} for w, x in sorted(self.idf.items())], "w string, idf double")
        of = [{"w": w, "k": k, "license": name, "rank": rank(name), "x": x} for k, (name, ws) in enumerate(self.rows) for w, x in sorted(ws.items())]
        weights = self._table(spark, of, "w string, k int, license string, rank int, x double")
        counts = units.select("u", F.explode("found").alias("w")).groupBy("u", "w").agg(F.count(F.lit(1)).alias("c"))
        own = counts.join(F.broadcast(idf), "w", "left").select("u", "w", (F.col("c") * F.coalesce("idf", F.lit(self.other))).alias("y"))
        own = keep(own, "unit_terms")
        norms = own.groupBy("u").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm"))
        dots = own.join(F.broadcast(weights), "w").groupBy("u", "k", "license", "rank").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
        # rounded, so that the order of addition can't decide
        scored = dots.join(norms, "u").select("u", "rank", (-F.round(F.col("dot") / F.col("norm"), 6)).alias("minus"), "license")
        return scored.where(F.col("minus") <= -limit).groupBy("u").agg(F.min(F.struct("rank", "minus", "license")).alias("near"))


#: Where a text is cut into lines, paragraphs and blocks.
CUTS = ("\n", r"\n[^A-Za-z0-9\n]*\n", r"\n[ \t\r]*\n")


def _directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(path.isNotNull(), F.lit("")))


def license_scan(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, limit: float = LIMIT, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Per file ``doc_id``, ``path``, ``license``, ``score`` (of its own match), ``basis`` (own, directory, none) and ``from_dir``."""
    rows = files.select(F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    vocabulary = sorted({w for _, t in templates for w in _terms(t)})
    has = F.array_intersect(terms(F.col("text")), F.array(*map(F.lit, vocabulary)))
    counts = rows.select(F.explode(F.concat(has, F.array(F.lit("")))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    having = {r["w"]: r["n"] for r in counts.union(rows.where("text is null").groupBy().agg(F.lit("null"), F.count(F.lit(1)))).collect()}
    # a text without any term still is a file: the empty term stands for the file itself
    weights = Weights(templates, having.pop("", 0) + having.pop("null", 0), having, limit)

    name = F.lower(F.regexp_replace(F.regexp_replace("path", "^.*/", ""), r"\..*$", ""))
    is_file = F.coalesce(name.isin(*FILE_NAMES), F.lit(False))
    marked = rows.select("doc_id", "path", is_file.alias("is_file"), "text", F.xxhash64("doc_id", "path", "text").alias("key"))
    heavy = F.array(*map(F.lit, weights.heavy))
    worth = marked.where(F.arrays_overlap(terms(F.col("text")), heavy))
    units = [F.split("text", cut, -1) for cut in CUTS]
    whole = F.when(F.col("is_file"), F.array("text")).otherwise(F.array().cast("array<string>"))
    units = worth.select("key", "path", "is_file", F.explode(F.array_distinct(F.concat(*units, whole))).alias("unit"))
    units = units.select("key", "path", "is_file", terms(F.col("unit")).alias("found")).where(F.arrays_overlap("found", heavy))
    units = keep(units.withColumn("u", F.xxhash64("found")), "units")
    scored = keep(weights.scores(units.groupBy("u").agg(F.first("found").alias("found")), limit), "scored")
    own = units.select("key", "path", "is_file", "u").join(scored, "u").groupBy("key", "path", "is_file").agg(F.min("near").alias("near"))
    own = keep(own.select("key", "path", "is_file", F.col("near.rank").alias("rank"), F.col("near.license").alias("license"), (-F.col("near.minus")).alias("score")), "own")

    by_dir = own.where("is_file").groupBy(_directory(F.col("path")).alias("from_dir")).agg(F.min(F.struct("rank", (-F.col("score")).alias("m"), "path", "license")).alias("x"))
    by_dir = keep(by_dir.select("from_dir", F.col("x.license").alias("dir_license")), "by_dir")
    dirs = rows.select(_directory(F.col("path")).alias("dir")).distinct().where("dir is not null")
    parts = F.split("dir", "/", -1)
    depth = F.explode(F.when(F.col("dir") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(parts)))).alias("depth")
    above = dirs.select("dir", depth).select("dir", "depth", F.expr("substring_index(dir, '/', depth) AS from_dir"))
    nearest = above.join(by_dir, "from_dir").groupBy("dir").agg(F.max(F.struct("depth", "from_dir", "dir_license")).alias("x"))
    nearest = keep(nearest.select("dir", "x.from_dir", "x.dir_license"), "nearest")

    every = marked.select("doc_id", "path", "key", _directory(F.col("path")).alias("dir"))
    got = every.join(own.select("key", "license", "score"), "key", "left").join(nearest, "dir", "left")
    return got.select(
        "doc_id",
        "path",
        F.coalesce("license", "dir_license").alias("license"),
        "score",
        F.when(F.col("license").isNotNull(), "own").when(F.col("dir_license").isNotNull(), "directory").otherwise("none").alias("basis"),
        F.when(F.col("license").isNull(), F.col("from_dir")).alias("from_dir"),
    )


#: The tree that the query makes of ``documents``: per source, folders by id in two levels; every 8th file is a licence file of its
#: folder, every 64th of the folder above.
PATH = (
    "concat(source, '/', doc_id {div} 1280, '/', CASE WHEN doc_id % 64 = 0 THEN '' ELSE concat(doc_id {div} 320, '/') END, "
    "CASE WHEN doc_id % 8 = 0 THEN concat('LICENSE.', doc_id) ELSE concat(doc_id, '.txt') END)"
)


def as_files(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.expr(PATH.format(div="div")).alias("path"), "text")


def _sql() -> str:
    values = ", ".join("({}, '{}', {}, '{}')".format(k, n, rank(n), t.replace("'", "''").replace("\n", " ")) for k, (n, t) in enumerate(TEMPLATES))
    low = f"translate({{}}, '{_UPPER}', '{_LOWER}')"
    found = f"regexp_extract_all({low}, '[a-z0-9]+')"
    return f"""
WITH f AS (SELECT doc_id, {PATH.format(div="//")} path, doc_id % 8 = 0 is_file, text FROM documents),
n AS (SELECT count(*) n FROM f),
df AS (SELECT w, count(*) df FROM (SELECT doc_id, unnest(list_distinct({found.format("text")})) w FROM f) GROUP BY 1),
t0(k, name, rank, text) AS (VALUES {values}),
t1 AS (SELECT k, name, rank, w, count(*) c FROM (SELECT k, name, rank, unnest({found.format("text")}) w FROM t0) GROUP BY ALL),
idf AS (SELECT w, ln((1 + n) / (1 + coalesce(df, 0))) + 1 idf FROM (SELECT DISTINCT w FROM t1) LEFT JOIN df USING (w), n),
t2 AS (SELECT k, name, rank, w, c * idf x FROM t1 JOIN idf USING (w)),
tn AS (SELECT k, sqrt(sum(x * x)) norm FROM t2 GROUP BY 1),
t AS (SELECT k, name, rank, w, x / norm x FROM t2 JOIN tn USING (k)),
u0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) unit FROM f
  UNION ALL SELECT doc_id, unnest(string_split_regex(text, '{CUTS[1]}')) FROM f
  UNION ALL SELECT doc_id, unnest(string_split_regex(text, '{CUTS[2]}')) FROM f UNION ALL SELECT doc_id, text FROM f WHERE is_file),
u1 AS (SELECT DISTINCT doc_id, {found.format("unit")} ws FROM u0),
d AS (SELECT ws, row_number() OVER () u FROM (SELECT DISTINCT ws FROM u1)),
l0 AS (SELECT u, w, count(*) c FROM (SELECT u, unnest(ws) w FROM d) GROUP BY ALL),
l AS (SELECT u, w, c * coalesce(idf, (SELECT ln(1 + n) + 1 FROM n)) x FROM l0 LEFT JOIN idf USING (w)),
ln_ AS (SELECT u, sqrt(sum(x * x)) norm FROM l GROUP BY 1),
s AS (SELECT u, name, rank, round(sum(l.x * t.x) / any_value(norm), 6) score FROM l JOIN t USING (w) JOIN ln_ USING (u) GROUP BY u, k, name, rank),
own AS (SELECT doc_id, min({{'r': rank, 'm': -score, 'name': name}}) b FROM s JOIN d USING (u) JOIN u1 USING (ws) WHERE score >= {LIMIT} GROUP BY 1),
o AS (SELECT f.doc_id, path, is_file, regexp_replace(path, '/[^/]*$', '') dir, b.r rank, b.name license, -b.m score FROM f LEFT JOIN own USING (doc_id)),
bd AS (SELECT dir from_dir, arg_min(license, {{'r': rank, 'm': -score, 'p': path}}) lic FROM o WHERE is_file AND license IS NOT NULL GROUP BY 1),
nearest AS (SELECT dir, arg_max(from_dir, length(from_dir)) from_dir, arg_max(lic, length(from_dir)) lic
  FROM (SELECT DISTINCT dir FROM o) d JOIN bd ON dir = from_dir OR starts_with(dir, concat(from_dir, '/')) GROUP BY 1)
SELECT doc_id, path, coalesce(license, lic) license, score,
  CASE WHEN license IS NOT NULL THEN 'own' WHEN lic IS NOT NULL THEN 'directory' ELSE 'none' END basis,
  CASE WHEN license IS NULL THEN from_dir END from_dir
FROM o LEFT JOIN nearest USING (dir)
"""


SQL = _sql()
