"""Licence scans by canonical digest: whole texts, paragraphs and lines are brought to one form and hash-joined to the
digests of known licence texts.

The form has lower-case words alone: punctuation is dropped, copyright lines go, equivalent spellings become one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settled
from .common import checkpointed, hot_keys, only, table

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"

#: Known licence texts and notices, as they are published. A bounded table, given by the caller if need be.
KNOWN: list[tuple[str, str]] = [
    ("MIT", _MIT),
    ("MIT", f"MIT License\n\n{_MIT}"),
    ("MIT", f"The MIT License (MIT)\n\n{_MIT}"),
    ("ISC", f"{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}"),
    ("0BSD", f"{_GRANT}.\n\n{_ISC_END}"),
    ("BSD-2-Clause", f"{_BSD_2}\n\n{_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_2}\n\n{_BSD_3}\n\n{_BSD_END}"),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
]
#: Columns of a digest table.
DIGEST = "license string, digest string, n int, paragraphs int, first_n int, last_n int"
#: Entire licence texts by the MD5 of their form, its length, how many paragraphs it has and the lengths of the first
#: and the last. digests() makes such rows of a table of texts.
KNOWN_DIGESTS: list[tuple[str, str, int, int, int, int]] = [
    ("Apache-2.0", "a4f874aaeee4dfe824fb3cc3dcca2009", 9920, 33, 68, 298),
    ("Artistic-1.0-Perl", "01297679267ad921516667ccd889865e", 5833, 29, 20, 7),
    ("CC0-1.0", "d2a76f70ce19809695b7fb93c6241c23", 6691, 13, 27, 1075),
    ("GFDL-1.2", "fc8fd4dca9351a1b1ba045c2a7d3d70f", 19579, 57, 56, 230),
    ("GFDL-1.3", "4a40aa345b578ab1bf118ce352f84043", 22014, 67, 58, 230),
    ("GPL-1.0", "738cc3b112640d95d4cd79a58967ecea", 11765, 50, 50, 25),
    ("GPL-2.0", "5e39ace6e62f5a7fe9c17b4da986ad8c", 17117, 59, 46, 325),
    ("GPL-3.0", "5eaa767cc0a56c87c3852144458a3bf1", 33409, 122, 49, 395),
    ("LGPL-2.0", "74cf7fcef3b29a39165a795b2cad3a3a", 24130, 83, 54, 25),
    ("LGPL-2.1", "f998bc436710cfece156aaa84fd26dd4", 25217, 85, 59, 25),
    ("LGPL-3.0", "b31b7335bc37919e8cdd79154e04d88d", 7104, 37, 56, 277),
    ("MPL-1.1", "252dfbcf46f9012c7c356a9252f1c30c", 22448, 73, 34, 251),
    ("MPL-2.0", "b5b7a0cf4994910cd0204fba4637d6ec", 14341, 83, 34, 108),
    ("Unlicense", "0ddb544fc94f1ac376b1b27618cf995a", 1170, 5, 70, 55),
]
#: Spellings that count as one, as (pattern, form).
SPELLINGS = [
    (r"\blicenc", "licens"),
    (r"\bsublicenc", "sublicens"),
    (r"\borganisation", "organization"),
    (r"\backnowledgement", "acknowledgment"),
    (r"\bnon[ \n]+commercial\b", "noncommercial"),
    (r"\bshare[ \n]+alike\b", "sharealike"),
    (r"\bnon[ \n]+infringement\b", "noninfringement"),
]
#: A line that only says who holds the rights since when.
RIGHTS_LINE = r"(?m)^ ?(?:(?:c )?copyright (?:c )?(?:by )?[0-9]{4}|copyright c |c [0-9]{4}).*$|^ ?all rights reserved ?$"


def canonical(text: Column) -> Column:
    """Words in lower case, lines kept apart by one newline and paragraphs by two or more."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\n]+", " ")
    for pattern, form in SPELLINGS:
        out = F.regexp_replace(out, pattern, form)
    out = F.regexp_replace(out, RIGHTS_LINE, "")
    return F.regexp_replace(out, r" ?\n ?", "\n")


def _whole(form: Column) -> Column:
    return F.trim(F.regexp_replace(form, r"\n+", " "))


def _paragraphs(form: Column) -> Column:
    return F.filter(F.transform(F.split(form, r"\n\n+"), lambda p: F.trim(F.regexp_replace(p, r"\n", " "))), lambda p: p != "")


def digests(texts: DataFrame, name_col: str = "license", text_col: str = "text") -> DataFrame:
    """A digest table (DIGEST) of licence texts, such as a folder of them read whole: rows for scan()'s `known`."""
    form = texts.select(F.col(f"`{name_col}`").alias("license"), canonical(F.col(f"`{text_col}`")).alias("form"))
    parts = form.select("license", _whole(F.col("form")).alias("whole"), _paragraphs(F.col("form")).alias("p")).filter("size(p) > 0")
    return parts.select("license", F.md5(F.col("whole").cast("binary")).alias("digest"), F.length("whole").alias("n"), F.size("p").alias("paragraphs"), F.length(F.col("p")[0]).alias("first_n"), F.length(F.element_at("p", -1)).alias("last_n")).distinct()


def known_licenses(spark: SparkSession) -> DataFrame:
    """The digest table of KNOWN and KNOWN_DIGESTS."""
    listed = digests(spark.createDataFrame(KNOWN, "license string, text string"))
    return listed.unionByName(spark.createDataFrame(KNOWN_DIGESTS, DIGEST)).distinct()


#: Digests that are broadcast at most; a longer table is joined by a shuffle of its digests.
MOST_BROADCAST = 100_000
#: Lengths of known texts that are listed in the plan; of more, texts between the least and the greatest length are hashed.
MOST_LENGTHS = 1000


def _one_of(n: Column, values: list[int]) -> Column:
    """Whether a length may be one of the values: whether it is, or, if they are many, lies between the first and last."""
    return n.isin(values) if len(values) <= MOST_LENGTHS else n.between(values[0], values[-1])


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: id, licenses, n_licenses, whole.

    licenses lists, sorted and joined by commas, the known licences whose entire text is the document, a line of it, a
    paragraph, or a run of as many paragraphs as that licence has; whole tells whether one is the entire document. Null
    and empty texts have none. Rows that repeat an id get the union of that id's licences, a null id those of all null
    ids; an empty table gives an empty one; other columns are left out. Whole texts of any length are scanned.

    Only units whose length some known text has are hashed and leave the document; texts aren't shuffled. `known` is a
    digest table, of which at most about MOST_LENGTHS lengths of each kind reach the driver; its digests are broadcast if
    they are few. What is found is a narrow table; ids with very many rows, and rows without an id, take their one row of it
    by broadcast, so that no repeated id is a hot task.
    """
    facts = checkpointed(known if known is not None else known_licenses(docs.sparkSession))
    listed = lambda c: F.sort_array(F.collect_set(c))  # noqa: E731  as many as texts have lengths, not as there are texts
    few = lambda c: F.when(F.size(listed(c)) <= MOST_LENGTHS, listed(c)).otherwise(F.concat(F.slice(listed(c), 1, MOST_LENGTHS), F.array(F.max(c))))
    lengths = facts.agg(few("n")).first()[0]
    runs = {r[0]: (r[1], r[2]) for r in facts.filter("paragraphs > 1").groupBy("paragraphs").agg(few("first_n"), few("last_n")).collect()}
    form, paragraphs, no = F.col("form"), F.col("paragraphs"), F.array().cast("array<string>")
    bodies = only(docs, id_col, text_col).select(F.col(id_col), canonical(F.col(text_col)).alias("form"))
    split = bodies.select(id_col, "form", _paragraphs(form).alias("paragraphs"))

    def run_of(k: int) -> Column:
        """Runs of k paragraphs that begin and end with paragraphs as long as a known text's."""
        firsts, lasts = runs[k]
        starts = F.filter(F.sequence(F.lit(1), F.size(paragraphs) - k + 1), lambda i: _one_of(F.length(F.element_at(paragraphs, i)), firsts) & _one_of(F.length(F.element_at(paragraphs, i + k - 1)), lasts))
        return F.when(F.size(paragraphs) >= k, F.transform(starts, lambda i: F.array_join(F.slice(paragraphs, i, k), " "))).otherwise(no)

    fits = lambda u: _one_of(F.length(u), lengths)
    lines = F.transform(F.split(form, r"\n"), lambda x: F.trim(x))
    units = F.array_distinct(F.filter(F.concat(lines, paragraphs, *[run_of(k) for k in sorted(runs)]), fits))
    whole = _whole(form)
    asked = facts.select("license", "digest")
    found = (
        split.select(id_col, F.when(fits(whole), F.md5(whole.cast("binary"))).alias("_whole"), F.explode(F.array_union(units, F.filter(F.array(whole), fits))).alias("unit"))
        .select(id_col, "_whole", F.md5(F.col("unit").cast("binary")).alias("digest"))
        .join(F.broadcast(asked) if facts.count() <= MOST_BROADCAST else asked, "digest")
        .groupBy(id_col)
        .agg(F.sort_array(F.collect_set("license")).alias("found"), F.max(F.coalesce(F.col("_whole") == F.col("digest"), F.lit(False))).alias("whole"))
    )
    found = settled(found.withColumnRenamed(id_col, "_found"))
    ids = only(docs, id_col).withColumnRenamed(id_col, "_id")
    hot = hot_keys(ids, "_id")
    apart = lambda c: F.col(c).isNull() | F.col(c).isin(hot) if hot else F.col(c).isNull()
    most = ids.filter(~apart("_id")).join(found.filter(~apart("_found")), F.col("_id") == F.col("_found"), "left")
    rest = ids.filter(apart("_id")).join(F.broadcast(found.filter(apart("_found"))), F.col("_id").eqNullSafe(F.col("_found")), "left")  # fewer than HOT_SHARE rows
    return most.unionByName(rest).select(
        F.col("_id").alias(id_col),
        F.coalesce(F.array_join("found", ","), F.lit("")).alias("licenses"),
        F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_licenses"),
        F.coalesce("whole", F.lit(False)).alias("whole"),
    )


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_canonical(x: str) -> str:
    out = rf"regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
    for pattern, to in SPELLINGS:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return rf"regexp_replace(regexp_replace({out}, '{RIGHTS_LINE}', '', 'g'), ' ?\n ?', chr(10), 'g')"


def oracle() -> str:
    known = ", ".join(f"({_sql_text(a)}, {_sql_text(b)})" for a, b in KNOWN)
    entire = ", ".join(f"({_sql_text(r[0])}, '{r[1]}', {r[3]})" for r in KNOWN_DIGESTS)
    whole = r"trim(regexp_replace(form, '\n+', ' ', 'g'))"
    paras = r"list_filter(list_transform(regexp_split_to_array(form, '\n\n+'), lambda p: trim(replace(p, chr(10), ' '))), lambda p: p <> '')"
    return f"""
WITH known AS (SELECT license, {_sql_canonical('body')} AS form FROM (VALUES {known}) AS v(license, body)),
facts AS (SELECT license, md5({whole}) AS digest, len({paras}) AS n FROM known UNION SELECT * FROM (VALUES {entire}) AS w(license, digest, n)),
forms AS (SELECT doc_id, {_sql_canonical('text')} AS form FROM documents),
split AS (SELECT doc_id, form, {paras} AS p FROM forms),
units AS (
  SELECT doc_id, trim(unnest(string_split(form, chr(10)))) AS unit, false AS whole FROM split
  UNION ALL SELECT doc_id, unnest(p), false FROM split
  UNION ALL SELECT doc_id, array_to_string(p[i:i + k - 1], ' '), false FROM (SELECT doc_id, p, k, unnest(range(1, len(p) - k + 2)) AS i FROM split, (SELECT DISTINCT n AS k FROM facts WHERE n > 1) WHERE len(p) >= k)
  UNION ALL SELECT doc_id, {whole}, true FROM split),
hits AS (SELECT doc_id, license, bool_or(whole) AS whole FROM units JOIN facts ON md5(unit) = digest GROUP BY 1, 2),
found AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS licenses, count(*) AS n, bool_or(whole) AS whole FROM hits GROUP BY 1)
SELECT d.doc_id, coalesce(licenses, '') AS licenses, CAST(coalesce(n, 0) AS BIGINT) AS n_licenses, coalesce(whole, false) AS whole
FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id"""
