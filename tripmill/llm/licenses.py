"""Licence scan by canonical digest lookup, in DataFrame operations only.

A text is brought to a canonical form (case, punctuation, list bullets, white space, copyright lines and equivalent
spellings folded) and the digest of the whole form is looked up among those of known licence texts and
notices. The known texts are a table, the caller's or ``known_texts``: notices, and the full texts in ``license_texts``
with the headings and wordings in use, each as it is wrapped there and with a paragraph to a line. Their digests are a written
table, one row per known text, that Spark broadcasts where it is small; no text is shuffled.

Besides the whole text every line is looked up, as a text of its own: licence notices stand on a line of their own in
other prose. Results by case: null and empty texts, and texts of copyright lines alone, match nothing; rows that share an id,
or have none, are scanned each for itself; repeated rows are scanned alike; an empty table gives no rows.
"""

from __future__ import annotations

from importlib.resources import files
from itertools import product
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tripmill.llm.common import saved

# Notices and short licence texts by SPDX identifier.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", """MIT License
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """BSD Zero Clause License
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
]
# The headings under which short licences go ("" is none). Underlines and hashes fold away.
HEADINGS = {
    "MIT": ("", "MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT", "License: MIT", "Expat License"),
    "ISC": ("", "ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC"),
    "0BSD": ("", "BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)", "0BSD", "BSD 0-Clause License"),
    "BSD-2-Clause": ("", "BSD 2-Clause License", "The BSD 2-Clause License", "BSD License", "The BSD License", "Simplified BSD License", "BSD-2-Clause", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("", "BSD 3-Clause License", "The BSD 3-Clause License", "BSD License", "The BSD License", "New BSD License", "BSD-3-Clause", 'BSD 3-Clause "New" or "Revised" License'),
    "Unlicense": ("", "The Unlicense", "Unlicense"),
    "Zlib": ("", "zlib License", "The zlib License", "zlib/libpng license"),
}
# The BSD licences in their clauses, with the wordings in use; a bullet folds away.
BSD_MARKS = (("1.", "2.", "3."), ("*", "*", "*"), ("a.", "b.", "c."))
BSD_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
)
BSD_NAMES = (
    "the copyright holder nor the names of its contributors", "the copyright holders nor the names of its contributors",
    "the copyright holder nor the names of the contributors", "the author nor the names of its contributors",
    "the author nor the names of other contributors", "the University nor the names of its contributors",
    "the project nor the names of its contributors", "Google Inc. nor the names of its contributors",
    "Google LLC nor the names of its contributors",
)
BSD_PARTIES = (
    ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT HOLDER OR CONTRIBUTORS"), ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT HOLDERS OR CONTRIBUTORS"),
    ("AUTHOR AND CONTRIBUTORS", "AUTHOR OR CONTRIBUTORS"), ("REGENTS AND CONTRIBUTORS", "REGENTS OR CONTRIBUTORS"),
)
BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE {} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE {} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
# Spellings that mean the same, applied in this order to lower-case words.
SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("noncommercial", "non commercial"),
    ("organisation", "organization"), ("merchantibility", "merchantability"), ("per cent", "percent"),
    ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("acknowledgement", "acknowledgment"),
    ("favour", "favor"), ("honour", "honor"), ("fulfil", "fulfill"), ("judgement", "judgment"), ("labour", "labor"),
    ("https", "http"), ("v", "version"),
]
COPYRIGHT_LINE = r"(?im)^[^\p{L}\p{N}\n]*(?:copyright|\(c\)|\x{A9}|all rights reserved)(?:[^\p{L}\n].*)?$"
NUMBER_DOT = r"(\p{N})\.(\p{N})"
OTHER = r"[^\p{L}\p{N}\x01\n]+"


def canonical_lines(text: Column) -> Column:
    """Lower-case words of letters and digits, a space around each, lines kept apart; dots inside numbers stay."""
    out = F.lower(F.regexp_replace(text, COPYRIGHT_LINE, ""))
    for _ in range(2):  # a digit may stand between two dots
        out = F.regexp_replace(out, NUMBER_DOT, "$1\u0001$2")
    out = F.regexp_replace(out, OTHER, " ")
    out = F.concat(F.lit(" "), F.replace(out, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for one, other in SPELLINGS:
        out = F.replace(out, F.lit(f" {one} "), F.lit(f" {other} "))
    return out


def digest(line: Column) -> Column:
    """Of a canonical line or text; null where nothing is left."""
    tidy = F.trim(F.regexp_replace(line, r"[ \n]+", " "))
    return F.when(tidy != "", F.sha2(tidy, 256))


def bsd_texts() -> list[tuple[str, str]]:
    made = []
    for marks, (giver, liable) in product(BSD_MARKS, BSD_PARTIES):
        clauses = [BSD_CLAUSES[0], *(f"{mark} {clause}" for mark, clause in zip(marks, BSD_CLAUSES[1:], strict=False))]
        end = BSD_DISCLAIMER.format(giver, liable)
        made.append(("BSD-2-Clause", "\n".join([*clauses, end])))
        for name in BSD_NAMES:
            third = f"{marks[2]} Neither the name of {name} may be used to endorse or promote products derived from this software without specific prior written permission."
            made.append(("BSD-3-Clause", "\n".join([*clauses, third, end])))
    return made


def full_texts() -> list[tuple[str, str]]:
    """(license_id, text): the files of ``license_texts`` (named by identifier and edition), the short texts of ``KNOWN`` and
    the BSD licences, under every heading."""
    found = [(path.name[: -len(".txt")], path.read_text(encoding="utf-8")) for path in files(__package__).joinpath("license_texts").iterdir() if path.name.endswith(".txt")]
    found = [(re.sub(r"\.[a-z]+$", "", name), text) for name, text in sorted(found)]
    found += [(name, re.sub(r"\n\s*\n", "\0", text).replace("\n", " ").replace("\0", "\n")) for name, text in found]
    short = [(name, text.split("\n", 1)[1]) for name, text in KNOWN if name in HEADINGS and text.split("\n", 1)[0] in HEADINGS[name]]
    short += [(name, text.replace("modify, and/or distribute", "modify, and distribute")) for name, text in short if name == "ISC"]
    found += short + bsd_texts()
    return [(name, f"{heading}\n{text}") for name, text in found for heading in HEADINGS.get(name, ("",))]


def known_texts(spark: SparkSession) -> DataFrame:
    """(license_id, text) of the notices and licence texts that come with the library; constant and small."""
    return spark.createDataFrame(list(dict.fromkeys(KNOWN + full_texts())), "license_id string, text string")


def known_digests(texts: DataFrame) -> DataFrame:
    """(license_id, known) of the known texts (license_id, text). A text under two identifiers goes by the first, so no
    document is doubled."""
    rows = texts.select("license_id", digest(canonical_lines(F.col("text"))).alias("known")).filter("known is not null")
    return rows.groupBy("known").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Every document: doc_id, digest of the canonical whole text, license_id that the whole text is (or null), and
    notices, the distinct identifiers found on lines of their own, in order, comma between (or null). ``texts`` (license_id, text) are
    looked up instead of ``known_texts``. Canonical forms are worked out once, and written as digests; a row is known by
    128 bits of its id and text."""
    known = saved(known_digests(known_texts(docs.sparkSession) if texts is None else texts), "known-digests")
    row = [F.xxhash64("doc_id", "text").alias("t1"), F.xxhash64(F.lit("t"), "doc_id", "text").alias("t2")]
    forms = docs.select("doc_id", *row, canonical_lines(F.col("text")).alias("form"))
    cut = forms.select("doc_id", "t1", "t2", digest(F.col("form")).alias("digest"), F.split("form", "\n").alias("lines"))
    lined = cut.select("doc_id", "t1", "t2", "digest", F.posexplode_outer("lines").alias("place", "line"))
    lined = saved(lined.select("doc_id", "t1", "t2", "digest", "place", digest(F.col("line")).alias("line")), "line-digests")
    named = known.withColumnRenamed("license_id", "name")
    found = lined.select("t1", "t2", "line").join(named, F.col("line") == F.col("known"))
    notices = found.groupBy("t1", "t2").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("notices"))
    whole = lined.filter("coalesce(place, 0) = 0").select("doc_id", "t1", "t2", "digest").join(known, F.col("digest") == F.col("known"), "left")
    return whole.join(notices, ["t1", "t2"], "left").select("doc_id", "digest", "license_id", "notices")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle_sql() -> str:
    form = f"lower(regexp_replace(text, {_quoted(COPYRIGHT_LINE)}, '', 'g'))"
    for _ in range(2):
        form = f"regexp_replace({form}, {_quoted(NUMBER_DOT)}, '\\1' || chr(1) || '\\2', 'g')"
    form = f"' ' || replace(regexp_replace({form}, {_quoted(OTHER)}, ' ', 'g'), chr(10), ' ' || chr(10) || ' ') || ' '"
    for one, other in SPELLINGS:
        form = f"replace({form}, ' {one} ', ' {other} ')"
    rows = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in dict.fromkeys(KNOWN + full_texts()))
    tidy = "trim(regexp_replace({}, '[ \n]+', ' ', 'g'))"
    return f"""
with known as (
  select min(license_id) as license_id, known from (
    select license_id, sha256({tidy.format("form")}) as known from (select license_id, {form} as form from (values {rows}) as t(license_id, text))
    where {tidy.format("form")} <> ''
  ) group by known
), forms as (select row_number() over () as row_id, doc_id, {form} as form from documents
), whole as (
  select row_id, doc_id, case when {tidy.format("form")} <> '' then sha256({tidy.format("form")}) end as digest from forms
), lines as (
  select row_id, {tidy.format("line")} as line from (select row_id, unnest(string_split(form, chr(10))) as line from forms)
), notices as (
  select row_id, string_agg(license_id, ',' order by license_id) as notices
  from (select distinct row_id, license_id from lines join known on sha256(line) = known where line <> '') group by row_id
)
select whole.doc_id, digest, license_id, notices
from whole left join known on digest = known left join notices on whole.row_id = notices.row_id
"""
