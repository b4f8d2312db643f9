"""Licence scans: canonical digests of entire texts, joined to those of known licences.

A text in canonical form has no copyright lines, no case, no punctuation and one spelling
of words that have several. A document may be a licence as a whole, or hold lines that
are licence notices; either is looked up by the digest of all of its canonical text.

Defined results: a null text counts as empty; an empty canonical text matches nothing.
Repeated rows give a row each. An empty table gives no rows. Columns other than the id
and the text are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayglass.llm.common import LOWER, UPPER, ascii_lower

# Spellings that count as one, as whole words of a lower-cased text.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("licencing", "licensing"),
    ("sublicence", "sublicense"),
    ("merchantibility", "merchantability"),
    ("noninfringement", "non infringement"),
    ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"),
)
# A copyright line names a year or has the sign; a body line that happens to begin with the
# word, as wrapping may have it, stays.
COPYRIGHT = r"(?m)^[ \t]*(copyright[^\n]*(\(c\)|©|[0-9]{4}|\[year\]|<year>)|(\(c\)|©)[^\n]*[0-9]{4})[^\n]*$"

# Public licence texts and notices by their usual short names.
_NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("all-rights-reserved", "All rights reserved."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        'copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY '
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
        "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
        "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
)

_ISC_LINES = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

""" + _NOTICES[6][1][_NOTICES[6][1].index("THE SOFTWARE") :]

_BSD_2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
_BSD_3 = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""


def _gnu(name: str, version: str) -> str:
    return f"""This program is free software: you can redistribute it and/or modify
it under the terms of the GNU {name} as published by
the Free Software Foundation, either version {version} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {name} for more details.

You should have received a copy of the GNU {name}
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""


_APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http{}://mozilla.org/MPL/2.0/.
"""
_SPDX = (
    "MIT", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later",
    "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "AGPL-3.0-only", "AGPL-3.0-or-later",
)

KNOWN = (
    *_NOTICES,
    *[("MIT", f"{title}\n\n{_NOTICES[5][1]}") for title in ("MIT License", "The MIT License", "The MIT License (MIT)")],
    *[("ISC", title + text) for title in ("ISC License\n\n", "The ISC License\n\n") for text in (_NOTICES[6][1], _ISC_LINES)],
    ("ISC", _ISC_LINES),
    *[("BSD-2-Clause", title + _BSD_2 + _BSD_END) for title in ("", "BSD 2-Clause License\n\n")],
    *[("BSD-3-Clause", title + _BSD_2 + _BSD_3 + _BSD_END) for title in ("", "BSD 3-Clause License\n\n")],
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", _APACHE.split("\n")[0]),
    *[("MPL-2.0", _MPL.format(s)) for s in ("", "s")],
    ("MPL-2.0", _MPL.split("\n")[0]),
    ("GPL-2.0-or-later", _gnu("General Public License", "2")),
    ("GPL-3.0-or-later", _gnu("General Public License", "3")),
    ("LGPL-2.1-or-later", _gnu("Lesser General Public License", "2.1")),
    ("LGPL-3.0-or-later", _gnu("Lesser General Public License", "3")),
    ("AGPL-3.0-or-later", _gnu("Affero General Public License", "3")),
    *[(name, f"SPDX-License-Identifier: {name}") for name in _SPDX],
)


# Digests of the canonical form of whole licence texts as their publishers give
# them, too long to be kept as text. A change of the canonical form changes them.
DIGESTS = (
    ("Apache-2.0", "95f35d79ea3bab75c250549d6a03cef242e0547d78c99e26fcede49936fb0184"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
)


def _spelling(words: Column) -> Column:
    """Padded words with one spelling each; a word at a time, so neighbours do not hide each other."""
    return reduce(lambda t, pair: F.replace(t, F.lit(f" {pair[0]} "), F.lit(f" {pair[1]} ")), SPELLINGS, words)


def canonical(text: Column) -> Column:
    lowered = ascii_lower(F.coalesce(text, F.lit("")))
    bare = F.regexp_replace(lowered, COPYRIGHT, "")
    # two spaces between words, so each has its own on either side
    spaced = F.concat(F.lit(" "), F.regexp_replace(bare, r"[^a-z0-9\x{80}-\x{10FFFF}]+", "  "), F.lit(" "))
    return F.trim(F.regexp_replace(_spelling(spaced), " +", " "))


def canonical_sql(text: str) -> str:
    """The same in DuckDB's SQL."""
    lowered = f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"
    pattern = COPYRIGHT.replace("©", r"\x{a9}")
    bare = f"regexp_replace({lowered}, '{pattern}', '', 'g')"
    spaced = rf"' ' || regexp_replace({bare}, '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+', '  ', 'g') || ' '"
    spelt = reduce(lambda t, pair: f"replace({t}, ' {pair[0]} ', ' {pair[1]} ')", SPELLINGS, spaced)
    return f"trim(regexp_replace({spelt}, ' +', ' ', 'g'))"


def known_digests(
    spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN, digests: tuple[tuple[str, str], ...] = DIGESTS
) -> DataFrame:
    """(``_licence``, ``_known``): one row for each distinct digest of the given texts, and for the given digests."""
    rows = F.array(*[F.struct(F.lit(n).alias("_licence"), F.lit(t).alias("_text")) for n, t in known])
    listed = spark.range(1).select(F.inline(rows))
    made = listed.select("_licence", F.sha2(canonical(F.col("_text")).cast("binary"), 256).alias("_known"))
    if digests:
        told = F.array(*[F.struct(F.lit(n).alias("_licence"), F.lit(d).alias("_known")) for n, d in digests])
        made = made.unionByName(spark.range(1).select(F.inline(told)))
    return made.groupBy("_known").agg(F.min("_licence").alias("_licence"))


def licence_scan(
    docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: id, ``text_digest``, ``licence`` of the whole text, ``line_licences``, ``n_licence_lines``.

    One pass: the whole text and its lines travel as one array, and are looked up at once.
    ``known`` has (``_licence``, ``_known``); the default list is a few rows.
    """
    listed = known_digests(docs.sparkSession) if known is None else known
    # a few dozen rows where it is the default; a larger table joins as its size demands
    table = F.broadcast(listed) if known is None else listed
    text = F.coalesce(F.col(text_col), F.lit(""))
    units = F.concat(F.array(text), F.split(text, "\n", -1))
    keyed = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text"), F.posexplode(units).alias("_at", "_unit"))
    digest = F.sha2(canonical(F.col("_unit")).cast("binary"), 256)
    met = keyed.select("_id", "_text", "_at", digest.alias("_digest")).join(table, F.col("_digest") == F.col("_known"), "left")
    line = (F.col("_at") > 0) & F.col("_licence").isNotNull()
    # the place 0 row counts the rows that repeat a document
    return (
        met.where((F.col("_at") == 0) | F.col("_licence").isNotNull())
        .groupBy("_id", "_text")
        .agg(
            F.max(F.when(F.col("_at") == 0, F.col("_digest"))).alias("text_digest"),
            F.max(F.when(F.col("_at") == 0, F.col("_licence"))).alias("licence"),
            F.sort_array(F.collect_set(F.when(line, F.col("_licence")))).alias("line_licences"),
            F.count_if(line).alias("_lines"),
            F.count_if(F.col("_at") == 0).alias("_rows"),
        )
        .select(
            F.col("_id").alias(id_col), "text_digest", "licence", "line_licences",
            (F.col("_lines") / F.col("_rows")).cast("long").alias("n_licence_lines"),
            F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))).alias("_copy"),
        )
        .drop("_copy")
    )
