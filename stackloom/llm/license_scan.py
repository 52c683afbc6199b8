"""Licence scans by canonical digests, in DataFrame expressions only.

A text is put into a canonical form (case, copyright lines, equivalent spellings, punctuation), hashed, and joined with
the digests of known licences: the entire text by a hash join, each of its lines, as notices stand in lines of
their own, by a lookup in the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.llm.common import keep, small

# Equivalent spellings, and texts of known licences and notices.
SPELLINGS = (
    ("licence", "license"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("non commercial", "noncommercial"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("sub license", "sublicense"),
    ("creative commons attribution noncommercial", "cc by nc"),
    ("gnu gpl", "gnu general public license"),
    ("version 3 0", "version 3"),
)  # of whole words
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Licensed under Creative Commons Attribution-NonCommercial 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions:

        The above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the Software.

        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
        THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
        AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
        IN THE SOFTWARE.""",
    ),
    (
        "0BSD",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted.

        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
        ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
        DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
        USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
)
WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
        EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
        DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
        LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
        THE POSSIBILITY OF SUCH DAMAGE."""
BINARY = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met:

        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution."""
ENDORSE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
        from this software without specific prior written permission."""
KNOWN += (
    ("BSD-2-Clause", f"{BINARY}\n\n{WARRANTY}"),
    ("BSD-3-Clause", f"{BINARY}\n\n{ENDORSE}\n\n{WARRANTY}"),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.

        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
        ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
        DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
        USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software.

        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
        alter it and redistribute it freely, subject to the following restrictions:

        1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.
        If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
        not required.

        2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
        software.

        3. This notice may not be removed or altered from any source distribution.""",
    ),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at

        http://www.apache.org/licenses/LICENSE-2.0

        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License."""),
)
#: Title lines with which a whole text may begin.
TITLES = {"MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"), "BSD-2-Clause": ("BSD 2-Clause License",), "BSD-3-Clause": ("BSD 3-Clause License",), "ISC": ("ISC License",), "Zlib": ("zlib License",)}
KNOWN += tuple((i, f"{title}\n\n{text}") for i, text in KNOWN if len(text) > 200 for title in TITLES.get(i, ()))
#: Known digests up to which lines are looked up in the row; beyond it they are joined.
INLINE = 100
COPYRIGHT_LINE = r"(?m)^[ \t/*#;>-]*(copyright|\(c\)|©)[^\n]*"
OTHER = r"[^\p{L}\p{N}]+"
WORD = r"[\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """Lower case without copyright lines, words apart by one space, equivalent spellings made one; empty for null."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, " ")
    t = F.concat(F.lit(" "), F.trim(F.regexp_replace(t, OTHER, "  ")), F.lit(" "))  # two spaces, so that each word has both of its own
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(f" {_wide(a)} "), F.lit(f" {_wide(b)} "))
    return F.trim(F.replace(t, F.lit("  "), F.lit(" ")))


def _wide(spelling: str) -> str:
    return spelling.replace(" ", "  ")


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form; that of the empty text where there is no word."""
    return F.sha2(canonical(text).cast("binary"), 256)


def first_words(heads: set[str]) -> list[str] | None:
    """The words, in lower case, that a text may begin with whose canonical form begins with one of ``heads``; None for any, as the form may be empty.

    A text whose first word is in a copyright line has lost all of that line, so a single line has then no word left.
    """
    if "" in heads:
        return None
    found = set(heads)
    for a, b in reversed(SPELLINGS):
        if b.split()[0] in found:
            found.add(a.split()[0])
    return sorted(found)


def scan(docs: DataFrame, known: tuple | DataFrame = KNOWN) -> DataFrame:
    """doc_id, digest, license (of the entire text, else null), line_licenses and n_license_lines of every row.

    ``known`` are pairs of a licence and a text, or a table (license, known) of any length; of licences with one digest the first by name
    counts. Null and empty texts match nothing; very long ones are hashed whole. Rows stay one for one, repeated ones too. Extra columns are not read.
    """
    spark = docs.sparkSession
    listed = known if isinstance(known, DataFrame) else spark.createDataFrame(list(known), "license string, known string")
    table = keep(listed.select(digest(F.col("known")).alias("digest"), "license", F.substring_index(canonical(F.col("known")), " ", 1).alias("head")).groupBy("digest").agg(F.min("license").alias("license"), F.min("head").alias("head")))
    rows = table.count()
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).withColumn("digest", digest(F.col("text")))
    each = F.split(F.coalesce("text", F.lit("")), "\n")
    of_text = small(table.drop("head"), rows)
    if rows <= INLINE:
        listed = table.collect()
        ids = F.create_map(*[F.lit(x) for r in listed for x in (r["digest"], r["license"])]) if rows else F.lit(None).cast("map<string,string>")
        begin = first_words({r["head"] for r in listed})
        if begin is not None:  # only lines that begin as a known form does can be one
            each = F.filter(each, lambda x: F.regexp_extract(F.lower(x), WORD, 0).isin(begin))
        d = d.select("doc_id", "digest", F.filter(F.transform(each, lambda x: F.try_element_at(ids, digest(x))), lambda x: x.isNotNull()).alias("lines"))
    else:  # rows of equal id and text have equal lines
        key = ["doc_id", "digest", "own"]
        d = d.withColumn("own", F.xxhash64("text"))
        lines = d.dropDuplicates(key).select(*key, F.explode(F.transform(each, digest)).alias("line")).groupBy(*key, "line").agg(F.count("*").alias("n"))
        met = lines.join(small(table.select(F.col("digest").alias("line"), "license"), rows), "line").groupBy(*(F.col(c).alias(f"{c}_") for c in key)).agg(F.flatten(F.collect_list(F.array_repeat("license", F.col("n").cast("int")))).alias("lines"))
        on = F.col("own") == F.col("own_")
        for c in key[:2]:
            on = on & F.col(c).eqNullSafe(F.col(f"{c}_"))
        d = d.drop("text").join(met, on, "left").select("doc_id", "digest", F.coalesce("lines", F.array().cast("array<string>")).alias("lines"))
    d = d.join(of_text, "digest", "left")
    return d.select("doc_id", "digest", "license", F.array_join(F.array_sort(F.array_distinct("lines")), ",").alias("line_licenses"), F.size("lines").cast("long").alias("n_license_lines"))


def scan_sql(known=KNOWN) -> str:
    """DuckDB SQL for the rows of scan() over ``documents``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def form(x: str) -> str:
        t = f"' ' || trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), {quote(COPYRIGHT_LINE)}, ' ', 'g'), {quote(OTHER)}, '  ', 'g')) || ' '"
        for a, b in SPELLINGS:
            t = f"replace({t}, {quote(f' {_wide(a)} ')}, {quote(f' {_wide(b)} ')})"
        return f"trim(replace({t}, '  ', ' '))"

    rows = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in known)
    return f"""
    WITH known AS (SELECT sha256({form("txt")}) AS digest, min(lic) AS lic FROM (VALUES {rows}) v(lic, txt) GROUP BY 1),
    units AS (SELECT doc_id, sha256({form("text")}) AS digest FROM documents),
    lines AS (SELECT doc_id, sha256({form("line")}) AS digest FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)),
    found AS (SELECT doc_id, string_agg(DISTINCT lic, ',' ORDER BY lic) AS ids, count(*) AS n FROM lines JOIN known USING (digest) GROUP BY doc_id)
    SELECT u.doc_id, u.digest, k.lic AS license, coalesce(f.ids, '') AS line_licenses, coalesce(f.n, 0)::BIGINT AS n_license_lines
    FROM units u LEFT JOIN known k ON k.digest = u.digest LEFT JOIN found f ON f.doc_id = u.doc_id
    """
