"""Licence scan by canonical digest lookup, with DataFrame functions only.

A text is brought to a canonical form (lower case, no copyright lines, punctuation and white space as single spaces,
equivalent spellings replaced) and its SHA-256 is hash-joined to the digests of known licences, so a licence is found
however it is wrapped, cased, punctuated or dated. Whole texts are joined so; the one-line notices by which a text names
its licence are looked up line by line with the same canonical form. Nothing is shuffled: the table of known digests is
a fixed list of this module and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Equivalent spellings, as published in the SPDX licence-matching guidelines.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog",
    "categorise": "categorize", "centre": "center", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite",
    "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling",
    "labour": "labor", "licence": "license", "licenced": "licensed", "licences": "licenses", "maximise": "maximize",
    "modelled": "modeled", "modelling": "modeling", "offence": "offense", "optimise": "optimize", "organisation": "organization",
    "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize",
    "signalling": "signaling", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}

#: The texts of some short licences.
_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n"
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
LICENSES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    'Software.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
    "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
    "OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": f"{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_AS_IS}",
    "0BSD": f"{_GRANT}.\n{_AS_IS}",
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission.\n" + _BSD_TAIL,
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
    'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the '
    "License for the specific language governing permissions and limitations under the License.",
    "WTFPL": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n"
    "0. You just DO WHAT THE FUCK YOU WANT TO.",
}

#: Digests of the canonical forms of whole licences, as Debian has them in /usr/share/common-licenses.
DIGESTS = {
    "045649cdaf85384ba827242062f2f3b36409835c98d297e25177cb1faf7c2847": "Apache-2.0",
    "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f": "CC0-1.0",
    "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71": "GFDL-1.2",
    "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6": "GFDL-1.3",
    "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224": "GPL-1.0",
    "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821": "GPL-2.0",
    "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68": "GPL-3.0",
    "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908": "LGPL-2.0",
    "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891": "LGPL-2.1",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354": "MPL-1.1",
    "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9": "MPL-2.0",
}

#: One-line notices. Each has a word that begins with "licens", which lets other lines be passed over.
NOTICES = {
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Licensed under the Apache License, Version 2.0 (the \"License\");": "Apache-2.0",
    "Released under the MIT License.": "MIT",
    "Licensed under the MIT License.": "MIT",
    "This project is licensed under the MIT License.": "MIT",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "Licensed under CC BY 4.0": "CC-BY-4.0",
    "Licensed under CC BY-SA 4.0": "CC-BY-SA-4.0",
    "Licensed under CC BY-NC 4.0": "CC-BY-NC-4.0",
    "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under the BSD 3-Clause License.": "BSD-3-Clause",
    "SPDX-License-Identifier: MIT": "MIT",
    "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
    "SPDX-License-Identifier: GPL-3.0-only": "GPL-3.0",
}

#: More of them: the SPDX ids that ``NOTICES`` has not.
SPDX = {
    f"SPDX-License-Identifier: {name}{suffix}": name
    for names, suffixes in (
        ("BSD-2-Clause ISC 0BSD WTFPL Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 MPL-1.1 MPL-2.0", ("",)),
        ("GPL-1.0 GPL-2.0 GPL-3.0 LGPL-2.0 LGPL-2.1 LGPL-3.0 AGPL-3.0 GFDL-1.2 GFDL-1.3", ("", "+", "-only", "-or-later")),
    )
    for name in names.split() for suffix in suffixes if (name, suffix) != ("GPL-3.0", "-only")
}

#: A line that opens with a copyright sign, or with the word and a sign, year or placeholder.
_COPYRIGHT_LINE = r"(^|\n)[^\p{L}\p{N}\n©(]*(©|\([cC]\)[ \t]|(?i:copyright)[ \t]*(©|\([cC]\)|[0-9<\[]))[^\n]*"
_NOT_WORD = r"[^\p{L}\p{N}]+"
_MARK = "licen"


def canonical(text: Column) -> Column:
    """The canonical form: words apart by two spaces, with one space around (so that each word has spaces of its own)."""
    lines = F.when(F.lower(text).rlike(r"copyright|©|\(c\)"), F.regexp_replace(text, _COPYRIGHT_LINE, "\n")).otherwise(text)
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(lines), _NOT_WORD, "  "), F.lit(" "))
    same = words
    for a, b in SPELLINGS.items():
        same = F.replace(same, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.when(words.rlike(f" (?:{'|'.join(SPELLINGS)}) "), same).otherwise(words)


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form of ``text``; null counts as empty."""
    return F.sha2(F.trim(F.regexp_replace(canonical(F.coalesce(text, F.lit(""))), " +", " ")), 256)


def known(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """(known_digest, license): a row for each known text."""
    rows = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in texts.items()])
    return spark.range(1).select(F.explode(rows).alias("k")).select(digest(F.col("k.text")).alias("known_digest"), "k.license")


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", more: DataFrame | None = None) -> DataFrame:
    """Per row: key, canonical_sha256, license (the known licence that the whole text is, or null), notices (ids of the
    licences named by one-line notices, sorted, distinct, comma-separated; empty if none).

    ``more`` is a table of further known texts (license, text) of any size; of several licences with one canonical form the
    least name is given. Its rows without a name or without words are passed over.

    Null and empty texts have the digest of the empty form and no licence. Repeated rows stay; only ``key`` and ``text``
    are read, so other columns cannot clash; an empty table gives no rows.
    """
    spark = df.sparkSession
    by_text = NOTICES | SPDX
    # notices that differ in punctuation only ("GPL-3.0+", "GPL-3.0") have one digest
    lookup = F.map_from_entries(F.array_distinct(F.array(*[F.struct(digest(F.lit(t)), F.lit(n)) for t, n in by_text.items()])))
    marked = F.filter(F.split(F.col("_text"), "\n"), lambda line: F.lower(line).contains(_MARK))
    names = F.array_compact(F.transform(marked, lambda line: F.try_element_at(lookup, digest(line))))
    notices = F.when(F.lower("_text").contains(_MARK), F.array_join(F.array_sort(F.array_distinct(names)), ",")).otherwise(F.lit(""))
    docs = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    docs = docs.select("doc_id", digest(F.col("_text")).alias("canonical_sha256"), notices.alias("notices"))
    texts = known(spark, LICENSES).unionByName(spark.createDataFrame(list(DIGESTS.items()), "known_digest string, license string"))
    if more is None:
        texts = F.broadcast(texts)  # a constant number of rows
    else:
        own = more.select(digest(F.col("text")).alias("known_digest"), F.col("license")).where(F.col("license").isNotNull() & (F.col("known_digest") != digest(F.lit(""))))
        texts = texts.unionByName(own).groupBy("known_digest").agg(F.min("license").alias("license"))
    return docs.join(texts, docs.canonical_sha256 == texts.known_digest, "left").select("doc_id", "canonical_sha256", "license", "notices")


def _sql_canonical(text: str) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    form = f"concat(' ', regexp_replace(lower(regexp_replace({text}, {quoted(_COPYRIGHT_LINE)}, chr(10), 'g')), {quoted(_NOT_WORD)}, '  ', 'g'), ' ')"
    for a, b in SPELLINGS.items():
        form = f"replace({form}, ' {a} ', ' {b} ')"
    return f"sha256(trim(regexp_replace({form}, ' +', ' ', 'g')))"


def oracle_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = lambda d: ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in d.items())
    return f"""
    WITH texts AS (SELECT license, {_sql_canonical("body")} AS digest FROM (VALUES {values(LICENSES)}) t(license, body)),
    notice AS (SELECT DISTINCT license, {_sql_canonical("body")} AS digest FROM (VALUES {values(NOTICES)}) t(body, license)),
    docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
    lines AS (SELECT rid, unnest(string_split(body, chr(10))) AS line FROM docs),
    named AS (SELECT rid, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
              FROM (SELECT rid, {_sql_canonical("line")} AS digest FROM lines WHERE lower(line) LIKE '%licen%') l JOIN notice USING (digest) GROUP BY rid)
    SELECT d.doc_id, d.digest AS canonical_sha256, t.license, coalesce(n.notices, '') AS notices
    FROM (SELECT rid, doc_id, {_sql_canonical("body")} AS digest FROM docs) d LEFT JOIN texts t USING (digest) LEFT JOIN named n USING (rid)
    """
