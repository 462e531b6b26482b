"""Operator 3: license scans by canonical digest lookup (DataFrame functions only).

A text is brought to a canonical form: lower case, without copyright lines, punctuation and white space as single
spaces, equivalent spellings made alike. The SHA-256 of the whole canonical text is joined to the digests of the known
license texts (KNOWN with their usual titles, and DIGESTS of long ones); so are the digests of single lines, which finds
the usual one-line notices.

Results: a null text counts as empty; an empty canonical text matches nothing; a text equal to several known ones gets
the first name; notices are listed once each, in order of name; documents without any have a null. Notices depend on the
text alone, so rows that repeat a doc_id, or have none, have their own; repeated rows stay; an empty table gives an empty
one; columns named like a result, whatever their case, are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gnosia.llm.common import without

#: Known texts up to which their digests are broadcast; more are joined by a shuffle.
BROADCAST_TEXTS = 50_000
COPYRIGHT = r"(?m)^[ \t]*(?:copyright\b|\(c\)|©|all rights reserved)[^\n]*$"
#: Equivalent spellings, each made like the second (whole words but for the stems).
SPELLINGS = [
    ("licenc", "licens"), ("sub licens", "sublicens"), ("isation", "ization"), ("acknowledgement", "acknowledgment"), (" favour", " favor"), (" fulfil ", " fulfill "),
    (" artefact", " artifact"), (" authoris", " authoriz"), (" organis", " organiz"), (" recognis", " recogniz"), (" whilst ", " while "), (" per cent ", " percent "),
    (" non commercial", " noncommercial"), (" wilful", " willful"), (" copyright owner", " copyright holder"), (" centre ", " center "), (" programme ", " program "), (" judgement", " judgment"),
    (" released under ", " licensed under "), (" distributed under ", " licensed under "), (" made available under ", " licensed under "), (" provided under ", " licensed under "), (" available under ", " licensed under "),
    (" this work is licensed under ", " licensed under "), (" this software is licensed under ", " licensed under "), (" this project is licensed under ", " licensed under "), (" the terms of the ", " the "),
]

_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
    "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED "
    "OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
    "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
    "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
#: Texts and notices known without a table of the caller's own (published texts, fixed values). Longer licenses come as a table.
KNOWN: list[tuple[str, str]] = [
    ("0BSD", f"{_ISC}.\n{_ISC_END}"),
    ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}"),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", f"{_BSD}3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n{_BSD_END}"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + _AS_IS),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    *((x, f"SPDX-License-Identifier: {x}") for x in ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0")),
]
#: Titles that stand above the short license texts, or not (fixed values).
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License", "The ISC License"], "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License"], "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License"],
}
KNOWN += [(name, f"{title}\n\n{text}") for name, text in KNOWN if "\n" in text for title in TITLES[name]]
#: Digests of the canonical forms of long published license texts (fixed values).
DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "9de1575bea8da38d08e39dc5a75155deea1535727e9ee346d850541a237b3ee2"),
    ("Artistic-1.0-Perl", "de5e8896b763918701eb91e7bf8bf81f20a97c9f8dd1cacc44519e47d3462bf8"),
    ("CC0-1.0", "d24369f38fdf7181917831aa40ec7761926fead9e1c43fbb25e4ed156fc0ba0f"),
    ("GFDL-1.2", "7462935f3ef7575ba2b1e6c8037ccca15d2ef67eea91430106201231a18ee5a2"),
    ("GFDL-1.3", "9a193c7dcfa64020db71c4380ec6ae4c1131eb7ee6a6bbdb02a866034b1c1022"),
    ("GPL-1.0", "7a119fa9d2fd5152b5ad22405d54120ee858bcf7d3680931b21eee08ab0de726"),
    ("GPL-2.0", "5045c47b28957fce73a1a041e9715ce78f3866c82926e58c85276f963432c125"),
    ("GPL-3.0", "35ee5fe8ad4bff67556d4e2459d2988fccefb6ce33af05a656071899e30e5a8f"),
    ("LGPL-2.0", "80a627a23f14f1f5b6e5e99dff00ca10b27f3d98c9f1031f926e0f7283bd0c4f"),
    ("LGPL-2.1", "9b57ca183358607b9f247a843e832bc3a99be0ceb048d34a4d57f323ec30704e"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "d60810cafea0c474cf585853e5c856a78313f67b4c997c1886a4af29d6efe61e"),
    ("MPL-2.0", "7d8b1151366bfb9810fdd82940a1f031f9811b46502527cfcf3deb77576b52ee"),
]


def canonical(text: Column) -> Column:
    """The canonical form of a text; empty for null."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT, " ")
    t = F.concat(F.lit(" "), F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    for other, usual in SPELLINGS:
        t = F.replace(t, F.lit(other), F.lit(usual))
    return F.trim(t)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """(digest, name) of the known texts: one row for each digest, with its first name."""
    table = known if known is not None else spark.createDataFrame(KNOWN, "name string, text string")
    rows = table.where("name is not null").select("name", canonical(F.col("text")).alias("c")).where("c <> ''").select(F.sha2("c", 256).alias("digest"), "name")
    if known is None and DIGESTS:
        rows = rows.union(spark.createDataFrame([(d, n) for n, d in DIGESTS], "digest string, name string"))
    return rows.groupBy("digest").agg(F.min("name").alias("name"))


def scan(df: DataFrame, known: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Add canonical_sha256, license (of the whole text) and notices (of lines, comma-separated) to every row.

    known: a table (name, text); KNOWN and DIGESTS by default. Lines are matched before anything is shuffled, so only
    digests of texts with notices move, each text's copies summed first.
    """
    table = known_digests(df.sparkSession, known)
    if table.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS:
        table = F.broadcast(table)
    base = without(df, ["canonical_sha256", "license", "notices"])
    src = base.select(F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in base.columns]).alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body"))
    src = src.withColumn("key", F.md5("body"))
    lines = src.select("key", F.explode(F.array_distinct(F.split("body", "\n"))).alias("line")).where("length(line) > 0")
    found = lines.select("key", digest(F.col("line")).alias("digest")).join(table, "digest").select("key", "name").distinct()
    notices = found.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("notices"))
    out = src.withColumn("canonical_sha256", digest(F.col("body"))).join(table.select(F.col("digest").alias("canonical_sha256"), F.col("name").alias("license")), "canonical_sha256", "left").join(notices, "key", "left")
    return out.select(*[F.col("row").getField(c).alias(c) for c in base.columns], "canonical_sha256", "license", "notices")


def oracle() -> str:
    """DuckDB SQL of scan() over `documents`, without the texts."""

    def canon(x: str) -> str:
        t = f"regexp_replace(lower(coalesce({x}, '')), '{COPYRIGHT}', ' ', 'g')"
        t = f"concat(' ', trim(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
        for other, usual in SPELLINGS:
            t = f"replace({t}, '{other}', '{usual}')"
        return f"trim({t})"

    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in KNOWN)
    long = ", ".join(f"('{d}', '{n}')" for n, d in DIGESTS)
    return f"""
WITH known AS (SELECT digest, min(name) AS name FROM (SELECT sha256({canon("t")}) AS digest, name FROM (VALUES {values}) v(name, t) UNION ALL SELECT * FROM (VALUES {long}) l(digest, name)) GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
notices AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS notices FROM lines JOIN known ON sha256({canon("line")}) = digest WHERE line <> '' GROUP BY doc_id),
whole AS (SELECT doc_id, sha256({canon("text")}) AS canonical_sha256 FROM documents)
SELECT doc_id, canonical_sha256, known.name AS license, notices FROM whole LEFT JOIN known ON canonical_sha256 = digest LEFT JOIN notices USING (doc_id)"""
