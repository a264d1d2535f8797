"""Licence scan by canonical digest: whole texts that differ in form only meet in one hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that count as equal at the beginning of a word, as (variant, canonical form), applied in this order.
SPELLINGS = (
    ("licence", "license"), ("licenci", "licensi"), ("sublicence", "sublicense"), ("sublicenci", "sublicensi"), ("acknowledgement", "acknowledgment"),
    ("authoris", "authoriz"), ("unauthoris", "unauthoriz"), ("organis", "organiz"), ("recognis", "recogniz"), ("favour", "favor"), ("behaviour", "behavior"), ("centre", "center"),
    ("fulfil ", "fulfill "), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("per cent ", "percent "), ("merchantibility", "merchantability"),
)
# Published licence texts and notices.
_PERMISSION = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
_NO_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_REDISTRIBUTION = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_NO_ENDORSEMENT = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_WARRANTY = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_WHOLE = (
    ("MIT", ("MIT License", "The MIT License", "The MIT License (MIT)"), f"{_PERMISSION}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_NO_WARRANTY}"),
    ("ISC", ("ISC License", "The ISC License"), f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}"),
    ("0BSD", ("BSD Zero Clause License", "Zero-Clause BSD"), f"{_ISC_GRANT}.\n\n{_ISC_WARRANTY}"),
    ("BSD-2-Clause", ("BSD 2-Clause License", "The 2-Clause BSD License"), _REDISTRIBUTION + _BSD_WARRANTY),
    ("BSD-3-Clause", ("BSD 3-Clause License", "The 3-Clause BSD License"), _REDISTRIBUTION + _NO_ENDORSEMENT + _BSD_WARRANTY),
)
NOTICES = (
    ("MIT-notice", "Released under the MIT License."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
)
# whole texts with each usual title and without, and the notices
KNOWN = tuple((n, f"{t}\n\n{x}") for n, titles, x in _WHOLE for t in titles) + tuple((n, x) for n, _, x in _WHOLE) + NOTICES
# Canonical SHA-256 of long licences as published, each with its title and appendix.
DIGESTS = (
    ("Apache-2.0", "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f"),
    ("GFDL-1.3", "7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Rules for copyright statements, (pattern, replacement with $1 for a group), in the syntax that Java and RE2 share:
# a grant begins a line, and so does a statement that follows a title; a line that begins with "copyright notice" and the like goes on
# with the one before; then lines that begin as a statement are dropped, and "all rights reserved" alone on a line.
STATEMENTS = (
    (r"\r", ""),
    (r"[ \t]+(permission is hereby granted|permission to use|redistribution and use)", "\n$1"),
    (r"(licen[sc]e|licen[sc]e \([a-z]+\)|zero-clause bsd)[ \t]+((copyright[ \t]+)?(\(c\)|©|[0-9]{4}))", "$1\n$2"),
    (r"\n[ \t#*/;%-]*(copyright[ \t]+(notice|holder|owner|licen[sc]e|law|statement|interest|protect|disclaimer|(and|or|in|on|of|to|is)[ \t]))", " $1"),
    (r"(^|\n)[ \t#*/;%-]*(copyright[ \t:(©]|\(c\)[ \t]*(copyright|[0-9])|©)[^\n]*", "$1 "),
    (r"(^|\n)[ \t#*/;%-]*all rights reserved[ .\t]*($|\n)", "\n"),
)
PUNCTUATION = r"[\x00-/:-@\[-`{-\x7f\x{a0}\x{a9}\x{2010}-\x{2027}]+"


def canonical(text: Column) -> Column:
    """A-Z lower-cased, copyright statements dropped, each run of punctuation and space one space, spellings evened."""
    x = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    for pattern, put in STATEMENTS:
        x = F.regexp_replace(x, pattern, put)
    x = F.concat(F.lit(" "), F.trim(F.regexp_replace(x, PUNCTUATION, " ")), F.lit(" "))
    for variant, form in SPELLINGS:
        x = F.replace(x, F.lit(f" {variant}"), F.lit(f" {form}"))
    return F.trim(x)


def canonical_sql(text: str) -> str:
    """The same as DuckDB SQL."""
    x = f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"
    for pattern, put in STATEMENTS:
        put = "E'" + put.replace("$", "\\\\").replace("\n", "\\n") + "'"
        x = f"regexp_replace({x}, '{pattern}', {put}, 'g')"
    x = f"' ' || trim(regexp_replace({x}, '{PUNCTUATION}', ' ', 'g')) || ' '"
    for variant, form in SPELLINGS:
        x = f"replace({x}, ' {variant}', ' {form}')"
    return f"trim({x})"


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license, text) of the built-in list."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(n).alias("license"), F.lit(t).alias("text")) for n, t in KNOWN])))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, canonical_sha256, license (null if the whole text is no known licence).

    The built-in list has a constant size and is broadcast; a caller's list is joined as Spark sizes it, and
    AQE splits a digest that many copies share. Several names of one canonical text: the smallest wins, so no row
    is doubled. A null text counts as empty; a known text that is empty matches nothing. Repeated rows and
    null ids keep one row each; an empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    listed = known if known is not None else known_licenses(spark)
    table = listed.select(canonical(F.col("text")).alias("__c"), F.col("license")).where("__c <> ''").select(F.sha2("__c", 256).alias("canonical_sha256"), "license")
    if known is None and DIGESTS:
        table = table.union(spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(d).alias("canonical_sha256"), F.lit(n).alias("license")) for n, d in DIGESTS]))))
    table = table.groupBy("canonical_sha256").agg(F.min("license").alias("license"))
    rows = docs.select(F.col(id_col), F.sha2(canonical(F.col(text_col)), 256).alias("canonical_sha256"))
    joined = rows.join(table if known is not None else F.broadcast(table), "canonical_sha256", "left")
    return joined.select(id_col, "canonical_sha256", "license")
