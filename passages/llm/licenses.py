"""Licence lookup by canonical digest: a whole text, normalised, against digests of known licences.

Normalising drops copyright lines, case, punctuation and layout and unifies equivalent spellings, so
that copies of a licence that differ only in these get one digest. The texts meet the known digests
in a hash join; the same expressions normalise both sides. The known licences are a table of (licence_id, text),
one row for each form in which a licence is published, with its title and without; :func:`licence_files` reads such
a table from a folder of full texts.

Defined results: a null text counts as empty; a text with nothing left after normalising has the
digest of the empty string and no licence; repeated rows give repeated rows; two known licences of one
digest give the smaller name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passages.llm.common import small, written

# The published texts of short licences.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "WTFPL": """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.
DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION
0. You just DO WHAT THE FUCK YOU WANT TO.""",
    "notice:MIT": "Released under the MIT License.",
    "notice:Apache-2.0": "Licensed under the Apache License, Version 2.0.",
}

# First lines that files of a licence carry.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License"],
    "Unlicense": ["The Unlicense"],
    "Zlib": ["zlib License", "The zlib License"],
    "WTFPL": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004"],
}

# Equivalent spellings, as words of a normalised text.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "cancelled": "canceled",
    "copyright holder": "copyright owner",
    "favour": "favor",
    "fulfil": "fulfill",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "licence": "license",
    "organisation": "organization",
    "recognise": "recognize",
    "sub license": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}

#: A line that states a copyright (with its sign or a year) or reserves rights.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}(©\n]*(?:copyright[ \t:]*(?:\(c\)|©|[0-9]{4})|\(c\)[ \t]*[0-9]{4}|©|all rights reserved)[^\n]*$"


def canonical(text: Column) -> Column:
    """The normalised text. Each replacement runs only where a cheap test says it can apply."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    low = F.when(low.contains("copyright") | low.contains("(c)") | low.contains("©") | low.contains("all rights"), F.regexp_replace(low, COPYRIGHT_LINE, "")).otherwise(low)
    return F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "))


def _spaced(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def unified(words: Column) -> Column:
    """A normalised text with equivalent spellings made one. Each word gets spaces of its own, so neighbours are both replaced."""
    out = F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))
    for said, meant in SPELLINGS.items():
        out = F.replace(out, F.lit(_spaced(said)), F.lit(_spaced(meant)))
    return F.when(words.rlike(f"(?:{'|'.join(SPELLINGS)})"), F.trim(F.replace(out, F.lit("  "), F.lit(" ")))).otherwise(words)


def known_digests(licences: DataFrame) -> DataFrame:
    """(digest, licence_id) of a table of (licence_id, text)."""
    return licences.select("licence_id", canonical(F.col("text")).alias("c")).select("licence_id", F.sha2(unified(F.col("c")), 256).alias("digest")).groupBy("digest").agg(F.min("licence_id").alias("licence_id"))


def _forms() -> list[tuple[str, str]]:
    return [(k, form) for k, text in KNOWN.items() for form in (text, *(f"{title}\n\n{text}" for title in TITLES.get(k, [])))]


def default_licences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_forms(), "licence_id string, text string")


def licence_files(spark: SparkSession, folder: str) -> DataFrame:
    """(licence_id, text) of each file of a folder of full licence texts, named after the file without ``.txt``."""
    name = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))), r"\.txt$", "")
    return spark.read.text(folder, wholetext=True).select(name.alias("licence_id"), F.col("value").alias("text"))


def licence_lookup(docs: DataFrame, licences: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Adds ``digest``, ``n_words`` of the normalised text and ``licence_id`` (null if unknown)."""
    licences = default_licences(docs.sparkSession) if licences is None else licences
    known = written(known_digests(licences), "licences") if (n := licences.count()) > len(_forms()) else known_digests(licences)
    normal = docs.drop("digest", "n_words", "licence_id").withColumn("__c", canonical(F.col(text)))
    n_words = F.when(F.col("__c") == "", 0).otherwise(F.length("__c") - F.length(F.translate("__c", " ", "")) + 1).cast("long")
    scanned = normal.withColumn("n_words", n_words).withColumn("digest", F.sha2(unified(F.col("__c")), 256)).drop("__c")
    return scanned.join(small(known, n), "digest", "left")


def licence_report(docs: DataFrame) -> DataFrame:
    return licence_lookup(docs.select("doc_id", "text")).select("doc_id", "n_words", "digest", "licence_id")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_digest(text: str) -> tuple[str, str]:
    """DuckDB expressions for the normalised text and its digest."""
    low = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    c = f"trim(regexp_replace(regexp_replace({low}, {_quoted(COPYRIGHT_LINE)}, '', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    out = "' ' || replace(c, ' ', '  ') || ' '"
    for said, meant in SPELLINGS.items():
        out = f"replace({out}, {_quoted(_spaced(said))}, {_quoted(_spaced(meant))})"
    return c, f"sha256(trim(replace({out}, '  ', ' ')))"


def report_sql() -> str:
    c, digest = _sql_digest("text")
    known = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in _forms())
    return f"""
WITH known AS (SELECT digest, min(licence_id) licence_id FROM (SELECT licence_id, {digest} digest FROM (SELECT licence_id, {c} c FROM (VALUES {known}) t(licence_id, text))) GROUP BY digest),
docs AS (SELECT doc_id, CASE WHEN c = '' THEN 0 ELSE length(c) - length(replace(c, ' ', '')) + 1 END::BIGINT n_words, {digest} digest FROM (SELECT doc_id, {c} c FROM documents))
SELECT doc_id, n_words, digest, licence_id FROM docs LEFT JOIN known USING (digest)"""
