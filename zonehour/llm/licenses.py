"""Licence scans by canonical digests: a text or a line is a known licence if both are equal in canonical form.

The canonical form drops copyright lines, case, punctuation and white space, and writes equivalent
spellings alike. Digests of whole texts, and of each line, are joined with those of the known licences.
"""

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonehour.sources.shared import save_round

from . import license_table
from .common import arrow_map, arrow_schema, keyed_text, slices

# Spellings that licence texts use alike, the second for the first.
WORDS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill",
    "fulfilment": "fulfillment", "https": "http", "initialise": "initialize", "judgement": "judgment",
    "labelling": "labeling", "labour": "labor", "licence": "license", "licences": "licenses", "maximise": "maximize",
    "modelled": "modeled", "modelling": "modeling", "offence": "offense", "optimise": "optimize",
    "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program",
    "realise": "realize", "recognise": "recognize", "signalling": "signaling", "sublicence": "sublicense",
    "utilisation": "utilization", "whilst": "while",
}
PHRASES = {
    "copyright owner": "copyright holder", "copyright owners": "copyright holders", "per cent": "percent",
    "non infringement": "noninfringement", "non commercial": "noncommercial", "sub license": "sublicense",
}
WORD = re.compile(r"[^\W_]+")
#: Lines that name an owner and a year, or reserve all rights.
COPYRIGHT = re.compile(r"[^\w(©]*(?:(?:copyright|\(c\)|©)\s*(?:copyright|\(c\)|©|[\[<{]?(?:\d|year|yyyy)|by\b|the\b.*\bauthors)"
                       r"|all\s+rights\s+reserved\W*\Z)")
#: The plus sign of an SPDX id.
LATER = re.compile(r"(?<=\d)\+")
PHRASE = re.compile(r"\b(?:" + "|".join(PHRASES) + r")\b")

MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:
"""
BSD_SOURCE = """Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer."""
BSD_BINARY = """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_NAMES = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""
BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted"""
ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
it and redistribute it freely, subject to the following restrictions:

The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you
use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
This notice may not be removed or altered from any source distribution."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of
all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""


def numbered(*parts: str) -> str:
    return "\n".join(f"{i}. {part}" for i, part in enumerate(parts, 1))


def known_licenses() -> list[tuple[str, str]]:
    """(licence id, text): licences that are often whole files or headers, with and without title, and one-line notices."""
    titled = [
        ("MIT", "MIT License", MIT_BODY), ("MIT", "The MIT License (MIT)", MIT_BODY), ("MIT", "The MIT License", MIT_BODY),
        ("ISC", "ISC License", f"{ISC_GRANT}, provided that the above copyright notice and this permission notice appear in"
                               f" all copies.\n\n{ISC_TAIL}"),
        ("0BSD", "Zero-Clause BSD", f"{ISC_GRANT}.\n\n{ISC_TAIL}"), ("0BSD", "BSD Zero Clause License", f"{ISC_GRANT}.\n\n{ISC_TAIL}"),
        ("Zlib", "zlib License", ZLIB), ("Unlicense", "The Unlicense", UNLICENSE), ("Apache-2.0", "", APACHE_NOTICE)]
    for mark in (numbered, lambda *parts: "\n".join(f"* {p}" for p in parts)):
        two = BSD_HEAD + mark(BSD_SOURCE, BSD_BINARY) + BSD_TAIL
        three = BSD_HEAD + mark(BSD_SOURCE, BSD_BINARY, BSD_NAMES) + BSD_TAIL
        titled += [("BSD-2-Clause", "BSD 2-Clause License", two), ("BSD-3-Clause", "BSD 3-Clause License", three)]
    notices = [("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
               ("MIT", "SPDX-License-Identifier: MIT"), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
               ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
               ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
               ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
               ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
               ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"), ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
               ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only")]
    bodies = {(i, body) for i, _, body in titled} | {(i, f"{title}\n\n{body}") for i, title, body in titled if title}
    return sorted(bodies) + notices + license_table.notice_lines()


def canonical_line(line: str) -> str:
    """One line's words in canonical spelling; a copyright line has none."""
    low = line.lower()
    if "spdx" in low:
        low = LATER.sub("-or-later", low)
    if ("copyright" in low or "(c)" in low or "©" in low or "reserved" in low) and COPYRIGHT.match(low):
        return ""
    return " ".join([WORDS.get(w, w) for w in WORD.findall(low)])


def canonical(lines: list[str]) -> str:
    """The text of canonical lines as one line; phrases are compared across line ends."""
    text = " ".join(filter(None, lines))
    return PHRASE.sub(lambda m: PHRASES[m[0]], text)


def digest(canonical_text: str) -> bytes:
    return hashlib.sha256(canonical_text.encode()).digest()


def text_digest(text: str) -> bytes | None:
    """The digest of a whole text, or None where nothing is left of it."""
    form = canonical([canonical_line(x) for x in text.split("\n")])
    return digest(form) if form else None


def license_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license) of the known licences, one row each; a digest of several is that of the least id.

    Without ``known``, long licences are there too, by the digests of their whole texts.
    """
    best = {bytes.fromhex(d): n for d, n in license_table.DIGESTS.items()} if known is None else {}
    for name, text in known_licenses() if known is None else known:
        if of := text_digest(text):
            best[of] = min(name, best.get(of, name))
    return spark.createDataFrame([(bytearray(d), n) for d, n in sorted(best.items())], "digest binary, license string")


def text_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, body, digest, lines): the whole text's digest, and those of its lines; NULL where nothing is left."""
    schema = "doc_id bigint, body bigint, digest binary, lines array<binary>"
    arrow = arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                whole, lines = [], []
                for text in part["text"].to_pylist():
                    forms = [canonical_line(x) for x in (text or "").split("\n")]
                    form = canonical(forms)
                    whole.append(digest(form) if form else None)
                    lines.append([digest(canonical([x])) for x in forms if x])
                yield pa.RecordBatch.from_arrays([
                    part["doc_id"], part["body"], pa.array(whole, pa.binary()), pa.array(lines, pa.list_(pa.binary()))],
                    schema=arrow)

    return arrow_map(keyed_text(docs).withColumn("body", F.xxhash64("text")), work, schema)


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, license, n_notices, notices) of every row.

    ``license``: the known licence that the entire text is, or NULL. ``n_notices``: lines that are a known
    licence by themselves; ``notices``: their licences, each once, ascending, joined by commas, or NULL.
    NULL and empty texts, and texts of copyright lines only, are no licence. Rows that agree in doc_id and
    text get equal results; NULL doc_id is a value. ``known`` is any table (digest, license) with one row
    a digest; Spark broadcasts it if it is small and shuffles it, splitting crowded digests, otherwise.
    """
    known = F.broadcast(license_digests(docs.sparkSession)) if known is None else known  # some 41,000 rows
    digests = save_round(text_digests(docs), "license-digests")
    lines = digests.select("doc_id", "body", F.explode("lines").alias("digest")).join(known, "digest")
    # Equal rows are counted together.
    times = digests.groupBy("doc_id", "body").agg(F.count("*").alias("times"))
    found = lines.groupBy("doc_id", "body").agg(
        F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("license")), ",").alias("notices"))
    found = found.join(times, found["doc_id"].eqNullSafe(times["doc_id"]) & (found["body"] == times["body"])).select(
        found["doc_id"].alias("_id"), found["body"].alias("_body"), F.expr("n div times").alias("n"), "notices")
    named = digests.drop("lines").join(known, "digest", "left")
    return named.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("body") == F.col("_body")), "left").select(
        "doc_id", "license", F.coalesce("n", F.lit(0)).alias("n_notices"), "notices")
