"""Licence scans by canonical digest lookup, in DataFrame functions only.

A text is made canonical: lower case, every run of other than letters and digits one
space, equivalent spellings alike, copyright lines left out. The digest of the whole
canonical text, and of each line of it as a text of its own (a notice stands on one), is
looked up among the digests of known licences by a hash join.

Known are whole texts (``TEXTS``), digests of longer whole texts (``DIGESTS``), one-line notices that
are made by rule of what is said before a licence's names (``notices``), and SPDX lines of all
these licences. ``known`` is a list of (name, text), or a table of them of any size, whose digests are
then made by the same functions; a table of over ``BROADCAST`` digests isn't broadcast.

Defined results: a null text, or one without letters and digits, matches nothing. A notice
that a document has on several lines counts once in ``notices`` and each time in
``n_notices``. Rows that repeat a doc_id are one document with the notices of all. Null
doc_ids are kept as one. Other columns are kept out of the result.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Digests that are broadcast at most: some 6 MB.
BROADCAST = 100_000

# Spellings that count as the same, from the public matching guidelines for licence texts.
ALIKE = (
    ("licenc", "licens"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("copyright owner", "copyright holder"),
    ("organisation", "organization"),
    ("authoris", "authoriz"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("acknowledgement", "acknowledgment"),
    ("per cent", "percent"),
    ("version ", "v"),
)
TWO = tuple(x for x in ALIKE if " " in x[0].strip())
#: A copyright line, once canonical.
COPYRIGHT = r"^(portions )?(copyright|c)( c)?( by)? .*[0-9]{4}.*$|^(portions )?copyright c .*$|^all rights reserved$"

# The texts of known licences and their usual notices.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
TEXTS = (
    ("MIT", MIT),
    ("MIT", "MIT License\n" + MIT),
    ("MIT", "The MIT License\n" + MIT),
    ("MIT", "The MIT License (MIT)\n" + MIT),
    ("ISC", ISC),
    ("ISC", "ISC License\n" + ISC),
    ("BSD-2-Clause", BSD_2 + DISCLAIMER),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + BSD_2 + DISCLAIMER),
    ("BSD-3-Clause", BSD_2 + BSD_3 + DISCLAIMER),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + BSD_2 + BSD_3 + DISCLAIMER),
    ("0BSD", ZERO_BSD),
    ("0BSD", "BSD Zero Clause License\n" + ZERO_BSD),
    ("Unlicense", UNLICENSE),
    ("Unlicense", UNLICENSE + "\nFor more information, please refer to <http://unlicense.org/>"),
    ("Unlicense", UNLICENSE + "\nFor more information, please refer to <https://unlicense.org/>"),
    ("Zlib", ZLIB),
    ("Zlib", "zlib License\n" + ZLIB),
    ("Apache-2.0", APACHE_HEADER),
)
# Digests of the canonical whole texts of longer licences as published, and up to the end of their terms.
DIGESTS = (
    ("Apache-2.0", "827e4e1afc40c461e3c6c1bef45e77aa", "49eb0f79aa8e9e8df51627e018c7aaa0", "292e0a7dab57e40c0b6b5509facccd68"),
    ("Artistic-1.0-Perl", "25efee8c706ec6ba8a417b90951fdbc3"),
    ("BSD-3-Clause", "ddcd765ed0a3236bf96e15f76c36983a"),
    ("CC0-1.0", "056cffdfd0d769e666f461ce9785b650"),
    ("GFDL-1.2", "8a896e65f5bf4d5e256e6f2ce015ec1f"),
    ("GFDL-1.3", "973b0a50df5b8d052b35cc33341cfb18"),
    ("GPL-1.0", "c727b48a2bd6f8fed29b8cdb2574c4ce", "32bdf449f66e0bafca30084a4b914d6c", "42121eac1ef2deef0b30577c285ff34a"),
    ("GPL-2.0", "1512ad476091d814397d38c78c01bec5", "52b1fe95a2c8d05b6e15b35f542cde5c", "6de7e85382f30507e81ddbd5b0205b76"),
    ("GPL-3.0", "3406409753d91eaa728af70df877f006", "5ad38ccfc7a20ba14bc79ee671cdb8b2", "8b8cbe9983607fe29728219ce0fa53a2"),
    ("LGPL-2.0", "8f885ab5f072c15e4d3611a0668eb77a", "a93d443d2bca387181020acfbf7a5999", "1fe9c815a52600e7fe11e76b3ced7607"),
    ("LGPL-2.1", "1104dacc4b6ef294ca6a2f8fecf19441", "9b36238fce785c42ef58a0c976a0f6e4", "07ecc0bb125d9efb7b9366eeacdc505a"),
    ("LGPL-3.0", "96965feae33b3aca5f2cd09a71b50503"),
    ("MPL-1.1", "f3af22db16669a3bc630feb63c08ff61"),
    ("MPL-2.0", "8fdb0781d0788fdfa49fe92396736114"),
)
# What licences are called in notices, after "the" where it begins so.
CALLED = (
    ("MIT", "the MIT License", "the MIT license (MIT)", "MIT"),
    ("ISC", "the ISC License", "ISC"),
    ("BSD-2-Clause", "the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License"),
    ("BSD-3-Clause", "the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License"),
    ("Apache-2.0", "the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License", "Apache 2.0"),
    ("MPL-2.0", "the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "the MPL 2.0"),
    ("Unlicense", "the Unlicense"),
    ("Zlib", "the zlib License"),
    ("CC0-1.0", "CC0 1.0", "CC0", "the CC0 1.0 Universal license"),
)
#: Families of the GNU project: id, name and versions; each with and without "or later".
GNU = (("GPL", "General Public License", ("2.0", "3.0")), ("LGPL", "Lesser General Public License", ("2.1", "3.0")), ("AGPL", "Affero General Public License", ("3.0",)))
#: Creative Commons: the words for each part of an id.
COMMONS = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
SAID = ("Licensed under", "Released under", "Distributed under", "Available under", "This work is licensed under", "This project is licensed under", "This software is licensed under", "This document is licensed under", "This file is licensed under", "Published under")


def notices() -> list[tuple[str, str]]:
    """Every one-line notice by rule: what is said, and what each licence is called; and the SPDX lines."""
    called = [(one, name) for one, *names in CALLED for name in names]
    for family, name, versions in GNU:
        for v in versions:
            for later, id_ in (("", f"{family}-{v}"), (" or later", f"{family}-{v}-or-later"), (" only", f"{family}-{v}")):
                for short in {v, v.removesuffix(".0")}:
                    called += [(id_, text.format(v=short) + later) for text in (f"the GNU {name}, version {{v}}", f"the GNU {name} v{{v}}", f"the GNU {name} {{v}}", f"the GNU {family} v{{v}}", f"the {family} v{{v}}", f"{family} v{{v}}", f"{family} {{v}}", f"{family}v{{v}}")]
    for part, words in COMMONS:
        for v in ("3.0", "4.0"):
            kind = "International" if v == "4.0" else "Unported"
            texts = (f"CC {part} {v}", f"CC-{part}-{v}", f"a CC {part} {v} license", f"the CC {part} {v} license", f"a Creative Commons {words} {v} {kind} License", f"the Creative Commons {words} {v} {kind} License", f"Creative Commons {words} {v}")
            called += [(f"CC-{part}-{v}", x) for x in texts]
    ids = dict.fromkeys([n for n, *_ in (*TEXTS, *DIGESTS)] + [n for n, _ in called])
    spdx = [(i, f"SPDX-License-Identifier: {x}") for i in ids for x in (i, *((f"{i}-only", f"{i}+") if i.split("-")[0] in ("GPL", "LGPL", "AGPL") and not i.endswith("later") else ()))]
    return [(n, f"{said} {x}") for n, x in called for said in SAID] + spdx


OTHER = r"[^\p{L}\p{N}\n]+"


def canonical(text: str) -> list[str]:
    """The canonical lines of a known text."""
    text = re.sub(r"[^\w\n]+|_", " ", text.lower())
    for a, b in ALIKE:
        text = text.replace(a, b)
    return [x for x in (line.strip(" ") for line in text.split("\n")) if x and not re.match(COPYRIGHT, x)]


def joined(lines: list[str]) -> str:
    """The canonical text of canonical lines; spellings of two words may stand on two lines."""
    text = " ".join(lines)
    for a, b in TWO:
        text = text.replace(a, b)
    return text


def digest(text: str) -> str:
    return hashlib.md5(joined(canonical(text)).encode()).hexdigest()


def digests(known: list[tuple[str, str]] | None = None) -> dict[str, str]:
    """Digest to licence of (name, text), by default of all that is known; the first of equal canonical texts counts."""
    out: dict[str, str] = {}
    for name, text in (*TEXTS, *notices()) if known is None else known:
        out.setdefault(digest(text), name)
    if known is None:
        for name, *of in DIGESTS:
            for d in of:
                out.setdefault(d, name)
    return out


def lines_of(text: Column) -> Column:
    """The canonical lines of a text as an array, by built-in functions."""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), OTHER, " ")
    for a, b in ALIKE:
        flat = F.replace(flat, F.lit(a), F.lit(b))
    return F.filter(F.transform(F.split(flat, "\n"), lambda x: F.btrim(x, F.lit(" "))), lambda x: (x != "") & ~x.rlike(COPYRIGHT))


def whole(lines: Column) -> Column:
    """The canonical text of canonical lines; spellings of two words may stand on two lines."""
    text = F.array_join(lines, " ")
    for a, b in TWO:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def lookup(spark: SparkSession, known: list[tuple[str, str]] | DataFrame | None) -> DataFrame:
    """(digest, name) of known texts, to be broadcast if they are at most BROADCAST."""
    if not isinstance(known, DataFrame):
        found = list(digests(known).items())
        table, n = spark.createDataFrame(found, "digest string, name string"), len(found)
    else:
        lines = known.select("name", lines_of(F.col("text")).alias("lines")).where(F.size("lines") > 0)
        table = lines.select(F.md5(whole(F.col("lines")).cast("binary")).alias("digest"), "name").groupBy("digest").agg(F.min("name").alias("name"))
        n = table.count()
    return F.broadcast(table) if n <= BROADCAST else table


def scan(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", known: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """(doc_id, license: of the whole text or null, n_notices, notices: sorted, with commas between)."""
    table = lookup(df.sparkSession, known)
    lines = df.select(F.col(doc_id).alias("doc_id"), lines_of(F.col(text)).alias("lines"))
    all_ = F.struct(F.lit(True).alias("whole"), F.md5(whole(F.col("lines")).cast("binary")).alias("digest"))
    units = F.array_append(F.transform("lines", lambda x: F.struct(F.lit(False).alias("whole"), F.md5(x.cast("binary")).alias("digest"))), all_)
    found = lines.where(F.size("lines") > 0).select("doc_id", F.explode(units).alias("u")).select("doc_id", "u.*").join(table, "digest")
    # matches are few; every document is named once, with or without
    matched = found.groupBy("doc_id").agg(
        F.min(F.when(F.col("whole"), F.col("name"))).alias("license"),
        F.count(F.when(~F.col("whole"), 1)).alias("n_notices"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("name")))), ",").alias("notices"),
    )
    ids = df.select(F.col(doc_id).alias("__id")).distinct()
    return ids.join(matched, F.col("__id").eqNullSafe(F.col("doc_id")), "left").select(
        F.col("__id").alias("doc_id"), "license", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices")
    )


def sql(known: list[tuple[str, str]] | None = None) -> str:
    """The same in DuckDB SQL."""
    flat = r"regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\n]+', ' ', 'g')"
    for a, b in ALIKE:
        flat = f"replace({flat}, '{a}', '{b}')"
    whole = "array_to_string(lines, ' ')"
    for a, b in TWO:
        whole = f"replace({whole}, '{a}', '{b}')"
    rows = ", ".join(f"('{d}', '{n}')" for d, n in digests(known).items())
    return f"""
    with known(digest, name) as (values {rows}),
    flat as (select doc_id, list_filter(list_transform(string_split({flat}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '' and not regexp_matches(x, '{COPYRIGHT}')) as lines from documents),
    units as (
      select doc_id, false as whole, md5(unnest(lines)) as digest from flat
      union all select doc_id, true, md5({whole}) from flat where len(lines) > 0
    ),
    matched as (
      select doc_id, min(name) filter (where whole) as license, count(*) filter (where not whole) as n_notices,
        coalesce(string_agg(distinct name, ',' order by name) filter (where not whole), '') as notices
      from units join known using (digest) group by doc_id
    )
    select d.doc_id, license, coalesce(n_notices, 0)::bigint as n_notices, coalesce(notices, '') as notices
    from (select distinct doc_id from documents) d left join matched m on d.doc_id is not distinct from m.doc_id
    """
