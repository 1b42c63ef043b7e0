"""Licence scan by canonical digests.

Texts are brought to one canonical form and their SHA-256 is looked up among
the digests of known licences by a hash join: the whole text against whole
licences, and the digest of each line among those of one-line notices.

Canonical form: ASCII letters in lower case; copyright lines dropped, which
begin (after comment marks) with "all rights reserved", or with "copyright" or
"(c)" and name a year, a sign or a holder, so that a sentence that happens to
break before "copyright notice" stays whole; numbers of list items dropped;
equivalent spellings replaced; every run of other characters than letters,
digits and those beyond ASCII one blank; no blanks at the ends. It doesn't
depend on line breaks, comment marks or the style of lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_YEAR = r"[^\n]*(?:19|20)[0-9]{2}"
COPYRIGHT_LINE = (r"(?m)^[ \t\r/*#;.-]*(?:copyright[ \t]*(?:[:<\[{(\x{a9}0-9]|by |" + _YEAR + r")|"
                  r"\(c\)[ \t]*(?:copyright|" + _YEAR + r")|\x{a9}|all rights reserved)[^\n]*$")
ITEM_NUMBER = r"(?m)^[ \t\r/*#;.-]*(?:[0-9]{1,2}[.)]|\([a-z0-9]\))[ \t]+"
NOT_WORD = r"[^a-z0-9\x{80}-\x{10FFFF}\n]+"
# Equivalent spellings, replaced in this order.
SPELLINGS = (("licenc", "licens"), ("sub-licens", "sublicens"), ("organis", "organiz"), ("favour", "favor"),
             ("acknowledgement", "acknowledgment"), ("non-commercial", "noncommercial"), ("per cent", "percent"),
             ("whilst", "while"), ("merchantibility", "merchantability"), ("https://", "http://"), ("&", " and "))

# Texts of widely used licences.
_AS_IS_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission.
"""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to
the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity
of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.
3. This notice may not be removed or altered from any source distribution."""
_BOOST = """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software
is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and
the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works
of the Software, unless such copies or derivative works are solely in the form of machine-executable object code
generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE
COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_GPL_3_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>."""
LICENSES = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n"
            + _ISC_END),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
             "hereby granted.\n" + _ISC_END),
    ("BSD-2-Clause", _BSD_TWO + _AS_IS_BSD),
    ("BSD-3-Clause", _BSD_TWO + _BSD_THIRD + _AS_IS_BSD),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
                   "compliance with the License. You may obtain a copy of the License at\n"
                   "http://www.apache.org/licenses/LICENSE-2.0\n"
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
                   "implied. See the License for the specific language governing permissions and limitations under the "
                   "License."),
    ("Unlicense", _UNLICENSE),
    ("Zlib", _ZLIB),
    ("BSL-1.0", _BOOST),
    ("MPL-2.0", _MPL_HEADER),
    ("GPL-3.0-or-later", _GPL_3_HEADER),
)
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)


def canonical_lines(text: Column) -> Column:
    """Canonical form with newlines kept; lines may have blanks at their ends."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    out = F.regexp_replace(F.translate(F.coalesce(text.cast("string"), F.lit("")), upper, lower), COPYRIGHT_LINE, "")
    out = F.regexp_replace(out, ITEM_NUMBER, "")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.regexp_replace(out, NOT_WORD, " ")


def digest(lines: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(lines, r"[ \n]+", " ")), 256)


def known_digests(spark, texts) -> DataFrame:
    """digest, license_id of known texts (pairs, or a table license_id, text), by
    the same expressions; of several ids with one digest the smallest."""
    known = texts if isinstance(texts, DataFrame) else spark.createDataFrame(list(texts), "license_id string, text string")
    return (known.select("license_id", digest(canonical_lines(F.col("text"))).alias("digest"))
            .groupBy("digest").agg(F.min("license_id").alias("license_id")))


def license_scan(documents: DataFrame, licenses=LICENSES, notices=NOTICES) -> DataFrame:
    """doc_id, digest (of the whole canonical text), license_id (null: none),
    notices (sorted ids of the licences named by whole lines): one row per
    input row.

    ``licenses`` are known whole texts: the built-in ones, or a table
    (license_id, text) of any size, which is joined without a broadcast.
    ``notices`` are a short list of one-line texts. Null and empty texts have the
    digest of the empty text and match nothing. Every row is judged by itself,
    whatever its doc_id; a very long text is canonicalised whole in one task. An
    empty table gives an empty result; other columns are not read.
    """
    spark = documents.sparkSession
    known = known_digests(spark, licenses)
    if not isinstance(licenses, DataFrame):
        known = F.broadcast(known)  # constants of the library
    # a handful of constants, looked up in the row
    named = F.create_map(*[F.lit(x) for r in known_digests(spark, notices).collect() for x in (r.digest, r.license_id)])
    lines = F.filter(F.split("lines", "\n"), lambda x: F.trim(x) != "")
    found = F.filter(F.transform(lines, lambda x: F.try_element_at(named, digest(x))), lambda x: x.isNotNull())
    scanned = (documents.select(F.col("doc_id").cast("long").alias("doc_id"), canonical_lines(F.col("text")).alias("lines"))
               .select("doc_id", digest(F.col("lines")).alias("digest"), F.array_sort(F.array_distinct(found)).alias("notices")))
    return scanned.join(known, "digest", "left").select("doc_id", "digest", "license_id", "notices")
