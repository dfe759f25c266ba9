"""License scans: whole texts are made canonical and looked up by digest among known licence texts.

Canonical means: lower case; lines that begin with a copyright notice and "all rights reserved" go; every run of characters
that are no letters or digits is one space; equivalent spellings become one. The digest is SHA-256. All of it is built-in
functions, and the known digests, a fixed short list, are the broadcast side of a hash join.

Defined results: a null or empty text has the digest of the empty text and no licence; repeated rows are looked up each; a
digest that several known texts share names the least identifier; an empty table gives an empty result; the documents' columns
are kept, and the two new ones get a free name if theirs is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beatlake.llm._shared import free_name, text_or_empty

# Spellings that count as equal, each as (variant, canonical).
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("https", "http"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)

COPYRIGHT = r"(^|\n)[ \t#*/;-]*(copyright|\(c\)|©)[^\n]*"
RESERVED = r"all rights reserved"
OTHER = r"[^\p{L}\p{N}]+"

_DISCLAIMER_BSD = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
    "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in "
    "the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
    "notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
    "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
    "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
    "and this permission notice appear in all copies. "
)
_ISC_DISCLAIMER = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
    "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of "
    "this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
    "subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you "
    "use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly "
    "marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
)

_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
    "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, "
    "the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the "
    "public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and "
    "future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. "
    "For more information, please refer to <https://unlicense.org>"
)
_APACHE_HEADER = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
    "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
    "limitations under the License."
)
_MPL_HEADER = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
    "https://mozilla.org/MPL/2.0/."
)


def _gnu_header(name: str, version: str, what: str = "program") -> str:
    """The notice that puts a program under a GNU licence of a version or later."""
    return (
        f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version "
        f"{version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        f"the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the {name} along "
        f"with this {what}. If not, see <https://www.gnu.org/licenses/>."
    )


# Licence identifiers and the texts (or whole notices) that are known for them.
KNOWN = (
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_DISCLAIMER),
    ("0BSD", "Zero-Clause BSD\n" + "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_DISCLAIMER),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", _BSD_2 + _DISCLAIMER_BSD),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_2 + _DISCLAIMER_BSD),
    ("BSD-3-Clause", _BSD_2 + _BSD_3 + _DISCLAIMER_BSD),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_2 + _BSD_3 + _DISCLAIMER_BSD),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", _ISC + _ISC_DISCLAIMER),
    ("ISC", "ISC License\n" + _ISC + _ISC_DISCLAIMER),
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("AGPL-3.0", _gnu_header("GNU Affero General Public License", "3")),
    ("Apache-2.0", _APACHE_HEADER),
    ("GPL-2.0", _gnu_header("GNU General Public License", "2")),
    ("GPL-3.0", _gnu_header("GNU General Public License", "3")),
    ("LGPL-3.0", _gnu_header("GNU Lesser General Public License", "3")),
    ("LGPL-3.0", _gnu_header("GNU Lesser General Public License", "3", "library")),
    ("MPL-2.0", _MPL_HEADER),
    ("Unlicense", _UNLICENSE),
)

# Licence identifiers and the digests of long licences' whole texts, as their authors publish them (of
# Apache-2.0 also without its appendix, and without the line before it).
KNOWN_DIGESTS = (
    ("Apache-2.0", "ff7be961361eda3cd2a76927dd0d9482cf45defafde2045befedf77400d98100"),
    ("Apache-2.0", "e9dbf930ca0f1e090ec68da9a37b657d11bc9e43b30643455d6a96dbf73116ca"),
    ("Apache-2.0", "1d2490e65bade4b7cde700178105759a1eeb6ed401841c01b9ff35e40e55c5ad"),
    ("Artistic-1.0-Perl", "cc2cd6cccfacd5fb622fb0e9b9a373fa9dcb86a8c152213a2b856dfbe24fe304"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "37db86be8f16e9b8dfb0d63e1698ad2e07d54f312494c1cb2dbdb4fa37487f0f"),
    ("GFDL-1.3", "7befa86e5ee53162018d597eee81db6c727f3e64fab4641af93e19deab1807b4"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1"),
    ("GPL-3.0", "010ce52b3b970c80b5447205f4afc3b42084811cda2d11b95178b1fd3940764f"),
    ("LGPL-2.0", "9b0b3105b96203f9d9e4b72d4b77951152156c88139302b5aedf6295e3ceaaa3"),
    ("LGPL-2.1", "cb225061bb71741fe8b31a2092e22fe05b1130438158ae5d16c48fd50186e345"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "fcb579371133afd771fed87cd5d8c6dc5648746c9945d4adf08ec5c79aba5c61"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
)


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    x = F.regexp_replace(F.lower(text), COPYRIGHT, "\n")
    x = F.trim(F.regexp_replace(F.regexp_replace(x, RESERVED, " "), OTHER, " "))
    # Two spaces between words, so that words that follow each other are both replaced.
    x = F.concat(F.lit(" "), F.replace(x, F.lit(" "), F.lit("  ")), F.lit(" "))
    for variant, word in SPELLINGS:
        x = F.replace(x, F.lit(f" {variant} "), F.lit(f" {word} "))
    return F.trim(F.replace(x, F.lit("  "), F.lit(" ")))


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN, digests: tuple[tuple[str, str], ...] = KNOWN_DIGESTS) -> DataFrame:
    """digest and license_id of the known texts (fixed lists; texts are made canonical by the same functions)."""
    listed = [F.struct(F.lit(name).alias("license_id"), F.sha2(canonical(F.lit(text)), 256).alias("digest")) for name, text in known]
    listed += [F.struct(F.lit(name).alias("license_id"), F.lit(digest).alias("digest")) for name, digest in digests]
    return spark.range(1).select(F.explode(F.array(*listed)).alias("x")).groupBy("x.digest").agg(F.min("x.license_id").alias("license_id"))


def scanned(documents: DataFrame, known: DataFrame | None = None, text_column: str = "text") -> DataFrame:
    """documents with digest (of the canonical text) and license_id (null unless the whole text is a known one)."""
    digest, licence = free_name(documents, "digest"), free_name(documents, "license_id")
    side = known_digests(documents.sparkSession) if known is None else known
    known_name, name = free_name(documents, "known"), free_name(documents, "license")
    side = side.select(F.col("digest").alias(known_name), F.col("license_id").alias(name))
    if known is None:
        side = F.broadcast(side)  # as many rows as KNOWN and KNOWN_DIGESTS have
    found = documents.withColumn(digest, F.sha2(canonical(text_or_empty(text_column)), 256)).join(side, F.col(digest) == F.col(known_name), "left")
    return found.select(*documents.columns, digest, F.col(name).alias(licence))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    x = f"trim(regexp_replace(regexp_replace(regexp_replace(lower({text}), '{COPYRIGHT}', chr(10), 'g'), '{RESERVED}', ' ', 'g'), '{OTHER}', ' ', 'g'))"
    x = f"' ' || replace({x}, ' ', '  ') || ' '"
    for variant, word in SPELLINGS:
        x = f"replace({x}, ' {variant} ', ' {word} ')"
    return f"trim(replace({x}, '  ', ' '))"


SCAN_SQL = f"""
WITH known AS (
  SELECT digest, min(license_id) AS license_id FROM (
    SELECT license_id, sha256({_canonical_sql('text')}) AS digest FROM (VALUES {', '.join(f'({_quoted(a)}, {_quoted(b)})' for a, b in KNOWN)}) k(license_id, text)
    UNION ALL SELECT license_id, digest FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in KNOWN_DIGESTS)}) k(license_id, digest)) GROUP BY 1),
found AS (SELECT doc_id, sha256({_canonical_sql("coalesce(text, '')")}) AS digest FROM documents)
SELECT doc_id, digest, license_id FROM found LEFT JOIN known USING (digest)
"""
