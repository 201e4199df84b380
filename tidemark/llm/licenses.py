"""Operator 9: license scans by canonical digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty

#: Fixed values, public wording: short licences in full, and the notices by which texts name the long ones.
KNOWN = {
    "MIT": [
        """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
    ],
    "ISC": [
        """ISC License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
}

_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_CLAUSES = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

{0}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

{1}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
_NAMES = "{2}Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

{0}The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

{1}Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

{2}This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def _titled(body: str, *titles: str, marks: tuple[tuple[str, ...], ...] = (("",) * 3,)) -> list[str]:
    """The text alone, after each title, with or without reserved rights, and with its points marked in each way."""
    return [head + rights + body.format(*m) for m in marks for head in ("", *(f"{t}\n\n" for t in titles)) for rights in ("", "All rights reserved.\n\n")]


_POINTS = (("",) * 3, ("1. ", "2. ", "3. "))
KNOWN["BSD-2-Clause"] = _titled(_CLAUSES + _WARRANTY, "BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License", marks=_POINTS)
KNOWN["BSD-3-Clause"] = _titled(_CLAUSES + _NAMES + _WARRANTY, "BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", marks=_POINTS)
KNOWN["Zlib"] = _titled(_ZLIB, "zlib License", "The zlib License", marks=_POINTS)
KNOWN["Unlicense"] = [head + _UNLICENSE + tail for head in ("", "The Unlicense\n\n") for tail in ("", *(f"\n\nFor more information, please refer to <{x}unlicense.org{y}>" for x in ("http://", "https://") for y in ("", "/")))]
KNOWN["BSL-1.0"] = _titled(_BOOST, "Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License 1.0")
for _name in ("MIT", "ISC"):
    _body = KNOWN[_name][0].split("\n\n", 1)[1]
    KNOWN[_name] += [_body, f"The {_name} License\n\n{_body}", f"The {_name} License ({_name})\n\n{_body}"]
#: Identifiers of SPDX lines. Names that other texts above have stay as they are.
SPDX = """0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BlueOak-1.0.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0
CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 EPL-1.0 EPL-2.0 EUPL-1.2 GFDL-1.3-only GFDL-1.3-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0
GPL-3.0-or-later ISC LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA OFL-1.1 OpenSSL
PostgreSQL PSF-2.0 Python-2.0 Ruby Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1"""
for _name in SPDX.split():
    KNOWN.setdefault(_name, []).append(f"SPDX-License-Identifier: {_name}")
#: Spellings that count as one, applied in this order to lower-case words.
SPELLINGS = {"licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "noninfringement": "non infringement", "organisation": "organization", "favour": "favor", "whilst": "while", "copyright holders": "copyright owner", "copyright holder": "copyright owner"}
#: A line that starts so is a copyright line.
COPYRIGHT = r"(?i)(^|\n)[\x20\x09]*(copyright[\x20\x09]*(\(c\)|©|[0-9<\[{])|\(c\)[\x20\x09]*[0-9]|©)[^\n]*"
OTHER = r"[^\p{L}\p{N}]+"
#: The known texts of one line all hold this.
MARKS = r"(?i)licen[cs]e|warrant"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Digests of the canonical long texts as published, and without the part that tells how to apply them.
DIGESTS = {
    "Apache-2.0": ("e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2", "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0"),
    "GPL-2.0": ("632eed5ccd9536a119e4736f4111f5ea096d69650e17f4a3fcacb4d273e39aec", "34646b71cb057a6b7fce252fc5685bc0f1ad2c22262d322eca0a90f39b1a0046"),
    "GPL-3.0": ("4c0936da0137c10346f05b6b5390985a2a03297b38fa1a371517221225236f28", "3b3886969d0e2e477d1814e06c6d0b28595c2f3afda31219384020ba4b06fc0a"),
    "LGPL-2.0-only": ("87c83ddf13b8d772a493615bbfb7368fb6c87b179e064f6b4573dd9008cbd283", "273fdbba53ad074b35cd45b58c1a4091f92c5a5d5027978e989cbbb73746d404"),
    "LGPL-2.1": ("4b7fd8442d92b28972b9aee4eb75166ac0ea6267095bdcdbe488d5f54b725b71", "f2113c5811629fb98497e5231be94432e92103fa33213fede9037b754d55e19b"),
    "LGPL-3.0": ("aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",),
    "MPL-1.1": ("3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1", "80cd52a1836f5ea3706bd2afa402fc448999d4a22581ee62d4041bd8a08efd87"),
    "MPL-2.0": ("f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a", "075fcdf87448c49dbad8c5f7963f0eb6907a3d8eae1b431ba2988508499ec0de"),
    "CC0-1.0": ("96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",),
    "GFDL-1.3-only": ("ac48f9c5ac6627cac07c42464e71743898508f6d8718a6dc0e1259a25f0c6b68", "2a106f884036b120e13449e43972050cdada368c82d26ec9261a76f24da1eb41"),
    "GFDL-1.2": ("dd21c1489470df7f8763c8da9d6ebad250b28e79589984a28a57cf60ae7a41be", "e5c033faab5442e1b9e32376a8793e96e10b22c9673d7367970c64b417e89e5e"),
    "GPL-1.0": ("596622575bcd3d827e7f6bce1f02e32bed2edeb0e9d8ce0d39441ba10031d1aa", "895ad9f6ba7614276f464f8c82a8f6ebb7f9605f2ab3c7f933b3193e1c0abdda"),
}


def canonical(text: F.Column) -> F.Column:
    """Without copyright lines, in lower case (A-Z), with everything but letters and digits as one space, equivalent
    spellings made one. Words stand between two spaces each while spellings are replaced, so that none takes a space from
    its neighbour."""
    lower = F.translate(F.regexp_replace(text, COPYRIGHT, "\n"), UPPER, LOWER)
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, OTHER, "  ")), F.lit(" "))
    for old, new in SPELLINGS.items():
        out = F.replace(out, F.lit(spaced(old)), F.lit(spaced(new)))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def spaced(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def digest(text: F.Column) -> F.Column:
    """SHA-256 of the canonical text; null if nothing is left."""
    return F.when(canonical(text) != "", F.sha2(canonical(text), 256))


def known_digests(spark, known: dict[str, list[str]] | None = None, digests: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(digest, license), one row per distinct digest, of texts and of digests by name (by default KNOWN and DIGESTS)."""
    rows = [(name, text) for name, texts in (KNOWN if known is None else known).items() for text in texts]
    made = spark.createDataFrame(rows, "license string, text string").select(digest(F.col("text")).alias("digest"), "license")
    given = [(d, name) for name, ds in (DIGESTS if digests is None else digests).items() for d in ds]
    return made.unionAll(spark.createDataFrame(given, "digest string, license string")).groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", marks: str | None = None) -> DataFrame:
    """One row per row of docs: id, text_digest, text_license (of the entire text, null if unknown) and line_licenses
    (of entire lines that are a known text: distinct names, sorted, comma-joined).

    Digests of entire texts and of lines are looked up in `known` (digest, license; distinct digests) by a hash join;
    Spark broadcasts `known` only under its own size threshold. `marks`: a pattern that every known text of one line
    matches; lines without it are not digested. A null or empty text has a null digest and no licences; repeated rows
    stay repeated; a null id is kept; an empty table gives no rows. Other columns of docs are not read.
    """
    lines = F.split("_text", "\n")
    if marks:
        lines = F.filter(lines, lambda x: F.rlike(x, F.lit(marks)))
    # digests are written once, with a number for each row: copies never meet under one key
    made = docs.select(F.col(id_col), text_or_empty(text_col).alias("_text"))
    rows = stored(made.select(F.col(id_col), digest(F.col("_text")).alias("text_digest"), F.filter(F.transform(lines, digest), lambda x: x.isNotNull()).alias("_lines"), F.monotonically_increasing_id().alias("_row")))
    unit = lambda d, line: F.struct(d.alias("digest"), F.lit(line).alias("line"))
    units = rows.select("_row", F.explode(F.concat(F.array(unit(F.col("text_digest"), False)), F.transform(F.array_distinct("_lines"), lambda x: unit(x, True)))).alias("_u")).select("_row", "_u.*")
    of = lambda line: F.when(F.col("line") == line, F.col("license"))
    per = units.where(F.col("digest").isNotNull()).join(known, "digest").groupBy("_row").agg(F.max(of(False)).alias("text_license"), F.array_join(F.sort_array(F.collect_set(of(True))), ",").alias("line_licenses"))
    return rows.select(id_col, "text_digest", "_row").join(per, "_row", "left").select(F.col(id_col), "text_digest", "text_license", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"))


def oracle() -> str:
    """DuckDB SQL of the query."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def canon(x: str) -> str:
        out = f"' ' || trim(regexp_replace(translate(regexp_replace({x}, {quote(COPYRIGHT)}, chr(10), 'g'), '{UPPER}', '{LOWER}'), {quote(OTHER)}, '  ', 'g')) || ' '"
        for old, new in SPELLINGS.items():
            out = f"replace({out}, '{spaced(old)}', '{spaced(new)}')"
        return f"nullif(trim(replace({out}, '  ', ' ')), '')"

    rows = ", ".join(f"({quote(name)}, {quote(text)})" for name, texts in KNOWN.items() for text in texts)
    given = ", ".join(f"({quote(d)}, {quote(name)})" for name, ds in DIGESTS.items() for d in ds)
    return f"""
WITH known AS (SELECT digest, min(license) AS license FROM
    (SELECT sha256({canon("t")}) AS digest, l AS license FROM (VALUES {rows}) AS v(l, t) UNION ALL SELECT * FROM (VALUES {given}) AS g(digest, license)) GROUP BY 1),
d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
whole AS (SELECT k, doc_id, sha256({canon("text")}) AS text_digest FROM d),
line AS (SELECT k, unnest(string_split(text, chr(10))) AS l FROM d),
hit AS (SELECT DISTINCT k, license FROM line JOIN known ON sha256({canon("l")}) = digest),
per AS (SELECT k, string_agg(license, ',' ORDER BY license) AS ls FROM hit GROUP BY k)
SELECT doc_id, text_digest, license AS text_license, coalesce(ls, '') AS line_licenses
FROM whole LEFT JOIN known ON text_digest = digest LEFT JOIN per USING (k)"""
