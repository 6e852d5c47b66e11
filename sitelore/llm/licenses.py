"""Licence scan: canonical digests of entire texts, looked up in a table of known licences."""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Public licence texts.
LICENCES = {
    "MIT": f"MIT License\n\nCopyright (c) <year> <holder>\n\n{_MIT_GRANT}",
    "MIT (no title)": _MIT_GRANT,
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_TAIL,
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    "MIT (short notice)": "Released under the MIT License.",
    "Apache-2.0 (short notice)": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 (short notice)": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 (short notice)": "Licensed under CC BY-NC 4.0.",
}

#: Title lines in use; each makes another known text.
TITLES = {
    "MIT (no title)": ("The MIT License", "The MIT License (MIT)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License", "BSD License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero Clause BSD License"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
#: Long texts as published, and the heading from which many copies leave the rest out.
LONG = {
    "Apache-2.0": "   APPENDIX: How to apply", "CC0-1.0": None, "GPL-2.0": "            How to Apply These Terms", "GPL-3.0": "            How to Apply These Terms", "LGPL-2.1": "           How to Apply These Terms", "LGPL-3.0": None,
    "MPL-1.1": "EXHIBIT A -", "MPL-2.0": "Exhibit A - Source Code",
}


def known_licences() -> dict[str, str]:
    """``LICENCES``, with each title, and the long texts with and without what follows their terms."""
    found = dict(LICENCES)
    for name, titles in TITLES.items():
        found |= {f"{name.removesuffix(' (no title)')} (title: {title})": f"{title}\n\n{LICENCES[name]}" for title in titles}
    for name, end in LONG.items():
        text = (Path(__file__).parent / "texts" / name).read_text(encoding="utf-8")
        found[name] = text
        if end is not None:
            found[f"{name} (terms only)"] = text[: text.index(end)]
    return found


#: Spellings taken as equal, after signs have gone (a pattern, its canonical form).
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("non commercial", "noncommercial"), ("organisation", "organization"),
    ("authoris", "authoriz"), ("recognis", "recogniz"), ("acknowledgement", "acknowledgment"), ("copyright owner", "copyright holder"), ("per cent", "percent"), ("favour", "favor"), ("https ", "http "),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words that follow "copyright", or "(c)" as the mark of a list's item, in prose; any other word there names a holder.
_PROSE = """act acts and agreement are as assignment assignments at claim claims disclaimer disclaimers doctrine doctrines for from grant grants holder holders if in infringement infringements interest interests is
law laws legend legends license licensed licenses may must nor notice notices of office on or owner owners ownership permission permissions protection protections registration restrictions right
rights shall statement statements status subsists term terms that the this to treaties treaty under which will with work works""".split()
_ITEMS = """a accompany all an any apply cause causes changes contributor contributors convey copies copy copying copyright derivative distribute distributing distribution do each either every give if include includes
it its make makes modifications modified modify neither no not only other our permit provide publish recipient recipients redistribute redistribution redistributions representations retain software source sublicense such their
there these they those use uses using we when where without you your""".split()
_THINGS = "library program software work works".split()


def _other_word(words: list[str]) -> str:
    """A pattern for the start of a word that is none of ``words``; without look-ahead, which not every engine has."""
    trie: dict = {}
    for word in words:
        node = trie
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def rest(node: dict, root: bool) -> str:
        letters = [c for c in node if c]
        ways = [c + rest(node[c], False) for c in letters]
        ways.append("[^\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f" + "".join(letters) + "]")
        if not root and "" not in node:
            ways.append(r"\b")
        return "(?:" + "|".join(ways) + ")"

    return rest(trie, True)


#: A notice that many long texts begin with, from its copyright to its last word, however its lines are broken.
VERBATIM_NOTICE = r"copyright[^a-z]{1,40}c[^a-z]{1,60}free[^a-z]{1,20}software[^a-z]{1,20}foundation[^\x00]{0,300}?" + r"[^a-z]{1,20}".join("everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document but changing it is not allowed".split(" "))
#: A copyright still to be filled in, wherever it stands.
PLACEHOLDER = r"copyright[^a-z0-9]{1,20}(?:c[^a-z0-9]{1,20})?(?:_{3}[^a-z]{0,99}(?:all[^a-z]{1,20}rights[^a-z]{1,20}reserved)?|[<\[{](?:yyyy|year)[>\]}][^a-z0-9]{1,30}name[^a-z]{1,20}of[^a-z]{1,20}(?:author|copyright[^a-z]{1,20}(?:owner|holder))[>\]}])"
_STATED = r"[ \t:,-]*(?:\(c\)|©|[0-9]{4}|[<\[{])"
#: A line that only states a copyright: its first word, after comment signs, says so and a year, a sign or a holder follows.
COPYRIGHT_LINE = (
    r"(^|\n)[ \t#*/;%>|!-]*(?:"
    rf"(?:\(c\)[ \t]*)?copyright(?:{_STATED}|[ \t]*:?[ \t]+(?:{_other_word(_PROSE)}|the[ \t]+{_other_word(_THINGS)}))[^\n]*"
    rf"|\(c\)(?:{_STATED}|[ \t]*{_other_word(_PROSE + _ITEMS)})[^\n]*"
    r"|©[^\n]*"
    r"|all rights reserved(?:[ \t]+by[ \t][^\n]*|[^a-z0-9\n]*(?:copyright|\(c\)|©|[0-9]{4})[^\n]*|[^a-z0-9\n]*))"
)
NOTICES = (VERBATIM_NOTICE, PLACEHOLDER, COPYRIGHT_LINE)
#: ASCII signs and white space, typographic quotes and dashes.
SIGNS = "[\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f‘’“”–— ]+"


def canonical(text: Column) -> Column:
    """Lower case (ASCII), no copyright lines, signs and white space as single blanks, one spelling; null as the empty text."""
    out = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    for pattern in NOTICES:
        out = F.regexp_replace(out, pattern, "\n")
    out = F.trim(F.regexp_replace(out, SIGNS, " "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def canonical_text(text: str) -> str:
    """The same for one text in Python, for the table of known digests."""
    out = text.translate(str.maketrans(_UPPER, _LOWER))
    for pattern in NOTICES:
        out = re.sub(pattern, "\n", out)
    out = re.sub(SIGNS, " ", out).strip(" ")
    for old, new in SPELLINGS:
        out = out.replace(old, new)
    return out


def digest_table(licences: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """(digest, licence), the first licence of a digest; of ``known_licences()`` unless others are given."""
    found: dict[str, str] = {}
    for name, text in (known_licences() if licences is None else licences).items():
        found.setdefault(hashlib.sha256(canonical_text(text).encode()).hexdigest(), name)
    return sorted(found.items())


def scan(docs: DataFrame, licences: dict[str, str] | None = None) -> DataFrame:
    """doc_id, canonical_chars, digest, license of every document; the license is null where the entire text isn't a known one.

    A null text is an empty one and matches nothing; repeated rows each get a row;
    null ids stay; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame(digest_table(licences), "digest string, license string")
    canon = docs.select("doc_id", canonical(F.col("text")).alias("c"))
    own = canon.select("doc_id", F.length("c").cast("long").alias("canonical_chars"), F.sha2("c", 256).alias("digest"))
    return own.join(F.broadcast(known), "digest", "left").select("doc_id", "canonical_chars", "digest", "license")  # a row for each known text


def oracle() -> str:
    """The same in DuckDB's SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    c = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    for pattern in NOTICES:
        c = f"regexp_replace({c}, {quoted(pattern)}, chr(10), 'g')"
    c = f"trim(regexp_replace({c}, {quoted(SIGNS)}, ' ', 'g'), ' ')"
    for old, new in SPELLINGS:
        c = f"replace({c}, '{old}', '{new}')"
    rows = ", ".join(f"('{d}', {quoted(n)})" for d, n in digest_table())
    return f"""
WITH known(digest, license) AS (VALUES {rows}), canon AS (SELECT doc_id, {c} AS c FROM documents)
SELECT doc_id, CAST(length(c) AS BIGINT) AS canonical_chars, sha256(c) AS digest, license
FROM canon LEFT JOIN known ON sha256(c) = known.digest"""
