"""Scan for known licence texts by a digest of their canonical form.

A text is normalised as licence matching guidelines ask: lower case, no copyright statements,
one spelling for words that are written in several ways, and single spaces in place of
punctuation and white space. Two texts are the same licence if what is left is equal. Whole texts and,
because a notice often stands on a line of its own, whole lines are digested (SHA-256) and
hash-joined to the digests of known texts. The known table is small and its size is checked before
it is sent to every task, so neither texts nor lines are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import let

#: One spelling for words that licence texts write in several ways (fixed values).
WORDS: tuple[tuple[str, str], ...] = (
    ("https", "http"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("merchantibility", "merchantability"),
    ("v2", "version 2"),
    ("v3", "version 3"),
    ("favour", "favor"),
    ("authorised", "authorized"),
    ("organisation", "organization"),
    ("initialise", "initialize"),
    ("behaviour", "behavior"),
    ("whilst", "while"),
    ("wilful", "willful"),
)
#: The same for words in a row, after single words.
PHRASES: tuple[tuple[str, str], ...] = (
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("per cent", "percent"),
    ("version 2 0", "version 2"),
    ("version 3 0", "version 3"),
)

#: Notices that stand alone (fixed values).
KNOWN: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\")",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ),
    "GPL-2.0": ("Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"),
    "LGPL-2.1": ("SPDX-License-Identifier: LGPL-2.1-only",),
    "LGPL-3.0": ("SPDX-License-Identifier: LGPL-3.0-only",),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"),
    "MPL-2.0": ("SPDX-License-Identifier: MPL-2.0",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "MIT": ("Licensed under the MIT License.", "Released under the MIT License.", "SPDX-License-Identifier: MIT"),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "ISC": ("SPDX-License-Identifier: ISC",),
    "proprietary": ("All rights reserved.", "All rights reserved. Unauthorized copying is prohibited."),
}

#: Licences in full (fixed values): their titles, and the paragraphs below the title and the copyright statement.
FULL: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "MIT": (
        ("", "MIT License", "The MIT License", "The MIT License (MIT)",),
        (
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
            "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions:",
            "The above copyright notice and this permission notice shall be included in all copies or substantial "
            "portions of the Software.",
            "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
            "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
            "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN "
            "AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
            "OR OTHER DEALINGS IN THE SOFTWARE.",
        ),
    ),
    "MIT-0": (
        ("", "MIT No Attribution",),
        (
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
            "the Software, and to permit persons to whom the Software is furnished to do so.",
            "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
            "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
            "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN "
            "AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
            "OR OTHER DEALINGS IN THE SOFTWARE.",
        ),
    ),
    "ISC": (
        ("", "ISC License", "The ISC License",),
        (
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
            "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
            "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
            "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
            "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
            "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        ),
    ),
    "0BSD": (
        ("", "BSD Zero Clause License", "Zero-Clause BSD",),
        (
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted.",
            "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
            "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
            "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
            "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
            "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        ),
    ),
    "BSD-2-Clause": (
        ("", "BSD 2-Clause License", "The 2-Clause BSD License",),
        (
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met:",
            "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
            "following disclaimer.",
            "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
            "following disclaimer in the documentation and/or other materials provided with the distribution.",
            "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
            "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
            "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
            "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
            "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
            "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
            "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
            "POSSIBILITY OF SUCH DAMAGE.",
        ),
    ),
    "BSD-3-Clause": (
        ("", "BSD 3-Clause License", "The 3-Clause BSD License",),
        (
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met:",
            "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
            "following disclaimer.",
            "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
            "following disclaimer in the documentation and/or other materials provided with the distribution.",
            "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
            "promote products derived from this software without specific prior written permission.",
            "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
            "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
            "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
            "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
            "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
            "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
            "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
            "POSSIBILITY OF SUCH DAMAGE.",
        ),
    ),
    "Unlicense": (
        ("",),
        (
            "This is free and unencumbered software released into the public domain.",
            "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
            "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
            "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all "
            "copyright interest in the software to the public domain. We make this dedication for the benefit of the "
            "public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt "
            "act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
            "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
            "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
            "EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
            "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
            "DEALINGS IN THE SOFTWARE.",
            "For more information, please refer to <https://unlicense.org>",
        ),
    ),
    "Zlib": (
        ("", "zlib License", "The zlib License",),
        (
            "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
            "held liable for any damages arising from the use of this software.",
            "Permission is granted to anyone to use this software for any purpose, including commercial applications, and "
            "to alter it and redistribute it freely, subject to the following restrictions:",
            "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
            "software. If you use this software in a product, an acknowledgment in the product documentation would be "
            "appreciated but is not required.",
            "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
            "original software.",
            "3. This notice may not be removed or altered from any source distribution.",
        ),
    ),
    "BSL-1.0": (
        ("Boost Software License - Version 1.0 - August 17th, 2003", "",),
        (
            "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software "
            "and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, "
            "distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to "
            "permit third-parties to whom the Software is furnished to do so, all subject to the following:",
            "The copyright notices in the Software and this entire statement, including the above license grant, this "
            "restriction and the following disclaimer, must be included in all copies of the Software, in whole or in "
            "part, and all derivative works of the Software, unless such copies or derivative works are solely in the "
            "form of machine-executable object code generated by a source language processor.",
            "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
            "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. "
            "IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR "
            "OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
            "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        ),
    ),
}

#: Longer licences (fixed values): digests of the canonical form of the texts as their stewards publish them, with a test that
#: computes them again from the copies that Debian ships.
DIGESTS: dict[str, str] = {
    "Apache-2.0": "db951b667a23eab69037d3a4055bbd37d7519d93c474e6b0688bef247c82c1c8",
    "Artistic-1.0-Perl": "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2",
    "BSD-3-Clause-UC": "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60",
    "GFDL-1.3": "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826",
    "GPL-1.0": "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
    "GPL-2.0": "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
    "GPL-3.0": "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a",
    "LGPL-2.0": "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
    "LGPL-2.1": "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6",
    "MPL-2.0": "22c9324e5634aa07c32060365e6191d4f9ec61fafc6091ce7394333c6d7db95e",
}

#: A line that holds a copyright statement: 'copyright' with a sign, a year or 'by' after it, or a sign before a year.
STATEMENT_LINE = (
    r"(^|\n)[ \t*#/;%<!-]*(?:portions )?(?:copyright[ \t:,-]*(?:\(c\)|©|&copy;|(?:19|20)[0-9]{2}|by |[<\[{(] ?(?:year|yyyy))"
    r"|©|&copy;|\(c\)[ \t,-]*(?:copyright|(?:19|20)[0-9]{2}|[<\[{] ?(?:year|yyyy)))[^\n]*"
)
RIGHTS = "all rights reserved"
EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()


def _spaced(words: str) -> str:
    """Words with a space around and two between, as they stand before the last step."""
    return f" {words.replace(' ', '  ')} "


def _respelled(text: Column, spellings: tuple[tuple[str, str], ...]) -> Column:
    for written, one in spellings:
        text = F.replace(text, F.lit(_spaced(written)), F.lit(_spaced(one)))
    return text


def _single(text: Column) -> Column:
    return F.btrim(F.replace(text, F.lit("  "), F.lit(" ")))


def _body(text: Column) -> Column:
    """Respelled words with two spaces between, so that neighbours can both be replaced, in lines."""

    def without_statements(low: Column) -> Column:
        some = F.lit(False)
        for sign in ("copyright", "(c)", "©", "&copy;"):
            some = some | F.contains(low, F.lit(sign))
        return F.when(some, F.regexp_replace(low, STATEMENT_LINE, "\n")).otherwise(low)

    words = F.regexp_replace(let(F.lower(text), without_statements), r"[^a-z0-9\n\p{L}\p{N}\p{M}]+", "  ")
    return _respelled(F.concat(F.lit(" "), F.replace(words, F.lit("\n"), F.lit(" \n ")), F.lit(" ")), WORDS)


def canonical(text: Column) -> Column:
    """The normalised form of a text; null stays null.

    Lines 'all rights reserved' are left out, unless nothing else is there.
    """

    def joined(lines: Column) -> Column:
        others = F.filter(lines, lambda x: x != RIGHTS.replace(" ", "  "))
        whole = _single(_respelled(F.concat(F.lit(" "), F.array_join(others, "  "), F.lit(" ")), PHRASES))
        return F.when((F.size(others) == 0) & (F.size(lines) > 0), F.lit(RIGHTS)).otherwise(whole)

    return let(F.filter(F.transform(F.split(_body(text), "\n"), lambda x: F.btrim(x)), lambda x: x != ""), joined)


def canonical_lines(text: Column) -> Column:
    """The normalised form of each line with a word."""
    return F.filter(F.transform(F.split(_respelled(_body(text), PHRASES), "\n"), lambda x: _single(x)), lambda x: x != "")


def known_texts(known: Mapping[str, tuple[str, ...]] | None = None) -> list[tuple[str, str]]:
    """(license, text) of notices and of licences in full, with each of their titles."""
    rows = [(name, text) for name, texts in sorted((KNOWN if known is None else known).items()) for text in texts]
    if known is None:
        rows += [(name, "\n\n".join(filter(None, (title, *body)))) for name, (titles, body) in sorted(FULL.items()) for title in titles]
    return rows


def known_digests(spark, known: Mapping[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(digest, license) of the given texts; of KNOWN, FULL and DIGESTS where none are given."""
    table = spark.createDataFrame(known_texts(known), "license string, text string").select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license")
    if known is None:
        table = table.unionByName(spark.createDataFrame(sorted((d, name) for name, d in DIGESTS.items()), "digest string, license string"))
    return table.groupBy("digest").agg(F.min("license").alias("license"))


def license_scan(docs: DataFrame, known: DataFrame | None = None, most_broadcast: int = 50_000) -> DataFrame:
    """(doc_id, text_digest, text_license, line_licenses): a row for each row of ``docs``.

    ``text_license`` is the licence that the whole text is, ``line_licenses`` the distinct ones that whole lines
    are, sorted and joined by commas ('' if none). Lines 'all rights reserved' are left out of a text with other words,
    and are a proprietary notice as a line and as a text without other words. A text that otherwise normalises to nothing is no licence; a null text has a null
    digest. Rows that repeat a doc_id get the licences of all of them; a row without doc_id gets those of its text only.
    """
    known = known_digests(docs.sparkSession) if known is None else known
    known = known.where(F.col("digest") != EMPTY_DIGEST)
    known = F.broadcast(known) if known.count() <= most_broadcast else known
    text = F.col("text").cast("string")
    lines = docs.where("doc_id is not null").select("doc_id", F.explode(F.array_distinct(canonical_lines(text))).alias("line"))
    found = (
        # Not nullable, or the join would compute it once more to drop nulls.
        lines.select("doc_id", F.coalesce(F.sha2("line", 256), F.lit("")).alias("digest"))
        .join(known, "digest")
        .groupBy("doc_id")
        .agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("line_licenses"))
    )
    whole = docs.select("doc_id", F.sha2(canonical(text), 256).alias("text_digest"))
    whole = whole.join(known.withColumnsRenamed({"digest": "text_digest", "license": "text_license"}), "text_digest", "left")
    return whole.join(found, "doc_id", "left").select("doc_id", "text_digest", "text_license", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"))
