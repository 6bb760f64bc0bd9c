"""Licence scans: whole licence texts and notices, alone or within other text, looked up by canonical digest, with built-in
functions only."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.llm.common import let

# Words that licence texts spell in more than one way, and the spelling that stands for both.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "licencee": "licensee", "licencees": "licensees",
    "acknowledgement": "acknowledgment", "authorisation": "authorization", "authorised": "authorized", "organisation": "organization", "organisations": "organizations",
    "merchantibility": "merchantability", "favour": "favor", "judgement": "judgment", "recognised": "recognized", "utilisation": "utilization", "whilst": "while",
}
# Words that stand for others after one word.
AFTER = {("copyright", "holder"): "owner", ("copyright", "holders"): "owners"}
# A word of licence texts that is also written as two.
SPLIT = ("noninfringement", "non infringement")

# Names and web addresses of licences in notices of one line.
NAMES = {
    "MIT": ("MIT License", "MIT license terms", "Expat License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2", "GNU GPL version 2", "GPL-2.0", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3", "GNU GPL version 3", "GPL-3.0", "GPLv3"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL-3.0", "LGPLv3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPL-3.0", "AGPLv3"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "Modified BSD License", "New BSD License"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"),
    "ISC": ("ISC License",),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0 1.0", "CC0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
}
# How a notice of one line begins; {} is a name.
NOTICES = (
    "{}", "The {}", "Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "Distributed under the {}", "Available under the {}",
    "This work is licensed under {}", "This work is licensed under the {}", "This work is licensed under a {}", "This file is licensed under the {}",
    "This project is licensed under the {}", "SPDX-License-Identifier: {}", "License: {}",
)
# Whole licence texts and notices, without their copyright lines; the first line may be a title, which a copy can leave out.
TEXTS = {
    "MIT": """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """BSD 2-Clause License

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "BSD-3-Clause": """BSD 3-Clause License

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "0BSD": """BSD Zero Clause License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """zlib License

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Unlicense": """The Unlicense

This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>""",
}
# The notice of the GNU licences, with its version, name and where the licence can be read.
GNU_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.

You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."""
GNU = {"GPL-2.0": ("General Public License", 2), "GPL-3.0": ("General Public License", 3), "LGPL-3.0": ("Lesser General Public License", 3), "AGPL-3.0": ("Affero General Public License", 3)}
# Whole licence texts too long to be here, as published: licence, SHA-256 of the canonical words, their number, the first three.
DIGESTS = (
    ("GPL-1.0", "37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f", 2067, "gnu general public"),
    ("GPL-2.0", "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6", 2975, "gnu general public"),
    ("GPL-3.0", "42de4913c0ec220db6e274a84efcdc7a52715762d22943334032232048072bc1", 5684, "gnu general public"),
    ("LGPL-2.0", "bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e", 4200, "gnu library general"),
    ("LGPL-2.1", "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692", 4401, "gnu lesser general"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", 1231, "gnu lesser general"),
    ("Apache-2.0", "4bc3c949c895ead14c0dc8c6e33fd6ed118359acaad7c084c4d563cd526a878d", 1596, "apache license version"),
    ("MPL-1.1", "1cfb6cca26abe2169c9c61164807107b2d4a0b64955a2cf2de46fad3483acda1", 3757, "mozilla public license"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9", 2414, "mozilla public license"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f", 1088, "creative commons legal"),
    ("GFDL-1.2", "bd8e32052e49e6b79fccbdd5dc03f7d40e45a8e895e3ecb79394b97961ffb127", 3315, "gnu free documentation"),
    ("GFDL-1.3", "e7579a53c7b8214f091590d94bfe39deb978a080895ca5506448b8baf4f77985", 3732, "gnu free documentation"),
    ("Artistic-1.0-Perl", "bc4d0c00d493021b9f3b1041689fa28b4bf980cf2e37601f7cb475a7265e3b93", 983, "the artistic license"),
)
COPYRIGHT_LINE = r"(?i)^[^\p{L}\p{N}]*(?:\(c\)|©|copyright\b[^\p{L}\p{N}]*(?:\(c\)|©|[0-9]{4}|(?:by|the)\b.*[0-9]{4})|all rights reserved)"
OTHER = r"[^\p{L}\p{N}]+"


#: A line's first words, up to LEAD of them; a known text is looked for only where a line begins as it does.
LEAD = 3
_FIRST_WORDS = r"^[^\p{L}\p{N}]*([\p{L}\p{N}]+(?:[^\p{L}\p{N}]+[\p{L}\p{N}]+){0,2})"
BREAK = "\u0001"


def known_licences() -> list[tuple[str, str]]:
    """(license, text) of the built-in table: whole texts with and without their titles, and every notice of every name."""
    bare = [(k, t.partition("\n\n")[2]) for k, t in TEXTS.items() if k != "Apache-2.0"]
    gnu = [(k, GNU_NOTICE.format(name=name, version=version)) for k, (name, version) in GNU.items()]
    return [*TEXTS.items(), *bare, *gnu, *((k, notice.format(name)) for k, names in NAMES.items() for name in names for notice in NOTICES)]


def canonical_words(text: str) -> list[str]:
    """Lower-cased runs of letters and digits of all lines but copyright lines, in one spelling."""
    lines = [x for x in re.split(r"\r?\n|\r", text) if not re.match(r"(?i)^[\W_]*(?:\(c\)|©|copyright\b[\W_]*(?:\(c\)|©|[0-9]{4}|(?:by|the)\b.*[0-9]{4})|all rights reserved)", x)]
    words = [SPELLINGS.get(w, w) for w in re.split(r"[\W_]+", " ".join(lines).lower()) if w]
    return [AFTER.get((words[i - 1] if i else "", w), w) for i, w in enumerate(words)]


def digest_table(known: list[tuple[str, str]] | None = None) -> list[tuple[str, str, int, str]]:
    """(license, digest, number of words, first LEAD words) of known (license, text), by default the built-in ones and DIGESTS; of
    licences with one digest the first in order. Texts with a word that is also written as two are there both ways."""
    found = [] if known is not None else list(DIGESTS)
    for name, text in known_licences() if known is None else known:
        plain = " ".join(canonical_words(text or ""))
        for x in {plain, plain.replace(*SPLIT), plain.replace(*SPLIT[::-1])} - {""}:
            words = x.split()
            found.append((name, hashlib.sha256(x.encode()).hexdigest(), len(words), " ".join(words[:LEAD])))
    first: dict[str, tuple[str, str, int, str]] = {}
    for row in sorted(found):
        first.setdefault(row[1], row)
    return list(first.values())


def _spelt(words: Column) -> Column:
    """canonical_words() of words as they stand."""
    one = F.create_map(*(F.lit(x) for pair in SPELLINGS.items() for x in pair))

    def after(ws: Column) -> Column:
        def word(w: Column, i: Column) -> Column:
            out = w
            for (before, own), new in AFTER.items():
                out = F.when((w == own) & (F.get(ws, i - 1) == before), new).otherwise(out)
            return out

        return F.transform(ws, word)

    return let(F.transform(words, lambda w: F.coalesce(one[w], w)), after)


def _stream(text: Column) -> Column:
    """array<struct(word, line, ends)>: the canonical words of a text; line is the number of the line that a word begins, else null,
    and ends tells that its line ends with it. Lines without words and copyright lines have none."""
    lines = F.split(text, r"\r?\n|\r")
    kept = F.transform(lines, lambda x, i: F.concat(F.lit(f" {BREAK}"), (i + 1).cast("string"), F.lit(" "), F.when(x.rlike(COPYRIGHT_LINE), "").otherwise(F.regexp_replace(F.lower(x), OTHER, " "))))
    # Spelling first, as breaks are no words; a word after a break looks at the one before it.
    tokens = F.array_remove(F.split(F.array_join(kept, ""), " "), "")

    def placed(ts: Column) -> Column:
        is_break = lambda t: t.isNull() | t.startswith(BREAK)
        found = F.transform(ts, lambda t, i: F.struct(t.alias("word"), F.when(is_break(F.get(ts, i - 1)), F.substring(F.get(ts, i - 1), 2, 20).cast("int")).alias("line"), is_break(F.get(ts, i + 1)).alias("ends")))
        words = F.filter(found, lambda x: ~x["word"].startswith(BREAK))
        return let(words, lambda ws: let(_spelt(F.transform(ws, lambda x: x["word"])), lambda ss: F.transform(ws, lambda x, i: F.struct(F.get(ss, i).alias("word"), x["line"].alias("line"), x["ends"].alias("ends")))))

    return let(tokens, placed)


def licence_scan(docs: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, line_no, n_words, whole, license): a row for each place of each text of docs(doc_id, text, ...) where lines that follow each
    other are a known licence or notice; whole tells that the text is nothing else.

    Texts are compared by the digest of their canonical words, so case, punctuation, line breaks, copyright lines and equivalent
    spellings do not matter. A licence has to begin with a line and to end with one; shorter ones within it, such as a
    title, are reported as well. Null, blank and punctuation-only texts match nothing; very long texts are looked at whole, from
    lines on that begin as a known text does; repeated rows are reported each; of licences with one digest the first in order counts; no rows
    give no rows; other columns are ignored. The licence table is a fixed list, or the caller's, and broadcast: no shuffle.
    """
    table = digest_table(known)
    spark = docs.sparkSession
    licences = spark.createDataFrame([(d, name) for name, d, _, _ in table], "digest string, license string")
    lengths = spark.createDataFrame(sorted({(first, n) for _, _, n, first in table}), "first string, n_words int")
    leads = sorted({" ".join(first.split()[:k]) for _, _, _, first in table for k in range(1, LEAD + 1)})
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    if not table:
        leads = ["\u0001"]
    begins = lambda x: F.array_join(_spelt(F.split(F.regexp_replace(F.regexp_extract(x, _FIRST_WORDS, 1), OTHER, " "), " ")), " ").isin(leads)
    likely = docs.select("doc_id", text.alias("text")).where(F.exists(F.split(F.lower("text"), r"\r?\n|\r"), begins))
    streams = likely.select("doc_id", _stream(F.col("text")).alias("ws")).select("doc_id", F.transform("ws", lambda x: x["word"]).alias("words"), F.transform("ws", lambda x: x["line"]).alias("lines"), F.transform("ws", lambda x: x["ends"]).alias("ends"))
    starts = streams.select("doc_id", "words", "ends", F.posexplode_outer("lines").alias("s", "line_no")).where("line_no is not null")
    leading = F.array_distinct(F.array(*(F.array_join(F.slice("words", F.col("s") + 1, k), " ") for k in range(1, LEAD + 1))))  # a known text of one or two words has no more
    starts = starts.select("*", F.explode(leading).alias("first"))
    runs = starts.join(F.broadcast(lengths), "first").where(F.get("ends", F.col("s") + F.col("n_words") - 1))
    units = runs.select("doc_id", "line_no", "n_words", ((F.col("s") == 0) & (F.size("words") == F.col("n_words"))).alias("whole"), F.sha2(F.array_join(F.slice("words", F.col("s") + 1, F.col("n_words")), " "), 256).alias("digest"))
    return units.join(F.broadcast(licences), "digest").select("doc_id", "line_no", "n_words", "whole", "license")
