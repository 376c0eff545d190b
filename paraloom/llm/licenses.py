"""Licence scans by canonical digest lookup; DataFrame functions only.

A unit is a whole document, one of its paragraphs (lines between blank ones) or one of
its lines. Its canonical form: ASCII lower case, copyright lines dropped, everything but
letters and digits to single blanks, equivalent spellings unified. Each line is made
canonical once; paragraphs and document are its lines joined. The SHA-256 of the whole
canonical document is hash-joined to the digests of the known licences, a fixed table of
some hundred rows at most (broadcast: its size does not depend on the data); paragraphs and
lines as long as a known text are looked up in the same table as a map. There is no shuffle.

Defined cases: null text counts as empty; an empty canonical form matches
nothing; several hits in a document are reported once per licence in name order;
repeated rows are rows of their own; an empty table gives an empty result; other
columns of docs are ignored.
"""

from __future__ import annotations

import hashlib
import re
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Notices that stand for a licence.
NOTICES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
]
#: Public licence texts by name, titles and paragraphs; the first paragraph alone stands for the licence too.
TEXTS: list[tuple[str, list[str], list[str]]] = [
    ("Apache-2.0", [""], [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        "http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ]),
    ("MIT", ["", "MIT License", "The MIT License", "The MIT License (MIT)"], [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ]),
    ("ISC", ["", "ISC License", "The ISC License", "ISC License (ISC)"], [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ]),
    ("0BSD", ["", "BSD Zero Clause License", "Zero-Clause BSD"], [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ]),
]
#: The parts of the BSD licences; {holder} and the like stand for the forms below.
BSD_INTRO = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_CLAUSES = [
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of {holder} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
]
BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY {givers} AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {giver} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
BSD_HOLDERS = ["the copyright holder", "the University"]
BSD_GIVERS = [("THE COPYRIGHT HOLDERS", "THE COPYRIGHT HOLDER"), ("THE COPYRIGHT HOLDERS", "THE COPYRIGHT OWNER"), ("THE REGENTS", "THE REGENTS")]
BSD_TITLES = {3: ["", "BSD 3-Clause License", "The 3-Clause BSD License"], 2: ["", "BSD 2-Clause License", "The 2-Clause BSD License"]}
#: Digests of the canonical forms of long public licence texts: name, characters, SHA-256.
DIGESTS: list[tuple[str, int, str]] = [
    ("Apache-2.0", 8804, "09ad3868555dada25cbf24199409a8c1e39fe8ef08d164adc6e98c1d02767793"),
    ("Apache-2.0", 9820, "f92c423b6d6da66caa78abd6f49f73f5bc8715dca82e1a73f62d1e6eec41986c"),
    ("Artistic-1.0", 5833, "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", 6691, "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", 19583, "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", 22018, "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0", 9415, "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", 11765, "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", 14483, "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", 17117, "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", 30968, "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("GPL-3.0", 33406, "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0", 22277, "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", 24130, "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", 23365, "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", 25217, "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", 7104, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", 22339, "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6"),
    ("MPL-2.0", 14271, "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
]
#: Spellings that count as the one they are replaced by (words, after lower case).
EQUIVALENT_SPELLINGS: list[tuple[str, str]] = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"), ("favour", "favor"),
    ("honour", "honor"), ("fulfil", "fulfill"), ("judgement", "judgment"), ("merchantibility", "merchantability"), ("non infringement", "noninfringement"), ("https", "http"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of a lower-cased line: a copyright line, by its sign, year or holder; `copyright notice` in running text is none.
COPYRIGHT_LINE = r"^[ \t]*(copyright[ \t]*(\(c\)|©|[0-9]{4}|[<\[{]|by )|(\(c\)|©)[ \t]|all rights reserved\.?[ \t\r]*$)"
BLANK_LINES = r"\n[ \t\r]*\n"


def canonical_literal(text: str) -> str:
    """The canonical form of a text, for the table of known ones."""
    lines = [re.sub("[^a-z0-9]+", " ", x).strip(" ") for x in text.translate(str.maketrans(UPPER, LOWER)).split("\n") if not re.search(COPYRIGHT_LINE, x)]
    x = " " + " ".join(y for y in lines if y) + " "
    for old, new in EQUIVALENT_SPELLINGS:
        x = x.replace(f" {old} ", f" {new} ")
    return x.strip(" ")


def known_licenses() -> dict[str, tuple[str, int]]:
    """Licence and length of each known canonical form, by its SHA-256."""
    texts = [(name, text) for name, text in NOTICES]
    for name, titles, paragraphs in TEXTS:
        texts += [(name, "\n".join([t, *paragraphs])) for t in titles] + [(name, paragraphs[0])]
    for n, titles in BSD_TITLES.items():
        for title, holder, (givers, giver), mark in product(titles, BSD_HOLDERS, BSD_GIVERS, ("{}. ", "* ")):
            clauses = [mark.format(i + 1) + c.format(holder=holder) for i, c in enumerate(BSD_CLAUSES[:n])]
            texts.append((f"BSD-{n}-Clause", "\n".join([title, BSD_INTRO, *clauses, BSD_WARRANTY.format(givers=givers, giver=giver)])))
    forms = {c: name for name, c in sorted(((name, canonical_literal(text)) for name, text in texts), reverse=True)}
    return {hashlib.sha256(c.encode()).hexdigest(): (name, len(c)) for c, name in forms.items()} | {digest: (name, n) for name, n, digest in DIGESTS}


def spelled(form: Column) -> Column:
    """A canonical form with equivalent spellings unified."""
    x = F.concat(F.lit(" "), form, F.lit(" "))
    for old, new in EQUIVALENT_SPELLINGS:
        x = F.replace(x, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(x)


def _line(line: Column) -> Column:
    return F.when(line.rlike(COPYRIGHT_LINE), F.lit("")).otherwise(F.trim(F.regexp_replace(line, "[^a-z0-9]+", " ")))


def paragraphs(text: Column) -> Column:
    """The canonical lines (spellings as they are) of each paragraph."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.transform(F.split(lowered, BLANK_LINES), lambda p: F.filter(F.transform(F.split(p, "\n"), _line), lambda x: x != ""))


def known_digests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name, digest) for digest, (name, _) in sorted(known_licenses().items())], "document_license string, canonical_sha256 string")


def license_scan(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row of docs: key, canonical_sha256, document_license (whole text), line_licenses and paragraph_licenses (joined by |), n_license_lines."""
    known = known_licenses()
    lengths = sorted({n for _, n in known.values()})
    table = F.create_map(*(F.lit(x) for digest, (name, _) in sorted(known.items()) for x in (digest, name)))
    # a spelling changes a form by a character at most, and there is none in four characters
    near = lambda x: (F.length(x) >= lengths[0] * 4 // 5) & (F.length(x) <= lengths[-1] * 5 // 4)
    exact = lambda x: F.length(x).isin(lengths)
    licenses = lambda units: F.filter(F.transform(F.filter(F.transform(F.filter(units, near), spelled), exact), lambda x: table[F.sha2(x, 256)]), lambda x: x.isNotNull())
    rows = docs.select(F.col(f"`{key}`").alias("__key"), paragraphs(F.col("text")).alias("__p"))
    rows = rows.select(
        F.col("__key").alias(key),
        F.sha2(spelled(F.array_join(F.flatten("__p"), " ")), 256).alias("canonical_sha256"),
        licenses(F.flatten("__p")).alias("__lines"),
        licenses(F.transform("__p", lambda p: F.array_join(p, " "))).alias("__paragraphs"),
    )
    found = rows.join(F.broadcast(known_digests(docs.sparkSession)), "canonical_sha256", "left")
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), "|")
    return found.select(key, "canonical_sha256", "document_license", joined("__lines").alias("line_licenses"), joined("__paragraphs").alias("paragraph_licenses"), F.size("__lines").cast("long").alias("n_license_lines"))
