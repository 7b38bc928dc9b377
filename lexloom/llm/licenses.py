"""Licence texts found by canonical digest.

A text is brought to a canonical form - lower case, copyright statements dropped, punctuation
and white space folded, equivalent spellings made one - and the digest of the whole form
is hash-joined to the digests of known licences.  That is done for each whole document, and inside longer ones for each
stretch of whole lines that begins with a known licence's first words and has as many words as it: digests of those only are taken.
Where lines break makes no difference, but for lines that state a copyright.
"""

from __future__ import annotations

import hashlib
import pkgutil
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that licence texts use for one another; each becomes the second.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog",
    "categorise": "categorize", "centre": "center", "copyrightholder": "copyright holder", "emphasised": "emphasized", "favour": "favor",
    "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "https": "http", "initialise": "initialize", "judgement": "judgment",
    "labelling": "labeling", "labour": "labor", "licence": "license", "licenced": "licensed", "licences": "licenses", "maximise": "maximize",
    "modelled": "modeled", "modelling": "modeling", "offence": "offense", "optimise": "optimize", "organisation": "organization",
    "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize",
    "signalling": "signaling", "sublicence": "sublicense", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
    "noncommercial": "non commercial", "percent": "per cent", "v2": "version 2", "v3": "version 3",
}
#: Lines that state a copyright: they name its sign or a year. A licence's own lines may begin with "copyright" or a clause "(c)".
STATEMENT = r"^[^\pL\pN]*(copyright[^\pL\pN]*(\(c\)|©|(by )?(19|20)[0-9][0-9]|[\[<{]y)|(\(c\)|©)[^\pL\pN]*(19|20)[0-9][0-9]|©|all rights reserved[^\pL\pN]*$)"
_COPYRIGHT = re.compile(STATEMENT.replace(r"[^\pL\pN]", r"[\W_]"), re.I)
#: Words of a licence that begin a stretch which is looked at.
OPENING = 3
_APART = re.compile(r"[\W_]+")

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Licences whose whole text is a file of license_texts.
WHOLE = [
    "Apache-2.0", "CC0-1.0", "GFDL-1.2-only", "GFDL-1.3-only", "GPL-1.0-only", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.0-only", "LGPL-2.1-only",
    "LGPL-3.0-only", "MPL-1.1", "MPL-2.0",
]
#: Where a licence's terms end; what follows tells how to use it.
_TERMS = re.compile(r"(END OF TERMS AND CONDITIONS)|\n(?=ADDENDUM: How to use)", re.I)


def whole_texts(name: str) -> list[str]:
    """A licence's text with and without what follows its terms and what precedes them, in the lines of its file and with a line for each paragraph.

    Lines matter where a copyright is stated; the text behind the paragraph that states one matches however it is broken.
    """
    text = pkgutil.get_data("lexloom.llm", f"license_texts/{name}.txt").decode()
    end = _TERMS.search(text)
    texts = [text, text[: end.end()]] if end else [text]
    parts = re.split(r"\n\s*\n", texts[-1])
    stated = [k for k, p in enumerate(parts[:8]) if any(map(_COPYRIGHT.match, p.split("\n")))]
    if stated:
        texts.append("\n\n".join(parts[stated[-1] + 1 :]))
    return texts + ["\n".join(" ".join(x.split()) for x in re.split(r"\n\s*\n", t)) for t in texts]


#: Licence id and a text that stands for it: whole licences, and the notices that name one.
KNOWN = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_END),
    ("ISC", "ISC License\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_END),
    ("0BSD", _ISC_GRANT + ".\n" + _ISC_END),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_THIRD + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD + _BSD_THIRD + _BSD_END),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
]


def canonical_line(line: str) -> str:
    """The canonical words of one line; a copyright line has none."""
    if _COPYRIGHT.match(line):
        return ""
    words = _APART.sub(" ", line.lower()).split()
    return " ".join(map(SPELLINGS.get, words, words))


def canonical(text: str) -> str:
    return " ".join(filter(None, map(canonical_line, text.split("\n"))))


KNOWN += [(name, text) for name in WHOLE for text in {canonical(t): t for t in whole_texts(name)}.values()]


def digest(form: str) -> bytes:
    return hashlib.sha256(form.encode()).digest()


def openings(known: list[tuple[str, str]]) -> dict[tuple[str, ...], dict[int, set[bytes]]]:
    """Of the texts' canonical forms: their first words, how many words they have, and their digests."""
    found: dict = {}
    for _, text in known:
        words = canonical(text).split()
        found.setdefault(tuple(words[:OPENING]), {}).setdefault(len(words), set()).add(digest(" ".join(words)))
    return found


def _stretches(text: str, known: dict, shortest: int) -> list[tuple[int, int, int, int, bytes, int]]:
    """(first word, words, first line, last line, digest, all words of the text) of the stretches that are known texts."""
    forms = [(k, form.split()) for k, form in enumerate(map(canonical_line, text.split("\n"))) if form]
    words = [w for _, line in forms for w in line]
    ends, at = {}, 0
    for k, line in forms:
        at += len(line)
        ends[at] = k
    found, at = [], 0
    for k, line in forms:
        for size in range(shortest, OPENING + 1):
            for n, digests in known.get(tuple(words[at : at + size]), {}).items():
                if at + n in ends and (d := digest(" ".join(words[at : at + n]))) in digests:
                    found.append((at, n, k, ends[at + n], d))
        at += len(line)
    return [(*x, len(words)) for x in found]


def _digests(known: dict, names: dict[bytes, str]):
    """Rows (doc_id, text) to a digest for each stretch of lines that is a known text; of a licence, only what lies in no longer stretch of its."""
    shortest = min(map(len, known), default=OPENING)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                held: list[tuple[int, int, str]] = []
                for at, n, line, last, d, total in sorted(_stretches(text or "", known, shortest), key=lambda x: (-x[1], x[0])):
                    if not any(a <= at and at + n <= b and name == names[d] for a, b, name in held):
                        held.append((at, at + n, names[d]))
                        out.append((row, "document" if n == total else "line" if line == last else "passage", *((None, None) if n == total else (line, last)), d))
            of, *columns = zip(*out, strict=True) if out else ((),) * 5
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary())
            yield pa.record_batch([batch.column(0).take(pa.array(of, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", "scope", "line", "last_line", "digest"])

    return run


def named(known: list[tuple[str, str]]) -> dict[bytes, str]:
    """License id by digest; two texts of one form must name one licence."""
    found: dict[bytes, str] = {}
    for name, text in known:
        if not canonical(text):
            raise ValueError(f"a text of {name} has no words")
        if found.setdefault(digest(canonical(text)), name) != name:
            raise ValueError(f"{name} and {found[digest(canonical(text))]} have the same canonical text")
    return found


def scan(spark: SparkSession, docs: DataFrame, known: list[tuple[str, str]] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, scope, line, last_line, license_id, digest): stretches of whole lines whose canonical text is a whole known licence's.

    scope is 'document' for a whole document (line and last_line null), 'line' for one line, and 'passage' for several.  A
    stretch within a longer one of the same licence is left out.  Null and empty texts, and those of copyright statements only, have no canonical text and
    match nothing.  Repeated rows and rows with a null id each give their own matches.  The known
    licences are a list of (license_id, text), which every task holds by first words and digest; repeats in it do no harm.  Other columns are left out; an empty
    table gives no rows.
    """
    known = KNOWN if known is None else known
    names = named(known)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    units = rows.mapInArrow(_digests(openings(known), names), f"doc_id {id_type}, scope string, line int, last_line int, digest binary")
    table = spark.createDataFrame([(name, bytearray(d)) for d, name in names.items()], "license_id string, digest binary")
    found = units.join(F.broadcast(table), "digest")  # the list given, a row of some 50 bytes for each of its texts
    return found.select("doc_id", "scope", "line", "last_line", "license_id", F.lower(F.hex("digest")).alias("digest"))
