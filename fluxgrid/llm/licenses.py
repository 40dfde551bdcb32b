"""Licence scans by lookup of canonical digests.

A text is brought to a canonical form: lower case, list marks, punctuation and white space to single spaces, copyright
lines dropped, equivalent spellings to one. The digest of the whole form is joined with those of known licences: that is
scan(). notices() is the same lookup for the short notices that stand in other texts, by line and by paragraph.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import cache
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.session import small

# Spellings that count as the same in licence texts, by the public matching guidelines for licences.
EQUIVALENT = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "capitalisations": "capitalizations",
    "catalogue": "catalog",
    "categorise": "categorize",
    "centre": "center",
    "copyright holder": "copyright owner",
    "copyright holders": "copyright owners",
    "emphasised": "emphasized",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "https": "http",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "licenced": "licensed",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "non commercial": "noncommercial",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "per cent": "percent",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sub license": "sublicense",
    "utilisation": "utilization",
    "while": "whilst",
    "wilful": "willful",
}
_TABLE = bytes(x + 32 if 65 <= x < 91 else x if x >= 128 or chr(x).isalnum() else 32 for x in range(256))
_WIDE = {"©": " c ", "“": " ", "”": " ", "‘": " ", "’": " ", "–": " ", "—": " ", " ": " "}
_WIDE_BYTES = {k.encode(): v.encode() for k, v in _WIDE.items()}
_SPELLING = re.compile(rb"(?<![^ ])(" + b"|".join(sorted((k.encode() for k in EQUIVALENT), key=len, reverse=True)) + rb")(?![^ ])")
_BY = {k.encode(): v.encode() for k, v in EQUIVALENT.items()}
#: A line, in canonical form, that says whose work it is; a line that merely begins with the word isn't one.
_COPYRIGHT = re.compile(
    rb"(portions )?(copyright|c) (c |by |\d{4}\b|year\b|yyyy\b|name of\b|owner\b).*|(portions )?copyright .*\b(19|20)\d\d\b.*|all rights reserved"
)
_MARK = re.compile(rb"(?:[*+\-]+|\xe2\x80\xa2|\(?(?:\d{1,2}|[A-Za-z]|[ivxIVX]{1,4})[.)])\s+")


def _canonical_line(line: bytes) -> bytes:
    """Words in lower case with single spaces between them, without a list mark; empty for a copyright line."""
    line = line.strip()
    if (m := _MARK.match(line)) and not line[: m.end()].strip().lower().startswith(b"(c)"):
        line = line[m.end() :]
    if any(x in line for x in (b"\xc2", b"\xe2\x80")):
        for wide, plain in _WIDE_BYTES.items():
            line = line.replace(wide, plain)
    line = b" ".join(line.translate(_TABLE).split())
    return b"" if line.startswith((b"copyright", b"all right", b"portions ", b"c ")) and _COPYRIGHT.fullmatch(line) else line


def _spelled(line: bytes) -> bytes:
    return _SPELLING.sub(lambda m: _BY[m[1]], line)


def canonical(text: str | None) -> str:
    """The canonical form of a text; that of null is empty."""
    lines = (text or "").encode("utf-8", "replace").split(b"\n")
    return _spelled(b" ".join(filter(None, map(_canonical_line, lines)))).decode("utf-8", "replace")


def _digest(form: bytes) -> str:
    return hashlib.sha256(form).hexdigest()


_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: (licence, file of its text, what stands between the terms and advice on their use) of the licences whose texts are packaged.
PACKAGED = (
    ("Apache-2.0", "Apache-2.0", "END OF TERMS AND CONDITIONS"), ("GPL-2.0", "GPL-2", "END OF TERMS AND CONDITIONS"), ("GPL-3.0", "GPL-3", "END OF TERMS AND CONDITIONS"),
    ("LGPL-2.1", "LGPL-2.1", "END OF TERMS AND CONDITIONS"), ("LGPL-3.0", "LGPL-3", None), ("MPL-1.1", "MPL-1.1", None), ("MPL-2.0", "MPL-2.0", "Exhibit A - Source Code Form License Notice"),
    ("CC0-1.0", "CC0-1.0", None), ("GFDL-1.3", "GFDL-1.3", "ADDENDUM: How to use this License for your documents"), ("Artistic-1.0", "Artistic", None),
)
#: (licence, title, terms) of short licences; a text may begin with the title.
SHORT = (
    ("MIT", "MIT License", _MIT),
    ("MIT", "The MIT License (MIT)", _MIT),
    ("ISC", "ISC License", _ISC),
    ("BSD-2-Clause", "BSD 2-Clause License", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
)
#: (licence, notice) of short notices that stand in other texts.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)


@cache
def known_texts() -> tuple[tuple[str, str], ...]:
    """(licence, text) of the known licences, each with and without its title or the advice after its terms."""
    out = [(name, text) for name, title, terms in SHORT for text in (terms, f"{title}\n\n{terms}")]
    for name, file, end in PACKAGED:
        text = (resources.files("fluxgrid.llm") / "license_texts" / f"{file}.txt").read_text(encoding="utf-8")
        out.append((name, text))
        if end:
            head = text[: text.index(end)]
            out += [(name, head), (name, head + end)]
    return tuple(out)


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license_id, text) of the licences known here."""
    return spark.createDataFrame(list(known_texts()), "license_id string, text string")


def _form(text: str) -> bytes:
    return canonical(text).encode()


def _digest_table(spark: SparkSession, listed: tuple[tuple[str, str], ...]) -> DataFrame:
    """(digest, license_id) of a list that is part of this module."""
    rows = sorted({(_digest(form), name) for name, text in listed if (form := _form(text))})
    return spark.createDataFrame(rows, "digest string, license_id string")


def _scanned(whole: bool, forms: frozenset[bytes] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(row, doc_id, digest) of the whole text of each row, or of its lines and paragraphs.

    forms: the canonical forms that are looked for, if they are few: what has another length or other first words is
    none of them, and its digest isn't taken. No spelling shortens a form to less than half.
    """
    sizes = frozenset(map(len, forms)) if forms is not None else frozenset()
    longest = 2 * max(sizes, default=0) if forms is not None else float("inf")
    heads = frozenset(form[:12] for form in forms or ())

    def units(data: bytes) -> Iterator[tuple[list[bytes], int]]:
        """What may be the form of something, as lines, and its length."""
        lines = [_canonical_line(x) for x in data.split(b"\n")]
        if whole:
            yield [x for x in lines if x], sum(map(len, lines))
            return
        paragraph: list[bytes] = []
        for line in (*lines, b""):
            if line:
                yield [line], len(line)
                paragraph.append(line)
            else:
                if len(paragraph) > 1:
                    yield paragraph, sum(map(len, paragraph))
                paragraph = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids, found = [], [], []
            for row, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                for lines, size in units(text.as_buffer().to_pybytes()) if text.is_valid else ():
                    if not size or size > longest or forms is not None and _spelled(b" ".join(lines[:3])[:200])[:12] not in heads and size > 200:
                        continue
                    form = _spelled(b" ".join(lines))
                    if forms is None or len(form) in sizes:
                        rows.append(row)
                        ids.append(doc)
                        found.append(_digest(form))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(found, pa.string())], ["row", "doc_id", "digest"])

    return run


def _looked_up(docs: DataFrame, table: DataFrame, whole: bool, forms: frozenset[bytes] | None, scope: str) -> DataFrame:
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    found = source.mapInArrow(_scanned(whole, forms), "row bigint, doc_id bigint, digest string")
    by_row = found.join(small(table), "digest").groupBy("row", "doc_id", "license_id").agg(F.count("*").alias("n"))
    return by_row.select("doc_id", "license_id", F.lit(scope).alias("scope"), "n")


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, license_id, scope, n) of each row of docs(doc_id, text) whose whole text is a licence; scope is 'text' and n is 1.

    Null and empty texts, and licences without a word, match nothing. Repeated rows give repeated results, null ids come
    out as null, and texts of any length are looked up whole. known(license_id, text): known_licenses() unless given; a
    table of any size, as its digests are taken by tasks and joined.
    """
    if known is None:
        return _looked_up(docs, _digest_table(docs.sparkSession, known_texts()), True, frozenset(_form(t) for _, t in known_texts()), "text")
    own = known.select(F.monotonically_increasing_id().alias("doc_id"), F.col("license_id").cast("string"), F.col("text").cast("string"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [_form(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(f) if f else None for f in forms], pa.string()), batch.column(1)], ["digest", "license_id"])

    table = own.mapInArrow(digests, "digest string, license_id string").where("digest is not null").distinct()
    return _looked_up(docs, table, True, None, "text")


def notices(docs: DataFrame) -> DataFrame:
    """(doc_id, license_id, scope, n) of each row of docs(doc_id, text) that has n lines, or paragraphs of several lines, which are a known notice; scope is 'notice'."""
    forms = frozenset(_form(t) for _, t in NOTICES)
    return _looked_up(docs, _digest_table(docs.sparkSession, NOTICES), False, forms, "notice")
