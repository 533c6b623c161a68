"""Texts that are a known licence, found by the digest of their canonical form.

The canonical form lower-cases, maps equivalent spellings, drops copyright lines and
keeps only letters and digits with single spaces between words. Known licences go
through the same form, so two texts are the same licence exactly when their digests
are equal. DataFrame functions only.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence notices and short licence texts, in their published wording.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
#: (licence, text): whole texts and one-line notices that name a licence.
KNOWN = [
    ("MIT", MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("MIT", "The MIT License (MIT)\n\n" + MIT),
    ("ISC", ISC),
    ("ISC", "ISC License\n\n" + ISC),
    ("BSD-2-Clause", BSD_2),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + BSD_2),
    ("Apache-2.0", APACHE_NOTICE),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]
#: Spellings that count as the same word, on lower-case words.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"),
    ("artefact", "artifact"),
    ("authorise", "authorize"),
    ("authorised", "authorized"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelled", "labeled"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("modelled", "modeled"),
    ("organisation", "organization"),
    ("practise", "practice"),
    ("recognise", "recognize"),
    ("sublicence", "sublicense"),
    ("utilisation", "utilization"),
    ("wilful", "willful"),
]
#: A line that only states a copyright, on lower-case text.
COPYRIGHT_LINE = r"(?m)^[ \t#*/;-]*(copyright\b|\(c\)|©)[^\n]*(\n|\z)|^[ \t#*/;-]*all rights reserved\.?[ \t]*(\n|\z)"


def canonical(text: Column) -> Column:
    """The form two texts share when they are the same licence."""
    low = F.lower(F.coalesce(text, F.lit("")))
    low = F.regexp_replace(low, "\r\n?", "\n")
    low = F.regexp_replace(low, COPYRIGHT_LINE, "")
    low = F.regexp_replace(low, "https://", "http://")
    # Two spaces between words, so that neighbouring words both have their own.
    words = F.concat(F.lit(" "), F.regexp_replace(low, r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    spelt = reduce(lambda t, pair: F.replace(t, F.lit(f" {pair[0]} "), F.lit(f" {pair[1]} ")), SPELLINGS, words)
    return F.trim(F.replace(spelt, F.lit("  "), F.lit(" ")))


def needles(known: list[tuple[str, str]]) -> list[str]:
    """Words of which every text with the canonical form of a known one has at least one, in lower case.

    For each known text its longest word, in every spelling that counts as the same.
    A known text without such a word gives the empty needle, which every text has.
    """
    spelt, out = dict(SPELLINGS), set()
    for _, text in known:
        kept = re.sub(COPYRIGHT_LINE.replace(r"\z", r"\Z"), "", text.lower())
        words = [spelt.get(w, w) for w in re.findall("[a-z0-9]+", kept)]
        longest = max(words, key=lambda w: (len(w), w), default="")
        out |= {longest, *(old for old, new in SPELLINGS if new == longest)}
    return sorted(out)


def known_digests(spark, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """``digest, licence``, one row per canonical text; the first name given to a text counts.

    The list is a constant or an argument of the caller, a row per known licence text,
    so its size does not depend on the documents.
    """
    rows = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(known or KNOWN)], "i int, licence string, text string")
    keyed = rows.select("i", "licence", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    return keyed.groupBy("digest").agg(F.min_by("licence", "i").alias("licence"))


def licence_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: list[tuple[str, str]] | None = None
) -> DataFrame:
    """Per row: ``doc_id, canonical_sha256, licence, n_notices, notices``.

    ``licence`` is the known licence the entire text is, else NULL. ``notices`` lists,
    sorted and without repeats, the licences that an entire line of the document
    states, ``n_notices`` counts such lines. Null texts are empty, and empty is no
    licence. Rows that repeat a doc_id are each returned and share their notices.
    Other columns are not read; an empty table gives an empty result.
    """
    table = F.broadcast(known_digests(docs.sparkSession, known))
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.select(F.col(id_col).alias("doc_id"), F.sha2(canonical(text), 256).alias("digest")).join(table, "digest", "left")
    lines = docs.select(F.col(id_col).alias("_id"), F.explode(F.split(text, "\n")).alias("line"))
    # Only lines with a word that some known text has can be one; the others are not brought into form.
    lines = lines.where(reduce(or_, [F.contains(F.lower("line"), F.lit(w)) for w in needles(known or KNOWN)]))
    stated = lines.select("_id", F.sha2(canonical(F.col("line")), 256).alias("digest")).join(table, "digest")
    counted = stated.groupBy("_id").agg(
        F.count("*").alias("n_notices"), F.array_sort(F.collect_set("licence")).alias("notices")
    )
    return whole.join(counted, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
        "doc_id", F.col("digest").alias("canonical_sha256"), "licence",
        F.coalesce("n_notices", F.lit(0)).alias("n_notices"),
        F.coalesce(F.array_join("notices", ","), F.lit("")).alias("notices"),
    )
