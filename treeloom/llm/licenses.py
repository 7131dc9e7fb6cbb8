"""Licences of files: TF-IDF cosine to templates, then inheritance from the nearest directory that has a licence.

Headers and licence files are wrapped in many ways, so a whole text is compared in windows: each line, each paragraph
(lines without a blank one, or one of comment marks only, between), each two paragraphs in a row, its head, and the text
as a whole. A window and a template are term counts weighted by inverse document frequency over all documents (terms
that no template has weigh as much as a term no document has); the nearest window, by cosine, is the file's own licence
if it is near enough. A file that consists of such windows to a good part, or begins with the title of a licence, is a
licence file and speaks for its directory; files without a licence of their own take that of the nearest directory above
them that has one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeloom.llm.common import batches, free_name, lean, lower_words, small, small_batches, written

_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_ENDORSEMENT = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_FREE = "is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_WORK = "This work is licensed under a Creative Commons {} 4.0 International License"
_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."


def _gnu(name: str, short: str, version: str) -> list[str]:
    return [f"This program {_FREE.format(name, version)}", f"This library {_FREE.format(name, version)}", f"Licensed under the GNU {name}, version {version}", f"This work is licensed under the GNU {name}, version {version}", f"Licensed under {short} {version}"]


#: Notices, headers and short licence texts by which well-known licences are declared.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "MIT": ["Released under the MIT License", "Licensed under the MIT License", _GRANT, f"MIT License {_GRANT}"],
    "ISC": ["Licensed under the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "AGPL-3.0": _gnu("Affero General Public License", "AGPL", "3"),
    "GPL-3.0": _gnu("General Public License", "GPL", "3"),
    "GPL-2.0": _gnu("General Public License", "GPL", "2"),
    "LGPL-3.0": _gnu("Lesser General Public License", "LGPL", "3"),
    "LGPL-2.1": _gnu("Lesser General Public License", "LGPL", "2.1"),
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License", f"{_REDISTRIBUTION} {_ENDORSEMENT} {_DISCLAIMER}", f"{_REDISTRIBUTION} {_ENDORSEMENT}"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License", f"{_REDISTRIBUTION} {_DISCLAIMER}", _REDISTRIBUTION],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, version 2.0"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0", "Licensed under the Eclipse Public License, version 2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", _WORK.format("Attribution")],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", _WORK.format("Attribution-ShareAlike")],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", _WORK.format("Attribution-NonCommercial")],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0", _WORK.format("Attribution-NoDerivatives")],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
}
for _name in TEMPLATES:
    TEMPLATES[_name] = [*TEMPLATES[_name], f"SPDX-License-Identifier: {_name}"]

#: What the full texts of long licences begin with.
TITLES = {
    "Apache-2.0": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "AGPL-3.0": f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {_VERBATIM}",
    "GPL-3.0": f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {_VERBATIM}",
    "GPL-2.0": f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. {_VERBATIM}",
    "LGPL-3.0": f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {_VERBATIM}",
    "LGPL-2.1": f"GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. {_VERBATIM}",
    "MPL-2.0": "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.",
    "EPL-2.0": "Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (AGREEMENT). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.",
    "CC0-1.0": "Creative Commons Legal Code CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES.",
}

#: Least cosine of a window, and least part of a text's words in such windows that makes it a licence file.
COSINE, PART = 0.7, 0.3


#: Columns that files are given.
NEW = ("own_license", "cosine", "is_license_file", "license", "license_from")


def vocabulary() -> set[bytes]:
    return {t for texts in (*TEMPLATES.values(), TITLES.values()) for x in texts for t in lower_words(x)}


@dataclass
class Scanner:
    """Templates under the document frequencies (of template terms) over n documents."""

    n: int
    frequency: dict[bytes, int]

    def __post_init__(self) -> None:
        self.unknown = math.log(1 + self.n) + 1
        self.weight = {t: math.log((1 + self.n) / (1 + self.frequency.get(t, 0))) + 1 for t in vocabulary()}
        self.names: list[str] = []
        self.postings: dict[bytes, list[tuple[int, float]]] = {}
        self.titles: set[int] = set()
        every = [(name, x, False) for name, texts in TEMPLATES.items() for x in texts] + [(name, x, True) for name, x in TITLES.items()]
        #: the longest title, in words: a text's head is as long
        self.head = max(len(lower_words(x)) for x in TITLES.values())
        for name, x, title in every:
            if title:
                self.titles.add(len(self.names))
            counts = Counter(lower_words(x))
            norm = math.sqrt(sum((c * self.weight[t]) ** 2 for t, c in counts.items()))
            for t, c in counts.items():
                self.postings.setdefault(t, []).append((len(self.names), c * self.weight[t] / norm))
            self.names.append(name)

    def best(self, words: list[bytes], title: bool = False) -> tuple[str | None, float]:
        """The template (or title) nearest to the terms and its cosine, if that is COSINE at least; equal cosines go to the first template."""
        known = Counter([t for t in words if t in self.postings])
        inner = sum((c * self.weight[t]) ** 2 for t, c in known.items())
        least = COSINE**2
        # each unknown term adds its weight at least; most windows end here
        if not known or inner < least * (inner + (len(words) - known.total()) * self.unknown**2):
            return None, 0.0
        outer = sum(c * c for t, c in Counter(words).items() if t not in self.postings) * self.unknown**2
        dots: dict[int, float] = {}
        for t, c in known.items():
            for k, w in self.postings[t]:
                if (k in self.titles) == title:
                    dots[k] = dots.get(k, 0.0) + c * self.weight[t] * w
        if not dots:
            return None, 0.0
        k = max(dots, key=lambda i: (dots[i], -i))
        cosine = dots[k] / math.sqrt(inner + outer)
        return (self.names[k], cosine) if cosine >= COSINE else (None, 0.0)

    def scan(self, text: str | None) -> tuple[str | None, float, bool]:
        """(licence, cosine, whether it is a licence file) of a whole text; (None, 0, False) where nothing is near enough."""
        lines = [lower_words(line) for line in (text or "").split("\n")]
        whole = [w for line in lines for w in line]
        best: tuple[str | None, float] = (None, 0.0)
        inside = 0

        def window(words: list[bytes]) -> bool:
            nonlocal best, inside
            found = self.best(words)
            if found[0] is None:
                return False
            inside = max(inside, len(words))
            if found[1] > best[1]:
                best = found
            return True

        total = sum(len(line) for line in lines if window(line))
        paragraphs: list[list[bytes]] = [[]]
        for line in lines:
            if line:
                paragraphs[-1] += line
            elif paragraphs[-1]:
                paragraphs.append([])
        several = len(paragraphs) > 1
        for k, own in enumerate(paragraphs if several else ()):
            window(own)
            if k:
                window(paragraphs[k - 1] + own)
        window(whole)
        inside = max(inside, total)
        title = self.best(whole[: self.head], True)
        for n in range(self.head // 2, self.head, 8):  # titles differ in length
            title = max(title, self.best(whole[:n], True), key=lambda x: x[1])
        if title[0]:
            return title[0], title[1], True
        return best[0], best[1], best[0] is not None and inside >= PART * len(whole)


def frequencies(files: DataFrame) -> Scanner:
    """A scanner with the document frequencies of the templates' terms over all files (text)."""
    schema = pa.schema([("term", pa.binary()), ("n", pa.int64())])
    known = vocabulary()

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        counts: Counter = Counter()
        for batch in source:
            for text in batch.column(0).to_pylist():
                counts[b""] += 1
                counts.update(known.intersection(lower_words(text)))
        yield from counts.items()

    rows = files.select("text").mapInArrow(lean(lambda source: batches(run(source), schema)), "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row a template term
    found = {bytes(r["term"]): r["n"] for r in rows}
    return Scanner(found.pop(b"", 0), found)


def scan(files: DataFrame, scanner: Scanner) -> DataFrame:
    """files without text, with own_license, cosine and is_license_file."""
    shared = files.sparkSession.sparkContext.broadcast(scanner)

    @F.pandas_udf("own_license string, cosine double, is_license_file boolean")
    def run(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.DataFrame([shared.value.scan(t) for t in texts], columns=["own_license", "cosine", "is_license_file"])

    rest = [F.col(f"`{c}`") for c in files.columns if c.lower() not in ("text", *NEW)]
    found = free_name(files.columns, "found")
    return files.select(*rest, run("text").alias(found)).select(*rest, *[F.col(f"{found}.{c}").alias(c) for c in NEW[:3]])


def _parent(path: F.Column) -> F.Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherit(scanned: DataFrame) -> DataFrame:
    """scanned (path, own_license, is_license_file, ...) with license and license_from.

    A directory's licence is that of most of its own licence files, of equally many the first by name. Each directory
    takes the licence of the nearest one at or above it, by joining the paths above it; files without a licence take
    their directory's. license_from says 'own', 'inherited' or 'none'.
    """
    folder, inherited = free_name(scanned.columns, "folder"), free_name(scanned.columns, "inherited_license")
    scanned = scanned.withColumn(folder, _parent(F.coalesce("path", F.lit(""))))
    slim = scanned.select(F.col(folder).alias("dir"), "own_license", "is_license_file")
    counts = slim.where("is_license_file").groupBy("dir", "own_license").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("dir").orderBy(F.desc("n"), "own_license"))  # a row a template at most
    declared = counts.withColumn("k", rank).where("k = 1").select(F.col("dir").alias("above"), F.col("own_license").alias("theirs"))
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))
    nearest = slim.select("dir").distinct().withColumn("above", F.explode(F.array_distinct(above))).join(small(written(declared, "declared")), "above").groupBy("dir").agg(F.max_by("theirs", F.length("above")).alias("theirs"))
    nearest = nearest.select(F.col("dir").alias(folder), F.col("theirs").alias(inherited))
    rows = scanned.join(small(written(nearest, "nearest")), folder, "left")
    origin = F.when(F.col("own_license").isNotNull(), "own").when(F.col(inherited).isNotNull(), "inherited").otherwise("none")
    return rows.withColumns({"license": F.coalesce("own_license", inherited), "license_from": origin}).select(*[F.col(f"`{c}`") for c in scanned.columns if c != folder], "license", "license_from")


def licensed(files: DataFrame) -> DataFrame:
    """files (path, text, ...) without text, with own_license, cosine, is_license_file, license and license_from.

    Null and empty texts have no licence of their own; a null path lies at the root. Repeated rows are files of their
    own. Columns called like a new one are replaced; the other columns pass.
    """
    small_batches(files.sparkSession)
    files = files.select(*[F.col(f"`{c}`") for c in files.columns if c.lower() not in NEW])
    return inherit(written(scan(files, frequencies(files)), "licenses"))
