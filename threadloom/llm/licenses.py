"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from directories.

A file's evidence are its passages: at every word the windows of each template's
length and a quarter more, and every line alone and joined with the lines that
follow it (up to five). Each passage is a sparse TF-IDF vector over words, with
inverse document frequencies of the templates (a word of no template weighs
most); its licence is the template of the largest cosine, if that reaches
`least` with two different words at least that are not words of any text. Whole texts are read. Passages are
left out only by bounds: one that repeats no word has the cosine that running
sums give, any other a smaller one, and a text without two telling words has
none that counts. Templates are notices, whole short
licences and the heads of the long ones. A licence file (LICENSE, COPYING and
the like, in any spelling of case and extension) also is compared whole. A file
without a licence of its own takes that of the licence file in the nearest
directory above it, found by joining paths.

Null texts count as empty. A null path inherits nothing. Repeated rows are
scanned alike; if several licence files lie in one directory, the largest
cosine counts, then the smaller licence name, then the smaller path.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import materialise, slices

_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS_MIT = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_FSF = "Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
# What common licences say of themselves in notices.
TEMPLATES = [
    ("AGPL-3.0", "GNU Affero General Public License version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "This software is distributed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "This software is distributed under the BSD 3-Clause License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0 Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "CC0 1.0 Universal public domain dedication"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    # Whole short licences.
    ("MIT", f"{_MIT} {_AS_IS_MIT}"),
    ("BSD-2-Clause", f"{_BSD} {_BSD_AS_IS}"),
    ("BSD-3-Clause", f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_AS_IS}"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    # Heads of the long ones.
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. License shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."),
    ("GPL-2.0", f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 {_FSF}"),
    ("GPL-3.0", f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 {_FSF}"),
    ("LGPL-3.0", f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 {_FSF}"),
    ("AGPL-3.0", f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 {_FSF}"),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
]
FILE_NAME = r"(?i)(^|/)(un)?(licen[cs]e|copying)([._-][^/]*)?$"
TOKEN = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
#: Words of any text: they weigh in a cosine like others, but two other words must be common to a passage and its template.
COMMON = "the of and to in is for or that by with this be as on are any not it an at all from no if has have may shall was which use other under such where a".split()
FOLLOWING = 5
#: Words of a text that are compared at a time; parts overlap by the longest window.
PART = 20_000
#: Most bytes of directories with an inherited licence that are broadcast; beyond it they are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


class Templates:
    def __init__(self, templates: list[tuple[str, str]], least: float):
        bags = [(name, Counter(TOKEN.findall(text.lower()))) for name, text in templates]
        df = Counter(w for _, b in bags for w in b)
        n = len(bags)
        self.least = least
        self.names = [name for name, _ in bags]
        self.lengths = [sum(b.values()) for _, b in bags]
        self.ids = {w: k for k, w in enumerate(df)}
        self.idf = np.array([*(math.log((1 + n) / (1 + c)) + 1 for c in df.values()), math.log(1 + n) + 1])  # the last: of an unknown word
        self.unit = np.zeros((len(df) + 1, n))
        for k, (_, b) in enumerate(bags):
            for w, c in b.items():
                self.unit[self.ids[w], k] = c * self.idf[self.ids[w]]
        self.unit /= np.linalg.norm(self.unit, axis=0)
        self.products = self.unit * self.idf[:, None]
        self.reach = max(self.lengths) * 5 // 4
        self.telling = (self.unit > 0) & np.array([w not in COMMON for w in [*self.ids, ""]])[:, None]
        self.words_that_tell = frozenset(df) - frozenset(COMMON)

    def hopeless(self, words: list[str]) -> bool:
        return len(self.words_that_tell.intersection(words)) < 2

    def cosine(self, ids: np.ndarray) -> tuple[float, int]:
        """The best template of one passage, with two telling words of it at least."""
        known, counts = np.unique(ids[ids < len(self.ids)], return_counts=True)
        square = ((counts * self.idf[known]) ** 2).sum()
        if len(ids) > counts.sum():
            own = Counter(self.words[i] for i in self.at[ids == len(self.ids)])
            square += sum(c * c for c in own.values()) * self.idf[-1] ** 2
        sums = (counts[:, None] * self.products[known]).sum(axis=0)
        sums[self.telling[known].sum(axis=0) < 2] = 0
        top = int(np.argmax(sums))
        return (float(sums[top] / math.sqrt(square)), top) if square else (0.0, top)

    def part(self, words: list[str], starts: np.ndarray, whole: bool, found: tuple[float, int]) -> tuple[float, int]:
        """The best of `found` and the passages of these words; lines begin at `starts`."""
        n, unknown = len(words), len(self.ids)
        ids = np.fromiter((self.ids.get(w, unknown) for w in words), np.int64, n)
        dots, squares = np.zeros((n + 1, len(self.names))), np.zeros(n + 1)
        np.cumsum(self.products[ids], axis=0, out=dots[1:])
        np.cumsum(self.idf[ids] ** 2, out=squares[1:])
        spans = []  # (bounds, begins, ends)

        def add(begin, end, ks):
            bound = ((dots[end][:, ks] - dots[begin][:, ks]) / np.sqrt(np.maximum(squares[end] - squares[begin], 1e-12))[:, None]).max(axis=1)
            fine = (bound >= self.least - 1e-9) & (end > begin)
            spans.append((bound[fine], begin[fine], end[fine]))

        for size in {length * f // 4 for length in self.lengths for f in (4, 5)}:
            if size <= n:
                add(np.arange(n - size + 1), np.arange(size, n + 1), [k for k, length in enumerate(self.lengths) if size in (length, length * 5 // 4)])
        edges = np.append(starts, n)
        for j in range(1, FOLLOWING + 2):
            if j < len(edges):
                add(edges[:-j], edges[j:], slice(None))
            elif len(edges) > 1:
                add(edges[:1], edges[-1:], slice(None))
        if whole:
            add(np.array([0]), np.array([n]), slice(None))
        bound, begin, end = (np.concatenate(x) for x in zip(*spans))
        self.words, seen = words, {}
        for i in np.argsort(-bound, kind="stable"):
            if bound[i] <= found[0] + 1e-9:
                break
            passage = tuple(words[begin[i] : end[i]])
            if passage not in seen:
                self.at = np.arange(begin[i], end[i])
                seen[passage] = self.cosine(ids[begin[i] : end[i]])
                found = max(found, seen[passage], key=lambda f: (f[0], -f[1]))
        return found

    def scan(self, text: str, whole: bool) -> tuple[float, str]:
        words, starts = [], []
        for line in text.lower().split("\n"):
            own = TOKEN.findall(line)
            if own:
                starts.append(len(words))
                words += own
        if self.hopeless(words):
            return 0.0, ""
        found, starts = (0.0, 0), np.array(starts)
        if whole and len(words) > PART:
            found = self.part(words, starts, True, found)
        else:
            for at in range(0, len(words), PART):
                own = words[at : at + PART + self.reach]
                if not self.hopeless(own):
                    found = self.part(own, starts[(starts >= at) & (starts < at + len(own))] - at, whole, found)
        return found[0], self.names[found[1]]


def scan(files: DataFrame, path: Column, text: str = "text", least: float = 0.6, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Add license, license_score, license_from (own, inherited or null) and license_dir; they replace columns of these names.

    `text` itself is left out of the result: nothing but the scan needs it. Other columns stay, whatever their names.
    """
    new = ["license", "license_score", "license_from", "license_dir"]
    stay = [c for c in files.columns if c not in (*new, text)]
    # The given columns lie in a struct, so that no name clashes.
    carried = F.struct(*(F.col(c) for c in stay)) if stay else F.lit(None).cast("string")
    rows = files.select(carried.alias("own"), path.alias("__path"), F.col(text).alias("text")).withColumn("__file", F.coalesce(F.col("__path").rlike(FILE_NAME), F.lit(False)))
    kept = [f for f in rows.schema.fields if f.name != "text"]
    names = [f.name for f in kept]

    def run(batches):
        known = Templates(templates, least)
        for batch in batches:
            for part in slices(batch):
                found = [known.scan(t or "", w) for t, w in zip(part.column("text").to_pylist(), part.column("__file").to_pylist())]
                own = [s >= least for s, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in names), pa.array([n if o else None for (_, n), o in zip(found, own)], pa.string()), pa.array([s if o else None for (s, _), o in zip(found, own)], pa.float64())],
                    names=[*names, "__license", "__score"],
                )

    seen = rows.mapInArrow(run, T.StructType([*kept, T.StructField("__license", T.StringType()), T.StructField("__score", T.DoubleType())]))
    folder = F.regexp_replace("__path", "/?[^/]*$", "")
    best = F.min(F.struct((-F.col("__score")).alias("s"), F.col("__license").alias("l"), F.col("__path").alias("p"))).alias("b")
    given = seen.where("__file and __license is not null").groupBy(folder.alias("__dir")).agg(best)
    # Nearest directory with a licence file, found once for each distinct directory.
    dirs = seen.where("__path is not null and __license is null").select(folder.alias("__own")).distinct()
    steps = F.split("__own", "/")
    up = dirs.select("__own", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(steps, 1, k), "/").alias("d")))).alias("u"))
    near = up.join(given, F.col("u.d") == F.col("__dir")).groupBy("__own").agg(F.max(F.struct("u.k", "__dir", "b")).alias("near"))
    # One directory may hold most files: the few directories that inherit go to the files, not the files to them.
    near = materialise(near, "near")
    size = near.agg(F.sum(F.octet_length("__own") + F.octet_length("near.__dir") + F.octet_length("near.b.p") + 64)).first()[0] or 0
    near = F.broadcast(near) if size <= BROADCAST_BYTES else near
    out = seen.withColumn("__own", F.when(F.col("__license").isNull(), folder)).join(near, "__own", "left")
    return out.select(
        *(F.col("own")[c].alias(c) for c in stay),
        F.coalesce("__license", F.col("near.b.l")).alias("license"),
        F.coalesce("__score", -F.col("near.b.s")).alias("license_score"),
        F.when(F.col("__license").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").alias("license_from"),
        F.when(F.col("__license").isNull(), F.col("near.__dir")).alias("license_dir"),
    )
