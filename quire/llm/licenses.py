"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory above."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import bounded_batches, byte_hashes, chunked, stored, utf8_rows

THRESHOLD = 0.75
FILE_NAMES = ("license", "licence", "copying", "notice", "unlicense")
# What notices, standard headers and short licence files say, by SPDX identifier.
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
    "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, "
    "this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution."
)
_BSD_THREE = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
)
_BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR '
    "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
    "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_MIT_KEEP = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, '
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
    "THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
    "See the License for the specific language governing permissions and limitations under the License.",
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
)
TEMPLATES = {
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "MIT License", _MIT, f"MIT License Copyright {_MIT} {_MIT_KEEP} {_AS_IS}"),
    "ISC": ("Released under the ISC License.", "ISC License", _ISC, f"ISC License Copyright {_ISC} {_ISC_AS_IS}"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", *_APACHE),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": (
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MPL-2.0": (
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "BSD-2-Clause": ("BSD 2-Clause License", f"BSD 2-Clause License Copyright All rights reserved. {_BSD_TWO} {_BSD_AS_IS}"),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted", "BSD 3-Clause License", _BSD_THREE,
        f"BSD 3-Clause License Copyright All rights reserved. {_BSD_TWO} {_BSD_THREE} {_BSD_AS_IS}",
    ),
    "Unlicense": (*_UNLICENSE, " ".join(_UNLICENSE)),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Creative Commons Attribution 4.0 International Public License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    "CC0-1.0": ("Released under CC0 1.0 into the public domain.", "CC0 1.0 Universal", "Creative Commons Legal Code CC0 1.0 Universal"),
    "LicenseRef-proprietary": ("All rights reserved.",),
}
# Other names of the same in SPDX tags.
SPDX_NAMES = {name: (f"{name}-only", f"{name}-or-later", f"{name}+") for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")}
_COMMON = ("the", "of", "to", "and", "in", "is", "or", "for", "this", "with", "by", "any", "a", "are", "into", "all", "that", "as", "an", "be", "on", "not", "may", "it", "its", "you", "can", "at", "if", "no", "from", "use", "under")
_WORD = re.compile(rb"[a-z0-9][a-z0-9.+-]*[a-z0-9]|[a-z0-9]")
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[list(b".+-")] = 1
_KIND[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = 2


def template_texts() -> list[tuple[str, str]]:
    """(license, text), by licence: the templates, and an SPDX tag for each name of each."""
    tags = {name: tuple(f"SPDX-License-Identifier: {x}" for x in (name, *SPDX_NAMES.get(name, ()))) for name in TEMPLATES}
    return sorted((name, text) for name, texts in TEMPLATES.items() for text in (*texts, *tags[name]))


@dataclass
class Vectors:
    """The templates as unit vectors. The idf is that among the templates, so a score doesn't move with the corpus."""

    licenses: list[str]  # of each template
    terms: list[bytes]
    idf: np.ndarray  # of each term, and last of all words that no template has
    weights: np.ndarray  # [term][template]

    @classmethod
    def of_templates(cls) -> Vectors:
        texts = template_texts()
        tf = [Counter(_WORD.findall(t.lower().encode())) for _, t in texts]
        seen = Counter(term for x in tf for term in x)
        terms = sorted(seen)
        idf = np.array([math.log((len(texts) + 1) / (seen.get(t, 0) + 1)) + 1 for t in [*terms, b""]])
        weights = np.array([[x[t] for x in tf] for t in terms]) * idf[:-1, None]
        return cls([name for name, _ in texts], terms, idf, weights / np.sqrt((weights**2).sum(axis=0)))

    def anchors(self, threshold: float) -> np.ndarray:
        """Whether a term is one of those of which a text must have one to reach the threshold: by Cauchy-Schwarz the squared
        weights of the terms that it shares with a template sum to threshold squared at least, and the others don't."""
        mass, out = np.zeros(len(self.licenses)), np.ones(len(self.terms), dtype=bool)
        for term in _COMMON:
            at = self.terms.index(term.encode()) if term.encode() in self.terms else -1
            if at >= 0 and (mass + self.weights[at] ** 2 < threshold**2).all():
                mass += self.weights[at] ** 2
                out[at] = False
        return out


def _words(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of every word of a chunk of texts its hash, its text, its line and its block of lines. Lines and blocks are numbered
    through the chunk; a line without words parts two blocks."""
    buffer = b"\n".join(texts).lower()
    data = np.frombuffer(buffer, dtype=np.uint8)
    kind = _KIND[data]
    edge = np.diff((kind > 0).astype(np.int8), prepend=0, append=0)
    begin, end, alone = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0), np.flatnonzero(kind == 2)
    first, last = np.searchsorted(alone, begin), np.searchsorted(alone, end)
    some = last > first
    begin, end = alone[first[some]], alone[last[some] - 1] + 1
    breaks = (data == 10) | ((data == 13) & (np.append(data[1:], 0) != 10))
    starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])[:-1])).astype(np.int64)
    row, line = np.searchsorted(starts, begin, side="right") - 1, np.cumsum(breaks)[begin] if len(begin) else begin
    block = np.cumsum((np.diff(line, prepend=-1) > 1) | (np.diff(row, prepend=-1) > 0)) - 1 if len(line) else line
    return byte_hashes(data).hash(begin, end), row, line, block


class Scanner:
    """Finds the template most like a part of each text."""

    def __init__(self, threshold: float):
        self.threshold, self.vectors = threshold, Vectors.of_templates()
        data = np.frombuffer(b"\n".join(self.vectors.terms), dtype=np.uint8)
        ends = np.cumsum([len(t) + 1 for t in self.vectors.terms]) - 1
        h = byte_hashes(data).hash(np.concatenate(([0], ends[:-1] + 1)), ends)
        self.order = np.argsort(h)
        self.hashes = h[self.order]
        self.is_anchor = self.vectors.anchors(threshold)

    def _best(self, unit: np.ndarray, code: np.ndarray, term: np.ndarray, of_row: np.ndarray, best: dict[int, tuple[float, str]]) -> None:
        """Compare the units of words (ascending) that have an anchor, and keep the best of each text."""
        anchored = np.zeros(int(unit[-1]) + 1, dtype=bool)
        anchored[unit[(term >= 0) & self.is_anchor[term]]] = True
        at = np.flatnonzero(anchored[unit])
        if not len(at):
            return
        at = at[np.lexsort((code[at], unit[at]))]
        opens = np.flatnonzero(np.concatenate(([True], (unit[at[1:]] != unit[at[:-1]]) | (code[at[1:]] != code[at[:-1]]))))
        tf = np.diff(np.concatenate((opens, [len(at)])))
        at = at[opens]
        weight = tf * self.vectors.idf[term[at]]  # term -1: the last idf
        units, place = np.unique(unit[at], return_inverse=True)
        norm = np.sqrt(np.bincount(place, weight**2))
        known = np.flatnonzero(term[at] >= 0)
        dot = np.zeros((len(units), len(self.vectors.licenses)))
        for i in range(0, len(known), 1 << 14):  # bounds the memory
            part = known[i : i + (1 << 14)]
            heads = np.flatnonzero(np.diff(place[part], prepend=-1))
            dot[place[part[heads]]] += np.add.reduceat(weight[part, None] * self.vectors.weights[term[at[part]]], heads)
        scores = np.round(dot / norm[:, None], 9)
        likest = scores.argmax(axis=1)  # the first of equals, in order of the identifiers
        top = scores[np.arange(len(units)), likest]
        rows = of_row[at[np.concatenate(([True], place[1:] != place[:-1]))]]
        for i in np.flatnonzero(top >= self.threshold).tolist():
            found = (-float(top[i]), self.vectors.licenses[int(likest[i])])
            best[int(rows[i])] = min(best.get(int(rows[i]), found), found)

    def scan(self, texts: list[bytes]) -> list[tuple[str, float] | None]:
        """The licence of each text and its score: the best of its lines, of its blocks of lines and of the whole text."""
        code, row, line, block = _words(texts)
        best: dict[int, tuple[float, str]] = {}
        if len(code):
            at = np.minimum(np.searchsorted(self.hashes, code), len(self.hashes) - 1)
            term = np.where(self.hashes[at] == code, self.order[at], -1)
            for unit in (line, block, row):
                self._best(unit, code, term, row, best)
        return [(best[i][1], -best[i][0]) if i in best else None for i in range(len(texts))]


def own_licenses(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(text_key, own_license, own_score) of files(text_key, text) that are like a template; see scan."""
    bounded_batches(files.sparkSession)

    def run(text: pa.Array) -> pa.Array:
        scanner, texts = Scanner(threshold), utf8_rows(text)
        found = [x for i, j in chunked(texts) for x in scanner.scan(texts[i:j])]
        return pa.array([None if x is None else {"own_license": x[0], "own_score": x[1]} for x in found], pa.struct([("own_license", pa.string()), ("own_score", pa.float64())]))

    likest = F.arrow_udf(run, "struct<own_license:string,own_score:double>")
    found = files.select("text_key", likest(F.col("text")).alias("own")).where("own is not null").groupBy("text_key").agg(F.min("own").alias("own"))
    return found.select("text_key", "own.own_license", "own.own_score")


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """files(path, text, ...) plus own_license, own_score, license and from_path.

    A file's own licence is the template most like one of its lines, one of its blocks (lines with words that follow each
    other) or the whole file, by the cosine of TF-IDF vectors, if that is `threshold` or more; a tie goes to the first
    identifier. Everything is compared; words that no template has count with the largest idf. A file without one takes
    that of the nearest directory at or above its own with a licence file: a file of one of FILE_NAMES, whatever its
    extension and letter case, with an own licence. If a directory has several, the first path counts.

    Null texts have no lines. A file of null path is compared, but inherits nothing. Repeated rows give repeated
    results. Other columns pass through, whatever their names; own columns of the four names are replaced.
    """
    kept = [c for c in files.columns if c not in ("own_license", "own_score", "license", "from_path")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    directory = F.regexp_extract(F.concat(F.lit("/"), F.ltrim("path", F.lit("/"))), r"^(.*)/", 1)
    own = stored(own_licenses(files.select(F.xxhash64(text).alias("text_key"), text.alias("text")), threshold), "own-licences")
    keyed = files.select(F.struct(*kept).alias("file"), F.col("path").cast("string").alias("at"), F.xxhash64(text).alias("text_key"), directory.alias("dir"))
    named = keyed.join(own, "text_key", "left")
    of_file = named.where("own_license is not null").where(F.lower("at").rlike(rf"(^|/)({'|'.join(FILE_NAMES)})([.][^/]*)?$"))
    dirs = stored(of_file.groupBy(F.col("dir").alias("above")).agg(F.min(F.struct("at", "own_license")).alias("near")), "licence-directories")
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    found = keyed.select("dir").where("dir is not null").distinct().select("dir", F.explode(above).alias("above")).join(dirs, "above")
    nearest = stored(found.groupBy("dir").agg(F.max_by("near", F.length("above")).alias("near")), "nearest-licences")
    alone = F.col("own_license").isNotNull()
    return named.join(nearest, "dir", "left").select(
        "file.*", "own_license", "own_score", F.coalesce("own_license", "near.own_license").alias("license"), F.when(alone, F.col("at")).otherwise(F.col("near.at")).alias("from_path")
    )
