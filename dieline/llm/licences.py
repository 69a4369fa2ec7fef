"""Licences of files by sparse TF-IDF cosine to templates, inherited from the nearest ancestor directory."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, bounded

_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
#: "Version 2", "v2.0" and "v. 2.0" are one word; a name's own number ("BSD 3-Clause", "CC0 1.0") stays a word.
_VERSION = re.compile(r"\b(?:versions?|v\.?)\s*(\d+(?:\.\d+)?)\b")

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN
AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source
code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written
permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY,
OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source
code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software")
to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"""
_APACHE = """you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License."""
_GNU_END = "{what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."


def _gnu(name: str, version: str, what: str, spdx: str, later: bool) -> list[str]:
    """The usual statements of a licence of this family."""
    head = f"{what} is free software: you can redistribute it and/or modify it under the terms of the {name}"
    dated = f"{head} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."
    return [
        f"This work is licensed under the {name}, version {version}.", f"{head} version {version}", dated, f"{dated} {_GNU_END.format(what=what)}",
        f"{head} as published by the Free Software Foundation; version {version} of the License", f"{name} Version {version}", f"Licensed under the {name} v{version}",
        f"SPDX-License-Identifier: {spdx}-only", *([f"SPDX-License-Identifier: {spdx}-or-later"] if later else []), f"SPDX-License-Identifier: {spdx}",
    ]


#: Names of licences and the public statements that announce them: headers, notices, and whole texts where these are short.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0", "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        f"Licensed under the Apache License, Version 2.0 (the License); {_APACHE}",
    ],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License", "SPDX-License-Identifier: MIT", _MIT[:_MIT.index(" (the")], _MIT],
    "GPL-3.0": _gnu("GNU General Public License", "3", "This program", "GPL-3.0", True),
    "GPL-2.0": _gnu("GNU General Public License", "2", "This program", "GPL-2.0", True),
    "LGPL-3.0": _gnu("GNU Lesser General Public License", "3", "This library", "LGPL-3.0", True),
    "LGPL-2.1": _gnu("GNU Lesser General Public License", "2.1", "This library", "LGPL-2.1", True),
    "AGPL-3.0": _gnu("GNU Affero General Public License", "3", "This program", "AGPL-3.0", True),
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the conditions are met",
        "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", f"{_BSD_TWO} {_BSD_NAME}", f"{_BSD_TWO} {_BSD_NAME} {_BSD_END}",
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause", _BSD_TWO, f"{_BSD_TWO} {_BSD_END}"],
    "ISC": ["Released under the ISC License.", "SPDX-License-Identifier: ISC", _ISC[:_ISC.index(" THE SOFTWARE")], _ISC],
    "Zlib": ["Released under the zlib License.", "SPDX-License-Identifier: Zlib", _ZLIB],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0", _BOOST],
    "Unlicense": ["Released into the public domain under the Unlicense.", "SPDX-License-Identifier: Unlicense", _UNLICENSE],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0", "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0", "SPDX-License-Identifier: EPL-2.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"],
}
#: Statements that count only where no licence is found, as licence headers have them too.
NOTICES = {"All-Rights-Reserved": ["All rights reserved."]}
#: File names that hold the licence of their directory.
LICENCE_FILES = r"(?i)^(licen[cs]e|copying|unlicense|notice)([._-][^/]*)?$"


def words(text: str) -> list[str]:
    return _WORD.findall(_VERSION.sub(lambda m: f" version-{m.group(1).removesuffix('.0')} ", text.lower()))


def weight(cosine: float, n: int) -> float:
    """What a match counts: of templates that match about as well, the longer one is the better evidence."""
    return cosine**3 * math.log(2 + n)


def _tables(idf: dict[str, float], rare: float, templates: dict[str, list[str]]):
    """Normalised sparse vectors of the templates, as word -> [(template, weight)], and names."""
    names, index = [], {}
    for name, statements in templates.items():
        for text in statements:
            v = {w: (1 + math.log(n)) * idf.get(w, rare) for w, n in Counter(words(text)).items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            for w, x in v.items():
                index.setdefault(w, []).append((len(names), x / norm))
            names.append(name)
    return names, index


def best_match(text: str, idf: dict[str, float], rare: float, names: list[str], index: dict) -> tuple[str | None, float, int]:
    """The template with the largest cosine to a passage, and the passage's number of words."""
    v = Counter(words(text))
    dot: dict[int, float] = {}
    square = 0.0
    for w, n in v.items():
        x = (1 + math.log(n)) * idf.get(w, rare)
        square += x * x
        for k, y in index.get(w, ()):
            dot[k] = dot.get(k, 0.0) + x * y
    if not dot:
        return None, 0.0, 0
    k = min(dot, key=lambda k: (-dot[k], k))
    return names[k], dot[k] / math.sqrt(square), sum(v.values())


def _passages(text: str) -> Iterator[str]:
    """Each line, and each sentence of a line that has several."""
    for line in text.split("\n"):
        yield line
        parts = re.split(r"(?<=[.;:!?])\s+", line)
        if len(parts) > 1:
            yield from parts


def _needed(v: dict[str, float], least: float) -> set[str]:
    """Words of a normalised vector without all of which no passage reaches the threshold."""
    left = 0.0
    order = sorted(v, key=lambda w: (v[w], w))
    for k, w in enumerate(order):
        left += v[w] ** 2
        if left >= least**2 - 1e-9:  # the words up to here, without this one, stay below it
            return set(order[k:])
    return set(order)


def _statements(idf: dict[str, float], rare: float, templates: dict[str, list[str]], least: float) -> list[tuple]:
    """Name, number of words, normalised vector and needed words of each statement."""
    names, index = _tables(idf, rare, templates)
    vectors: list[dict[str, float]] = [{} for _ in names]
    for w, found in index.items():
        for k, x in found:
            vectors[k][w] = x
    sizes = [len(words(t)) for v in templates.values() for t in v]
    return [(name, n, v, _needed(v, least)) for name, n, v in zip(names, sizes, vectors, strict=True)]


def best_window(seq: list[str], idf: dict[str, float], rare: float, statements: list[tuple], least: float) -> tuple[str | None, float, int]:
    """The statement that matches best with as many consecutive words, over the ends of lines and sentences."""
    best: tuple[str | None, float, int] = (None, 0.0, 0)
    present = set(seq)
    for name, size, vector, needed in statements:
        # the cosine is at most the norm of the shared part
        if sum(vector[w] ** 2 for w in vector.keys() & present) < least**2 - 1e-9:
            continue
        last, done = max(0, len(seq) - size), -1
        for at in (i for i, w in enumerate(seq) if w in needed):
            for k in range(max(done + 1, at - size + 1), min(at, last) + 1):
                window = seq[k : k + size]
                if sum(vector[w] ** 2 for w in vector.keys() & set(window)) < least**2 - 1e-9:
                    continue
                v = {w: (1 + math.log(n)) * idf.get(w, rare) for w, n in Counter(window).items()}
                score = sum(x * vector.get(w, 0.0) for w, x in v.items()) / math.sqrt(sum(x * x for x in v.values()))
                if score >= least and weight(score, size) > weight(best[1], best[2]):
                    best = name, score, size
            done = max(done, min(at, last))
    return best


def _frequencies(vocabulary: set[str]):
    """The number of texts with each of these words, and under the empty word that of all texts."""

    def run(batches: Iterator[pa.RecordBatch]):
        counts: Counter = Counter()
        for b in batches:
            for text in b.column(0):
                counts.update(vocabulary.intersection(words(text.as_py() or "")))
            counts[""] += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    return run


def _scan(state, least: float):
    def run(batches: Iterator[pa.RecordBatch]):
        idf, rare, names, index, keys, statements, notices = state.value
        for b in batches:
            for k in range(0, b.num_rows, 512):
                licence, score = [], []
                for text in b.column(1).slice(k, 512):
                    best: tuple[str | None, float, int] = (None, 0.0, 0)
                    closest = 0.0
                    whole = text.as_py() or ""
                    seq = words(whole)
                    for part in () if keys.isdisjoint(seq) else _passages(whole):
                        if not keys.isdisjoint(words(part)):
                            found = best_match(part, idf, rare, names, index)
                            closest = max(closest, found[1])
                            if found[1] >= least and weight(*found[1:]) > weight(*best[1:]):
                                best = found
                    for of in (statements, notices):
                        found = best_window(seq, idf, rare, of, least) if of is statements or best[0] is None else best
                        best = found if weight(*found[1:]) > weight(*best[1:]) else best
                    licence.append(best[0])
                    score.append(best[1] if best[0] else closest)
                columns = [b.column(0).slice(k, 512), pa.array(licence, pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays([*columns, b.column(2).slice(k, 512)], ["doc_id", "own", "similarity", "path"])

    return run


def licence_scan(
    docs: DataFrame,
    scratch: Scratch,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str = "path",
    least: float = 0.75,
    templates: dict[str, list[str]] | None = None,
    notices: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Find each file's licence: its own, or that of the nearest ancestor directory that has one.

    Every line and sentence of every text is a passage. Its TF-IDF vector is compared with those of
    the templates' statements, which are headers, notices and whole short licences; document frequencies of their words come from all texts, and any other word
    weighs as much as the rarest. A version with its number is one word. Each statement is compared with every run of as many words of the text as well,
    so it is found over the ends of lines, inside longer sentences, and as a whole file. Of matches with a cosine of at least `least`, weight() decides:
    the longer of about equally good ones, so that a whole text counts more than a sentence that several licences share. A notice counts where no licence is found. A passage that shares none of the templates' rarer words with
    them can't reach the threshold and isn't compared. A licence file (by its name) that has a licence
    gives it to its directory, of several the first by path; a file without a licence of its own takes the
    one of its nearest ancestor directory, found by joining the prefixes of its path.

    Cases: a null or empty text has no licence of its own; long ones are read whole. Equal weights go to the first template. A null path has no directory. Null or repeated ids pass
    through. Other columns are ignored. An empty table gives an empty result.

    Returns doc_id, licence, origin (own, inherited or null), from_path, similarity.
    """
    if notices is None:
        notices = NOTICES if templates is None else {}
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    plain = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(path_col).cast("string").alias("path")
    )
    vocabulary = sorted({w for v in [*templates.values(), *notices.values()] for t in v for w in words(t)})
    seen = plain.select("text").mapInArrow(_frequencies(set(vocabulary)), "word string, n bigint")
    df = dict(seen.groupBy("word").agg(F.sum("n")).collect())  # a row for each of the templates' words
    n = df.pop("", 0)
    idf = {w: math.log((n + 1) / (d + 1)) + 1 for w in vocabulary for d in [df.get(w, 0)]}
    rare = math.log(n + 1) + 1
    names, index = _tables(idf, rare, templates)
    statements, marks = (_statements(idf, rare, t, least) for t in (templates, notices))
    needed = {w for *_, v in statements for w in v}
    state = spark.sparkContext.broadcast((idf, rare, names, index, needed, statements, marks))
    found = plain.mapInArrow(_scan(state, least), "doc_id bigint, own string, similarity double, path string")
    found = scratch.save(found, "found")
    found = found.withColumn("folder", F.regexp_replace("path", "[^/]*$", ""))

    files = found.filter(F.regexp_extract("path", "([^/]*)$", 1).rlike(LICENCE_FILES) & F.col("own").isNotNull())
    files = files.groupBy("folder").agg(F.min(F.struct("path", "own")).alias("f")).select("folder", F.col("f.own").alias("theirs"), F.col("f.path").alias("from_path"))
    # one row for each ancestor of each distinct folder without a licence of its own
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    above = F.transform(above, lambda p: F.when(p == "", F.lit("")).otherwise(F.concat(p, F.lit("/"))))
    folders = found.filter("own IS NULL AND folder IS NOT NULL").select("folder").distinct()
    steps = folders.select(F.col("folder").alias("at"), F.explode(F.array_distinct(F.concat(F.array("folder"), above))).alias("folder"))
    nearest = steps.join(files, "folder").groupBy("at").agg(F.max_by(F.struct("theirs", "from_path"), F.length("folder")).alias("near"))
    # a folder may hold any share of the files: its row goes to them, or, if there are too many folders, a written table lets the join split it
    nearest = bounded(scratch.save(nearest.select(F.col("at").alias("folder"), "near"), "nearest"))
    out = found.join(nearest, "folder", "left")
    own = F.col("own").isNotNull()
    return out.select(
        "doc_id",
        F.coalesce("own", "near.theirs").alias("licence"),
        F.when(own, F.lit("own")).when(F.col("near").isNotNull(), F.lit("inherited")).alias("origin"),
        F.when(own, F.col("path")).otherwise(F.col("near.from_path")).alias("from_path"),
        F.round("similarity", 6).alias("similarity"),
    )
