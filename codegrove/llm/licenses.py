"""License scan: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans.

Templates are cut into words; of the hashes of every K words the smallest of each WINDOW are kept, so that any run of
K + WINDOW - 1 matching words has a kept one, and a template shorter than that keeps all. The inverted index holds the
kept hashes' templates and places; it is as large as the templates, whatever the corpus. A document's hashes that are in
the index propose a template and a shift, a candidate. Each candidate is aligned word by word within a
band around its shift, again for hits that no match of that template covers, in the words between its matches. Matches
with coverage of LEAST or more are reported; of overlapping matches the one with more matched words, then with more coverage,
then the first template by name.

Edge cases: null, empty and wordless texts have no match; long texts are scanned whole; a document has one row for each
match, also of the same template; repeated rows are scanned each; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import prepare, table

K, WINDOW, BAND, LEAST = 3, 4, 6, 0.75

#: Wordings of well-known licenses and notices.
TEMPLATES = {
    "agpl-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it
will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
See the GNU Affero General Public License for more details.""",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND
ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to
endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY
WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it
will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
See the GNU General Public License for more details.""",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it
will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
See the GNU General Public License for more details.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies.""",
    "isc-whole": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "lgpl-2.1": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by
the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it
will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
See the GNU Lesser General Public License for more details.""",
    "mit-line": "Released under the MIT License.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "mit-whole": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

_WORD = re.compile(r"\w+")


def words(text: str) -> tuple[list[str], list[int], list[int]]:
    """Words in lower case, and where each begins and ends."""
    found = list(_WORD.finditer(text))
    return [m[0].lower() for m in found], [m.start() for m in found], [m.end() for m in found]


def grams(w: list[str]) -> list[int]:
    return [zlib.crc32(" ".join(w[i : i + K]).encode("utf-8", "replace")) for i in range(len(w) - K + 1)]


def winnow(hashes: list[int]) -> set[int]:
    """Places of the smallest hash of each window, the last one on ties; all places if there are fewer than two windows."""
    if len(hashes) <= WINDOW:
        return set(range(len(hashes)))
    return {max(range(i, i + WINDOW), key=lambda k: (-hashes[k], k)) for i in range(len(hashes) - WINDOW + 1)}


class Scanner:
    def __init__(self, templates: dict[str, str], least: float = LEAST):
        self.names, self.least = sorted(templates), least
        self.texts = [words(templates[n])[0] for n in self.names]
        self.index: dict[int, list[tuple[int, int]]] = {}
        self.first: set[str] = set()
        for t, w in enumerate(self.texts):
            if len(w) < K:
                raise ValueError(f"the template {self.names[t]} has fewer than {K} words")
            hashes = grams(w)
            for q in winnow(hashes):
                self.index.setdefault(hashes[q], []).append((t, q))
                self.first.add(w[q])

    def align(self, w: list[str], t: int, shift: int, low: int, high: int) -> tuple[int, int, int]:
        """Matched words of template t around a shift, in the document's words low to high, and those from and to between which they are."""
        text = self.texts[t]
        best: dict[int, tuple[int, int]] = {}  # of a document place: matched words and the first place matched, the later the better
        top = (0, -1, -1)
        for q, word in enumerate(text):
            row: dict[int, tuple[int, int]] = {}
            left = None
            for p in range(q + shift - BAND, q + shift + BAND + 1):
                if not low <= p < high:
                    continue
                here = max((x for x in (best.get(p), left) if x), default=None)
                if w[p] == word:
                    before = best.get(p - 1)
                    own = (before[0] + 1, before[1]) if before else (1, p)
                    here = max(here, own) if here else own
                    if own[0] > top[0]:
                        top = (own[0], own[1], p)
                if here:
                    row[p] = left = here
            best = row or best
        return top[0], top[1], top[2] + 1

    def __call__(self, text: str | None) -> list[tuple[str, int, int, int, float]]:
        """Matches: template, start, end (code points), matched words, coverage; in text order."""
        w, begin, end = words(text or "")
        shifts: dict[int, dict[int, list[int]]] = {}
        for p in [i for i, x in enumerate(w[: len(w) - K + 1]) if x in self.first] if len(w) >= K else []:
            for t, q in self.index.get(zlib.crc32(" ".join(w[p : p + K]).encode("utf-8", "replace")), ()):
                shifts.setdefault(t, {}).setdefault(p - q, []).append(p)
        found = []
        for t, at in shifts.items():
            taken, tried = bytearray(len(w)), set()  # words in this template's matches, which don't overlap
            for s in sorted(at):
                for p in at[s]:
                    while not taken[p]:
                        # the words around p that are in no match
                        low, high = taken.rfind(1, max(0, s - BAND), p) + 1, taken.find(1, p)
                        if (s, low, high) in tried:
                            break
                        tried.add((s, low, high))
                        n, a, b = self.align(w, t, s, low, high if high >= 0 else len(w))
                        if n < self.least * len(self.texts[t]):
                            break
                        taken[a:b] = b"\1" * (b - a)
                        found.append((-n, t, a, b))
        kept: list[tuple[int, int, int, int]] = []
        for n, t, a, b in sorted(found, key=lambda x: (x[0], len(self.texts[x[1]]), *x[1:])):
            if all(b <= x[2] or a >= x[3] for x in kept):
                kept.append((n, t, a, b))
        return [(self.names[t], begin[a], end[b - 1], -n, -n / len(self.texts[t])) for n, t, a, b in sorted(kept, key=lambda x: x[2])]


@lru_cache(4)
def _scanner(templates: tuple[tuple[str, str], ...], least: float) -> Scanner:
    return Scanner(dict(templates), least)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, *, least: float = LEAST) -> DataFrame:
    """doc_id, license, begin, end (code points), n_words (matched) and coverage of each match in whole texts."""
    prepare(docs.sparkSession)
    given = tuple(sorted(templates.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(given, least)
        for b in batches:
            rows = [(k, *m) for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in scanner(text)]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], ["doc_id", "license", "begin", "end", "n_words", "coverage"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, `begin` long, `end` long, n_words long, coverage double")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
