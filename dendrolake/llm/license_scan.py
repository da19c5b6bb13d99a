"""License scans by patience alignment.

Texts and templates are lower-cased words without punctuation. Template and text are aligned by anchors:
words that occur once in both, of which the longest increasing subsequence is kept; the gaps between anchors
are aligned in the same way, where other words may now be unique. Coverage is the part of the template's
words that are aligned within one window of the text; a template is found where it reaches MIN_COVERAGE.

A template can only reach it in stretches of the text that hold as many of its words, so a text is cut into
stretches around the template's rarer words before it is aligned; stretches without enough of the
template's words are passed over, which loses nothing. Every stretch of a text is aligned, so a license that
is repeated is found each time. Near relatives differ in few words (a version, `NC`, a clause): where two templates reach it at
one place, each must have half of the words there that the other hasn't, so a third relative is neither. A notice, which
names its license, must have all words that do, without one that makes another of it; in long texts no single word, as the number
of a list, decides. Versions are the same with and without `.0`.

Result: one row per license found: doc_id, license, start and n_words (in words of the text), coverage,
passage. Defined results: null and empty texts find nothing; a null doc_id is kept as null; repeated rows are
scanned each; of licenses that overlap, and hold against each other, the one with more aligned words, then the higher coverage, then the
first in TEMPLATES stays; a very long text is scanned whole by one task; an empty table gives no rows. Only doc_id
and text are read, so other columns may have any names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import text_or_empty

MIN_COVERAGE = 0.8
STRETCH = 1.5  # a found license covers at most so many times the template's words

# Public license notices and license texts, whole but for titles, copyright lines and appendices.
_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
    "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_END = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
    "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GPL = (
    "This program is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by "
    "the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in "
    "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
    "PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details. You should have received a copy of the GNU {kind}General Public License "
    "along with this program. If not, see https://www.gnu.org/licenses/."
)
_CC = "This work is licensed under a Creative Commons Attribution{kind} 4.0 International License."
_CC_KINDS = {"BY": "", "BY-SA": "-ShareAlike", "BY-NC": "-NonCommercial", "BY-ND": "-NoDerivatives", "BY-NC-SA": "-NonCommercial-ShareAlike", "BY-NC-ND": "-NonCommercial-NoDerivatives"}
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause-notice": "Released under the BSD 3-Clause License.",
    "BSD-2-Clause-notice": "Released under the BSD 2-Clause License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    **{f"CC-{k}-4.0-notice": f"Licensed under CC {k} 4.0." for k in _CC_KINDS},
    **{f"CC-{k}-4.0-long-notice": _CC.format(kind=kind) for k, kind in _CC_KINDS.items()},
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. " + _AS_IS
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies. " + _ISC_END
    ),
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_END,
    "BSD-2-Clause": _BSD_START + _BSD_END,
    "BSD-3-Clause": _BSD_START + _BSD_NAMES + _BSD_END,
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You "
        "may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-2.0-or-later": _GPL.format(colon=";", kind="", version="2"),
    "GPL-3.0-or-later": _GPL.format(colon=":", kind="", version="3"),
    "LGPL-2.1-or-later": _GPL.format(colon=";", kind="Lesser ", version="2.1"),
    "LGPL-3.0-or-later": _GPL.format(colon=":", kind="Lesser ", version="3"),
    "AGPL-3.0-or-later": _GPL.format(colon=":", kind="Affero ", version="3"),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must "
        "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
        "software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions "
        "that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
        "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an "
        "overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _AS_IS
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by "
        "this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the "
        "Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software "
        "and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the "
        "Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of "
        "machine-executable object code generated by a source language processor."
    ),
}
#: Identifiers of licenses, as files name them in one line.
SPDX = ("MIT", "MIT-0", "ISC", "0BSD", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "MPL-2.0", "Zlib", "BSL-1.0", "CC0-1.0", "Unlicense")
TEMPLATES |= {f"{x}-spdx": f"SPDX-License-Identifier: {x}" for x in SPDX} | {"Apache-2.0-name": "Apache License 2.0", "Apache-2.0-short": "Apache-2.0 license"}
NOTICE = 60  # words of a template up to which it is a notice: it names its license, and must do so
#: Words by which a notice names its license; all of a notice's own must be aligned.
TELLING = {"1", "2", "2.1", "3", "4", "nc", "sa", "nd", "sharealike", "noncommercial", "noderivatives", "lesser", "affero", "clause", "mit", "apache", "bsd", "gnu", "cc", "mozilla"}
#: Words that make another license of the one that is named.
MODIFIERS = {"nc", "sa", "nd", "sharealike", "noncommercial", "noderivatives", "lesser", "affero"}

_TOKEN = re.compile(r"[^\W_]+(?:\.\d+)*")


def plain(word: str) -> str:
    """Lower case; version 3.0 is 3."""
    return word.lower().removesuffix(".0") if word[0].isdigit() else word.lower()


def words_of(text: str) -> list[str]:
    return [plain(w) for w in _TOKEN.findall(text)]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned index pairs of a and b: common ends, unique words in increasing order, then the gaps."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        where: dict = {}
        for side, (words, lo, hi) in enumerate(((a, a0, a1), (b, b0, b1))):
            for i in range(lo, hi):
                where.setdefault(words[i], ([], []))[side].append(i)
        both = sorted((x[0][0], x[1][0]) for x in where.values() if len(x[0]) == 1 and len(x[1]) == 1)
        # longest increasing subsequence of the places in b
        tails, ends, back = [], [], [-1] * len(both)
        for k, (_, j) in enumerate(both):
            at = bisect_left(tails, j)
            tails[at:at + 1], ends[at:at + 1] = [j], [k]
            back[k] = ends[at - 1] if at else -1
        k, anchors = ends[-1] if ends else -1, []
        while k >= 0:
            anchors.append(both[k])
            k = back[k]
        if not anchors:
            continue
        anchors.reverse()
        out += anchors
        ai, bi = a0, b0
        for i, j in [*anchors, (a1, b1)]:
            todo.append((ai, i, bi, j))
            ai, bi = i + 1, j + 1
    return sorted(out)


@lru_cache(8)
def _compiled(items: tuple) -> list:
    return [(name, words_of(text), frozenset(words_of(text))) for name, text in items]


def _stretches(places: list[int], need: int, span: int) -> list[tuple[int, int]]:
    """Unions of the windows of `span` words that hold at least `need` of the places."""
    out: list[list[int]] = []
    for k in range(len(places) - need + 1):
        lo, hi = places[k], places[k + need - 1]
        if hi - lo < span:
            lo, hi = hi - span + 1, lo + span
            if out and lo <= out[-1][1]:
                out[-1][1] = hi
            else:
                out.append([lo, hi])
    return [tuple(x) for x in out]


def _told(template: list[str], words: list[str], lo: int, pairs: list[tuple[int, int]]) -> bool:
    """Whether a notice's telling words are all aligned, and no word between them makes another license of it."""
    if len(template) > NOTICE:
        return True
    aligned = {i for i, _ in pairs}
    if any(w in TELLING and i not in aligned for i, w in enumerate(template)):
        return False
    places, own = {lo + j for _, j in pairs}, set(template)
    return not any(words[i] in MODIFIERS and words[i] not in own and i not in places for i in range(lo + pairs[0][1], lo + pairs[-1][1] + 1))


@lru_cache(4096)
def _apart(a: tuple, b: tuple) -> frozenset:
    """The places of a's words that b doesn't have."""
    return frozenset(range(len(a))) - {i for i, _ in patience(list(a), list(b))}


def _stands(mine: tuple, others: list[tuple]) -> bool:
    """Whether a find isn't rather one of the relatives found at its place: of the words that it has and the relative hasn't, half are there."""
    _, x, y, template, aligned = mine
    for _, a, b, other, _ in others:
        if other != template and a < y and x < b:
            own = _apart(template, other)
            if own and 2 * len(own & aligned) < len(own):
                return False
    return True


def scan(text: str, templates: dict[str, str] = TEMPLATES, min_coverage: float = MIN_COVERAGE) -> list[tuple[str, int, int, float, str]]:
    """(license, start, n_words, coverage, passage) of every license found in the text, in order."""
    from math import ceil

    spans = [m.span() for m in _TOKEN.finditer(text)]
    words = [plain(text[x:y]) for x, y in spans]
    index: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        index.setdefault(w, []).append(i)
    found = []
    for order, (name, template, known) in enumerate(_compiled(tuple(templates.items()))):
        need = ceil(min_coverage * len(template) - 1e-9)
        places = sorted(i for w in known if w in index for i in index[w])
        if len(places) < need:
            continue
        span = int(STRETCH * len(template))
        todo = [(max(0, lo), min(len(words), hi)) for lo, hi in _stretches(places, need, span)]
        while todo:
            lo, hi = todo.pop()
            pairs = patience(template, words[lo:hi])
            # the densest run of aligned words within the span
            best, k = (0, 0, 0), 0
            for j in range(len(pairs)):
                while pairs[j][1] - pairs[k][1] >= span:
                    k += 1
                best = max(best, (j - k + 1, -k, -j))
            n, k, j = best[0], -best[1], -best[2]
            if n >= need:
                x, y = lo + pairs[k][1], lo + pairs[j][1] + 1
                if _told(template, words, lo, pairs[k: j + 1]):
                    found.append(((n, n / len(template), -order, name), x, y, tuple(template), frozenset(i for i, _ in pairs[k: j + 1])))
                todo += [(lo, x), (y, hi)]
            elif hi - lo > span:  # repeated words hide anchors: align overlapping windows one by one
                todo += [(at, at + span) for at in range(lo, hi - span, max(1, (span - len(template)) // 2))] + [(hi - span, hi)]
    taken: list[tuple[int, int]] = []
    out = []
    for (n, coverage, _, name), x, y, _, _ in sorted((f for f in found if _stands(f, found)), key=lambda f: f[:3], reverse=True):
        if all(y <= a or b <= x for a, b in taken):
            taken.append((x, y))
            out.append((name, x, y - x, coverage, text[spans[x][0]: spans[y - 1][1]]))
    return sorted(out, key=lambda r: r[1])


def gate(templates: dict[str, str], min_coverage: float) -> set[str]:
    """Words of which any text with a license holds one: of each template so many of its longest words that
    a text without them misses more of its words than the coverage allows."""
    from math import ceil

    out = set()
    for template in map(words_of, templates.values()):
        spare = len(template) - ceil(min_coverage * len(template) - 1e-9)
        for word in sorted(set(template), key=lambda w: (-len(w), w)):
            if spare < 0:
                break
            out.add(word)
            spare -= template.count(word)
    return out


FOUND = "doc_id long, license string, start int, n_words int, coverage double, passage string"


def license_matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row per license found in docs."""

    def run(batches):
        import pyarrow as pa

        import ahocorasick

        some = ahocorasick.Automaton()
        for word in gate(templates, min_coverage):
            some.add_word(word, word)
        some.make_automaton()
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string()]
        names = ["doc_id", "license", "start", "n_words", "coverage", "passage"]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if next(some.iter(text.lower()), None):
                    rows += [(doc_id, *x) for x in scan(text, templates, min_coverage)]
            if rows:
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, FOUND)
