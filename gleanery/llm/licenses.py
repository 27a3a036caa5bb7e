"""License scans by conditional compression.

Candidate blocks are whole wordings, and runs of whole sentences around license words, however long. A block is compressed
once alone and once with each template as zstandard raw dictionary; a template that describes the block makes it much
smaller. Templates are ranked by that reduction. Confirmed are only whole wordings, whole sentences of the text, that equal
a template's line word by word but for the slots it declares; all else is reported unconfirmed, with the words that differ
from the wording it is nearest to.

One pass over whole texts, no shuffle; a filter in the JVM leaves out texts without a license word. Templates are a
parameter and fixed in number.
"""

from __future__ import annotations

import pkgutil
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import missing


def _file(name: str) -> str:
    """A whole text on one line, and, where a guide to its use follows, a second line without that."""
    text = " ".join((pkgutil.get_data("gleanery.llm", f"license_texts/{name}.txt") or b"").decode().split())
    head, end, guide = text.partition("END OF TERMS AND CONDITIONS")
    return f"\n{text}\n{head}{end}\n{head}" if guide.strip() else f"\n{text}"


_BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: {{mark}} Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. {{mark}} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY {{provider}} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {{holder}} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Each line is one whole wording, a public notice or a whole license text. {{mark}} is a place for a list mark,
#: any other name in such brackets one for a name of a few words.
TEMPLATES = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0.
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
    + _file("Apache-2.0"),
    "MIT": """Released under the MIT License.
Licensed under the MIT License.
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "GPL-3.0": """This work is licensed under the GNU General Public License, version 3.
This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
    + _file("GPL-3.0"),
    "GPL-2.0": """This work is licensed under the GNU General Public License, version 2.
This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
    + _file("GPL-2.0"),
    "LGPL-3.0": """This work is licensed under the GNU Lesser General Public License, version 3.
This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
    + _file("LGPL-3.0"),
    "LGPL-2.1": """This work is licensed under the GNU Lesser General Public License, version 2.1.
This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"""
    + _file("LGPL-2.1"),
    "AGPL-3.0": """This work is licensed under the GNU Affero General Public License, version 3.
This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "EPL-2.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/
Licensed under the Eclipse Public License, version 2.0.""",
    "BSL-1.0": """Distributed under the Boost Software License, Version 1.0.
Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Zlib": """Licensed under the zlib License.
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: {{mark}} The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. {{mark}} Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. {{mark}} This notice may not be removed or altered from any source distribution.""",
    "BSD-3-Clause": f"""Licensed under the BSD 3-Clause License.
{_BSD_CONDITIONS} {{{{mark}}}} Neither the name of {{{{holder}}}} nor the names of {{{{holder}}}} contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_DISCLAIMER}""",
    "BSD-2-Clause": f"""Licensed under the BSD 2-Clause License.
{_BSD_CONDITIONS} {_BSD_DISCLAIMER}""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
    + _file("MPL-2.0"),
    "ISC": """Licensed under the ISC License.
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND {{holder}} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {{holder}} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "CC-BY-NC-4.0": """Licensed under CC BY-NC 4.0.
This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.""",
    "CC-BY-4.0": """Licensed under CC BY 4.0.
This work is licensed under a Creative Commons Attribution 4.0 International License.""",
    "CC-BY-SA-4.0": """Licensed under CC BY-SA 4.0.
This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.""",
    "CC0-1.0": """Licensed under CC0 1.0.
To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.
To the extent possible under law, {{holder}} has waived all copyright and related or neighboring rights to this work."""
    + _file("CC0-1.0"),
    "Unlicense": """This is free and unencumbered software released into the public domain.
This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to {{scheme}} unlicense.org""",
}
#: What a text without any license word lacks, for the JVM: the words of HINT without their borders.
CUES = r"(?iu)licen[sc]|copyright|permission is|redistribut|warrant|public domain|creative commons|spdx|cc0?[ -]by|mpl"
HINT = re.compile(r"(?i)licen[sc]|copyright|permission is|redistribut|warrant|public domain|creative commons|spdx|\bcc0?[ -]by\b|\bmpl\b")
WORD = re.compile(r"[0-9a-z]+(?:[.-][0-9a-z]+)*")
#: Characters between two license words of one run at most; of a run that goes on to blank lines at least, and how far it goes.
GAP, TEXT, MARGIN = 300, 200, 1_500
BLANK = re.compile(r"\n[^\S\n]*\n")
#: Bytes of judged blocks that a worker remembers.
MEMO_BYTES = 16 << 20
#: Words that anchor two wordings to each other, if both have them once.
ANCHOR = 3
SLOT = re.compile(r"\{\{(\w+)\}\}")
MARK = re.compile(r"\d{1,2}|[a-z]|i{1,3}")
#: Words of a name in a slot at most, and words that a wording is looked up by.
NAME, FIRST = 12, 3
TOKEN = re.compile(r"[0-9A-Za-z]+(?:[.-][0-9A-Za-z]+)*")
#: Where a sentence ends: at its mark, at a blank line, or where the next line does not go on in small letters.
BREAK = re.compile(r"[.!?:;](?=\s|$)|\n(?=[^\w\n]*(?:[A-Z0-9]|\n|$))")


def blocks(text: str, sure: list[tuple[int, int]] = ()) -> Iterator[tuple[int, int]]:
    """Spans of runs of sentences with a license word, outside the spans that are sure.

    Sentences go over line ends. A run goes over GAP characters without such a word, and one of TEXT characters or more on
    to blank lines, at most MARGIN characters away.
    """
    at = 0
    for a, b in [*sure, (len(text), len(text))]:
        last = None
        for s, e in _runs(text, at, a):
            if e - s >= TEXT:
                before = [m.end() for m in BLANK.finditer(text, max(at, s - MARGIN), s)]
                after = BLANK.search(text, e, min(a, e + MARGIN))
                s, e = before[-1] if before else max(at, s - MARGIN), after.start() if after else min(a, e + MARGIN)
            if last and s <= last[1]:
                last = last[0], max(e, last[1])
                continue
            if last:
                yield last
            last = s, e
        if last:
            yield last
        at = b


def _runs(text: str, at: int, end: int) -> Iterator[tuple[int, int]]:
    """Runs of sentences with a license word between two places, without white space at their ends."""
    run = None
    for stop in [*(m.end() for m in BREAK.finditer(text, at, end)), end]:
        part = text[at:stop]
        if HINT.search(part):
            s, e = at + len(part) - len(part.lstrip()), at + len(part.rstrip())
            if run and s - run[1] > GAP:
                yield run
                run = None
            run = (run[0], e) if run else (s, e)
        at = stop
    if run:
        yield run


class Wording:
    """One whole wording: words that must be equal, with slots between them that a license lets vary."""

    def __init__(self, text: str):
        parts = SLOT.split(text)
        self.fixed = [WORD.findall(t.lower()) for t in parts[::2]]
        self.marks = [name == "mark" for name in parts[1::2]]
        self.words = [w for p in self.fixed for w in p]

    def end(self, words: list[str], at: int) -> tuple[int, list[str]] | None:
        """Where the wording that starts at a word ends, and the words in its slots; None if any other word differs."""
        filled: list[str] = []
        for k, part in enumerate(self.fixed):
            if k:
                for n in range(2 if self.marks[k - 1] else NAME + 1):
                    if words[at + n : at + n + len(part)] == part and (not self.marks[k - 1] or all(MARK.fullmatch(w) for w in words[at : at + n])):
                        break
                else:
                    return None
                filled += words[at : at + n]
                at += n
            elif words[at : at + len(part)] != part:
                return None
            at += len(part)
        return at, filled


_OPEN, _MARKS, _REST = frozenset(" \t*#/;-<>\"'(["), frozenset(" \t*#/;-"), re.compile(r"[^\w\n.!?:;]*")


def _back(text: str, at: int, over: frozenset[str]) -> int:
    while at and text[at - 1] in over:
        at -= 1
    return at


def _apart(text: str, start: int, end: int) -> bool:
    """Whether a span is whole sentences, with no word of its first or last sentence outside it."""
    at = _back(text, start, _OPEN)
    if at and text[at - 1] not in ".!?:;":
        if text[at - 1] != "\n":
            return False
        line = _back(text, at - 1, _MARKS)
        if text[start].islower() and line and text[line - 1] not in "\n.!?:;":
            return False
    upto = _REST.match(text, end).end()
    return upto == len(text) or BREAK.match(text, upto) is not None


def aligned(words: list[str], template: list[str]) -> tuple[int, list[str]]:
    """How many words two wordings share in order, nearly, and the words that differ in the part that both cover.

    Runs of ANCHOR words that each side has once anchor one to the other, the longest rising chain of these counts; between
    two anchors words are compared as multisets. Work grows with the lengths, not with their product.
    """

    def once(w: list[str]) -> dict[tuple[str, ...], int]:
        out: dict[tuple[str, ...], int] = {}
        for i in range(len(w) - ANCHOR + 1):
            key = tuple(w[i : i + ANCHOR])
            out[key] = -1 if key in out else i
        return out

    other = once(template)
    spots = [(i, j) for key, i in once(words).items() if i >= 0 and (j := other.get(key, -1)) >= 0]
    tails: list[int] = []  # places in template that chains of each length end at
    at: list[int] = []
    before = [-1] * len(spots)
    for k, (_, j) in enumerate(spots):
        n = bisect_left(tails, j)
        before[k] = at[n - 1] if n else -1
        tails[n:], at[n:] = [j, *tails[n + 1 :]], [k, *at[n + 1 :]]
    chain = []
    k = at[-1] if at else -1
    while k >= 0:
        chain.append(spots[k])
        k = before[k]
    chain.reverse()
    if not chain:
        both = Counter(words) & Counter(template)
        return both.total() if len(template) < 2 * ANCHOR else 0, words
    share, differ = 0, []
    i, j = 0, max(0, chain[0][1] - chain[0][0])
    for x, y in [*chain, (len(words), min(len(template), chain[-1][1] + len(words) - chain[-1][0]))]:
        a, b = Counter(words[i:x]), Counter(template[j:y])  # empty where anchors overlap
        share += (a & b).total()
        differ += [*(a - b).elements(), *(b - a).elements()]
        end = min(x + ANCHOR, len(words)), min(y + ANCHOR, len(template))
        share += max(0, end[0] - max(i, x))
        i, j = max(i, end[0]), max(j, end[1])
    return min(share, len(words), len(template)), differ


class Scanner:
    def __init__(self, templates: dict[str, str]):
        import zstandard

        self.names = list(templates)
        self.plain = zstandard.ZstdCompressor(level=3)
        self.given = []
        for t in templates.values():
            plain = "\n".join(" ".join(WORD.findall(line)) for line in SLOT.sub(" ", t.lower()).split("\n"))
            d = zstandard.ZstdCompressionDict(plain.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=3)
            self.given.append(zstandard.ZstdCompressor(level=3, dict_data=d))
        self.lines = [[w for line in t.split("\n") if (w := Wording(line)).fixed[0]] for t in templates.values()]
        self.first: dict[tuple[str, ...], list[tuple[int, Wording]]] = {}
        for i, wording in sorted(((i, w) for i, ws in enumerate(self.lines) for w in ws), key=lambda x: -len(x[1].words)):
            self.first.setdefault(tuple(wording.fixed[0][:FIRST]), []).append((i, wording))
        self.short = sorted({len(k) for k in self.first}, reverse=True)
        self.memo: dict[str, tuple] = {}
        self.held = 0

    def __call__(self, block: str) -> tuple[str | None, float, float, list[str]]:
        """Name or None, size reduction of the best template, equal words as a share of the longer of block and wording, and the words that differ."""
        key = " ".join(WORD.findall(block.lower()))
        if (known := self.memo.get(key)) is not None:
            return known
        out = self._judge(key)
        self.held += len(key) + 500
        if self.held <= MEMO_BYTES:
            self.memo[key] = out
        return out

    def exact(self, text: str) -> Iterator[tuple[int, int, str, float, list[str]]]:
        """Whole wordings in a text, from left to right: start, end, name, size reduction, words in slots."""
        spots = [m.span() for m in TOKEN.finditer(text)]
        words = [text[a:b].lower() for a, b in spots]
        at = 0
        while at < len(words):
            found = None
            for n in self.short:
                for i, wording in self.first.get(tuple(words[at : at + n]), ()):
                    got = wording.end(words, at)
                    if got and _apart(text, spots[at][0], spots[got[0] - 1][1]) and (found is None or got[0] > found[0]):
                        found = (*got, i)
            if found is None:
                at += 1
                continue
            upto, filled, i = found
            raw = " ".join(words[at:upto]).encode()
            alone = len(self.plain.compress(raw))
            end = spots[upto - 1][1]
            yield spots[at][0], end + (text[end : end + 1] in (".", "!")), self.names[i], (alone - len(self.given[i].compress(raw))) / alone, filled
            at = upto

    def _judge(self, key: str) -> tuple[str | None, float, float, list[str]]:
        raw, words = key.encode(), key.split()
        if not words:
            return None, 0.0, 0.0, []
        alone = len(self.plain.compress(raw))
        saved = [(alone - len(c.compress(raw))) / alone for c in self.given]
        rank = sorted(range(len(saved)), key=lambda i: (-saved[i], self.names[i]))
        # the wording that explains most of the block, then the one that the block has most of, then the size reduction
        best: tuple[int, float, float] = (-1, 0.0, 0.0)
        name, differing = rank[0], words
        for i in rank:
            for line in self.lines[i]:
                if min(len(words), len(line.words)) < best[0]:
                    continue  # cannot explain more
                same, differ = aligned(words, line.words)
                now = (same, same / max(len(words), len(line.words)), saved[i])
                if now > best:
                    best, name, differing = now, i, differ
        return self.names[name], best[2], best[1], differing


def found(text: str, scanner: Scanner) -> list[tuple[int, int, str | None, float, float, list[str], bool]]:
    """Candidates of one text: start, end, license, saved, equal, differing, and whether it is a whole wording."""
    if not HINT.search(text):
        return []
    sure = [*scanner.exact(text)]
    out = [(a, b, name, gain, 1.0, filled, True) for a, b, name, gain, filled in sure]
    return out + [(a, b, *scanner(text[a:b]), False) for a, b in blocks(text, [x[:2] for x in sure])]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, saved: float = 0.3, least: float = 0.9) -> DataFrame:
    """One row for each candidate block: doc_id, start, end (code points), license, saved, equal, differing, confirmed.

    saved is the size reduction by the best template, equal the share of words that are equal or in a slot; a candidate is
    confirmed if it is a whole wording and they reach `saved` and `least`. differing holds, where it is one, the words in its
    slots. license names the best template, also where it was not confirmed. What follows a whole wording is not judged with it. Null and
    empty texts have no candidates; rows that repeat give theirs again; a null id stays null; other columns are ignored.
    """
    missing(docs, ("doc_id", "text"))
    texts = dict(TEMPLATES if templates is None else templates)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("saved", pa.float64()), ("equal", pa.float64()), ("differing", pa.list_(pa.string())), ("exact", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(texts)
        for batch in batches:
            out = [(doc_id.as_py(), *x) for doc_id, text in zip(batch.column(0), batch.column(1), strict=True) for x in found(text.as_py(), scanner)]
            cols = list(zip(*out, strict=True)) if out else [[]] * len(schema)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    out = rows.filter(F.col("text").rlike(CUES)).mapInArrow(run, "doc_id long, start long, end long, license string, saved double, equal double, differing array<string>, exact boolean")
    return out.withColumn("confirmed", F.col("exact") & (F.col("saved") >= saved) & (F.col("equal") >= least)).drop("exact")
